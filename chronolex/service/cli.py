"""Command line: artifact queries, ingestion of files, and the HTTP server.

    python -m chronolex.service.cli --documents TABLE timeline "Name" --limit 5
"""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from typing import Any

from chronolex.service.contract import success


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="chronolex")
    top.add_argument("--documents", help="parquet table of documents, or with --store the folder of a store")
    top.add_argument("--store", action="store_true", help="ask, and ingest into, the store in the folder")
    commands = top.add_subparsers(dest="command", required=True)
    for name, extra in {
        "timeline": {"--limit": (int, 10)}, "comparisons": {"--comparison-type": (str, None), "--limit": (int, 10)}, "phrases": {"--limit": (int, 20), "--min-rarity": (float, None)},
        "latest": {}, "orphaned": {"--window-days": (int, 75), "--min-emphasis": (int, 3)}, "drift": {"--theme": (str, None), "--window-days": (int, 730), "--limit": (int, 20)}, "brief": {"--theme": (str, None)},
    }.items():
        sub = commands.add_parser(name)
        sub.add_argument("speaker_name")
        for flag, (kind, default) in extra.items():
            sub.add_argument(flag, type=kind, default=default)
    question = commands.add_parser("question")
    question.add_argument("speaker_name")
    question.add_argument("question")
    manifest = commands.add_parser("ingest")
    manifest.add_argument("manifest")
    job = commands.add_parser("schedule", help="one ingestion run, as a scheduler calls it")
    what = job.add_mutually_exclusive_group(required=True)
    what.add_argument("--urls-file")
    what.add_argument("--manifest")
    job.add_argument("--no-skip-existing", action="store_true")
    server = commands.add_parser("serve")
    server.add_argument("--host", default="127.0.0.1")
    server.add_argument("--port", type=int, default=8000)
    return top


_METHODS = {
    "timeline": "speaker_timeline", "comparisons": "recent_comparisons", "phrases": "phrase_anomalies", "latest": "latest_document_snapshot", "orphaned": "orphaned_concepts",
    "drift": "theme_drift", "brief": "speaker_brief", "question": "answer_question",
}


def run(argv: list[str], make_service: Callable[..., Any]) -> dict[str, Any]:
    """The envelope of a command."""
    args = vars(parser().parse_args(argv))
    where, stored = args.pop("documents"), args.pop("store")
    command, service = args.pop("command"), make_service(where, stored) if stored else make_service(where)
    if command == "serve":
        from chronolex.service.http import serve

        serve(service, args["host"], args["port"])
        return success(None, command, "cli")
    if command == "schedule" and args["urls_file"]:
        with open(args["urls_file"], encoding="utf-8") as f:
            urls = [u for u in (line.strip() for line in f) if u and not u.startswith("#")]
        return success(service.ingest_urls(urls, skip_existing=not args["no_skip_existing"]), command, "cli")
    if command in ("ingest", "schedule"):
        with open(args["manifest"], encoding="utf-8") as f:
            return success(service.run_manifest(json.load(f)), command, "cli")
    return success(getattr(service, _METHODS[command])(**args), command, "cli")


def main() -> None:  # pragma: no cover
    import sys

    from chronolex.service.facade import TextService
    from chronolex.session import local_session
    from chronolex.sources.store import Store

    spark = local_session()

    def make(where: str | None, stored: bool = False) -> TextService:
        return TextService(spark, store=Store(spark, where)) if stored else TextService(spark, spark.read.parquet(where) if where else None)

    print(json.dumps(run(sys.argv[1:], make), indent=2, default=str))


if __name__ == "__main__":  # pragma: no cover
    main()
