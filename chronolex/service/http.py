"""HTTP requests to service calls. ``dispatch`` is a plain function, so tests need no server."""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import Any
from urllib.parse import parse_qs, urlparse

from chronolex.service.contract import ROUTES, error, openapi, success

_READ = {"string": str, "integer": int, "number": float, "boolean": bool, "array": list, "object": dict}

#: operation: how the service is called with the request's values
_CALLS = {
    "health": lambda s, v: {"ok": True},
    "speaker_brief": lambda s, v: s.speaker_brief(v["speaker_name"], theme=v["theme"]),
    "speaker_timeline": lambda s, v: s.speaker_timeline(v["speaker_name"], limit=v["limit"]),
    "speaker_comparisons": lambda s, v: s.recent_comparisons(v["speaker_name"], comparison_type=v["comparison_type"], limit=v["limit"]),
    "speaker_orphaned": lambda s, v: s.orphaned_concepts(v["speaker_name"], window_days=v["window_days"], min_emphasis=v["min_emphasis"]),
    "speaker_drift": lambda s, v: s.theme_drift(v["speaker_name"], theme=v["theme"], window_days=v["window_days"], limit=v["limit"]),
    "speaker_phrases": lambda s, v: s.phrase_anomalies(v["speaker_name"], limit=v["limit"], min_rarity=v["min_rarity"]),
    "speaker_latest": lambda s, v: s.latest_document_snapshot(v["speaker_name"]),
    "speaker_question": lambda s, v: s.answer_question(v["speaker_name"], v["question"]),
    "ingest_url": lambda s, v: s.ingest_url(v["url"], skip_existing=v["skip_existing"]),
    "ingest_urls": lambda s, v: s.ingest_urls(v["urls"], skip_existing=v["skip_existing"]),
    "ingest_markdown": lambda s, v: s.ingest_markdown(v["markdown_text"], metadata=v["metadata"]),
}


def dispatch(service: Any, method: str, path: str, body: bytes | None = None) -> tuple[int, dict[str, Any]]:
    """Status and payload of a request."""
    url = urlparse(path)
    route = ROUTES.get(url.path)
    if route is None or route[0] != method.lower():
        return 404, error("not found", "unknown", "http", 404)
    _, operation, parameters = route
    if operation == "openapi_json":
        return 200, openapi()
    sent: dict[str, Any] = json.loads(body.decode()) if body else {}
    if method == "GET":
        sent = {k: v[0] for k, v in parse_qs(url.query).items()}
    missing = [n for n, (_, needed, _d) in parameters.items() if needed and not sent.get(n)]
    if missing:
        needed = [n for n, (_, needed, _d) in parameters.items() if needed]
        return 400, error(" and ".join(needed) + (" is required" if len(needed) == 1 else " are required"), operation, "http", 400)
    values = {n: _READ[kind](sent[n]) if sent.get(n) is not None else default for n, (kind, _, default) in parameters.items()}
    return 200, success(_CALLS[operation](service, values), operation, "http")


def handler(service: Any) -> type[BaseHTTPRequestHandler]:
    class Handler(BaseHTTPRequestHandler):
        def _answer(self) -> None:
            size = int(self.headers.get("Content-Length", 0))
            try:
                status, payload = dispatch(service, self.command, self.path, self.rfile.read(size) if size else None)
            except Exception as e:  # the server's boundary
                status, payload = 500, error(type(e).__name__, "internal_error", "http", 500, str(e))
            raw = json.dumps(payload, default=str).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(raw)))
            self.end_headers()
            self.wfile.write(raw)

        do_GET = do_POST = _answer

        def log_message(self, *_args: object) -> None:
            pass

    return Handler


def serve(service: Any, host: str = "127.0.0.1", port: int = 8000) -> None:
    with ThreadingHTTPServer((host, port), handler(service)) as server:
        server.serve_forever()
