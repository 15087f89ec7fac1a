"""The driver-side face: artifact queries of one speaker as plain Python values, and ingestion.

Ingestion appends to a :class:`Store`: documents, their fingerprints, phrases,
comparisons, speakers and runs. Queries read what is stored and compute none of it anew. A table of
documents without analysis (``documents``) can be asked as well; its artifacts are computed per request.
Every answer collects frames that are bounded by their limits; the work is in the plans.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.operators import artifacts
from chronolex.operators.normalize import normalize_markdown
from chronolex.plans.corpus import Corpus, phrases_of
from chronolex.session import shared_dir
from chronolex.sources.readers import read_pages
from chronolex.sources.store import Store
from chronolex.streaming.incremental import ingest_documents


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [json.loads(x) for x in df.toJSON().collect()]


@dataclass
class _Artifacts:
    """One speaker's frames."""

    docs: DataFrame
    themes: DataFrame
    comparisons: Callable[[], DataFrame]
    phrases: Callable[[], DataFrame]


class TextService:
    """Queries over stored documents, and ingestion into the store.

    ``fetch`` gives a URL's HTML (the network lies behind it); without it URLs cannot be ingested.
    Without a ``store`` ingestion begins one of its own in the shared folder.
    """

    def __init__(self, spark: SparkSession, documents: DataFrame | None = None, fetch: Callable[[str], str] | None = None, store: Store | None = None):
        self.spark, self.documents, self.fetch = spark, documents, fetch
        self._store = store

    @property
    def store(self) -> Store:
        if self._store is None:
            self._store = Store(self.spark, f"{shared_dir(self.spark)}/chronolex/service-{uuid.uuid4().hex}")
        return self._store

    def _of(self, speaker: str) -> _Artifacts:
        if self.documents is not None:
            own = self.documents.filter(F.col("speaker_name") == speaker)
            c = Corpus.of(own)
            return _Artifacts(c.docs, c.themes, c.comparisons, lambda: phrases_of(own))
        stored = self.store.read("documents")
        if stored is None:
            raise LookupError("no documents")
        own = stored.filter(F.col("speaker_name") == speaker)
        heads = artifacts.latest_versions(self.store.read("fingerprints").withColumn("fingerprint_id", F.concat_ws("|", "prompt_version", "model_version")))
        docs = own.drop("normalized_text").join(heads.select("doc_id", "overall_tone"), "doc_id", "left")

        def of(table: str) -> DataFrame:
            return self.store.read(table).join(own.select("doc_id"), "doc_id", "left_semi")

        return _Artifacts(docs, of("theme_assessments"), lambda: of("comparison_results"), lambda: of("phrase_observations"))

    def speaker_timeline(self, speaker_name: str, limit: int = 10) -> dict[str, Any]:
        c = self._of(speaker_name)
        rows = _rows(artifacts.speaker_timeline(c.docs, c.themes, limit).orderBy("rn"))
        return {"speaker_name": speaker_name, "count": len(rows), "timeline": rows}

    def recent_comparisons(self, speaker_name: str, comparison_type: str | None = None, limit: int = 10) -> dict[str, Any]:
        c = self._of(speaker_name)
        rows = _rows(artifacts.recent_comparisons(c.comparisons(), comparison_type, limit).orderBy("rn"))
        return {"speaker_name": speaker_name, "count": len(rows), "comparisons": rows}

    def phrase_anomalies(self, speaker_name: str, limit: int = 20, min_rarity: float | None = None) -> dict[str, Any]:
        c = self._of(speaker_name)
        rows = _rows(artifacts.phrase_anomalies(c.phrases(), c.docs, limit, min_rarity).orderBy("rn"))
        return {"speaker_name": speaker_name, "count": len(rows), "phrase_anomalies": rows}

    def latest_document_snapshot(self, speaker_name: str) -> dict[str, Any]:
        c = self._of(speaker_name)
        rows = _rows(artifacts.latest_snapshot(c.docs, c.themes))
        return {"speaker_name": speaker_name, "document": rows[0] if rows else None}

    def orphaned_concepts(self, speaker_name: str, window_days: int = 75, min_emphasis: int = 3) -> dict[str, Any]:
        c = self._of(speaker_name)
        rows = _rows(artifacts.orphaned_concepts(c.docs, c.themes, window_days, min_emphasis).orderBy("rn"))
        return {"speaker_name": speaker_name, "window_days": window_days, "orphaned_concepts": rows}

    def theme_drift(self, speaker_name: str, theme: str | None = None, window_days: int = 730, limit: int = 20) -> dict[str, Any]:
        c = self._of(speaker_name)
        rows = _rows(artifacts.theme_drift(c.docs, c.themes, theme, window_days, limit).orderBy("rn"))
        return {"speaker_name": speaker_name, "window_days": window_days, "theme": theme, "theme_drift": rows}

    def _brief(self, speaker_name: str, theme: str | None) -> DataFrame:
        c = self._of(speaker_name)
        return artifacts.speaker_brief(c.docs, c.themes, c.comparisons(), c.phrases(), theme=theme)

    def speaker_brief(self, speaker_name: str, theme: str | None = None) -> dict[str, Any]:
        rows = _rows(self._brief(speaker_name, theme))
        return rows[0] if rows else {"speaker_name": speaker_name, "latest": None, "theme_focus": theme}

    def answer_question(self, speaker_name: str, question: str) -> dict[str, Any]:
        theme = self.spark.range(1).select(artifacts.infer_theme(F.lit(question)).alias("t")).first()["t"]
        said = artifacts.highlights(self._brief(speaker_name, theme)).first()
        return {"speaker_name": speaker_name, "question": question, "theme_focus": theme, "highlights": list(said["highlights"]) if said else []}

    # --- ingestion ---

    def _add(self, documents: DataFrame) -> list[dict[str, Any]]:
        """Store a request's documents; their keys and URLs."""
        if self.documents is not None:
            raise RuntimeError("a given table of documents is only read")
        kept = documents.persist()
        try:
            ingest_documents(self.store, kept)
            return [r.asDict() for r in kept.select("document_key", "source_url").collect()]
        finally:
            kept.unpersist()

    def ingest_url(self, url: str, skip_existing: bool = False) -> dict[str, Any]:
        return self.ingest_urls([url], skip_existing)["results"][0]

    def ingest_urls(self, urls: list[str], skip_existing: bool = True) -> dict[str, Any]:
        """All pages as one batch; of a URL given twice the first counts."""
        wanted = [u.strip() for u in urls if u.strip()]
        stored = self.store.read("source_documents") if skip_existing else None
        seen = {r["source_url"] for r in stored.filter(F.col("source_url").isin(wanted)).select("source_url").distinct().collect()} if stored is not None else set()
        fresh = [u for u in dict.fromkeys(wanted) if u not in seen]
        if fresh and self.fetch is None:
            raise RuntimeError("no fetcher is set")
        keys: dict[str, list[str]] = {}
        if fresh:
            pages = self.spark.createDataFrame([(u, self.fetch(u)) for u in fresh], "source_url string, raw_content string")
            for r in self._add(read_pages(pages, ("source_url",))):
                keys.setdefault(r["source_url"], []).append(r["document_key"])
        results, left = [], set(fresh)
        for u in wanted:
            new = u in left
            left.discard(u) if skip_existing else None
            results.append({"url": u, "skipped": False, "document_keys": keys.get(u, [])} if new else {"url": u, "skipped": True, "reason": "already_ingested"})
        skipped = sum(1 for r in results if r["skipped"])
        return {"count": len(results), "ingested": len(results) - skipped, "skipped": skipped, "results": results}

    def ingest_markdown(self, markdown_text: str, metadata: dict[str, str] | None = None) -> dict[str, Any]:
        text = self.spark.createDataFrame([(markdown_text, metadata or {})], "markdown_text string, metadata map<string,string>")
        return {"document_keys": [r["document_key"] for r in self._add(normalize_markdown(text))]}

    def ingest_markdown_file(self, path: str, metadata: dict[str, str] | None = None) -> dict[str, Any]:
        with open(path, encoding="utf-8") as f:
            return self.ingest_markdown(f.read(), {"source_type": "markdown_file", "source_path": path} | (metadata or {}))

    def run_manifest(self, manifest: dict[str, Any]) -> dict[str, Any]:
        results: list[dict[str, Any]] = []
        if manifest.get("urls"):
            results.append({"type": "urls", "result": self.ingest_urls(manifest["urls"], manifest.get("skip_existing", True))})
        for item in manifest.get("markdown_files", []):
            results.append({"type": "markdown_file", "path": item["path"], "result": self.ingest_markdown_file(item["path"], item.get("metadata"))})
        return {"count": len(results), "results": results}
