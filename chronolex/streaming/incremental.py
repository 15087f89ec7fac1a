"""Incremental ingestion: new files of pages become stored documents with their analysis, each micro-batch once.

Stateless by design: what was seen is the stored table itself, so a lost
executor or a restart repeats a batch and the idempotent appends drop what was
written before. History as of arrival: the documents of a batch are compared with the
stored documents of their speakers and with one another, by speech date; a
document that arrives later with an earlier date changes no stored row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from chronolex.functions.ontology import DEFAULT, Ontology
from chronolex.functions.text import slug
from chronolex.operators.compare import comparison_results, merged_notes
from chronolex.operators.fingerprint import headers, theme_assessments
from chronolex.operators.normalize import segments
from chronolex.operators.phrases import phrase_signals
from chronolex.plans.materialize import materialize
from chronolex.sources.readers import read_pages
from chronolex.sources.store import Store, skip_existing

PAGES = "id long, source_url string, raw_content string, fetched_at timestamp"
PROMPT_VERSION, MODEL_VERSION = "v2", "heuristic-v1"
_ASSESSED = ["doc_id", "theme", "stance", "trajectory", "emphasis_score", "hedging_level", "uncertainty", "evidence"]
_ABOUT = ["doc_id", "document_key", "speaker_name", "speech_date", "created_at", "normalized_text"]


def _with_stored(stored: DataFrame | None, fresh: DataFrame, columns: list[str], history: DataFrame | None) -> DataFrame:
    """The batch's rows and the stored ones of the history's documents."""
    rows = fresh.select(*columns)
    return rows if stored is None or history is None else rows.unionByName(stored.select(*columns).join(history.select("doc_id"), "doc_id", "left_semi"))


def _run_key() -> Column:
    return F.concat(F.lit("run_"), F.substring(F.sha1(F.concat_ws("|", "document_key", F.lit(PROMPT_VERSION), F.lit(MODEL_VERSION))), 1, 12)).alias("run_key")


def analyze_batch(store: Store, fresh: DataFrame, ontology: Ontology = DEFAULT) -> None:
    """Store speakers, runs, fingerprints, phrases and comparisons of new documents, as of what is stored."""
    now = F.current_timestamp().alias("created_at")
    versions = [F.lit(PROMPT_VERSION).alias("prompt_version"), F.lit(MODEL_VERSION).alias("model_version")]
    about = fresh.select("doc_id", "document_key", "speaker_name", slug(F.col("speaker_name")).alias("speaker_key"))
    stored = store.read("documents")
    named = fresh.select("speaker_name").filter("speaker_name is not null").distinct()
    history = None if stored is None else stored.select(*_ABOUT).join(named, "speaker_name", "left_semi")
    all_docs = fresh.select(*_ABOUT) if history is None else fresh.select(*_ABOUT).unionByName(history.select(*_ABOUT))

    themes = materialize(theme_assessments(fresh, keep=("doc_id", "document_key"), ontology=ontology), "batch-themes")
    heads = materialize(headers(fresh, themes.select("doc_id", "theme"), ontology=ontology), "batch-headers")
    signals = phrase_signals(all_docs, ontology=ontology).join(about.select("doc_id"), "doc_id", "left_semi")
    signals = materialize(signals, "batch-phrases")
    all_themes = _with_stored(store.read("theme_assessments"), themes, _ASSESSED, history)
    notes = _with_stored(store.read("fingerprints"), heads, ["doc_id", "uncertainty_notes"], history)

    store.append("speakers", about.filter("speaker_name is not null").select("speaker_key", F.col("speaker_name").alias("name"), now), ["name"])
    listed = themes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("theme", "stance", "trajectory", "emphasis_score", "hedging_level", "confidence", "uncertainty"))).alias("themes"))
    output = F.to_json(F.struct("overall_tone", "uncertainty_notes", "themes")).alias("parsed_output")
    runs = fresh.select("doc_id", "document_key", "source_hash").join(heads, "doc_id").join(listed, "doc_id", "left")
    kind = [F.lit("fingerprint_extraction").alias("analysis_type"), F.lit("document").alias("target_type"), F.col("document_key").alias("target_id")]
    store.append("analysis_runs", runs.select(_run_key(), *kind, *versions, F.col("source_hash").alias("input_hash"), F.lit(None).cast("string").alias("raw_output"), output, now))
    store.append("theme_assessments", themes.select("*", *versions))
    store.append("fingerprints", heads.join(fresh.select("doc_id", "document_key", "created_at"), "doc_id").select("*", *versions), ["doc_id"])
    store.append("phrase_observations", signals.join(about.drop("speaker_name"), "doc_id").select("*", F.array("phrase_text").alias("examples"), now), ["rank"])

    mine, theirs = (notes.select(F.col("doc_id").alias(k), F.col("uncertainty_notes").alias(n)) for k, n in (("doc_id", "mine"), ("base_doc_id", "theirs")))
    rows = comparison_results(all_docs, all_themes, signals).join(about, "doc_id").join(mine, "doc_id").join(theirs, "base_doc_id", "left")
    noted = merged_notes(F.col("mine"), F.col("theirs")).alias("uncertainty_notes")
    store.append("comparison_results", rows.select(*[c for c in rows.columns if c not in ("mine", "theirs")], noted, now), ["doc_id"])


#: Columns of stored documents, whatever they came from.
_DOCUMENT = ("document_key", "source_url", "source", "source_type", "content_type", "title", "speaker_name", "speech_date", "document_type", "normalized_text", "source_hash", "word_count")


def ingest_documents(store: Store, documents: DataFrame, ontology: Ontology = DEFAULT) -> None:
    """Analyze and store normalized documents; what is stored already is left as it is."""
    rows = documents.select(*_DOCUMENT, F.current_timestamp().alias("created_at"))
    sources = store.new_rows("source_documents", rows, ["source_url"]).persist()
    fresh = store.new_rows("documents", sources.withColumn("doc_id", F.xxhash64("document_key")), ["source_url"]).persist()
    try:
        analyze_batch(store, fresh, ontology)
        store.append("document_segments", segments(fresh, "document_key"), ["text"])
        # after its analysis: a document that is stored counts as analyzed and as history
        store.append("documents", fresh, ["source_url"])
        # last: a source that is stored counts as done, so a batch cut short is done again
        store.append("source_documents", sources.select("source_hash", "source_url", "content_type", "source_type", "created_at"), ["source_url"])
    finally:
        fresh.unpersist()
        sources.unpersist()


def ingest_pages(store: Store, pages: DataFrame, skip_seen: bool = True, ontology: Ontology = DEFAULT) -> None:
    """Normalize, analyze and store the pages of one batch."""
    stored = store.read("source_documents")
    if skip_seen and stored is not None:
        pages = skip_existing(pages, stored).filter("not skipped").drop("skipped")
    ingest_documents(store, read_pages(pages, ("source_url",)), ontology)


def stream_pages(spark: SparkSession, folder: str, store: Store, checkpoint: str, max_files: int = 100, form: str = "json") -> StreamingQuery:
    """Process all files that arrived (then stop); run it again for later ones."""
    source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", max_files).format(form).load(folder).filter("raw_content is not null")

    def each(batch: DataFrame, _number: int) -> None:
        ingest_pages(store, batch)

    return source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
