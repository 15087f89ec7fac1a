"""Stored tables: parquet folders that grow by idempotent appends.

An append keeps what is new by key: repeats within the batch go first (one row
per key), then an anti join against the stored keys. The anti join
reads the key columns only, and of tables partitioned by a column that a key fixes
(``partition_by``) only the partitions that the batch has.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronolex.functions.text import slug
from chronolex.operators.artifacts import latest_versions
from chronolex.sources import sites

COMPARISON_TYPES = ("t_minus_1", "window_75d", "window_24m")

#: Table: the columns that make a row unique.
KEYS: dict[str, list[str]] = {
    "speakers": ["speaker_key"],
    "source_documents": ["source_hash"],
    "documents": ["document_key"],
    "document_segments": ["document_key", "segment_index"],
    "analysis_runs": ["run_key"],
    "fingerprints": ["document_key", "prompt_version", "model_version"],
    "theme_assessments": ["document_key", "prompt_version", "model_version", "theme"],
    "phrase_observations": ["document_key", "phrase_text"],
    "comparison_results": ["comparison_key"],
}


@dataclass
class Store:
    """Tables under one folder."""

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def read(self, table: str) -> DataFrame | None:
        """A table, or None before its first append."""
        try:
            return self.spark.read.parquet(self.path(table))
        except AnalysisException:
            return None

    def new_rows(self, table: str, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
        """Rows whose key isn't stored, one per key: the first by ``order`` (else by the other columns)."""
        return new_rows(rows, self.read(table), KEYS[table], order)

    def append(self, table: str, rows: DataFrame, order: list[str] | None = None, partition_by: list[str] | None = None) -> None:
        stored = self.read(table)
        if stored is not None and partition_by:
            stored = stored.join(rows.select(*partition_by).distinct(), partition_by, "left_semi")
        writer = new_rows(rows, stored, KEYS[table], order).write.mode("append")
        (writer.partitionBy(*partition_by) if partition_by else writer).parquet(self.path(table))

    def lookup(self, table: str, **equal: object) -> DataFrame:
        """At most one row with the given values."""
        df = self.read(table)
        if df is None:
            raise ValueError(f"{table} is empty")
        for c, v in equal.items():
            df = df.filter(F.col(c) == F.lit(v))
        return df.limit(1)


def new_rows(rows: DataFrame, stored: DataFrame | None, keys: list[str], order: list[str] | None = None) -> DataFrame:
    by = order or [c for c, t in rows.dtypes if c not in keys and not t.startswith("map")]
    w = Window.partitionBy(*keys).orderBy(*by) if by else Window.partitionBy(*keys).orderBy(F.lit(0))
    once = rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return once if stored is None else once.join(stored.select(*keys).distinct(), keys, "left_anti")


def skip_existing(urls: DataFrame, stored_sources: DataFrame, url_col: str = "source_url") -> DataFrame:
    """Adds ``skipped``: the (non-blank, trimmed) URL was fetched before."""
    wanted = urls.withColumn(url_col, F.trim(url_col)).filter(F.col(url_col) != "")
    seen = stored_sources.select(F.col(url_col)).filter(F.col(url_col).isNotNull()).distinct().withColumn("_seen", F.lit(True))
    return wanted.join(seen, url_col, "left").withColumn("skipped", F.coalesce("_seen", F.lit(False))).drop("_seen")


def get_or_create_speakers(names: DataFrame, speakers: DataFrame, name_col: str = "speaker_name") -> DataFrame:
    """``speaker_key, name, is_new``: one row per slug of the names, with the registered name where there is one."""
    asked = names.filter(F.col(name_col).isNotNull()).select(F.col(name_col).alias("_n"), slug(F.col(name_col)).alias("speaker_key")).groupBy("speaker_key").agg(F.min("_n").alias("_n"))
    known = speakers.groupBy("speaker_key").agg(F.min_by("name", "id").alias("_known"))
    return asked.join(known, "speaker_key", "left").select("speaker_key", F.coalesce("_known", "_n").alias("name"), F.col("_known").isNull().alias("is_new"))


def recent_documents(documents: DataFrame, fingerprints: DataFrame) -> DataFrame:
    """View: documents with their fingerprints, if any; newest first, those without date last."""
    f = fingerprints.select("doc_id", *[F.col(c).alias("fingerprint_" + c) for c in fingerprints.columns if c != "doc_id"])
    return documents.join(f, "doc_id", "left").orderBy(F.col("speech_date").desc_nulls_last(), F.col("created_at").desc_nulls_last(), "doc_id")


def latest_comparisons(comparisons: DataFrame, documents: DataFrame) -> DataFrame:
    """View: comparisons with title and date of both documents; newest first."""
    b = documents.select(F.col("doc_id").alias("base_doc_id"), F.col("title").alias("base_title"), F.col("speech_date").alias("base_date"))
    t = documents.select("doc_id", F.col("title").alias("target_title"), F.col("speech_date").alias("target_date"))
    return comparisons.join(b, "base_doc_id", "left").join(t, "doc_id", "left").orderBy(F.col("created_at").desc_nulls_last(), "comparison_key")


def hydrate_documents(records: DataFrame) -> DataFrame:
    """Typed documents of loose records: unknown types fall back, dates are read from their first ten characters."""
    known = lambda c, values, other: F.when(F.col(c).isin(values), F.col(c)).otherwise(F.lit(other)).alias(c)
    day = F.try_to_date(F.substring(F.col("speech_date").cast("string"), 1, 10), "yyyy-MM-dd").alias("speech_date")
    changed = {"document_type": known("document_type", sites.DOCUMENT_TYPES, "unknown"), "content_type": known("content_type", sites.CONTENT_TYPES, "unknown"), "speech_date": day}
    return records.select(*[changed.get(c, F.col(c)) for c in records.columns])


def hydrate_fingerprints(fingerprints: DataFrame, themes: DataFrame, prompt_version: str | None = None, model_version: str | None = None) -> DataFrame:
    """One row per document: its latest fingerprint (of the given versions), with its theme rows as a map; no themes give an empty map."""
    rows = latest_versions(fingerprints, prompt_version, model_version)
    fields = [c for c in themes.columns if c not in ("doc_id", "document_key", "theme", "ordinal", "prompt_version", "model_version", "created_at")]
    entry = F.struct("theme", F.struct(*fields))
    on = [c for c in ("doc_id", "prompt_version", "model_version") if c in themes.columns and c in rows.columns]
    folded = themes.groupBy(*on).agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("themes"))
    out = rows.join(folded, on, "left")
    return out.withColumn("themes", F.coalesce("themes", F.create_map().cast(out.schema["themes"].dataType)))


def hydrate_comparisons(records: DataFrame) -> DataFrame:
    """Comparisons whose lists are never null and whose unknown types fall back to the comparison with the previous document."""
    lists = {c: F.coalesce(F.col(c), F.array().cast(f.dataType)) for f in records.schema if f.dataType.typeName() == "array" for c in [f.name]}
    kind = F.when(F.col("comparison_type").isin(*COMPARISON_TYPES), F.col("comparison_type")).otherwise(COMPARISON_TYPES[0])
    return records.withColumns(lists | {"comparison_type": kind})


def hydrate_segments(records: DataFrame) -> DataFrame:
    kind = F.when(F.col("segment_type").isin(sites.SEGMENT_TYPES), F.col("segment_type")).otherwise("body")
    return records.withColumn("segment_type", kind)
