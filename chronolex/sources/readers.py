"""Readers of the input forms: URL lists, manifests, markdown files, fetched pages and PDF files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions.text import clean_text
from chronolex.operators.normalize import normalize_markdown, normalize_pages
from chronolex.sources.html import parse_pages


def read_url_list(spark: SparkSession, path: str, skip_comments: bool = True) -> DataFrame:
    """``source_url``: the stripped lines that aren't blank (nor start with ``#``)."""
    lines = spark.read.text(path).select(F.trim("value").alias("source_url")).filter("source_url <> ''")
    return lines.filter("not startswith(source_url, '#')") if skip_comments else lines


_MANIFEST = "urls array<string>, skip_existing boolean, markdown_files array<struct<path: string, metadata: map<string, string>>>"


def read_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``(urls, files)``: ``source_url, skip_existing`` (true if not said) and ``path, metadata``."""
    m = spark.read.schema(_MANIFEST).json(path, multiLine=True)
    urls = m.select(F.explode("urls").alias("source_url"), F.coalesce("skip_existing", F.lit(True)).alias("skip_existing"))
    files = m.select(F.explode("markdown_files").alias("f")).select("f.path", F.coalesce("f.metadata", F.create_map().cast("map<string,string>")).alias("metadata"))
    return urls, files


def read_markdown(spark: SparkSession, path: str, metadata: dict[str, str] | None = None) -> DataFrame:
    """Documents of whole markdown files; the source type and path are filled in where the metadata lacks them."""
    given = F.create_map(*[F.lit(x) for kv in (metadata or {}).items() for x in kv]).cast("map<string,string>") if metadata else F.create_map().cast("map<string,string>")
    raw = spark.read.text(path, wholetext=True).select(F.col("value").alias("markdown_text"), F.col("_metadata.file_path").alias("path"))
    filled = F.map_concat(
        F.map_filter(F.create_map(F.lit("source_type"), F.lit("markdown_file"), F.lit("source_path"), F.col("path")), lambda k, _v: ~F.map_contains_key(given, k)), given
    )
    return normalize_markdown(raw.withColumn("metadata", filled))


def read_pages(pages: DataFrame, keep: tuple[str, ...] = ("id", "source_url"), html_col: str = "raw_content") -> DataFrame:
    """Documents of fetched pages (``source_url`` and HTML): the fetch itself lies before this boundary."""
    return normalize_pages(parse_pages(pages, html_col, "source_url", keep))


def read_pdf(spark: SparkSession, path: str, pages_of: Callable[[bytes], list[str]]) -> DataFrame:
    """``path, text`` of PDF files; ``pages_of`` is the plug-in that gives a file's page texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = ["\n\n".join(p for p in pages_of(bytes(c)) if p and p.strip()) for c in b["content"]]
            yield pd.DataFrame({"path": b["path"], "text": texts})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select("path", "content")
    return files.mapInPandas(run, "path string, text string").withColumn("text", clean_text(F.col("text")))
