"""Normalization of fetched texts into canonical, typed and segmented documents; JVM expressions throughout.

Null texts are treated as empty. Nothing here shuffles.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions.text import blocks, clean_text, content_key, has_any, texts, trim_ws, word_count
from chronolex.sources import sites

TYPE_CHARS, DATE_CHARS, SPEAKER_LINES, SPEAKER_WORDS, LEAST_CHARS = 2000, 5000, 15, 8, 120


def host(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _by_domain(h: Column, values: dict[str, Column]) -> Column:
    """The value of the first domain that ends the host."""
    items = list(values.items())
    out = F.when(h.endswith(items[0][0]), items[0][1])
    for domain, v in items[1:]:
        out = out.when(h.endswith(domain), v)
    return out


def detect_source(url: Column, labels: dict[str, str] = sites.SOURCES) -> Column:
    """The label of a known domain, else the host, else null."""
    h = host(url)
    return F.coalesce(_by_domain(h, {d: F.lit(x) for d, x in labels.items()}), F.nullif(h, F.lit("")))


def is_known_site(url: Column, labels: dict[str, str] = sites.SOURCES) -> Column:
    h = host(url)
    return F.coalesce(reduce(lambda a, b: a | b, [h.endswith(d) for d in labels]), F.lit(False))


def detect_document_type(text: Column, title: Column, url: Column) -> Column:
    """By the first phrase, in order of precedence, in the text's start, the title or the URL."""
    hay = F.lower(F.concat_ws(" ", *[F.nullif(c, F.lit("")) for c in (F.substring(text, 1, TYPE_CHARS), title, url)]))
    (first, phrases), *rest = sites.TYPE_PHRASES
    out = F.when(has_any(hay, phrases), first)
    for kind, words in rest:
        out = out.when(has_any(hay, words), kind)
    return out.otherwise("unknown")


def known_or(value: Column, known: list[str], other: str) -> Column:
    return F.when(value.isin(known), value).otherwise(F.lit(other))


_MONTH = "January|February|March|April|May|June|July|August|September|October|November|December"


def _as_date(raw: Column) -> Column:
    """A date of an ISO prefix or of ``Month d, yyyy``; null for anything else."""
    r = trim_ws(raw)
    iso = F.when(r.rlike(r"^\d{4}-\d{2}-\d{2}"), F.try_to_date(F.substring(r, 1, 10), "yyyy-MM-dd"))
    spaced = F.regexp_replace(r, r"\s+", " ")
    named = F.when(spaced.rlike(rf"^(?i:{_MONTH}) \d{{1,2}}, \d{{4}}$"), F.try_to_date(F.initcap(spaced), "MMMM d, yyyy"))
    return F.coalesce(iso, named)


def extract_date(text: Column, candidates: Column | None = None) -> Column:
    """The first candidate that is a date: given ones, then month names, then ISO dates in the text's start."""
    start = F.substring(F.coalesce(text, F.lit("")), 1, DATE_CHARS)
    found = F.concat(
        F.coalesce(candidates, F.array().cast("array<string>")) if candidates is not None else F.array().cast("array<string>"),
        F.regexp_extract_all(start, F.lit(rf"((?:{_MONTH})\s+\d{{1,2}},\s+\d{{4}})"), 1),
        F.regexp_extract_all(start, F.lit(r"(\d{4}-\d{2}-\d{2})"), 1),
    )
    return F.get(F.filter(F.transform(found, _as_date), lambda d: d.isNotNull()), F.lit(0))


def extract_speaker(text: Column) -> Column:
    """The first of the first lines that is short, has a word with a capital and names no organisation."""
    lines = F.slice(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trim_ws), lambda x: x != ""), 1, SPEAKER_LINES)

    def fits(x: Column) -> Column:
        short = F.size(F.split(x, r"(?U)\s+")) <= SPEAKER_WORDS
        capital = x.rlike(r"(?U)(^|\s)\p{Lu}")
        return short & capital & ~has_any(F.lower(x), sites.NOT_A_SPEAKER)

    return F.get(F.filter(lines, fits), F.lit(0))


def refine_page_text(text: Column, title: Column) -> Column:
    """A page's blocks without its title, organisation lines, share links and bare dates before the title; cut
    at the first end mark. The text stays as it was if little would be left."""
    all_blocks = blocks(text)
    ends = F.transform(all_blocks, lambda b: has_any(F.lower(b), sites.END_MARKS))
    end = F.array_position(ends, True)
    kept = F.when(end > 0, F.slice(all_blocks, F.lit(1), (end - 1).cast("int"))).otherwise(all_blocks)
    at = F.when(title != "", F.array_position(kept, trim_ws(title)))

    def stays(b: Column, i: Column) -> Column:
        low = F.lower(b)
        before = F.coalesce(at == 0, F.lit(True)) | (i + 1 < at)
        bare = before & (F.size(F.split(b, r"(?U)\s+")) <= 3) & has_any(low, sites.MONTHS)
        share = reduce(lambda x, y: x | y, [low.startswith(p) for p in sites.SHARE_PREFIXES])
        is_title = F.coalesce((title != "") & (b == trim_ws(title)), F.lit(False))
        return ~(is_title | low.isin(sites.ORGANISATION_LINES) | share | bare)

    out = F.array_join(F.filter(kept, stays), "\n\n")
    return F.when(F.length(out) >= LEAST_CHARS, out).otherwise(text)


def suppress_blocks(
    text: Column, document_type: Column, source: Column, speaker: Column,
    by_type: dict[str, list[str]] = sites.SUPPRESSED, by_source: dict[tuple[str, str], list[str]] = sites.SUPPRESSED_BY_SOURCE, by_speaker: dict[tuple[str, str], list[str]] = sites.SUPPRESSED_BY_SPEAKER,
) -> Column:
    """Leave out blocks that match a pattern of the type, the source or the speaker; a text that would vanish stays."""

    def matched(b: Column) -> Column:
        tests = [(document_type == t) & b.rlike("(?iu)" + "|".join(f"(?:{p})" for p in ps)) for t, ps in by_type.items()]
        tests += [(document_type == t) & (source == s) & b.rlike("(?iu)" + "|".join(f"(?:{p})" for p in ps)) for (s, t), ps in by_source.items()]
        tests += [(document_type == t) & (speaker == s) & b.rlike("(?iu)" + "|".join(f"(?:{p})" for p in ps)) for (s, t), ps in by_speaker.items()]
        return F.coalesce(reduce(lambda x, y: x | F.coalesce(y, F.lit(False)), tests, F.lit(False)), F.lit(False))

    some = document_type.isin(list(by_type))
    for (s, t) in by_source:
        some = some | ((document_type == t) & F.coalesce(source == s, F.lit(False)))
    for (s, t) in by_speaker:
        some = some | ((document_type == t) & F.coalesce(speaker == s, F.lit(False)))
    kept = F.filter(blocks(text), lambda b: ~matched(b))
    return F.when(F.coalesce(some, F.lit(False)) & (F.size(kept) > 0), F.array_join(kept, "\n\n")).otherwise(text)


def segments(documents: DataFrame, key: str = "doc_id", text_col: str = "normalized_text", speaker_col: str = "speaker_name") -> DataFrame:
    """``key, segment_index, speaker_name, segment_type, text``: blocks between empty lines, marked questions and answers told apart."""
    low = F.lower("text")
    question, answer = low.rlike(r"^(q\.|question:)"), low.rlike(r"^(a\.|answer:)")
    rows = documents.select(key, F.col(speaker_col).alias("_s"), F.posexplode(blocks(F.col(text_col))).alias("segment_index", "text"))
    return rows.select(
        key, "segment_index", F.when(question, "Question").otherwise(F.col("_s")).alias("speaker_name"),
        F.when(question, "question").when(answer, "answer").otherwise("body").alias("segment_type"), "text",
    )


def _finish(df: DataFrame) -> DataFrame:
    """Type, suppression, hash, counts and key of rows with text, title, speaker_name, speech_date, source_url, source."""
    df = df.withColumn("document_type", F.coalesce(F.col("_given_type"), detect_document_type(F.col("text"), F.col("title"), F.col("source_url"))))
    df = df.withColumn("normalized_text", suppress_blocks(F.col("text"), F.col("document_type"), F.col("source"), F.col("speaker_name")))
    df = df.withColumn("source_hash", F.sha1("normalized_text")).withColumn("word_count", word_count(F.col("normalized_text")))
    return df.withColumn("document_key", content_key("doc", F.coalesce("source_url", F.lit("")), F.col("source_hash"))).drop("_given_type", "text")


def normalize_pages(parsed: DataFrame, url_col: str = "source_url") -> DataFrame:
    """Documents of parsed pages (``text, title, speaker, dates`` and the URL)."""
    from chronolex.sources.html import url_title

    df = parsed.withColumn("source_url", F.col(url_col)).withColumn("title", F.coalesce("title", url_title(F.col(url_col))))
    df = df.withColumn("text", F.when(is_known_site(F.col("source_url")), refine_page_text(F.col("text"), F.col("title"))).otherwise(F.col("text")))
    df = df.withColumn("speaker_name", F.coalesce("speaker", extract_speaker(F.col("text")))).withColumn("speech_date", extract_date(F.col("text"), F.col("dates")))
    df = df.withColumn("source", detect_source(F.col("source_url"))).withColumn("content_type", F.lit("html")).withColumn("source_type", F.lit("url"))
    return _finish(df.withColumn("_given_type", F.lit(None).cast("string")).drop("speaker", "dates"))


def normalize_markdown(texts_df: DataFrame, text_col: str = "markdown_text", metadata_col: str = "metadata") -> DataFrame:
    """Documents of markdown texts; what the metadata map tells goes before what the text tells."""
    meta = lambda k: F.nullif(F.try_element_at(F.col(metadata_col), F.lit(k)), F.lit(""))
    df = texts_df.withColumn("text", clean_text(F.coalesce(F.col(text_col), F.lit(""))))
    df = df.withColumn("title", meta("title")).withColumn("source_url", meta("source_url")).withColumn("source", meta("source"))
    df = df.withColumn("speaker_name", F.coalesce(meta("speaker_name"), extract_speaker(F.col("text"))))
    df = df.withColumn("speech_date", F.coalesce(F.try_to_date(meta("speech_date"), "yyyy-MM-dd"), extract_date(F.col("text"))))
    given = F.when(meta("document_type").isin(sites.DOCUMENT_TYPES), meta("document_type"))
    return _finish(df.withColumn("_given_type", given).withColumn("content_type", F.lit("markdown")).withColumn("source_type", F.coalesce(meta("source_type"), F.lit("markdown"))))


#: Marks of the older line cleaner: what begins and what ends the text proper (fixed values).
LINE_STARTS = ["Thank you", "Good morning", "Good afternoon", "Good evening"]
LINE_ENDS = ["Last Update", "Back to Top", "Return to text"]


def clean_lines(text: Column, least: int = 20, long: int = 100) -> Column:
    """The older line cleaner: from the first line with a greeting, or the first long one after the top line, up to
    the first end mark; lines of more than ``least`` characters. Empty where nothing begins."""
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), trim_ws), lambda x: x != "")
    first = F.array_position(F.transform(lines, lambda x, i: has_any(x, LINE_STARTS) | ((i > 0) & (F.length(x) > long))), True).cast("int")
    body = F.slice(lines, F.greatest(first, F.lit(1)), F.greatest(F.size(lines) - first + 1, F.lit(0)))
    end = F.array_position(F.transform(body, lambda x: has_any(x, LINE_ENDS)), True).cast("int")
    kept = F.when(end > 0, F.slice(body, F.lit(1), end - 1)).otherwise(body)
    return F.when(first > 0, F.array_join(F.filter(kept, lambda x: F.length(x) > least), "\n\n")).otherwise("")
