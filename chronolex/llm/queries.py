"""Named queries of the training-data operators over the test tables, whole tables each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.llm import boilerplate, bpe, names, near_duplicates, packing, repeated_lines, splitting, turns
from chronolex.plans.ship import ship
from chronolex.plans.spread import spread


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df, df.columns[0])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.speaker_turns(_table(spark, sf_dir, "document_segments"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.link_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "speakers"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boilerplate.find_boilerplate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "source_documents"))


def p3_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    return boilerplate.main_body(documents, boilerplate.find_boilerplate(documents, _table(spark, sf_dir, "source_documents")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_pairs(_table(spark, sf_dir, "documents"), width=3, min_percent=70)


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.similar_groups(_table(spark, sf_dir, "documents"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.find_repeated_lines(_table(spark, sf_dir, "documents"))


def p5_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_lines.frequent_sequences(_table(spark, sf_dir, "documents"))
    return found.withColumn("lines", F.array_join("lines", " / "))


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_lines.remove_repeated_lines(_table(spark, sf_dir, "documents"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_corpus(_table(spark, sf_dir, "documents"))


def _specs(spark: SparkSession, sf_dir: str, use: str) -> dict[int, tuple[int, int]]:
    """Capacities and overlaps by spec id: a handful of rows of parameters."""
    rows = _table(spark, sf_dir, "token_specs").filter(f"use_case = '{use}'").collect()
    return {r["spec_id"]: (r["capacity_tokens"], r["overlap_tokens"]) for r in rows}


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacities = {s: c for s, (c, _) in _specs(spark, sf_dir, "pack").items()}
    return packing.pack_documents(_table(spark, sf_dir, "documents"), capacities)


def p8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.split_corpus(_table(spark, sf_dir, "documents"), _specs(spark, sf_dir, "split"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p3_body, p4_found, p4_groups, p5_found, p5_sequences, p5_clean, p6_ids, p7_packed, p8_pieces)}


_FORMS = """
forms AS (
  SELECT doc_id, source, i - 1 AS line_no,
    trim(regexp_replace(regexp_replace(lower(l[i]), '[ \t]+', ' ', 'g'), '[0-9]+', '0', 'g'), '-–—*•|·>»:.,; ') AS form
  FROM (SELECT doc_id, source, l, unnest(range(1, len(l) + 1)) AS i
        FROM (SELECT doc_id, source, string_split(normalized_text, chr(10)) AS l FROM documents WHERE source IS NOT NULL))
), frequent AS (
  SELECT source, form, count(DISTINCT doc_id) AS docs FROM forms WHERE form <> ''
  GROUP BY source, form
  HAVING docs >= 5 AND docs * 100 >= 5 * (SELECT count(*) FROM documents d WHERE d.source = forms.source)
)"""


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(normalized_text), '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+'), lambda x: x <> '') AS t
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] AS run
  FROM (SELECT doc_id, t, unnest(range(1, len(t) - 1)) AS i FROM w WHERE len(t) >= 3)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL)
SELECT doc_a, doc_b FROM c JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE c * 100 >= 70 * (x.n + y.n - c)
""",
        "p4_groups": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(normalized_text), '[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{3000}]+'), lambda x: x <> '') AS t
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(t[i:i + 4], ' ') AS run
  FROM (SELECT doc_id, t, unnest(range(1, len(t) - 3)) AS i FROM w WHERE len(t) >= 5)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.run = b.run AND a.doc_id < b.doc_id GROUP BY ALL
), p AS (SELECT a, b, c = x.n AND c = y.n AS same FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c * 100 >= 80 * (x.n + y.n - c)
), e AS (SELECT a, b, same FROM p UNION ALL SELECT b, a, same FROM p
), reach AS (SELECT doc_id AS a, doc_id AS b FROM n UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM e WHERE e.a = doc_id AND same), doc_id)) AS class_id,
  (SELECT min(b) FROM reach WHERE reach.a = doc_id) AS group_id, (SELECT count(*) FROM e WHERE e.a = doc_id) AS n_links
FROM n
""",
        "p5_sequences": f"""
WITH {_FORMS}, lines AS (
  SELECT doc_id, source, line_no, form, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS seq FROM forms WHERE form <> ''
), kept AS (
  SELECT doc_id, source, form, seq, CASE WHEN seq - lag(seq) OVER (PARTITION BY doc_id ORDER BY seq) <= 2 THEN 0 ELSE 1 END AS apart FROM lines JOIN frequent USING (source, form)
), blocks AS (
  SELECT source, doc_id, list(form ORDER BY seq) AS l
  FROM (SELECT *, sum(apart) OVER (PARTITION BY doc_id ORDER BY seq) AS block FROM kept) GROUP BY source, doc_id, block
), spans AS (
  SELECT source, doc_id, l[i:j] AS s FROM (SELECT *, unnest(range(i, len(l) + 1)) AS j FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM blocks))
)
SELECT source, CAST(len(s) AS INTEGER) AS n_lines, array_to_string(s, ' / ') AS lines, count(DISTINCT doc_id) AS docs FROM spans
GROUP BY source, s HAVING docs >= 5 AND docs * 100 >= 5 * (SELECT count(*) FROM documents d WHERE d.source = spans.source)
""",
        "p5_found": f"""
WITH {_FORMS}
SELECT doc_id, CAST(line_no AS INTEGER) AS line_no FROM forms JOIN frequent USING (source, form)
""",
        "p5_clean": f"""
WITH {_FORMS}, gone AS (SELECT doc_id, list(line_no) AS gone FROM forms JOIN frequent USING (source, form) GROUP BY doc_id)
SELECT doc_id,
  CASE WHEN gone IS NULL THEN normalized_text ELSE
    array_to_string(list_filter(string_split(normalized_text, chr(10)), lambda x, i: NOT list_contains(gone, i - 1)), chr(10)) END AS text,
  CAST(coalesce(len(gone), 0) AS INTEGER) AS removed
FROM documents LEFT JOIN gone USING (doc_id)
""",
    }
