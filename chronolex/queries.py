"""Named queries over the test tables, each with a SQL twin where SQL can say it.

Results are flat: lists are joined by bars, so that both engines' values compare.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronolex.functions import ontology as O
from chronolex.functions import text as X
from chronolex.operators import artifacts, compare, fingerprint, normalize, phrases, shifts, similarity
from chronolex.plans.corpus import Corpus
from chronolex.plans.materialize import materialize, remove_folder
from chronolex.plans.ship import ship
from chronolex.plans.spread import spread
from chronolex.session import shared_dir
from chronolex.sources import html, readers, sites, store

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_t(spark, sf_dir, "documents"), "doc_id")


def _corpus(spark: SparkSession, sf_dir: str, keep_themes: bool = True) -> Corpus:
    return Corpus.of(_docs(spark, sf_dir), keep_themes=keep_themes)


def _bar(c: Column | str) -> Column:
    return F.array_join(c, "|")


# --- pieces of SQL ---

_WS = r"\s\x0b\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def _list(words: list[str]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _count(text: str, words: str) -> str:
    return f"CAST(list_sum(list_transform({words}, lambda w: (length({text}) - length(replace({text}, w, ''))) // length(w))) AS INTEGER)"


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '" + w.replace("'", "''") + "')" for w in words) + ")"


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{_WS}]+|[{_WS}]+$', '', 'g')"


_SENTS = (
    f"list_filter(list_transform(string_split(regexp_replace(normalized_text, '([.!?])[{_WS}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {_strip('s')}), lambda s: s <> '')"
)
_BLOCKS = f"list_filter(list_transform(string_split(normalized_text, chr(10) || chr(10)), lambda s: {_strip('s')}), lambda s: s <> '')"
_ONTOLOGY = ", ".join(f"({i}, '{t}', {_list(k)})" for i, (t, k) in enumerate(O.THEME_KEYWORDS.items()))
_THEMES = f"""
base AS (SELECT *, lower(normalized_text) AS low, {_SENTS} AS sents FROM documents),
each AS (SELECT b.*, o.theme, o.ordinal, {_count('low', 'o.keywords')} AS hits,
    list_filter(sents, lambda s: len(list_filter(o.keywords, lambda k: contains(lower(s), k))) > 0) AS m
  FROM base b, (VALUES {_ONTOLOGY}) o(ordinal, theme, keywords)),
joined AS (SELECT *, len(m) AS matched, lower(array_to_string(m, ' ')) AS j FROM each WHERE hits >= 2),
counted AS (SELECT *, {_count('j', _list(O.STANCE_UP))} AS su, {_count('j', _list(O.STANCE_DOWN))} AS sd, {_count('j', _list(O.TRAJECTORY_UP))} AS tu, {_count('j', _list(O.TRAJECTORY_DOWN))} AS td,
    list_filter({_list(sorted(O.HEDGES))}, lambda h: contains(j, h))[1:6] AS hedges FROM joined),
themes AS (SELECT doc_id, document_key, speaker_name, title, speech_date, document_type, created_at, normalized_text, theme, ordinal, hits, matched, m, hedges,
    CASE WHEN sd - su >= 3 THEN 'very_concerned' WHEN sd > su THEN 'concerned' WHEN su - sd >= 3 THEN 'very_optimistic' WHEN su > sd THEN 'optimistic' ELSE 'neutral' END AS stance,
    CASE WHEN td > tu THEN 'worsening' WHEN tu >= td + 2 THEN 'improving' WHEN td > 0 THEN 'stable_negative' ELSE 'stable' END AS trajectory,
    CAST(greatest(1, least(10, matched + least(hits, 4))) AS INTEGER) AS emphasis_score,
    CASE WHEN len(hedges) = 0 THEN 'none' WHEN len(hedges) <= 2 THEN 'light' WHEN len(hedges) <= 4 THEN 'moderate' ELSE 'heavy' END AS hedging_level,
    CASE WHEN matched < 3 THEN 'low' ELSE 'moderate' END AS confidence, CASE WHEN matched < 3 THEN 'high' ELSE 'medium' END AS uncertainty FROM counted)"""
_TONE = f"CASE WHEN {_any('s20', O.TONE_CAUTIOUS)} THEN 'cautious' WHEN {_any('s20', O.TONE_CONFIDENT)} THEN 'confident' ELSE 'measured' END"
_TONES = f"tones AS (SELECT doc_id, {_TONE} AS overall_tone FROM (SELECT doc_id, lower(array_to_string({_SENTS}[1:20], ' ')) AS s20 FROM documents))"
_PREVIOUS = """
d AS (SELECT doc_id, document_key, speaker_name, title, speech_date, created_at, speech_date - DATE '1970-01-01' AS day FROM documents WHERE speaker_name IS NOT NULL),
previous AS (SELECT a.doc_id, p.base_doc_id FROM d a LEFT JOIN (
  SELECT doc_id, base_doc_id FROM (
    SELECT a.doc_id, b.doc_id AS base_doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY b.day DESC NULLS LAST, CASE WHEN b.day IS NOT NULL THEN b.created_at END DESC NULLS LAST, b.doc_id DESC) AS n
    FROM d a JOIN d b ON a.speaker_name = b.speaker_name AND a.doc_id <> b.doc_id AND (a.day IS NULL OR b.day BETWEEN a.day - 730 AND a.day - 1)
  ) WHERE n = 1) p USING (doc_id))"""
_LATEST = """
ranked AS (SELECT *, row_number() OVER (PARTITION BY speaker_name ORDER BY speech_date DESC NULLS LAST, document_key DESC, doc_id DESC) AS rn FROM (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY speaker_name ORDER BY speech_date DESC NULLS FIRST, doc_id DESC) AS k FROM documents WHERE speaker_name IS NOT NULL) WHERE k <= {limit}))"""


def _index(order: list[str], c: str) -> str:
    return f"list_position({_list(order)}, {c})"


def _delta(order: list[str], b: str, a: str) -> str:
    return f"CAST(coalesce({_index(order, a)} - {_index(order, b)}, 0) AS INTEGER)"


_DELTAS = f"""{_delta(O.STANCES, 'b.stance', 't.stance')} AS s, {_delta(O.TRAJECTORIES, 'b.trajectory', 't.trajectory')} AS tr, t.emphasis_score - b.emphasis_score AS e,
    CAST({_index(O.HEDGING_LEVELS, 't.hedging_level')} - {_index(O.HEDGING_LEVELS, 'b.hedging_level')} AS INTEGER) AS h"""
_CHANGES = f"""
pairs AS (SELECT p.doc_id, p.base_doc_id, t.theme, {_DELTAS}, b.stance AS bs, t.stance AS ts, b.trajectory AS bt, t.trajectory AS tt, b.emphasis_score AS be, t.emphasis_score AS te, b.uncertainty AS bu, t.uncertainty AS tu
  FROM previous p JOIN themes t USING (doc_id) JOIN themes b ON b.doc_id = p.base_doc_id AND b.theme = t.theme),
changes AS (SELECT *, (CASE WHEN s <> 0 THEN 1 + least(abs(s), 2) ELSE 0 END) + (CASE WHEN tr <> 0 THEN 1 + least(abs(tr), 2) ELSE 0 END) + (CASE WHEN abs(e) >= 2 THEN 1 ELSE 0 END) + (CASE WHEN h <> 0 THEN 1 ELSE 0 END) AS severity FROM pairs)"""

_HOST = "lower(regexp_extract(source_url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]+)', 1))"
_SOURCE_CASES = " ".join(f"WHEN ends_with(h, '{d}') THEN '{x.replace(chr(39), chr(39) * 2)}'" for d, x in sites.SOURCES.items())


# --- normalization ---


@_query(
    f"""SELECT doc_id, sha1({_strip("regexp_replace(regexp_replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g')")}) AS clean_sha1 FROM documents"""
)
def n1_clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha1(X.clean_text(F.coalesce("text", F.lit("")))).alias("clean_sha1"))


@_query()
def n2_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages read by the element tree (text, title, speaker, date candidates)."""
    pages = spread(_t(spark, sf_dir, "source_documents").filter("content_type = 'html'"), "id")
    return html.parse_pages(pages).select("id", F.length("text").alias("n_chars"), F.sha1("text").alias("text_sha1"), "title", "speaker", _bar("dates").alias("dates"))


@_query()
def n3_normalized_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to documents: text, title, speaker, date, type, source, hash, key."""
    pages = spread(_t(spark, sf_dir, "source_documents").filter("content_type = 'html'"), "id")
    out = normalize.normalize_pages(html.parse_pages(pages, keep=("id", "source_url")))
    return out.select("id", "title", "speaker_name", F.col("speech_date").cast("string").alias("speech_date"), "document_type", "source", "source_hash", "word_count", "document_key")


@_query(f"SELECT id, CASE {_SOURCE_CASES} ELSE nullif(h, '') END AS source FROM (SELECT id, {_HOST} AS h FROM source_documents)")
def n5_detect_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "source_documents").select("id", normalize.detect_source(F.col("source_url")).alias("source"))


_TYPE_CASES = " ".join(f"WHEN {_any('hay', w)} THEN '{k}'" for k, w in sites.TYPE_PHRASES)


@_query(
    f"SELECT doc_id, CASE {_TYPE_CASES} ELSE 'unknown' END AS detected_type FROM (SELECT doc_id, lower(concat_ws(' ', nullif(substring(normalized_text, 1, 2000), ''), nullif(title, ''))) AS hay FROM documents)"
)
def n6_document_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = normalize.detect_document_type(F.col("normalized_text"), F.col("title"), F.lit(None).cast("string"))
    return _docs(spark, sf_dir).select("doc_id", kind.alias("detected_type"))


_MONTHS_SQL = normalize._MONTH


@_query(
    rf"""WITH c AS (SELECT doc_id, list_concat(regexp_extract_all(substring(normalized_text, 1, 5000), '(?:{_MONTHS_SQL})\s+\d{{1,2}},\s+\d{{4}}'), regexp_extract_all(substring(normalized_text, 1, 5000), '\d{{4}}-\d{{2}}-\d{{2}}')) AS l FROM documents),
p AS (SELECT doc_id, list_filter(list_transform(l, lambda x: coalesce(try_cast(CASE WHEN regexp_matches(x, '^\d{{4}}-') THEN x END AS DATE), CAST(try_strptime(regexp_replace(x, '\s+', ' ', 'g'), '%B %d, %Y') AS DATE))), lambda x: x IS NOT NULL) AS l FROM c)
SELECT doc_id, CAST(l[1] AS VARCHAR) AS found_date FROM p"""
)
def n8_extract_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", normalize.extract_date(F.col("normalized_text")).cast("string").alias("found_date"))


@_query(
    rf"""SELECT doc_id, list_filter(list_filter(list_transform(string_split(normalized_text, chr(10)), lambda s: {_strip('s')}), lambda s: s <> '')[1:15],
  lambda x: len(regexp_split_to_array(x, '[{_WS}]+')) <= 8 AND regexp_matches(x, '(^|[{_WS}])\p{{Lu}}') AND NOT {_any('lower(x)', sites.NOT_A_SPEAKER)})[1] AS speaker FROM documents"""
)
def n9_extract_speaker(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", normalize.extract_speaker(F.col("normalized_text")).alias("speaker"))


_SHARE = " OR ".join(f"starts_with(lower(b), '{p}')" for p in sites.SHARE_PREFIXES)


@_query(
    f"""WITH b AS (SELECT doc_id, normalized_text, title, {_BLOCKS} AS l FROM documents),
e AS (SELECT *, list_position(list_transform(l, lambda b: {_any('lower(b)', sites.END_MARKS)}), true) AS e FROM b),
k AS (SELECT doc_id, normalized_text, {_strip("coalesce(title, '')")} AS title, CASE WHEN e > 0 THEN l[1:e - 1] ELSE l END AS l FROM e),
p AS (SELECT *, coalesce(CASE WHEN title <> '' THEN list_position(l, title) END, 0) AS title_at FROM k),
f AS (SELECT doc_id, normalized_text, array_to_string(list_filter(l, lambda b, i: NOT ((title <> '' AND b = title) OR lower(b) IN ('{sites.ORGANISATION_LINES[0]}', '{sites.ORGANISATION_LINES[1]}') OR {_SHARE}
  OR ((title_at = 0 OR i < title_at) AND len(regexp_split_to_array(b, '[{_WS}]+')) <= 3 AND {_any('lower(b)', sites.MONTHS)}))), chr(10) || chr(10)) AS r FROM p)
SELECT doc_id, sha1(CASE WHEN length(r) >= 120 THEN r ELSE normalized_text END) AS refined_sha1 FROM f"""
)
def n10_refine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha1(normalize.refine_page_text(F.col("normalized_text"), F.col("title"))).alias("refined_sha1"))


#: Patterns for this corpus; the defaults speak of another one.
_OWN = {
    "press_release": [r"figures are provided as is", r"reproduction without consent of .* is not allowed"],
    "speech": [r"thank you for having me", r"this concludes my prepared text"],
}
_OWN_SOURCE = {("Continental Reserve Board", "press_release"): [r"contact the .*? media desk at ext\. \d+"]}


def _own_match() -> str:
    tests = [f"(document_type = '{t}' AND regexp_matches(b, '{'|'.join(f'(?:{p})' for p in ps)}', 'i'))" for t, ps in _OWN.items()]
    tests += [f"(document_type = '{t}' AND coalesce(source = '{s}', false) AND regexp_matches(b, '{'|'.join(f'(?:{p})' for p in ps)}', 'i'))" for (s, t), ps in _OWN_SOURCE.items()]
    return " OR ".join(tests)


@_query(
    f"""WITH k AS (SELECT doc_id, normalized_text, document_type, list_filter({_BLOCKS}, lambda b: NOT ({_own_match()})) AS l FROM documents)
SELECT doc_id, sha1(CASE WHEN document_type IN ('press_release', 'speech') AND len(l) > 0 THEN array_to_string(l, chr(10) || chr(10)) ELSE normalized_text END) AS kept_sha1 FROM k"""
)
def n11_suppress(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = normalize.suppress_blocks(F.col("normalized_text"), F.col("document_type"), F.col("source"), F.col("speaker_name"), _OWN, _OWN_SOURCE, {})
    return _docs(spark, sf_dir).select("doc_id", F.sha1(out).alias("kept_sha1"))


@_query(
    f"""SELECT doc_id, CAST(i - 1 AS INTEGER) AS segment_index, CASE WHEN regexp_matches(lower(l[i]), '^(q\\.|question:)') THEN 'Question' ELSE speaker_name END AS speaker_name,
  CASE WHEN regexp_matches(lower(l[i]), '^(q\\.|question:)') THEN 'question' WHEN regexp_matches(lower(l[i]), '^(a\\.|answer:)') THEN 'answer' ELSE 'body' END AS segment_type, sha1(l[i]) AS text_sha1
FROM (SELECT doc_id, speaker_name, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, speaker_name, {_BLOCKS} AS l FROM documents))"""
)
def n12_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.segments(_docs(spark, sf_dir)).select("doc_id", "segment_index", "speaker_name", "segment_type", F.sha1("text").alias("text_sha1"))


@_query(
    f"SELECT doc_id, sha1(normalized_text) = source_hash AS same_hash, sha1(normalized_text) AS hash, CAST(len(list_filter(regexp_split_to_array(normalized_text, '[{_WS}]+'), lambda w: w <> '')) AS INTEGER) AS words FROM documents"
)
def n13_source_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.sha1("normalized_text")
    return _docs(spark, sf_dir).select("doc_id", (h == F.col("source_hash")).alias("same_hash"), h.alias("hash"), X.word_count(F.col("normalized_text")).alias("words"))


_LINES = f"list_filter(list_transform(string_split(normalized_text, chr(10)), lambda s: {_strip('s')}), lambda s: s <> '')"


@_query(
    f"""WITH l AS (SELECT doc_id, {_LINES} AS l FROM documents),
f AS (SELECT *, coalesce(list_position(list_transform(l, lambda x, i: {_any('x', normalize.LINE_STARTS)} OR (i > 1 AND length(x) > 100)), true), 0) AS f FROM l),
b AS (SELECT doc_id, f, CASE WHEN f > 0 THEN l[f:] ELSE [] END AS l FROM f),
e AS (SELECT *, coalesce(list_position(list_transform(l, lambda x: {_any('x', normalize.LINE_ENDS)}), true), 0) AS e FROM b)
SELECT doc_id, sha1(coalesce(array_to_string(list_filter(CASE WHEN e > 0 THEN l[1:e - 1] ELSE l END, lambda x: length(x) > 20), chr(10) || chr(10)), '')) AS cleaned_sha1 FROM e"""
)
def n14_clean_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha1(normalize.clean_lines(F.col("normalized_text"))).alias("cleaned_sha1"))


@_query(
    f"""WITH {_THEMES}, {_PREVIOUS}, n AS (SELECT doc_id, CASE WHEN doc_id IN (SELECT doc_id FROM themes) THEN ['{O.DRAFT_NOTE}'] ELSE ['{O.DRAFT_NOTE}', '{O.NO_THEME_NOTE}'] END AS notes FROM documents)
SELECT p.doc_id, array_to_string(list_concat(t.notes, list_filter(b.notes, lambda x: NOT list_contains(t.notes, x))), '|') AS notes FROM previous p JOIN n t USING (doc_id) JOIN n b ON b.doc_id = p.base_doc_id"""
)
def c12_merged_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A comparison's notes: the target's and those of the base that it lacks."""
    docs = _docs(spark, sf_dir)
    notes = fingerprint.headers(docs).select("doc_id", "uncertainty_notes")
    pairs = compare.previous_documents(docs).filter("base_doc_id is not null").join(notes, "doc_id")
    both = pairs.join(notes.select(F.col("doc_id").alias("base_doc_id"), F.col("uncertainty_notes").alias("base_notes")), "base_doc_id")
    return both.select("doc_id", _bar(compare.merged_notes(F.col("uncertainty_notes"), F.col("base_notes"))).alias("notes"))


# --- stored tables and views ---


@_query("SELECT source_hash, min(id) AS id, count(*) AS copies FROM source_documents GROUP BY source_hash")
def s8_new_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an idempotent append of all fetches would store: one row per hash, the first id."""
    rows = _t(spark, sf_dir, "source_documents").select("source_hash", "id")
    once = store.new_rows(rows, None, store.KEYS["source_documents"], ["id"])
    return once.join(rows.groupBy("source_hash").agg(F.count("*").alias("copies")), "source_hash").select("source_hash", "id", "copies")


@_query("SELECT id, trim(source_url) AS source_url, EXISTS (SELECT 1 FROM source_documents x WHERE x.source_url = trim(s.source_url) AND x.source_type = 'url' AND x.fetched_at < TIMESTAMP '2020-01-01') AS skipped FROM source_documents s WHERE trim(source_url) <> ''")
def s10_skip_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fetched URLs against those fetched before 2020."""
    sources = _t(spark, sf_dir, "source_documents")
    stored = sources.filter("source_type = 'url' and fetched_at < timestamp'2020-01-01'")
    return store.skip_existing(sources.select("id", "source_url"), stored).select("id", "source_url", "skipped")


@_query(
    """WITH t AS (SELECT EXISTS (SELECT 1 FROM source_documents x WHERE x.source_url = trim(s.source_url) AND x.source_type = 'url' AND x.fetched_at < TIMESTAMP '2020-01-01') AS skipped FROM source_documents s WHERE trim(source_url) <> '')
SELECT count(*) AS asked, count(*) FILTER (WHERE NOT skipped) AS ingested, count(*) FILTER (WHERE skipped) AS skipped FROM t"""
)
def a5_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.ingest_counts(s10_skip_existing(spark, sf_dir))


@_query("SELECT DISTINCT trim(source_url) AS source_url FROM source_documents WHERE trim(source_url) <> ''")
def s4_url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All URLs written to a list with comments and blank lines among them, and read from it."""
    import uuid

    urls = _t(spark, sf_dir, "source_documents").select(F.trim("source_url").alias("u")).filter("u <> ''").distinct()
    path = f"{shared_dir(spark)}/chronolex/urls-{uuid.uuid4().hex}"
    urls.select(F.explode(F.array(F.concat(F.lit("# "), "u"), F.lit("  "), F.concat(F.lit(" "), "u"))).alias("value")).write.text(path)
    out = materialize(readers.read_url_list(spark, path), "urls")
    remove_folder(spark, path)
    return out


_CLEANED = f"""m AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN nullif(title, '') END AS title, CASE WHEN doc_id % 3 > 0 THEN nullif(speaker_name, '') END AS speaker_name, CASE WHEN doc_id % 5 > 0 THEN speech_date END AS speech_date,
  CASE WHEN doc_id % 7 > 0 THEN document_type END AS document_type, nullif(source, '') AS source,
  {_strip("regexp_replace(regexp_replace(replace(replace(coalesce(normalized_text, ''), chr(160), ' '), chr(13), chr(10)), '\\n{3,}', chr(10) || chr(10), 'g'), '[ \\t]{2,}', ' ', 'g')")} AS normalized_text FROM documents)"""


@_query(
    f"""WITH {_CLEANED}, k AS ({_SQL['n6_document_type'].replace('FROM documents', 'FROM m')}), n AS ({_SQL['n9_extract_speaker'].replace('FROM documents', 'FROM m')}), dt AS ({_SQL['n8_extract_date'].replace('FROM documents', 'FROM m')})
SELECT m.doc_id, m.title, coalesce(m.speaker_name, n.speaker) AS speaker_name, coalesce(CAST(m.speech_date AS VARCHAR), dt.found_date) AS speech_date, coalesce(m.document_type, k.detected_type) AS document_type, m.source, 'markdown' AS content_type
FROM m JOIN k USING (doc_id) JOIN n USING (doc_id) JOIN dt USING (doc_id)"""
)
def s2_markdown_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with metadata that tell some of their fields; the others are found in the text."""
    told = {"title": "doc_id % 2 = 0", "speaker_name": "doc_id % 3 > 0", "speech_date": "doc_id % 5 > 0", "document_type": "doc_id % 7 > 0", "source": "true"}
    pairs = [x for c, when in told.items() for x in (F.lit(c), F.when(F.expr(when), F.col(c).cast("string")))]
    texts = _docs(spark, sf_dir).select("doc_id", F.col("normalized_text").alias("markdown_text"), F.create_map(*pairs).alias("metadata"))
    return normalize.normalize_markdown(texts).select("doc_id", "title", "speaker_name", F.col("speech_date").cast("string").alias("speech_date"), "document_type", "source", "content_type")


@_query("SELECT id, name, institution FROM speakers WHERE speaker_key = 'henrik_lunvrabane' LIMIT 1")
def s7_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "speakers").filter("speaker_key = 'henrik_lunvrabane'").limit(1).select("id", "name", "institution")


_SLUG = "coalesce(nullif(trim(regexp_replace(lower(speaker_name), '[^a-z0-9]+', '_', 'g'), '_'), ''), 'unknown_speaker')"


@_query(
    f"""WITH n AS (SELECT {_SLUG} AS speaker_key, min(speaker_name) AS n FROM documents WHERE speaker_name IS NOT NULL GROUP BY 1), k AS (SELECT speaker_key, arg_min(name, id) AS known FROM speakers GROUP BY 1)
SELECT n.speaker_key, coalesce(known, n.n) AS name, known IS NULL AS is_new FROM n LEFT JOIN k USING (speaker_key)"""
)
def s8_get_or_create_speakers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.get_or_create_speakers(_docs(spark, sf_dir), _t(spark, sf_dir, "speakers"))


@_query(f"WITH {_TONES} SELECT doc_id, title, CAST(speech_date AS VARCHAR) AS speech_date, overall_tone FROM documents LEFT JOIN tones USING (doc_id)")
def s10_recent_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    tones = docs.select("doc_id", fingerprint.tone(X.sentences(F.col("normalized_text")), O.DEFAULT).alias("overall_tone"))
    return store.recent_documents(docs, tones).select("doc_id", "title", F.col("speech_date").cast("string").alias("speech_date"), F.col("fingerprint_overall_tone").alias("overall_tone"))


@_query(
    """SELECT d.doc_id, CASE WHEN document_type IN ('speech','prepared_remarks','press_release','press_conference','qa_transcript','interview','testimony','statement','comment','unknown') THEN document_type ELSE 'unknown' END AS document_type,
  CAST(speech_date AS VARCHAR) AS speech_date, p.n AS n_phrases FROM documents d JOIN (SELECT document_id, count(*) AS n FROM phrase_observations GROUP BY 1) p ON p.document_id = d.doc_id"""
)
def s9_hydrate_with_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed documents that have phrase observations (inner join)."""
    n = _t(spark, sf_dir, "phrase_observations").groupBy(F.col("document_id").alias("doc_id")).agg(F.count("*").alias("n_phrases"))
    docs = store.hydrate_documents(_docs(spark, sf_dir).select("doc_id", "document_type", "content_type", "speech_date"))
    return docs.join(n, "doc_id").select("doc_id", "document_type", F.col("speech_date").cast("string").alias("speech_date"), "n_phrases")


# --- fingerprints ---


@_query(
    f"WITH {_THEMES} SELECT doc_id, theme, hits, CAST(matched AS INTEGER) AS matched, stance, trajectory, emphasis_score, array_to_string(hedges, '|') AS key_hedges, hedging_level, confidence, uncertainty FROM themes"
)
def f14_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.theme_assessments(_docs(spark, sf_dir)).select(
        "doc_id", "theme", "hits", "matched", "stance", "trajectory", "emphasis_score", _bar("key_hedges").alias("key_hedges"), "hedging_level", "confidence", "uncertainty"
    )


@_query(
    f"""WITH {_THEMES}, q AS (SELECT doc_id, theme, normalized_text, list_transform(m[1:3], lambda s: substring(s, 1, 280)) AS q FROM themes)
SELECT doc_id, theme, array_to_string(q, '|') AS quotes, array_to_string(list_transform(q, lambda x: CAST(strpos(normalized_text, x) - 1 AS VARCHAR)), '|') AS starts FROM q"""
)
def f11_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fingerprint.theme_assessments(_docs(spark, sf_dir))
    starts = F.transform("evidence", lambda e: F.coalesce(e["start_char"], F.lit(-1)).cast("string"))
    return t.select("doc_id", "theme", _bar(F.transform("evidence", lambda e: e["quote"])).alias("quotes"), _bar(starts).alias("starts"))


@_query(
    f"WITH {_THEMES}, {_TONES} SELECT doc_id, overall_tone, CASE WHEN doc_id IN (SELECT doc_id FROM themes) THEN '{O.DRAFT_NOTE}' ELSE '{O.DRAFT_NOTE}|{O.NO_THEME_NOTE}' END AS notes FROM tones"
)
def f12_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.headers(_docs(spark, sf_dir)).select("doc_id", "overall_tone", _bar("uncertainty_notes").alias("notes"))


_TEMPLATE = "Title: {title}\nSpeaker: {speaker_name}\nDate: {speech_date}\nType: {document_type}\n\n{speech_text}"


@_query(
    """SELECT doc_id, sha1('Title: ' || coalesce(title, '') || chr(10) || 'Speaker: ' || coalesce(speaker_name, '') || chr(10) || 'Date: ' || coalesce(CAST(speech_date AS VARCHAR), '') || chr(10)
  || 'Type: ' || document_type || chr(10) || chr(10) || normalized_text) AS prompt_sha1 FROM documents"""
)
def f15_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {"title": F.col("title"), "speaker_name": F.col("speaker_name"), "speech_date": F.col("speech_date"), "document_type": F.col("document_type"), "speech_text": F.col("normalized_text")}
    return _docs(spark, sf_dir).select("doc_id", F.sha1(fingerprint.render_prompt(_TEMPLATE, values)).alias("prompt_sha1"))


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Heuristic theme rows, and answers in a model's form made of them: every fifth document's lacks a field, every seventh's is no JSON."""
    themes = fingerprint.theme_assessments(_docs(spark, sf_dir))
    fields = ["stance", "trajectory", "emphasis_score", "hedging_level", "key_hedges", "uncertainty"]
    confident = F.when(F.col("doc_id") % 5 != 0, F.col("confidence")).alias("confidence")
    folded = themes.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("theme", F.struct(*fields, confident)))).alias("themes"))
    raw = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct("themes")), F.lit("\n```"))
    return themes, folded.select("doc_id", F.when(F.col("doc_id") % 7 == 0, "no answer").otherwise(raw).alias("raw_response"))


@_query(
    f"WITH {_THEMES} SELECT doc_id, theme, stance, trajectory, emphasis_score, hedging_level, CASE WHEN doc_id % 5 = 0 OR doc_id % 7 = 0 THEN 'heuristic' ELSE 'model' END AS extractor FROM themes"
)
def f17_answers_with_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parsed answers where they are valid, heuristic rows elsewhere."""
    themes, answers = _answers(spark, sf_dir)
    parsed = fingerprint.response_themes(answers)
    return fingerprint.with_fallback(parsed, parsed, themes).select("doc_id", "theme", "stance", "trajectory", "emphasis_score", "hedging_level", "extractor")


@_query(
    f"""WITH {_THEMES} SELECT DISTINCT doc_id, '{fingerprint.FALLBACK_NOTE}' || CASE WHEN doc_id % 7 = 0 THEN 'JSONDecodeError' ELSE 'ValidationError' END AS note FROM themes WHERE doc_id % 5 = 0 OR doc_id % 7 = 0"""
)
def f17_fallback_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes of documents whose answers could not be used."""
    _, answers = _answers(spark, sf_dir)
    return fingerprint.fallback_notes(answers, fingerprint.response_themes(answers))


@_query(
    f"""WITH {_TONES}, f AS (SELECT doc_id, created_at, 'v1' AS v FROM documents UNION ALL SELECT doc_id, created_at + INTERVAL 1 DAY, 'v2' FROM documents WHERE doc_id % 2 = 0)
SELECT doc_id, v AS prompt_version, overall_tone FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY created_at DESC NULLS LAST, v DESC) AS n FROM f) JOIN tones USING (doc_id) WHERE n = 1"""
)
def j4_latest_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of each document's fingerprints; every second document has one of a later version."""
    docs = _docs(spark, sf_dir)
    first = docs.select("doc_id", "created_at", fingerprint.tone(X.sentences(F.col("normalized_text")), O.DEFAULT).alias("overall_tone"), F.lit("v1").alias("prompt_version"))
    later = first.filter("doc_id % 2 = 0").withColumns({"created_at": F.col("created_at") + F.expr("interval 1 day"), "prompt_version": F.lit("v2")})
    rows = first.unionByName(later).withColumn("fingerprint_id", F.col("prompt_version"))
    return artifacts.latest_versions(rows).select("doc_id", "prompt_version", "overall_tone")


# --- phrases ---

_GRAMS = f"""
tok AS (SELECT doc_id, speaker_name AS s, speech_date - DATE '1970-01-01' AS d, list_transform(regexp_extract_all(normalized_text, '[A-Za-z][A-Za-z\\-'']+'), lambda w: lower(w)) AS t FROM documents),
grams AS (SELECT doc_id, s, d, n, i, t[i:i + n - 1] AS g FROM (SELECT *, unnest(range(1, len(t) - n + 2)) AS i FROM tok, (VALUES (2), (3), (4), (5)) z(n))),
counts AS (SELECT doc_id, s, d, n, array_to_string(g, ' ') AS phrase, count(*) AS c, min(i) AS pos FROM grams
  WHERE len(list_filter(g, lambda w: NOT list_contains({_list(O.STOPWORDS)}, w))) >= 2 GROUP BY doc_id, s, d, n, phrase HAVING phrase NOT IN ({', '.join("'" + w + "'" for w in O.LOW_SIGNAL)})),
history AS (SELECT *, CASE WHEN s IS NULL THEN 0 WHEN d IS NULL THEN sum(c) OVER (PARTITION BY s, phrase) - c
  ELSE coalesce(sum(c) OVER (PARTITION BY s, phrase ORDER BY d RANGE BETWEEN 730 PRECEDING AND 1 PRECEDING), 0) END AS h FROM counts),
scored AS (SELECT *, c / (h + 1) * ln(c + 1.5) AS r FROM history)"""


@_query(
    f"""WITH {_GRAMS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC, n, pos) AS rank FROM scored)
SELECT doc_id, CAST(rank AS INTEGER) AS rank, phrase AS phrase_text, trim(phrase, ' .,;:"''()[]{{}}') AS normalized_phrase, substring(sha1(trim(phrase, ' .,;:"''()[]{{}}')), 1, 12) AS semantic_key,
  CAST(c AS INTEGER) AS current_count, CAST(h AS INTEGER) AS historical_count, round(r, 4) AS rarity_score FROM ranked WHERE rank <= 20"""
)
def phrase_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.phrase_signals(_docs(spark, sf_dir))


# --- comparisons ---


@_query(f"WITH {_PREVIOUS} SELECT doc_id, CAST(base_doc_id AS VARCHAR) AS base_doc_id FROM previous")
def j8_previous_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare.previous_documents(_docs(spark, sf_dir)).withColumn("base_doc_id", F.col("base_doc_id").cast("string"))


@_query(
    f"""WITH {_THEMES}, {_PREVIOUS}, {_CHANGES}
SELECT doc_id, base_doc_id, theme, CASE WHEN s > 0 THEN 'more_concerned' WHEN s < 0 THEN 'more_optimistic' WHEN tr > 0 THEN 'worse_trajectory' WHEN tr < 0 THEN 'better_trajectory' WHEN abs(e) >= 2 THEN 'emphasis_shift' ELSE 'mixed_shift' END AS change_type,
  CASE WHEN severity >= 3 THEN 'high' WHEN severity = 2 THEN 'moderate' ELSE 'low' END AS strength,
  CASE WHEN {_index(O.UNCERTAINTIES, 'tu')} > {_index(O.UNCERTAINTIES, 'bu')} THEN tu ELSE bu END AS uncertainty,
  concat_ws('; ', CASE WHEN s <> 0 THEN 'stance moved from ' || bs || ' to ' || ts END, CASE WHEN tr <> 0 THEN 'trajectory moved from ' || bt || ' to ' || tt END,
    CASE WHEN abs(e) >= 2 THEN 'emphasis ' || CASE WHEN e > 0 THEN 'increased' ELSE 'decreased' END || ' from ' || be || ' to ' || te END,
    CASE WHEN h <> 0 THEN 'language became ' || CASE WHEN h > 0 THEN 'more hedged' ELSE 'less hedged' END END) AS summary
FROM changes WHERE severity > 0"""
)
def c13_theme_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return compare.compare_to_previous(c.docs, c.themes).select("doc_id", "base_doc_id", "theme", "change_type", "strength", "uncertainty", "summary")


@_query(f"WITH {_THEMES}, {_PREVIOUS} SELECT t.doc_id, t.theme FROM themes t JOIN previous p USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM themes b WHERE b.doc_id = p.base_doc_id AND b.theme = t.theme)")
def c8_new_themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return compare.new_themes(c.docs, c.themes)


_ORPHANS = """
orphans AS (SELECT DISTINCT a.doc_id, w.days, b.theme FROM d a, (VALUES (75), (730)) w(days), themes b
  WHERE b.speaker_name = a.speaker_name AND b.emphasis_score >= 3 AND (b.speech_date - DATE '1970-01-01') BETWEEN a.day - w.days AND a.day - 1
  AND NOT EXISTS (SELECT 1 FROM themes t WHERE t.doc_id = a.doc_id AND t.theme = b.theme))"""


@_query(f"WITH {_THEMES}, {_PREVIOUS}, {_ORPHANS} SELECT doc_id, theme FROM orphans WHERE days = 75")
def c9_orphaned_75d(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return compare.orphaned_themes(c.docs, c.themes, 75)


_COMPARED = f"""{_THEMES}, {_PREVIOUS}, {_CHANGES}, {_ORPHANS}, {_GRAMS},
n AS (SELECT doc_id, count(*) AS n FROM changes WHERE severity > 0 GROUP BY 1),
f AS (SELECT t.doc_id, string_agg(t.theme, '|' ORDER BY t.theme) AS l, count(*) AS n FROM themes t JOIN previous p USING (doc_id) WHERE NOT EXISTS (SELECT 1 FROM themes b WHERE b.doc_id = p.base_doc_id AND b.theme = t.theme) GROUP BY 1),
g AS (SELECT doc_id, days, string_agg(theme, '|' ORDER BY theme) AS l, count(*) AS n FROM orphans GROUP BY 1, 2),
rare AS (SELECT doc_id, string_agg(phrase, '|' ORDER BY rank) AS l, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY r DESC, n, pos) AS rank FROM scored) WHERE rank <= 10 GROUP BY 1),
compared AS (SELECT p.doc_id, p.base_doc_id, k.kind AS comparison_type, CAST(CASE WHEN k.kind <> 't_minus_1' THEN k.days ELSE 0 END AS INTEGER) AS window_days, CAST(coalesce(n.n, 0) AS INTEGER) AS n_changes, coalesce(f.l, '') AS new_themes, coalesce(g.l, '') AS orphaned,
  CAST(coalesce(rare.n, 0) AS INTEGER) AS n_phrases, coalesce(rare.l, '') AS phrase_anomalies,
  coalesce(nullif(concat_ws('; ', CASE WHEN n.n > 0 THEN n.n || ' theme changes vs baseline' END, CASE WHEN f.n > 0 THEN f.n || ' new themes' END, CASE WHEN g.n > 0 THEN g.n || ' orphaned concepts' END, CASE WHEN rare.n > 0 THEN rare.n || ' phrase anomalies' END), ''), 'No material changes detected') AS summary
FROM previous p CROSS JOIN (VALUES ('t_minus_1', 730), ('window_75d', 75), ('window_24m', 730)) k(kind, days) LEFT JOIN n USING (doc_id) LEFT JOIN f USING (doc_id) LEFT JOIN g ON g.doc_id = p.doc_id AND g.days = k.days LEFT JOIN rare ON rare.doc_id = p.doc_id
WHERE p.base_doc_id IS NOT NULL)"""


@_query(f"WITH {_COMPARED} SELECT * FROM compared")
def c15_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _corpus(spark, sf_dir).comparisons()
    return rows.select("doc_id", "base_doc_id", "comparison_type", F.coalesce("window_days", F.lit(0)).alias("window_days"), "n_changes", _bar("new_themes").alias("new_themes"), _bar("orphaned").alias("orphaned"), "n_phrases", _bar("phrase_anomalies.phrase_text").alias("phrase_anomalies"), "summary")


def _no_phrases(c: Corpus) -> DataFrame:
    """For queries of comparisons that show nothing of phrases."""
    return c.docs.select("doc_id", F.lit(1).alias("rank"), *[F.lit("").alias(n) for n in ("phrase_text", "semantic_key")], F.lit(0.0).alias("rarity_score")).limit(0)


@_query(
    f"""WITH {_THEMES}, {_PREVIOUS}, {_CHANGES}, quoted AS (SELECT doc_id, theme, array_to_string(list_transform(m[1:2], lambda s: substring(s, 1, 280)), ' | ') AS q FROM themes)
SELECT c.doc_id, c.theme, b.q AS evidence_before, a.q AS evidence_after FROM changes c JOIN quoted a ON a.doc_id = c.doc_id AND a.theme = c.theme JOIN quoted b ON b.doc_id = c.base_doc_id AND b.theme = c.theme WHERE severity > 0"""
)
def c7_change_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes that the comparisons with the previous document carry for each changed theme."""
    c = _corpus(spark, sf_dir)
    rows = c.comparisons(_no_phrases(c)).filter("comparison_type = 't_minus_1'").select("doc_id", F.explode("theme_changes").alias("t"))
    said = [F.array_join(F.transform(f"t.evidence_{side}", lambda e: e["quote"]), " | ").alias(f"evidence_{side}") for side in ("before", "after")]
    return rows.select("doc_id", "t.theme", *said)


@_query(
    f"""WITH {_THEMES}, {_TONES}, {_PREVIOUS},
w AS (SELECT a.doc_id, b.doc_id AS b, b.day FROM d a JOIN d b ON a.speaker_name = b.speaker_name AND b.day BETWEEN a.day - 75 AND a.day - 1),
t AS (SELECT w.doc_id, theme, count(*) AS n, max(day) AS last, min(ordinal) AS o FROM w JOIN themes t ON t.doc_id = w.b GROUP BY 1, 2),
top AS (SELECT doc_id, string_agg(theme, ', ' ORDER BY k) AS l FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, last DESC, o) AS k FROM t) WHERE k <= 3 GROUP BY 1),
tn AS (SELECT doc_id, overall_tone FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, last DESC, overall_tone) AS k FROM (SELECT w.doc_id, overall_tone, count(*) AS n, max(day) AS last FROM w JOIN tones x ON x.doc_id = w.b GROUP BY 1, 2)) WHERE k = 1)
SELECT doc_id, CASE WHEN tn.overall_tone IS NULL THEN 'No documents available for 75d.' ELSE '75d: dominant themes ' || coalesce(top.l, 'none') || '; dominant tone ' || tn.overall_tone || '.' END AS summary
FROM d LEFT JOIN top USING (doc_id) LEFT JOIN tn USING (doc_id) WHERE day IS NOT NULL"""
)
def c14_window_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return compare.window_summaries(c.docs, c.themes, 75, "75d")


# --- graded shifts ---

_SHIFTS = f"""
moves AS (SELECT p.base_doc_id, p.doc_id, t.theme, {_DELTAS} FROM previous p JOIN themes t USING (doc_id) JOIN themes b ON b.doc_id = p.base_doc_id AND b.theme = t.theme),
typed AS (SELECT *, CASE WHEN e >= 3 THEN 'NEW_EMPHASIS' WHEN e <= -3 THEN 'REDUCED_EMPHASIS' WHEN s + tr - h >= 2 THEN 'HAWKISH_DRIFT' WHEN s + tr - h <= -2 THEN 'DOVISH_PIVOT' WHEN abs(h) >= 2 THEN 'CONVICTION_CHANGE' WHEN s <> 0 OR tr <> 0 THEN 'SUBTLE_SHIFT' ELSE 'MINOR_CHANGE' END AS shift_type,
  abs(s) + abs(tr) + abs(e) / 3 AS size FROM moves WHERE s <> 0 OR tr <> 0 OR abs(e) >= 2 OR h <> 0)"""


_SHIFT_ROWS = """SELECT base_doc_id, doc_id, theme, shift_type, CASE WHEN shift_type IN ('HAWKISH_DRIFT', 'DOVISH_PIVOT') THEN CASE WHEN theme IN ('INFLATION', 'POLICY_STANCE', 'LABOR_MARKETS') OR size >= 3 THEN 'HIGH' ELSE 'MEDIUM' END
  WHEN shift_type IN ('NEW_EMPHASIS', 'CONVICTION_CHANGE') THEN CASE WHEN size >= 4 THEN 'HIGH' ELSE 'MEDIUM' END ELSE CASE WHEN size >= 2 THEN 'MEDIUM' ELSE 'LOW' END END AS significance FROM typed
UNION ALL SELECT p.base_doc_id, p.doc_id, b.theme, 'ORPHANED_CONCEPT', CASE WHEN b.emphasis_score >= 6 THEN 'HIGH' ELSE 'MEDIUM' END FROM previous p JOIN themes b ON b.doc_id = p.base_doc_id WHERE b.emphasis_score >= 3 AND NOT EXISTS (SELECT 1 FROM themes t WHERE t.doc_id = p.doc_id AND t.theme = b.theme)
UNION ALL SELECT p.base_doc_id, p.doc_id, t.theme, 'NEW_THEME', CASE WHEN t.emphasis_score >= 6 THEN 'HIGH' ELSE 'MEDIUM' END FROM previous p JOIN themes t USING (doc_id) WHERE p.base_doc_id IS NOT NULL AND t.emphasis_score >= 3 AND NOT EXISTS (SELECT 1 FROM themes b WHERE b.doc_id = p.base_doc_id AND b.theme = t.theme)"""


@_query(f"WITH {_THEMES}, {_PREVIOUS}, {_SHIFTS} {_SHIFT_ROWS}")
def l6_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return shifts.detect_shifts(compare.previous_documents(c.docs).filter("base_doc_id is not null"), c.themes).drop("interpretation")


@_query(
    f"""WITH {_THEMES}, {_PREVIOUS}, {_CHANGES}, hedged AS (SELECT doc_id, theme, hedging_level AS l FROM themes), q AS (SELECT chr(39) AS q)
SELECT c.doc_id, c.theme, concat_ws('. ', CASE WHEN s <> 0 THEN concat('Stance shifted ', CASE WHEN s > 0 THEN 'more concerned' ELSE 'more optimistic' END, ' (from ', q, bs, q, ' to ', q, ts, q, ')') END,
  CASE WHEN tr <> 0 THEN concat('Trajectory viewed as ', CASE WHEN tr > 0 THEN 'worsening' ELSE 'improving' END, ' (from ', q, bt, q, ' to ', q, tt, q, ')') END,
  CASE WHEN abs(e) >= 2 THEN concat('Emphasis ', CASE WHEN e > 0 THEN 'increased' ELSE 'decreased' END, ' from ', be, '/10 to ', te, '/10') END,
  CASE WHEN h <> 0 THEN concat('Hedging ', CASE WHEN h > 0 THEN 'increased' ELSE 'decreased' END, ' (from ', q, b.l, q, ' to ', q, a.l, q, ')') END) AS interpretation
FROM changes c CROSS JOIN q JOIN hedged a ON a.doc_id = c.doc_id AND a.theme = c.theme JOIN hedged b ON b.doc_id = c.base_doc_id AND b.theme = c.theme WHERE severity > 0"""
)
def l4_interpretations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What moved between each document and its previous one, in words."""
    c = _corpus(spark, sf_dir)
    rows = shifts.detect_shifts(compare.previous_documents(c.docs).filter("base_doc_id is not null"), c.themes)
    return rows.filter("interpretation is not null").select("doc_id", "theme", "interpretation")


@_query(f"WITH {_THEMES}, q AS (SELECT doc_id, theme, normalized_text, unnest(m[1:3]) AS s FROM themes) SELECT doc_id, theme, count(*) AS n, CAST(sum(CASE WHEN contains(normalized_text, substring(s, 1, 280)) THEN 1 ELSE 0 END) AS BIGINT) AS verified FROM q GROUP BY 1, 2")
def l7_verified_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    quotes = fingerprint.theme_assessments(docs).select("doc_id", "theme", F.explode("evidence").alias("e")).select("doc_id", "theme", "e.quote")
    return shifts.verify_quotes(quotes, docs).groupBy("doc_id", "theme").agg(F.count("*").alias("n"), F.count_if("verified").alias("verified"))


@_query(
    f"""WITH {_THEMES}, previous AS (SELECT doc_id, doc_id AS base_doc_id FROM documents), {_SHIFTS}, graded AS ({_SHIFT_ROWS})
SELECT (SELECT count(*) FROM graded WHERE significance = 'HIGH') AS high_shifts, count(*) AS n_documents FROM documents"""
)
def l8_negative_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against itself: no shift of high significance."""
    c = _corpus(spark, sf_dir)
    same = c.docs.select(F.col("doc_id").alias("base_doc_id"), "doc_id")
    high = shifts.detect_shifts(same, c.themes).filter("significance = 'HIGH'").agg(F.count("*").alias("high_shifts"))
    return high.crossJoin(c.docs.agg(F.count("*").alias("n_documents")))


@_query(
    f"""WITH {_THEMES}, {_PREVIOUS}, p AS (SELECT * FROM previous WHERE base_doc_id IS NOT NULL), a AS (SELECT p.doc_id, t.theme, t.stance, t.trajectory, t.emphasis_score FROM p JOIN themes t USING (doc_id)), b AS (SELECT p.doc_id, t.theme, t.stance, t.trajectory, t.emphasis_score FROM p JOIN themes t ON t.doc_id = p.base_doc_id),
j AS (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.theme IS NOT NULL AND b.theme IS NOT NULL THEN 1 ELSE 0 END AS both_, a.stance = b.stance AS s, a.trajectory = b.trajectory AS t, abs(a.emphasis_score - b.emphasis_score) AS e FROM a FULL JOIN b ON a.doc_id = b.doc_id AND a.theme = b.theme),
g AS (SELECT doc_id, count(*) AS n_any, sum(both_) AS n, greatest(sum(both_), 1) AS m, count(*) FILTER (WHERE s) AS ns, count(*) FILTER (WHERE t) AS nt, coalesce(sum(e), 0) AS gap FROM j GROUP BY 1)
SELECT doc_id, round(n / n_any, 4) AS themes_agreement, round(ns / m, 4) AS stance_agreement, round(nt / m, 4) AS trajectory_agreement, round(1 - gap / m / 10, 4) AS emphasis_agreement, 1.0::DOUBLE AS policy_agreement,
  round(n / n_any * 0.3::DOUBLE + ns / m * 0.3::DOUBLE + nt / m * 0.2::DOUBLE + (1 - gap / m / 10) * 0.1::DOUBLE + 0.1::DOUBLE, 4) AS score FROM g"""
)
def l9_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of every document's themes with those of its previous document."""
    c = _corpus(spark, sf_dir)
    pairs = compare.previous_documents(c.docs).filter("base_doc_id is not null")
    own = pairs.join(c.themes, "doc_id").select(*c.themes.columns)
    other = pairs.join(c.themes.withColumnRenamed("doc_id", "base_doc_id"), "base_doc_id").select(*c.themes.columns)
    return shifts.consistency(own, other)


# --- artifact queries ---


@_query(
    f"""WITH {_THEMES}, {_TONES}, {_LATEST.format(limit=10)}
SELECT r.speaker_name, CAST(rn AS INTEGER) AS rn, doc_id, CAST(speech_date AS VARCHAR) AS speech_date, r.title, overall_tone, coalesce((SELECT string_agg(theme, '|' ORDER BY theme) FROM themes t WHERE t.doc_id = r.doc_id), '') AS themes FROM ranked r JOIN tones USING (doc_id)"""
)
def q1_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus.latest(_docs(spark, sf_dir), 10)
    return artifacts.speaker_timeline(c.docs, c.themes).withColumns({"speech_date": F.col("speech_date").cast("string"), "themes": _bar("themes")}).drop("emergent_themes")


@_query(
    f"""WITH {_THEMES}, {_PREVIOUS}, {_CHANGES}, n AS (SELECT doc_id, count(*) AS n FROM changes WHERE severity > 0 GROUP BY 1),
r AS (SELECT d.speaker_name, p.doc_id, p.base_doc_id, CAST(coalesce(n.n, 0) AS INTEGER) AS n_changes, row_number() OVER (PARTITION BY d.speaker_name ORDER BY created_at DESC NULLS LAST, 'cmp_' || substring(sha1(p.doc_id || '|' || p.base_doc_id || '|t_minus_1'), 1, 12) DESC) AS rn FROM previous p JOIN d USING (doc_id) LEFT JOIN n USING (doc_id) WHERE p.base_doc_id IS NOT NULL)
SELECT speaker_name, doc_id, base_doc_id, n_changes, CAST(rn AS INTEGER) AS rn FROM r WHERE rn <= 10"""
)
def q2_recent_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = artifacts.recent_comparisons(_corpus(spark, sf_dir).comparisons(), "t_minus_1")
    return rows.select("speaker_name", "doc_id", "base_doc_id", "n_changes", "rn")


def _observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "phrase_observations").withColumnRenamed("document_id", "doc_id")


@_query(
    """WITH r AS (SELECT d.speaker_name, p.phrase_text, p.semantic_key, p.rarity_score, d.doc_id, d.title, CAST(d.speech_date AS VARCHAR) AS speech_date, row_number() OVER (PARTITION BY d.speaker_name ORDER BY rarity_score DESC NULLS LAST, d.doc_id, semantic_key) AS rn
  FROM phrase_observations p JOIN documents d ON d.doc_id = p.document_id WHERE d.speaker_name IS NOT NULL)
SELECT speaker_name, phrase_text, semantic_key, rarity_score, doc_id, title, speech_date FROM r WHERE rn <= 20 AND rarity_score >= 0.5"""
)
def q3_phrase_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = artifacts.phrase_anomalies(_observed(spark, sf_dir), _docs(spark, sf_dir), 20, 0.5)
    return rows.select("speaker_name", "phrase_text", "semantic_key", "rarity_score", "doc_id", "title", F.col("speech_date").cast("string").alias("speech_date"))


@_query(
    f"""WITH {_THEMES}, {_TONES}, r AS (SELECT *, row_number() OVER (PARTITION BY speaker_name ORDER BY speech_date DESC NULLS FIRST, doc_id DESC) AS k FROM documents WHERE speaker_name IS NOT NULL)
SELECT speaker_name, doc_id, title, CAST(speech_date AS VARCHAR) AS speech_date, overall_tone, coalesce((SELECT string_agg(theme, '|' ORDER BY theme) FROM themes t WHERE t.doc_id = r.doc_id), '') AS themes FROM r JOIN tones USING (doc_id) WHERE k = 1"""
)
def q4_latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus.latest(_docs(spark, sf_dir), 1)
    rows = artifacts.latest_snapshot(c.docs, c.themes)
    return rows.select("speaker_name", "doc_id", "title", F.col("speech_date").cast("string").alias("speech_date"), "overall_tone", F.coalesce(_bar("themes"), F.lit("")).alias("themes"))


@_query(
    f"""WITH {_THEMES}, {_LATEST.format(limit=100)}, x AS (SELECT r.speaker_name, r.rn, r.doc_id, t.theme, t.ordinal, t.emphasis_score FROM ranked r JOIN themes t USING (doc_id)),
p AS (SELECT *, row_number() OVER (PARTITION BY speaker_name, theme ORDER BY rn) AS k FROM x WHERE rn > 1 AND emphasis_score >= 3 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.speaker_name = x.speaker_name AND y.rn = 1 AND y.theme = x.theme)),
g AS (SELECT speaker_name, theme, count(*) AS n, min(rn) AS f, min(ordinal) AS o, string_agg(CASE WHEN k <= 5 THEN CAST(doc_id AS VARCHAR) END, '|' ORDER BY rn) AS supporting FROM p GROUP BY 1, 2)
SELECT speaker_name, theme, CAST(n AS INTEGER) AS historical_mentions, supporting, CAST(row_number() OVER (PARTITION BY speaker_name ORDER BY n DESC, f, o) AS INTEGER) AS rn FROM g"""
)
def q5_orphaned_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus.latest(_docs(spark, sf_dir), 100, keep_themes=True)
    ids = _bar(F.transform("supporting", lambda s: s["doc_id"].cast("string")))
    return artifacts.orphaned_concepts(c.docs, c.themes).select("speaker_name", "theme", "historical_mentions", ids.alias("supporting"), "rn")


@_query(
    f"""WITH {_THEMES}, {_LATEST.format(limit=20)}, x AS (SELECT r.speaker_name, r.rn, r.doc_id, r.speech_date, t.theme, t.ordinal, t.stance, t.trajectory, t.emphasis_score FROM ranked r JOIN themes t USING (doc_id)),
g AS (SELECT speaker_name, theme, min(ordinal) AS o, count(*) AS n, arg_max(doc_id, rn) AS first_doc_id, arg_min(doc_id, rn) AS latest_doc_id, max(rn) AS f, arg_min(emphasis_score, rn) - arg_max(emphasis_score, rn) AS net,
  string_agg(stance, '|' ORDER BY rn DESC) AS stance_path, string_agg(trajectory, '|' ORDER BY rn DESC) AS trajectory_path FROM x GROUP BY 1, 2)
SELECT speaker_name, theme, CAST(n AS INTEGER) AS n, first_doc_id, latest_doc_id, net AS net_emphasis_change, stance_path, trajectory_path, CAST(row_number() OVER (PARTITION BY speaker_name ORDER BY abs(net) DESC, n DESC, f DESC, o) AS INTEGER) AS rn FROM g"""
)
def q6_theme_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = Corpus.latest(_docs(spark, sf_dir), 20)
    rows = artifacts.theme_drift(c.docs, c.themes)
    return rows.select("speaker_name", "theme", "n", "first_doc_id", "latest_doc_id", "net_emphasis_change", _bar("stance_path").alias("stance_path"), _bar("trajectory_path").alias("trajectory_path"), "rn")


def _brief(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    return artifacts.speaker_brief(c.docs, c.themes, c.comparisons(), _observed(spark, sf_dir))


_BRIEF = f"""{_COMPARED}, q4 AS ({_SQL['q4_latest_snapshot']}), q5 AS ({_SQL['q5_orphaned_concepts']}), q6 AS ({_SQL['q6_theme_drift']}),
last AS (SELECT speaker_name, comparison_key, base_doc_id, summary FROM (SELECT d.speaker_name, c.*, 'cmp_' || substring(sha1(c.doc_id || '|' || c.base_doc_id || '|t_minus_1'), 1, 12) AS comparison_key,
    row_number() OVER (PARTITION BY d.speaker_name ORDER BY d.created_at DESC NULLS LAST, comparison_key DESC) AS k FROM compared c JOIN d USING (doc_id) WHERE comparison_type = 't_minus_1') WHERE k = 1),
o AS (SELECT speaker_name, string_agg(theme || ':' || historical_mentions, '|' ORDER BY rn) AS l, string_agg(CASE WHEN rn <= 3 THEN theme END, ', ' ORDER BY rn) AS three FROM q5 GROUP BY 1),
dr AS (SELECT speaker_name, string_agg(theme || ':' || n || ':' || net_emphasis_change, '|' ORDER BY rn) AS l, arg_min(theme || ' with net emphasis change ' || net_emphasis_change, rn) AS top FROM q6 GROUP BY 1),
ph AS (SELECT speaker_name, string_agg(phrase_text, '|' ORDER BY rn) AS l, arg_min(phrase_text, rn) AS top FROM (SELECT d.speaker_name, p.phrase_text, row_number() OVER (PARTITION BY d.speaker_name ORDER BY rarity_score DESC NULLS LAST, d.doc_id, semantic_key) AS rn
  FROM phrase_observations p JOIN documents d ON d.doc_id = p.document_id WHERE d.speaker_name IS NOT NULL) WHERE rn <= 10 GROUP BY 1),
brief AS (SELECT q4.*, last.comparison_key, last.base_doc_id, last.summary, o.l AS orphaned, o.three, dr.l AS drift, dr.top AS top_drift, ph.l AS phrases, ph.top AS top_phrase
  FROM q4 LEFT JOIN last USING (speaker_name) LEFT JOIN o USING (speaker_name) LEFT JOIN dr USING (speaker_name) LEFT JOIN ph USING (speaker_name))"""


@_query(f"WITH {_BRIEF} SELECT speaker_name, doc_id, title, overall_tone, themes, coalesce(comparison_key, '') AS comparison_key, coalesce(CAST(base_doc_id AS VARCHAR), '') AS base_doc_id, coalesce(summary, '') AS summary, coalesce(orphaned, '') AS orphaned, coalesce(drift, '') AS drift, coalesce(phrases, '') AS phrases FROM brief")
def q7_speaker_briefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A brief of every speaker."""

    def listed(c: str, *fields: str) -> Column:
        return F.coalesce(_bar(F.transform(c, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields]))), F.lit(""))

    last = [F.coalesce(F.col(f"latest_t_minus_1.{c}").cast("string"), F.lit("")).alias(c) for c in ("comparison_key", "base_doc_id", "summary")]
    return _brief(spark, sf_dir).select(
        "speaker_name", "latest.doc_id", "latest.title", "latest.overall_tone", F.coalesce(_bar("latest.themes"), F.lit("")).alias("themes"), *last,
        listed("orphaned_concepts_75d", "theme", "historical_mentions").alias("orphaned"), listed("theme_drift_24m", "theme", "n", "net_emphasis_change").alias("drift"), listed("phrase_anomalies", "phrase_text").alias("phrases"),
    )


@_query(
    f"""WITH {_BRIEF} SELECT speaker_name, concat_ws('|', summary, 'Orphaned concepts in 75d window: ' || three, 'Theme drift focus: ' || top_drift, 'Top phrase anomaly: ' || top_phrase) AS highlights FROM brief"""
)
def q8_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentences that answer a question about every speaker."""
    return artifacts.highlights(_brief(spark, sf_dir)).select("speaker_name", _bar("highlights").alias("highlights"))


_HINTS = " ".join(f"WHEN {_any('lower(title)', w)} THEN '{t}'" for t, w in O.QUESTION_HINTS.items())


@_query(f"SELECT doc_id, CASE {_HINTS} END AS theme FROM documents")
def q9_infer_theme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The theme that each title, read as a question, asks for."""
    return _docs(spark, sf_dir).select("doc_id", artifacts.infer_theme(F.col("title")).alias("theme"))


@_query(
    f"""WITH {_LATEST.format(limit=25)}, x AS (SELECT document_key FROM (SELECT *, row_number() OVER (PARTITION BY speaker_name ORDER BY speech_date DESC NULLS LAST, document_key DESC, doc_id DESC) AS r FROM documents WHERE speaker_name IS NOT NULL) WHERE r = 1)
SELECT speaker_name, arg_min(doc_id, rn) AS doc_id, arg_min(document_key, rn) AS document_key FROM ranked WHERE document_key NOT IN (SELECT document_key FROM x) GROUP BY 1"""
)
def q10_latest_other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each speaker's newest document beside the very newest."""
    docs = _docs(spark, sf_dir)
    # the greatest of the order that rn has; nulls are least in a struct, as its nulls last are
    newest = docs.filter("speaker_name is not null").groupBy("speaker_name").agg(F.max(F.struct("speech_date", "document_key", "doc_id"))["document_key"].alias("document_key"))
    return artifacts.latest_other(docs, newest)


@_query(
    f"""WITH {_LATEST.format(limit=100)} SELECT speaker_name, doc_id, CAST(speech_date AS VARCHAR) AS speech_date, CAST(rn AS INTEGER) AS rn FROM ranked WHERE speech_date < DATE '2024-01-01' AND speech_date >= DATE '2024-01-01' - INTERVAL 730 DAY"""
)
def q11_documents_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each speaker's documents of the two years before 2024."""
    rows = artifacts.documents_before(_docs(spark, sf_dir), None, 100, "2024-01-01", 730)
    return rows.select("speaker_name", "doc_id", F.col("speech_date").cast("string").alias("speech_date"), "rn")


@_query(
    """WITH s AS (SELECT document_id, segment_index, min(id) AS id, count(*) AS copies FROM document_segments GROUP BY 1, 2)
SELECT document_id, segment_index, id, copies, CAST(row_number() OVER (PARTITION BY document_id ORDER BY segment_index) AS INTEGER) AS place FROM s"""
)
def q12_segments_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    once = _t(spark, sf_dir, "document_segments").groupBy("document_id", "segment_index").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    return once.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("segment_index")))


@_query(
    f"WITH {_THEMES}, q AS (SELECT doc_id, theme, stance, trajectory, emphasis_score, hedging_level, list_transform(m[1:2], lambda s: substring(s, 1, 280)) AS q FROM themes) SELECT doc_id, theme, stance, trajectory, emphasis_score, hedging_level, array_to_string(q, ' | ') AS evidence FROM q"
)
def s14_theme_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.theme_table(fingerprint.theme_assessments(_docs(spark, sf_dir)))


@_query("SELECT document_id AS doc_id, phrase_text, normalized_phrase, rarity_score, current_count, historical_count, semantic_key FROM phrase_observations")
def s14_phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return artifacts.phrase_table(_observed(spark, sf_dir))


@_query(f"SELECT doc_id, 't_minus_1' AS comparison_type, theme, change_type, strength, uncertainty, summary FROM ({_SQL['c13_theme_changes']})")
def s14_change_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _corpus(spark, sf_dir)
    rows = c.comparisons(_no_phrases(c))
    return artifacts.change_table(rows.filter("comparison_type = 't_minus_1'"))


@_query(
    f"WITH {_THEMES}, {_PREVIOUS} SELECT p.doc_id, p.base_doc_id, x.title AS target_title, CAST(x.speech_date AS VARCHAR) AS target_date, y.title AS base_title, CAST(y.speech_date AS VARCHAR) AS base_date FROM previous p JOIN documents x ON x.doc_id = p.doc_id JOIN documents y ON y.doc_id = p.base_doc_id"
)
def s11_latest_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    pairs = compare.previous_documents(docs).filter("base_doc_id is not null").join(docs.select("doc_id", "created_at"), "doc_id").withColumn("comparison_key", F.col("doc_id").cast("string"))
    rows = store.latest_comparisons(pairs, docs)
    return rows.select("doc_id", "base_doc_id", "target_title", F.col("target_date").cast("string").alias("target_date"), "base_title", F.col("base_date").cast("string").alias("base_date"))


@_query(
    f"WITH {_THEMES} SELECT theme, count(*) AS n_documents, count(DISTINCT speaker_name) AS n_speakers, round(avg(emphasis_score), 4) AS mean_emphasis FROM themes WHERE emphasis_score >= 3 GROUP BY theme"
)
def a1_theme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    themes = fingerprint.theme_assessments(_docs(spark, sf_dir), keep=("doc_id", "speaker_name")).filter("emphasis_score >= 3")
    return themes.groupBy("theme").agg(F.count("*").alias("n_documents"), F.count_distinct("speaker_name").alias("n_speakers"), F.round(F.avg("emphasis_score"), 4).alias("mean_emphasis"))


@_query()
def x2_streamed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fetched pages streamed into a store of their own (every file once), then its documents with what their analysis stored."""
    import uuid

    from chronolex.streaming.incremental import stream_pages

    where = f"{shared_dir(ship(spark))}/chronolex/streamed-{uuid.uuid4().hex}"
    kept = store.Store(spark, where + "/store")
    stream_pages(spark, f"{sf_dir}/source_documents.parque[t]", kept, where + "/progress", form="parquet").awaitTermination()
    columns = ["document_key", "source_url", "title", "speaker_name", "document_type", "source_hash", "word_count"]
    docs = kept.read("documents").select("doc_id", *columns)
    for table, name in (("theme_assessments", "n_themes"), ("phrase_observations", "n_phrases"), ("comparison_results", "n_comparisons"), ("analysis_runs", "n_runs")):
        key = "target_id" if table == "analysis_runs" else "document_key"
        n = kept.read(table).groupBy(F.col(key).alias("document_key")).agg(F.count("*").alias(name))
        docs = docs.join(n, "document_key", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    last = kept.read("comparison_results").filter("comparison_type = 't_minus_1'").select("document_key", "base_doc_id", "summary")
    out = materialize(docs.join(last, "document_key", "left").drop("doc_id"), "streamed")
    remove_folder(spark, where)  # the store was this query's own
    return out


@_query(
    """SELECT query_id, vec_id, label, round(s, 4) AS similarity FROM (SELECT q.vec_id AS query_id, e.vec_id, e.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS s
  FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 20 = 0) q) WHERE s >= 0.2"""
)
def x1_concept_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine similarity of every twentieth concept vector (by id) to all of them, above a threshold."""
    e = spread(_t(spark, sf_dir, "embeddings"), "vec_id")
    found = similarity.similar_vectors(e, e.filter("vec_id % 20 = 0"), 0.2)
    return found.join(e.select("vec_id", "label"), "vec_id").select("query_id", "vec_id", "label", F.round("similarity", 4).alias("similarity"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)



