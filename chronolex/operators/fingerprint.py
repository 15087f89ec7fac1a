"""Semantic fingerprints: per document and theme the stance, trajectory, emphasis, hedging and evidence.

Long form throughout: one row per (document, theme). No shuffle: the ontology
is a literal, its themes are exploded next to each document and everything is
computed from the row's own sentences.

Documents with null text have no themes; their header row has the draft notes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions.ontology import DEFAULT, DRAFT_NOTE, NO_THEME_NOTE, Ontology
from chronolex.functions.text import count_all, count_of, has_any, sentences, texts

QUOTE_CHARS, QUOTES, HEDGES_KEPT, TONE_SENTENCES = 280, 3, 6, 20


def stance(text: Column, o: Ontology) -> Column:
    """From very_optimistic to very_concerned, by the balance of two word lists in (lower-case) text."""
    up, down = count_all(text, o.stance_up), count_all(text, o.stance_down)
    return (
        F.when(down - up >= 3, "very_concerned").when(down > up, "concerned").when(up - down >= 3, "very_optimistic").when(up > down, "optimistic").otherwise("neutral")
    )


def trajectory(text: Column, o: Ontology) -> Column:
    up, down = count_all(text, o.trajectory_up), count_all(text, o.trajectory_down)
    return F.when(down > up, "worsening").when(up >= down + 2, "improving").when(down > 0, "stable_negative").otherwise("stable")


def hedges(text: Column, o: Ontology) -> Column:
    """The first hedging words, in alphabetical order, that stand in (lower-case) text."""
    return F.slice(F.filter(texts(sorted(o.hedges)), lambda h: F.contains(text, h)), 1, HEDGES_KEPT)


def hedging_level(found: Column) -> Column:
    n = F.size(found)
    return F.when(n == 0, "none").when(n <= 2, "light").when(n <= 4, "moderate").otherwise("heavy")


def tone(sents: Column, o: Ontology) -> Column:
    """cautious, confident or measured, from the first sentences."""
    start = F.lower(F.array_join(F.slice(sents, 1, TONE_SENTENCES), " "))
    return F.when(has_any(start, o.cautious), "cautious").when(has_any(start, o.confident), "confident").otherwise("measured")


def evidence(matched: Column, text: Column) -> Column:
    """The first matched sentences with their first place in the text (null where cut text isn't found)."""

    def quote(s: Column) -> Column:
        q = F.substring(s, 1, QUOTE_CHARS)
        at = F.nullif(F.instr(text, q), F.lit(0)) - 1
        return F.struct(q.alias("quote"), at.alias("start_char"), (at + F.length(q)).alias("end_char"))

    return F.transform(F.slice(matched, 1, QUOTES), quote)


def _once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that filters above it cannot make the planner compute twice."""
    return df.withColumn(name, F.explode(F.array(value)))


def theme_assessments(documents: DataFrame, text_col: str = "normalized_text", keep: tuple[str, ...] = ("doc_id",), ontology: Ontology = DEFAULT) -> DataFrame:
    """One row per document and theme that is mentioned at least twice.

    ``keep`` columns, then ``theme, ordinal, hits, matched, stance, trajectory, emphasis_score,
    key_hedges, hedging_level, confidence, uncertainty, evidence``.
    """
    o = ontology
    table = F.array(*[F.struct(F.lit(i).alias("ordinal"), F.lit(t).alias("theme"), texts(k).alias("keywords")) for i, (t, k) in enumerate(o.themes.items())])
    base = documents.select(*keep, F.col(text_col).alias("_text")).withColumn(
        "_sents", F.transform(sentences(F.col("_text")), lambda s: F.struct(s.alias("said"), F.lower(s).alias("low")))
    )
    each = base.withColumn("_t", F.explode(table)).select(*keep, "_text", "_sents", "_t.*")
    pairs = F.filter("_sents", lambda s: F.exists("keywords", lambda k: F.contains(s["low"], k)))
    each = _once(each, "_pairs", pairs).filter(F.size("_pairs") > 0)
    each = _once(each, "_joined", F.array_join("_pairs.low", " ")).withColumn("_matched", F.col("_pairs.said")).withColumn("matched", F.size("_pairs"))
    # No keyword reaches over the end of a sentence, so all hits of the text lie in the matched sentences;
    # each of these holds one, so two matched sentences are two hits: hits alone decide.
    occurrences = F.aggregate("keywords", F.lit(0), lambda n, k: n + count_of(F.col("_joined"), k))
    each = _once(each, "hits", occurrences).filter("hits >= 2")
    few = F.col("matched") < 3
    return (
        each.withColumn("key_hedges", hedges(F.col("_joined"), o))
        .withColumn("stance", stance(F.col("_joined"), o))
        .withColumn("trajectory", trajectory(F.col("_joined"), o))
        .withColumn("emphasis_score", F.greatest(F.lit(1), F.least(F.lit(10), F.col("matched") + F.least("hits", F.lit(4)))))
        .withColumn("hedging_level", hedging_level(F.col("key_hedges")))
        .withColumn("confidence", F.when(few, "low").otherwise("moderate"))
        .withColumn("uncertainty", F.when(few, "high").otherwise("medium"))
        .withColumn("evidence", evidence(F.col("_matched"), F.col("_text")))
        .select(*keep, "theme", "ordinal", "hits", "matched", "stance", "trajectory", "emphasis_score", "key_hedges", "hedging_level", "confidence", "uncertainty", "evidence")
    )


def headers(documents: DataFrame, themes: DataFrame | None = None, text_col: str = "normalized_text", key: str = "doc_id", ontology: Ontology = DEFAULT) -> DataFrame:
    """One row per document: ``key, overall_tone, uncertainty_notes`` (the second note where ``themes`` has no row)."""
    base = documents.select(key, tone(sentences(F.coalesce(F.col(text_col), F.lit(""))), ontology).alias("overall_tone"))
    if themes is None:
        themes = theme_assessments(documents, text_col, (key,), ontology)
    with_any = themes.select(F.col(key).alias("_k")).distinct()
    joined = base.join(with_any, base[key] == with_any["_k"], "left")
    notes = F.array_compact(F.array(F.lit(DRAFT_NOTE), F.when(F.col("_k").isNull(), NO_THEME_NOTE)))
    return joined.select(base[key], "overall_tone", notes.alias("uncertainty_notes"))


ASSESSMENT = (
    "struct<stance:string,trajectory:string,emphasis_score:int,hedging_level:string,key_hedges:array<string>,confidence:string,uncertainty:string,evidence:array<string>>"
)
RESPONSE = f"struct<themes:map<string,{ASSESSMENT}>,emergent_themes:array<string>,overall_tone:string,uncertainty_notes:array<string>>"


def parse_response(raw: Column) -> Column:
    """The JSON of a model's answer, with or without a fence; null if it is no such JSON."""
    fenced = F.regexp_extract(raw, r"(?s)```json(.*?)(?:```|$)", 1)
    plain = F.regexp_extract(raw, r"(?s)```(.*?)(?:```|$)", 1)
    body = F.when(F.contains(raw, F.lit("```json")), fenced).when(F.contains(raw, F.lit("```")), plain).otherwise(raw)
    return F.from_json(F.trim(body), RESPONSE, {"mode": "PERMISSIVE"})


def response_themes(answers: DataFrame, key: str = "doc_id", raw_col: str = "raw_response") -> DataFrame:
    """Theme rows of the answers that are valid as a whole.

    An answer counts only if every theme has stance, trajectory, emphasis (1 to 10), hedging level
    and confidence; one bad theme makes the document fall back (see :func:`with_fallback`).
    """
    parsed = answers.select(key, parse_response(F.col(raw_col)).alias("r")).filter("r.themes is not null")

    def sound(_k: Column, v: Column) -> Column:
        needed = [v[c].isNotNull() for c in ("stance", "trajectory", "hedging_level", "confidence")]
        return needed[0] & needed[1] & needed[2] & needed[3] & F.coalesce(v["emphasis_score"].between(1, 10), F.lit(False))

    whole = parsed.filter(F.size(F.map_filter("r.themes", sound)) == F.size("r.themes"))
    return whole.select(key, F.explode("r.themes").alias("theme", "v")).select(
        key, "theme", "v.stance", "v.trajectory", "v.emphasis_score", "v.hedging_level", F.coalesce("v.key_hedges", F.array().cast("array<string>")).alias("key_hedges"),
        "v.confidence", F.coalesce("v.uncertainty", F.lit("medium")).alias("uncertainty"), F.coalesce("v.evidence", F.array().cast("array<string>")).alias("quotes"),
    )


def with_fallback(primary: DataFrame, valid_keys: DataFrame, heuristic: DataFrame, key: str = "doc_id") -> DataFrame:
    """Primary theme rows where the document's answer is valid, heuristic rows elsewhere; ``extractor`` says which."""
    columns = [c for c in heuristic.columns if c in primary.columns]
    rest = heuristic.join(valid_keys.select(key).distinct(), key, "left_anti")
    return primary.select(*columns, F.lit("model").alias("extractor")).unionByName(rest.select(*columns, F.lit("heuristic").alias("extractor")))


#: Note of a document whose answer could not be used (fixed value).
FALLBACK_NOTE = "Primary extractor failed and heuristic fallback was used: "


def fallback_notes(answers: DataFrame, valid_keys: DataFrame, key: str = "doc_id", raw_col: str = "raw_response") -> DataFrame:
    """``key, note`` of the documents that fall back, with the kind of failure: no JSON of themes, or a theme that isn't valid."""
    kind = F.when(parse_response(F.col(raw_col))["themes"].isNull(), "JSONDecodeError").otherwise("ValidationError")
    return answers.join(valid_keys.select(key).distinct(), key, "left_anti").select(key, F.concat(F.lit(FALLBACK_NOTE), kind).alias("note"))


def render_prompt(template: str, values: dict[str, Column]) -> Column:
    """The template with each ``{name}`` replaced; nulls become empty."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out
