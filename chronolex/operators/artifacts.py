"""Artifact queries over documents, theme rows, comparisons and phrase observations.

Each is one plan over all speakers; a speaker is a filter on top, which the
planner pushes to the scans. ``docs``: ``doc_id, document_key, speaker_name, title, speech_date,
document_type, created_at, overall_tone`` of fingerprinted documents.

``anchor``: None takes the latest ``limit`` documents whatever their date (the
literal behaviour of the queries); "latest" also asks for the trailing
``window_days`` before the speaker's latest date. Limits come before filters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.ontology import QUESTION_HINTS


def of_speaker(df: DataFrame, speaker: str | None) -> DataFrame:
    return df.filter("speaker_name is not null") if speaker is None else df.filter(F.col("speaker_name") == speaker)


def latest_documents(docs: DataFrame, limit: int = 100, speaker: str | None = None, window_days: int | None = None, anchor: str | None = None) -> DataFrame:
    """The ``limit`` latest documents of each speaker (those without date first), with ``rn`` 1 for the newest by date.

    The order for the limit is date descending with nulls first, then id descending; ``rn`` puts nulls last.
    """
    taken = Window.partitionBy("speaker_name").orderBy(F.col("speech_date").desc_nulls_first(), F.col("doc_id").desc())
    rows = of_speaker(docs, speaker).withColumn("_n", F.row_number().over(taken)).filter(F.col("_n") <= limit).drop("_n")
    if anchor == "latest" and window_days is not None:
        newest = F.max("speech_date").over(Window.partitionBy("speaker_name"))
        rows = rows.withColumn("_newest", newest).filter(F.col("speech_date") >= F.date_sub("_newest", window_days)).drop("_newest")
    order = Window.partitionBy("speaker_name").orderBy(F.col("speech_date").desc_nulls_last(), F.col("document_key").desc(), F.col("doc_id").desc())
    return rows.withColumn("rn", F.row_number().over(order))


def speaker_timeline(docs: DataFrame, themes: DataFrame, limit: int = 10, speaker: str | None = None) -> DataFrame:
    """The latest documents with tone and sorted themes, newest first per speaker."""
    names = themes.groupBy("doc_id").agg(F.array_sort(F.collect_set("theme")).alias("themes"))
    rows = latest_documents(docs, limit, speaker).join(names, "doc_id", "left")
    none = F.array().cast("array<string>")
    # themes beside the ontology's, where the extractor names any
    emergent = F.coalesce("emergent_themes", none) if "emergent_themes" in docs.columns else none
    return rows.select("speaker_name", "rn", "doc_id", "speech_date", "title", "overall_tone", F.coalesce("themes", none).alias("themes"), emergent.alias("emergent_themes"))


def recent_comparisons(comparisons: DataFrame, comparison_type: str | None = None, limit: int = 10, speaker: str | None = None) -> DataFrame:
    """The latest comparisons of each speaker, by ``created_at`` then key."""
    rows = of_speaker(comparisons, speaker)
    if comparison_type:
        rows = rows.filter(F.col("comparison_type") == comparison_type)
    w = Window.partitionBy("speaker_name").orderBy(F.col("created_at").desc_nulls_last(), F.col("comparison_key").desc())
    return rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)


def phrase_anomalies(observations: DataFrame, docs: DataFrame, limit: int = 20, min_rarity: float | None = None, speaker: str | None = None) -> DataFrame:
    """The rarest observed phrases of each speaker with their documents; the rarity floor comes after the limit."""
    about = docs.select("doc_id", "speaker_name", "speech_date", "title")
    rows = of_speaker(observations.drop("speaker_name").join(about, "doc_id"), speaker)
    w = Window.partitionBy("speaker_name").orderBy(F.col("rarity_score").desc_nulls_last(), "doc_id", "semantic_key")
    rows = rows.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)
    return rows if min_rarity is None else rows.filter(F.col("rarity_score") >= min_rarity)


def latest_snapshot(docs: DataFrame, themes: DataFrame, speaker: str | None = None) -> DataFrame:
    """Each speaker's newest document (one without date goes first) and its themes, if any."""
    key = F.struct(F.col("speech_date").isNull().alias("open"), "speech_date", "doc_id")
    newest = of_speaker(docs, speaker).groupBy("speaker_name").agg(F.max_by(F.struct("doc_id", "document_key", "title", "speech_date", "document_type", "overall_tone"), key).alias("d"))
    names = themes.groupBy("doc_id").agg(F.array_sort(F.collect_set("theme")).alias("themes"))
    return newest.select("speaker_name", "d.*").join(names, "doc_id", "left")


def orphaned_concepts(docs: DataFrame, themes: DataFrame, window_days: int = 75, min_emphasis: int = 3, speaker: str | None = None, anchor: str | None = None, limit: int = 100) -> DataFrame:
    """Themes stressed in a speaker's earlier documents that the newest one lacks.

    ``speaker_name, theme, historical_mentions, supporting, rn``: the five newest supporting documents; most mentions first.
    """
    d = latest_documents(docs, limit, speaker, window_days, anchor).select("speaker_name", "doc_id", "speech_date", "rn")
    t = d.join(themes.select("doc_id", "theme", "ordinal", "emphasis_score"), "doc_id")
    newest = t.filter("rn = 1").select("speaker_name", "theme")
    prior = t.filter((F.col("rn") > 1) & (F.col("emphasis_score") >= min_emphasis)).join(newest, ["speaker_name", "theme"], "left_anti")
    # only five rows of each group travel: rank within the group before collecting
    w = Window.partitionBy("speaker_name", "theme").orderBy("rn")
    few = prior.withColumn("k", F.row_number().over(w)).groupBy("speaker_name", "theme").agg(
        F.count("*").cast("int").alias("historical_mentions"), F.min("rn").alias("first_rn"), F.min("ordinal").alias("ordinal"),
        F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("rn", "doc_id", "speech_date", "emphasis_score")))).alias("supporting"),
    )
    order = Window.partitionBy("speaker_name").orderBy(F.desc("historical_mentions"), "first_rn", "ordinal")
    return few.withColumn("rn", F.row_number().over(order)).drop("first_rn", "ordinal")


def theme_drift(docs: DataFrame, themes: DataFrame, theme: str | None = None, window_days: int = 730, limit: int = 20, speaker: str | None = None, anchor: str | None = None) -> DataFrame:
    """Per speaker and theme the first and latest observation, the change of emphasis and the paths.

    At most ``limit`` documents enter a group, so the ordered lists are bounded. Order: greatest change,
    most observations, earliest first observation, ontology.
    """
    d = latest_documents(docs, limit, speaker, window_days, anchor).select("speaker_name", "doc_id", "speech_date", "rn")
    rows = d.join(themes.select("doc_id", "theme", "ordinal", "stance", "trajectory", "emphasis_score"), "doc_id")
    if theme:
        rows = rows.filter(F.col("theme") == theme)
    seen = F.array_sort(F.collect_list(F.struct((-F.col("rn")).alias("at"), "speech_date", "doc_id", "stance", "trajectory", "emphasis_score")))
    g = rows.groupBy("speaker_name", "theme").agg(seen.alias("o"), F.min("ordinal").alias("ordinal"))
    first, last = F.element_at("o", 1), F.element_at("o", -1)
    g = g.select(
        "speaker_name", "theme", "ordinal", F.size("o").alias("n"), first["doc_id"].alias("first_doc_id"), first["speech_date"].alias("first_date"), last["doc_id"].alias("latest_doc_id"), last["speech_date"].alias("latest_date"),
        (last["emphasis_score"] - first["emphasis_score"]).alias("net_emphasis_change"), F.col("o.stance").alias("stance_path"), F.col("o.trajectory").alias("trajectory_path"), first["at"].alias("first_at"),
    )
    order = Window.partitionBy("speaker_name").orderBy(F.desc(F.abs("net_emphasis_change")), F.desc("n"), "first_at", "ordinal")
    return g.withColumn("rn", F.row_number().over(order)).drop("first_at", "ordinal")


def infer_theme(question: Column, hints: dict[str, list[str]] = QUESTION_HINTS) -> Column:
    """The first theme with a hint in the question, or null."""
    low = F.lower(question)
    out = None
    for name, words in hints.items():
        test = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in words])
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def speaker_brief(docs: DataFrame, themes: DataFrame, comparisons: DataFrame, observations: DataFrame, speaker: str | None = None, theme: str | None = None) -> DataFrame:
    """One row per speaker: newest document, latest comparison, orphaned themes, drift and rarest phrases."""
    snap = latest_snapshot(docs, themes, speaker).select("speaker_name", F.struct("doc_id", "title", "speech_date", "overall_tone", "themes").alias("latest"))
    last = recent_comparisons(comparisons, "t_minus_1", 1, speaker).select("speaker_name", F.struct("comparison_key", "base_doc_id", "summary").alias("latest_t_minus_1"))

    def listed(df: DataFrame, fields: list[str], name: str) -> DataFrame:
        return df.groupBy("speaker_name").agg(F.array_sort(F.collect_list(F.struct("rn", *fields))).alias(name))

    orphaned = listed(orphaned_concepts(docs, themes, speaker=speaker), ["theme", "historical_mentions"], "orphaned_concepts_75d")
    drift = listed(theme_drift(docs, themes, theme, speaker=speaker), ["theme", "n", "net_emphasis_change"], "theme_drift_24m")
    phrases = listed(phrase_anomalies(observations, docs, 10, speaker=speaker), ["phrase_text", "rarity_score"], "phrase_anomalies")
    out = snap
    for part in (last, orphaned, drift, phrases):
        out = out.join(part, "speaker_name", "left")
    return out.withColumn("theme_focus", F.lit(theme).cast("string"))


def highlights(brief: DataFrame) -> DataFrame:
    """At most four sentences of each brief: comparison, orphaned themes, top drift, top phrase."""
    names = F.array_join(F.transform(F.slice("orphaned_concepts_75d", 1, 3), lambda x: x["theme"]), ", ")
    top, phrase = F.get("theme_drift_24m", F.lit(0)), F.get("phrase_anomalies", F.lit(0))
    said = F.array_compact(
        F.array(
            F.nullif(F.col("latest_t_minus_1.summary"), F.lit("")),
            F.when(F.size("orphaned_concepts_75d") > 0, F.concat(F.lit("Orphaned concepts in 75d window: "), names)),
            F.when(top.isNotNull(), F.concat(F.lit("Theme drift focus: "), top["theme"], F.lit(" with net emphasis change "), top["net_emphasis_change"].cast("string"))),
            F.when(phrase.isNotNull(), F.concat(F.lit("Top phrase anomaly: "), phrase["phrase_text"])),
        )
    )
    return brief.select("speaker_name", "theme_focus", said.alias("highlights"))


def documents_before(docs: DataFrame, speaker: str | None = None, limit: int = 100, before: str | None = None, within_days: int | None = None) -> DataFrame:
    """A speaker's (else each speaker's) latest ``limit`` documents, then those strictly before a date and not older than ``within_days`` before it."""
    rows = latest_documents(docs, limit, speaker)
    if before:
        rows = rows.filter(F.col("speech_date") < F.lit(before).cast("date"))
        if within_days is not None:
            rows = rows.filter(F.col("speech_date") >= F.date_sub(F.lit(before).cast("date"), within_days))
    return rows


def latest_other(docs: DataFrame, exclude: DataFrame, among: int = 25) -> DataFrame:
    """Each speaker's newest of the latest ``among`` documents whose key isn't excluded (``document_key``)."""
    rows = latest_documents(docs, among).join(exclude.select("document_key"), "document_key", "left_anti")
    return rows.groupBy("speaker_name").agg(F.min_by(F.struct("doc_id", "document_key"), "rn").alias("d")).select("speaker_name", "d.doc_id", "d.document_key")


def latest_versions(fingerprints: DataFrame, prompt_version: str | None = None, model_version: str | None = None) -> DataFrame:
    """Each document's latest fingerprint row, of the given versions if any."""
    rows = fingerprints
    if prompt_version:
        rows = rows.filter(F.col("prompt_version") == prompt_version)
    if model_version:
        rows = rows.filter(F.col("model_version") == model_version)
    w = Window.partitionBy("doc_id").orderBy(F.col("created_at").desc_nulls_last(), F.col("fingerprint_id").desc())
    return rows.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def theme_table(themes: DataFrame) -> DataFrame:
    """Theme rows for display: the first two quotes joined by a bar."""
    return themes.select("doc_id", "theme", "stance", "trajectory", "emphasis_score", "hedging_level", F.array_join(F.transform(F.slice("evidence", 1, 2), lambda e: e["quote"]), " | ").alias("evidence"))


def change_table(comparisons: DataFrame) -> DataFrame:
    """Rows of the comparisons' theme changes for display."""
    rows = comparisons.select("doc_id", "comparison_type", F.explode("theme_changes").alias("c"))
    return rows.select("doc_id", "comparison_type", "c.theme", "c.change_type", "c.strength", "c.uncertainty", "c.summary")


def phrase_table(observations: DataFrame) -> DataFrame:
    """Phrase rows for display."""
    return observations.select("doc_id", "phrase_text", "normalized_phrase", "rarity_score", "current_count", "historical_count", "semantic_key")


def ingest_counts(tried: DataFrame) -> DataFrame:
    """``asked, ingested, skipped`` of URLs with ``skipped``."""
    return tried.agg(F.count("*").alias("asked"), F.count_if(~F.col("skipped")).alias("ingested"), F.count_if("skipped").alias("skipped"))
