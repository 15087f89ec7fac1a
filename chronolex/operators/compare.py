"""Comparison of a document with the speaker's previous one and with trailing windows.

Set-based: all documents of all speakers at once. The previous document is a
range-framed ``max_by`` over (speaker, day), not a join; windows are range
conditions on the speaker's own history. Documents without a speaker are not
compared and are kept out of the shuffles, so nulls never gather in one task.

Inputs: ``docs`` (``doc_id, speaker_name, speech_date, created_at, overall_tone``, one row per
fingerprinted document) and ``themes`` (long form, see fingerprint). Batch
semantics: history is as of the speech date over the whole table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronolex.functions.ontology import HEDGING_LEVELS, STANCES, TRAJECTORIES, UNCERTAINTIES
from chronolex.functions.text import texts
from chronolex.plans.materialize import materialize

#: Comparison types: trailing days of the context (null: all history loaded).
TYPES: dict[str, int | None] = {"t_minus_1": None, "window_75d": 75, "window_24m": 730}
HISTORY_DAYS = 730
TOP_PHRASES = 10


def ordered_delta(order: list[str], before: Column, after: Column) -> Column:
    """Steps from before to after in an order; 0 where either isn't in it."""
    a, b = F.array_position(texts(order), after), F.array_position(texts(order), before)
    return F.when((a > 0) & (b > 0), a - b).otherwise(F.lit(0)).cast("int")


def hedging_score(level: Column) -> Column:
    """0 to 3; an unknown level counts as none."""
    return F.greatest(F.coalesce(F.array_position(texts(HEDGING_LEVELS), level), F.lit(1)) - 1, F.lit(0)).cast("int")


def max_uncertainty(before: Column, after: Column) -> Column:
    """The greater of two; a tie keeps the first, an unknown one counts as medium, none gives medium."""

    def rank(c: Column) -> Column:
        p = F.array_position(texts(UNCERTAINTIES), c)
        return F.when(p > 0, p - 1).otherwise(1)

    b, a = F.nullif(before, F.lit("")), F.nullif(after, F.lit(""))
    return F.when(b.isNull(), F.coalesce(a, F.lit("medium"))).when(a.isNull(), b).when(rank(a) > rank(b), a).otherwise(b)


def theme_changes(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """Adds ``change_type, strength, uncertainty, summary`` and the deltas; unchanged themes drop out.

    ``before`` and ``after`` are structs with ``stance, trajectory, emphasis_score, hedging_level, uncertainty``.
    """
    return graded(pairs, before, after).filter("severity > 0")


def graded(pairs: DataFrame, before: str = "before", after: str = "after") -> DataFrame:
    """:func:`theme_changes` with the unchanged themes, whose ``severity`` is 0."""
    b, a = F.col(before), F.col(after)
    out = (
        pairs.withColumn("stance_delta", ordered_delta(STANCES, b["stance"], a["stance"]))
        .withColumn("trajectory_delta", ordered_delta(TRAJECTORIES, b["trajectory"], a["trajectory"]))
        .withColumn("emphasis_delta", a["emphasis_score"] - b["emphasis_score"])
        .withColumn("hedging_delta", hedging_score(a["hedging_level"]) - hedging_score(b["hedging_level"]))
    )
    s, t, e, h = (F.col(c) for c in ("stance_delta", "trajectory_delta", "emphasis_delta", "hedging_delta"))
    louder, hedged = F.abs(e) >= 2, h != 0

    def steps(d: Column) -> Column:
        return F.when(d != 0, 1 + F.least(F.abs(d), F.lit(2))).otherwise(0)

    severity = steps(s) + steps(t) + louder.cast("int") + hedged.cast("int")
    kind = (
        F.when(s > 0, "more_concerned").when(s < 0, "more_optimistic").when(t > 0, "worse_trajectory").when(t < 0, "better_trajectory").when(louder, "emphasis_shift").otherwise("mixed_shift")
    )
    said = F.concat_ws(
        "; ",
        F.when(s != 0, F.concat(F.lit("stance moved from "), b["stance"], F.lit(" to "), a["stance"])),
        F.when(t != 0, F.concat(F.lit("trajectory moved from "), b["trajectory"], F.lit(" to "), a["trajectory"])),
        F.when(louder, F.concat(F.lit("emphasis "), F.when(e > 0, "increased").otherwise("decreased"), F.lit(" from "), b["emphasis_score"].cast("string"), F.lit(" to "), a["emphasis_score"].cast("string"))),
        F.when(hedged, F.concat(F.lit("language became "), F.when(h > 0, "more hedged").otherwise("less hedged"))),
    )
    return (
        out.withColumn("severity", severity)
        .withColumn("change_type", kind)
        .withColumn("strength", F.when(F.col("severity") >= 3, "high").when(F.col("severity") == 2, "moderate").otherwise("low"))
        .withColumn("uncertainty", max_uncertainty(b["uncertainty"], a["uncertainty"]))
        .withColumn("summary", said)
    )


def _days(docs: DataFrame) -> DataFrame:
    return docs.filter("speaker_name is not null").withColumn("day", F.datediff("speech_date", F.lit("1970-01-01").cast("date")))


def previous_documents(docs: DataFrame, within_days: int = HISTORY_DAYS) -> DataFrame:
    """``doc_id, base_doc_id``: the speaker's latest strictly earlier document within the days before; null if none.

    Of several on one day the later ``created_at``, then the greater id. A document without
    date takes its speaker's latest other document.
    """
    d = _days(docs).select("doc_id", "speaker_name", "day", "created_at")
    place = F.struct("day", "created_at", "doc_id")
    # by days first: a speaker has no more rows in the window than there are days
    days = d.filter("day is not null").groupBy("speaker_name", "day").agg(F.max(place).alias("last"))
    w = Window.partitionBy("speaker_name").orderBy("day").rangeBetween(-within_days, -1)
    based = days.select("speaker_name", "day", F.max("last").over(w)["doc_id"].alias("base_doc_id"))
    dated = d.filter("day is not null").join(based, ["speaker_name", "day"])
    undated = d.filter("day is null").select("doc_id", "speaker_name")
    # any dated document comes first; else the greatest other undated one, so the two greatest are enough
    newest = d.filter("day is not null").groupBy("speaker_name").agg(F.max(place)["doc_id"].alias("dated"))
    by_id = Window.partitionBy("speaker_name").orderBy(F.desc("doc_id"))
    two = undated.withColumn("n", F.row_number().over(by_id)).filter("n <= 2").groupBy("speaker_name")
    two = two.agg(F.max(F.when(F.col("n") == 1, F.col("doc_id"))).alias("one"), F.max(F.when(F.col("n") == 2, F.col("doc_id"))).alias("two"))
    undated = undated.join(newest, "speaker_name", "left").join(two, "speaker_name", "left")
    other = F.coalesce("dated", F.when(F.col("one") != F.col("doc_id"), F.col("one")).otherwise(F.col("two")))
    undated = undated.select("doc_id", other.alias("base_doc_id"))
    return dated.select("doc_id", "base_doc_id").unionByName(undated)


_ASSESSED = ("stance", "trajectory", "emphasis_score", "hedging_level", "uncertainty")


def _assessed(themes: DataFrame, name: str) -> DataFrame:
    """Theme rows as a struct, with the first two quotes where the rows have evidence."""
    quotes = [F.slice("evidence", 1, 2).alias("evidence")] if "evidence" in themes.columns else []
    return themes.select(F.col("doc_id").alias("_d"), "theme", F.struct(*_ASSESSED, *quotes).alias(name))


def _paired(base: DataFrame, themes: DataFrame) -> DataFrame:
    """``doc_id, base_doc_id, theme, after, before``: a document's themes with those of its base, null where that lacks them."""
    after = base.join(_assessed(themes, "after"), F.col("doc_id") == F.col("_d")).drop("_d")
    before = _assessed(themes, "before").select(F.col("_d").alias("base_doc_id"), "theme", "before")
    return after.join(before, ["base_doc_id", "theme"], "left").select("doc_id", "base_doc_id", "theme", "after", "before")


def compare_to_previous(docs: DataFrame, themes: DataFrame, within_days: int = HISTORY_DAYS) -> DataFrame:
    """Theme changes of every document against its previous one: ``doc_id, base_doc_id, theme, before, after, ...``."""
    base = previous_documents(docs, within_days).filter("base_doc_id is not null")
    return theme_changes(_paired(base, themes).filter("before is not null"))


def new_themes(docs: DataFrame, themes: DataFrame, within_days: int = HISTORY_DAYS) -> DataFrame:
    """``doc_id, theme``: themes that the previous document lacks; all themes where there is none."""
    base = previous_documents(docs, within_days)
    mine = base.join(themes.select("doc_id", "theme"), "doc_id")
    theirs = themes.select(F.col("doc_id").alias("base_doc_id"), "theme")
    return mine.join(theirs, ["base_doc_id", "theme"], "left_anti").select("doc_id", "theme")


def _orphaned(docs: DataFrame, themes: DataFrame, reaches: list[int], min_emphasis: int) -> DataFrame:
    """``doc_id, theme, within``: themes of emphasis that stood in a reach (days) before and the document lacks; ``within`` lists the reaches.

    Per (speaker, theme) range frames over the days say whether the theme stood in the windows,
    so histories are never multiplied out and no speaker has more rows there than there are days.
    """
    d = _days(docs).filter("day is not null").select("doc_id", "speaker_name", "day")
    loud = themes.filter(F.col("emphasis_score") >= min_emphasis).select("doc_id", "theme").distinct()
    seen = d.join(loud, "doc_id").groupBy("speaker_name", "theme", "day").agg(F.count("*").alias("n"))
    names = seen.select("speaker_name", "theme").distinct()
    # every day of a speaker asks for each theme the speaker ever stressed
    asks = d.select("speaker_name", "day").distinct().join(names, "speaker_name").select("speaker_name", "theme", "day", F.lit(0).cast("long").alias("n"), F.lit(True).alias("ask"))
    both = asks.unionByName(seen.select("speaker_name", "theme", "day", "n", F.lit(False).alias("ask")))
    w = Window.partitionBy("speaker_name", "theme").orderBy("day")
    within = F.array_compact(F.array(*[F.when(F.sum("n").over(w.rangeBetween(-r, -1)) > 0, F.lit(r)) for r in reaches]))
    due = both.withColumn("within", within).filter("ask and size(within) > 0").select("speaker_name", "theme", "day", "within")
    told = d.join(due, ["speaker_name", "day"])
    return told.select("doc_id", "theme", "within").join(themes.select("doc_id", "theme"), ["doc_id", "theme"], "left_anti")


def orphaned_themes(docs: DataFrame, themes: DataFrame, window_days: int | None = None, min_emphasis: int = 3, within_days: int = HISTORY_DAYS) -> DataFrame:
    """``doc_id, theme``: themes of emphasis in the history that a document no longer has.

    History: the speaker's strictly earlier documents of ``window_days`` (else ``within_days``).
    """
    return _orphaned(docs, themes, [min(window_days or within_days, within_days)], min_emphasis).select("doc_id", "theme")


#: What a comparison carries of each changed theme.
CHANGE = ("theme", "change_type", "strength", "uncertainty", "summary")


def comparison_results(docs: DataFrame, themes: DataFrame, phrases: DataFrame, types: dict[str, int | None] = TYPES) -> DataFrame:
    """One row per document with history and comparison type.

    ``doc_id, base_doc_id, comparison_type, window_days, n_changes, theme_changes, new_themes, orphaned, phrase_anomalies, n_phrases, summary, comparison_key``.
    All types share the previous document and the ten rarest phrases of the document (``phrases``: its
    phrase signals); only the context of the orphaned themes differs. Changes carry up to two quotes of
    either side where ``themes`` has evidence. The previous documents are found once, their themes are met
    once, and all windows come from one pass over the days.
    """
    base = materialize(previous_documents(docs).filter("base_doc_id is not null"), "previous")
    with_quotes = "evidence" in themes.columns
    met = graded(_paired(base, themes))
    quotes = [F.col(f"{side}.evidence").alias(f"evidence_{side}") for side in ("before", "after")] if with_quotes else []
    known = F.col("before").isNotNull()
    per_doc = met.groupBy("doc_id").agg(
        F.array_sort(F.collect_list(F.when(known & (F.col("severity") > 0), F.struct(*CHANGE, *quotes)))).alias("theme_changes"),
        F.array_sort(F.collect_set(F.when(~known, F.col("theme")))).alias("new_themes"),
    )
    reach = {k: min(days or HISTORY_DAYS, HISTORY_DAYS) for k, days in types.items()}
    reaches = sorted(set(reach.values()))
    lost = [F.array_sort(F.collect_set(F.when(F.array_contains("within", r), F.col("theme")))).alias(f"_{r}") for r in reaches]
    gone = _orphaned(docs, themes, reaches, 3).groupBy("doc_id").agg(*lost)
    # ranks go by the unrounded rarity, so they also order the rounded one with its ties
    rare = F.array_sort(F.collect_list(F.struct("rank", "phrase_text", "semantic_key", "rarity_score")))
    rarest = phrases.filter(F.col("rank") <= TOP_PHRASES).groupBy("doc_id").agg(rare.alias("phrase_anomalies"))
    rows = base.join(per_doc, "doc_id", "left").join(rarest, "doc_id", "left").join(gone, "doc_id", "left")
    filled = {c: F.coalesce(c, F.array().cast(rows.schema[c].dataType)) for c in ("theme_changes", "new_themes", "phrase_anomalies", *[f"_{r}" for r in reaches])}
    kinds = F.array(*[F.struct(F.lit(k).alias("comparison_type"), F.lit(w).cast("int").alias("window_days"), F.col(f"_{reach[k]}").alias("orphaned")) for k, w in types.items()])
    rows = rows.withColumns(filled).select("*", F.explode(kinds).alias("_k")).select("*", "_k.*")
    rows = rows.withColumns({"n_changes": F.size("theme_changes"), "n_phrases": F.size("phrase_anomalies")})
    return rows.select(
        "doc_id", "base_doc_id", "comparison_type", "window_days", "n_changes", "theme_changes", "new_themes", "orphaned", "phrase_anomalies", "n_phrases", summary_line(F.col("n_changes"), F.size("new_themes"), F.size("orphaned"), F.col("n_phrases")).alias("summary"),
        F.concat(F.lit("cmp_"), F.substring(F.sha1(F.concat_ws("|", F.col("doc_id").cast("string"), F.col("base_doc_id").cast("string"), "comparison_type")), 1, 12)).alias("comparison_key"),
    )


def summary_line(changes: Column, fresh: Column, orphaned: Column, phrases: Column) -> Column:
    def bit(n: Column, what: str) -> Column:
        return F.when(n > 0, F.concat(n.cast("string"), F.lit(" " + what)))

    said = F.concat_ws("; ", bit(changes, "theme changes vs baseline"), bit(fresh, "new themes"), bit(orphaned, "orphaned concepts"), bit(phrases, "phrase anomalies"))
    return F.when(said == "", "No material changes detected").otherwise(said)


def merged_notes(target: Column, base: Column) -> Column:
    """The target's notes and those of the base that it lacks."""
    return F.concat(target, F.array_except(F.coalesce(base, F.array().cast("array<string>")), target))


def window_summaries(docs: DataFrame, themes: DataFrame, window_days: int, label: str) -> DataFrame:
    """``doc_id, summary``: dominant themes and tone of each document's trailing window.

    Counted by range frames per (speaker, theme) and (speaker, tone). Ties go to the theme or tone
    first seen in the window (latest document first), then to the ontology's order.
    """
    toned = _days(docs).filter("day is not null").select("doc_id", "speaker_name", "day", "overall_tone")
    d = toned.drop("overall_tone")
    days = d.select("speaker_name", "day").distinct()

    def counted(values: DataFrame, name: str) -> DataFrame:
        """Per day and value: how often it stood in the window before, and the latest day it did."""
        per_day = values.groupBy("speaker_name", name, "day").agg(F.count("*").alias("n"), F.min("ordinal").alias("ordinal"))
        names = per_day.groupBy("speaker_name", name).agg(F.min("ordinal").alias("ordinal"))
        asks = days.join(names, "speaker_name").select("speaker_name", name, "day", "ordinal", F.lit(0).cast("long").alias("n"), F.lit(True).alias("ask"))
        both = asks.unionByName(per_day.select("speaker_name", name, "day", "ordinal", "n", F.lit(False).alias("ask")))
        w = Window.partitionBy("speaker_name", name).orderBy("day").rangeBetween(-window_days, -1)
        stood = F.max(F.when(F.col("n") > 0, F.col("day"))).over(w)
        return both.withColumn("times", F.sum("n").over(w)).withColumn("seen", stood).filter("ask and times > 0")

    said = counted(d.join(themes.select("doc_id", "theme", "ordinal"), "doc_id"), "theme")
    tones = counted(toned.filter("overall_tone <> ''").withColumn("ordinal", F.lit(0)), "overall_tone")
    order = F.struct((-F.col("times")).alias("t"), (-F.col("seen")).alias("d"), "ordinal")
    top = said.groupBy("speaker_name", "day").agg(F.slice(F.array_sort(F.collect_list(F.struct(order.alias("o"), "theme"))), 1, 3).alias("top"))
    tone = tones.groupBy("speaker_name", "day").agg(F.min(F.struct((-F.col("times")).alias("t"), (-F.col("seen")).alias("d"), F.col("overall_tone").alias("tone"))).alias("m"))
    text = F.concat(
        F.lit(label + ": dominant themes "), F.coalesce(F.nullif(F.array_join(F.transform("top", lambda x: x["theme"]), ", "), F.lit("")), F.lit("none")),
        F.lit("; dominant tone "), F.coalesce("m.tone", F.lit("unknown")), F.lit("."),
    )
    joined = d.join(top, ["speaker_name", "day"], "left").join(tone, ["speaker_name", "day"], "left")
    empty = F.col("top").isNull() & F.col("m").isNull()
    return joined.select("doc_id", F.when(empty, f"No documents available for {label}.").otherwise(text).alias("summary"))
