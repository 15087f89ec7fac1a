"""The earlier family of shift operators: typed, graded shifts between two fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolex.functions.ontology import STANCES, TRAJECTORIES
from chronolex.operators.compare import hedging_score, ordered_delta

HIGH_IMPACT = ["INFLATION", "POLICY_STANCE", "LABOR_MARKETS"]
#: Weights of the agreement score.
WEIGHTS = {"themes": 0.3, "stance": 0.3, "trajectory": 0.2, "emphasis": 0.1, "policy": 0.1}


def shift_type(stance: Column, trajectory: Column, emphasis: Column, hedging: Column) -> Column:
    hawkish = stance + trajectory - hedging
    return (
        F.when(emphasis >= 3, "NEW_EMPHASIS").when(emphasis <= -3, "REDUCED_EMPHASIS").when(hawkish >= 2, "HAWKISH_DRIFT").when(hawkish <= -2, "DOVISH_PIVOT")
        .when(F.abs(hedging) >= 2, "CONVICTION_CHANGE").when((stance != 0) | (trajectory != 0), "SUBTLE_SHIFT").otherwise("MINOR_CHANGE")
    )


def significance(kind: Column, theme: Column, stance: Column, trajectory: Column, emphasis: Column) -> Column:
    size = F.abs(stance) + F.abs(trajectory) + F.abs(emphasis) / 3
    drift = kind.isin("HAWKISH_DRIFT", "DOVISH_PIVOT", "ORPHANED_CONCEPT")
    middle = kind.isin("NEW_EMPHASIS", "CONVICTION_CHANGE")
    return (
        F.when(drift, F.when(theme.isin(HIGH_IMPACT) | (size >= 3), "HIGH").otherwise("MEDIUM"))
        .when(middle, F.when(size >= 4, "HIGH").otherwise("MEDIUM"))
        .otherwise(F.when(size >= 2, "MEDIUM").otherwise("LOW"))
    )


def interpretation(before: dict[str, Column], after: dict[str, Column], s: Column, t: Column, e: Column, h: Column) -> Column:
    """What moved, in words: a sentence each for stance, trajectory, emphasis (by 2 or more) and hedging."""

    def span(c: str) -> Column:
        return F.concat(F.lit(" (from '"), before[c], F.lit("' to '"), after[c], F.lit("')"))

    def way(d: Column, up: str, down: str) -> Column:
        return F.when(d > 0, up).otherwise(down)

    louder = F.concat(F.lit("Emphasis "), way(e, "increased", "decreased"), F.lit(" from "), before["emphasis_score"].cast("string"), F.lit("/10 to "), after["emphasis_score"].cast("string"), F.lit("/10"))
    return F.concat_ws(
        ". ",
        F.when(s != 0, F.concat(F.lit("Stance shifted "), way(s, "more concerned", "more optimistic"), span("stance"))),
        F.when(t != 0, F.concat(F.lit("Trajectory viewed as "), way(t, "worsening", "improving"), span("trajectory"))),
        F.when(F.abs(e) >= 2, louder),
        F.when(h != 0, F.concat(F.lit("Hedging "), way(h, "increased", "decreased"), span("hedging_level"))),
    )


def detect_shifts(pairs: DataFrame, themes: DataFrame) -> DataFrame:
    """All shifts of ``pairs`` (``base_doc_id, doc_id``): changed, orphaned and new themes.

    ``base_doc_id, doc_id, theme, shift_type, significance, interpretation`` (the last for changed themes); orphaned themes had emphasis 3 or more
    in the base (HIGH from 6), new themes have it in the target.
    """
    cols = ["stance", "trajectory", "emphasis_score", "hedging_level"]
    t = themes.select("doc_id", "theme", *cols)
    b = t.select(F.col("doc_id").alias("base_doc_id"), "theme", *[F.col(c).alias("b_" + c) for c in cols])
    after, before = pairs.join(t, "doc_id"), pairs.join(b, "base_doc_id")
    both = after.join(b, ["base_doc_id", "theme"])
    d = both.select(
        "base_doc_id", "doc_id", "theme", ordered_delta(STANCES, F.col("b_stance"), F.col("stance")).alias("s"), ordered_delta(TRAJECTORIES, F.col("b_trajectory"), F.col("trajectory")).alias("t"),
        (F.col("emphasis_score") - F.col("b_emphasis_score")).alias("e"), (hedging_score(F.col("hedging_level")) - hedging_score(F.col("b_hedging_level"))).alias("h"),
        *cols, *["b_" + c for c in cols],
    )
    moved = d.filter("s <> 0 or t <> 0 or abs(e) >= 2 or h <> 0").withColumn("shift_type", shift_type(F.col("s"), F.col("t"), F.col("e"), F.col("h")))
    moved = moved.withColumn("significance", significance(F.col("shift_type"), F.col("theme"), F.col("s"), F.col("t"), F.col("e")))

    sides = [{c: F.col(side + c) for c in cols} for side in ("b_", "")]
    moved = moved.withColumn("interpretation", interpretation(*sides, *[F.col(c) for c in "steh"]))

    def one_sided(rows: DataFrame, other: DataFrame, keys: list[str], emphasis: str, kind: str) -> DataFrame:
        only = rows.filter(F.col(emphasis) >= 3).join(other.select(*keys, "theme"), [*keys, "theme"], "left_anti")
        return only.select("base_doc_id", "doc_id", "theme", F.lit(kind).alias("shift_type"), F.when(F.col(emphasis) >= 6, "HIGH").otherwise("MEDIUM").alias("significance"), F.lit(None).cast("string").alias("interpretation"))

    orphaned = one_sided(before, t, ["doc_id"], "b_emphasis_score", "ORPHANED_CONCEPT")
    new = one_sided(after, b, ["base_doc_id"], "emphasis_score", "NEW_THEME")
    return moved.select(*new.columns).unionByName(orphaned).unionByName(new)


def ordered_shifts(shifts: DataFrame) -> DataFrame:
    """High before medium before low, then by theme."""
    rank = F.when(F.col("significance") == "HIGH", 0).when(F.col("significance") == "MEDIUM", 1).otherwise(2)
    return shifts.orderBy(rank, "theme", "shift_type", "doc_id")


def verify_quotes(quotes: DataFrame, documents: DataFrame, text_col: str = "normalized_text") -> DataFrame:
    """Adds ``verified``: the stripped quote stands in its document's text."""
    text = documents.select("doc_id", F.col(text_col).alias("_text"))
    quote = F.regexp_replace("quote", r"(?U)^\s+|\s+$", "")
    return quotes.join(text, "doc_id", "left").withColumn("verified", F.coalesce(F.contains("_text", quote), F.lit(False))).drop("_text")


def consistency(one: DataFrame, two: DataFrame, policy: DataFrame | None = None) -> DataFrame:
    """How far two extractions of the same documents agree: per document the parts and the weighted score.

    ``policy`` (``doc_id, policy_match``) says where both read the same policy direction; without it all do.
    """
    cols = ["stance", "trajectory", "emphasis_score"]
    a = one.select("doc_id", "theme", *[F.col(c).alias("a_" + c) for c in cols], F.lit(1).alias("in_a"))
    b = two.select("doc_id", "theme", *[F.col(c).alias("b_" + c) for c in cols], F.lit(1).alias("in_b"))
    both = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()

    def same(c: str) -> Column:
        return F.sum(F.when(both & (F.col("a_" + c) == F.col("b_" + c)), 1).otherwise(0))

    gap = F.sum(F.when(both, F.abs(F.col("a_emphasis_score") - F.col("b_emphasis_score"))).otherwise(0))
    parts = a.join(b, ["doc_id", "theme"], "full").groupBy("doc_id").agg(
        F.count("*").alias("n_any"), F.sum(both.cast("int")).alias("n_both"), same("stance").alias("n_stance"), same("trajectory").alias("n_trajectory"), gap.alias("gap")
    )
    parts = parts.join(policy, "doc_id", "left") if policy is not None else parts.withColumn("policy_match", F.lit(True))
    n = F.greatest("n_both", F.lit(1))
    score = {
        "themes": F.col("n_both") / F.greatest("n_any", F.lit(1)), "stance": F.col("n_stance") / n, "trajectory": F.col("n_trajectory") / n,
        "emphasis": 1 - F.col("gap") / n / 10, "policy": F.coalesce(F.col("policy_match").cast("int"), F.lit(0)).cast("double"),
    }
    total = sum((score[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    return parts.select("doc_id", *[F.round(v, 4).alias(k + "_agreement") for k, v in score.items()], F.round(total, 4).alias("score"))
