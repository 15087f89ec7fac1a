"""Phrase signals: rare runs of two to five words against the same speaker's own history.

Two ways, with the same results. The runs of a document are an order of
magnitude more than its words, so where all texts of a speaker fit into a task
(:data:`HOT_CHARS`) the texts travel, once, and counts and histories are found by
array operations in one pass over the speaker's runs. Texts of speakers beyond that size stay
where they are and their runs travel, as hashes with their place; histories
are summed by day first, so no phrase of a hot speaker has more rows in a
window than there are days. Documents without a speaker have no history and are
read where they are.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.functions.ontology import DEFAULT, Ontology
from chronolex.functions.text import texts, tokens
from chronolex.plans.materialize import materialize

#: Characters of a speaker's texts that are worked on in one task (about 20 bytes of arrays each); speakers with more are spread.
HOT_CHARS = 16_000_000
SIZES = (2, 3, 4, 5)
STRIPPED = " .,;:\"'()[]{}"


def rarity(current: Column, history: Column) -> Column:
    return current / (history + 1) * F.log(current + F.lit(1.5))


def normalized_phrase(phrase: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(phrase), r"\s+", " "), F.lit(STRIPPED))


def semantic_key(normalized: Column) -> Column:
    return F.substring(F.sha1(normalized), 1, 12)



_TOKEN = re.compile(r"[A-Za-z][A-Za-z\-']+")


def signals_of(days: list[int | None], bodies: list[str | None], top: int, within_days: int, ontology: Ontology, history: bool) -> list[tuple[int, int, str, int, int]]:
    """``(document, rank, phrase, current, past)`` of the rarest runs of one speaker's documents (without ``history``: of documents by themselves)."""
    code: dict[str, int] = defaultdict()
    code.default_factory = code.__len__
    each = [np.fromiter(map(code.__getitem__, " ".join(_TOKEN.findall(t)).lower().split()), dtype=np.int64) if t else np.empty(0, dtype=np.int64) for t in bodies]
    sizes = np.array([len(e) for e in each], dtype=np.int64)
    word = np.concatenate(each) if each else np.empty(0, dtype=np.int64)
    if not len(word):
        return []
    spelled = list(code)
    stop, low = set(ontology.stopwords), set(ontology.low_signal)
    doc = np.repeat(np.arange(len(each)), sizes)
    end = np.cumsum(sizes)[doc]
    content = np.concatenate([[0], np.cumsum(np.array([w not in stop for w in spelled])[word])])
    day = np.array([np.nan if d is None else d for d in days], dtype=float) if history else None
    kept, run = [], word
    for n in SIZES:
        m = len(word) - n + 1
        if m <= 0:
            break
        # runs get numbers from those of the runs a word shorter, so equal numbers are equal runs
        run = np.unique(run[:m] * len(spelled) + word[n - 1 :], return_inverse=True)[1]
        at = np.nonzero((np.arange(m) + n <= end[:m]) & (content[n:] - content[:m] >= 2))[0]
        known = int(run.max()) + 1
        _, first, current = np.unique(doc[at] * known + run[at], return_index=True, return_counts=True)
        at = at[first]
        of, past = doc[at], np.zeros(len(at), dtype=np.int64)
        if history:
            past = _past(run[at], day[of], current, within_days)
        score = current / (past + 1) * np.log(current + 1.5)
        # of each size only what can be among the rarest goes on
        best = _best(of, score, at, top + len(low))
        kept.append([x[best] for x in (of, score, np.full(len(at), n), at, current, past)])
    of, score, n, at, current, past = (np.concatenate(x) for x in zip(*kept)) if kept else (np.empty(0, dtype=np.int64),) * 6
    order = np.lexsort((at, n, -score, of))
    out, taken = [], defaultdict(int)
    for i in order.tolist():
        k = int(of[i])
        if taken[k] < top:
            phrase = " ".join([spelled[w] for w in word[at[i] : at[i] + n[i]].tolist()])
            if phrase not in low:
                taken[k] += 1
                out.append((k, taken[k], phrase, int(current[i]), int(past[i])))
    return out


def _past(run: np.ndarray, day: np.ndarray, current: np.ndarray, within_days: int) -> np.ndarray:
    """How often each run stood in the days before (in all other documents, where there is no day)."""
    past = np.zeros(len(run), dtype=np.int64)
    others = np.isnan(day)
    dated = np.nonzero(~others)[0]
    if len(dated):
        least, span = int(day[dated].min()), int(day[dated].max() - day[dated].min()) + 1
        d, start = day[dated].astype(np.int64) - least, run[dated] * span
        order = np.argsort(start + d, kind="stable")
        place, total = (start + d)[order], np.concatenate([[0], np.cumsum(current[dated][order])])
        past[dated] = total[np.searchsorted(place, start + d)] - total[np.searchsorted(place, start + np.maximum(d - within_days, 0))]
    if others.any():
        past[others] = (np.bincount(run, current).astype(np.int64)[run] - current)[others]
    return past


def _best(of: np.ndarray, score: np.ndarray, at: np.ndarray, most: int) -> np.ndarray:
    """Indices of each document's ``most`` greatest scores, the earlier ones first of equal ones."""
    order = np.lexsort((at, -score, of))
    ranked = of[order]
    return order[np.arange(len(order)) - np.searchsorted(ranked, ranked) < most]


def _table(keys: pa.Array, rows: list[tuple[int, int, str, int, int]]) -> list[pa.Array]:
    at, rank, phrase, current, past = zip(*rows) if rows else ((),) * 5
    return [keys.take(pa.array(at, pa.int64())), pa.array(rank, pa.int32()), pa.array(phrase, pa.string()), pa.array(current, pa.int32()), pa.array(past, pa.int32())]


def _gathered(docs: DataFrame, top: int, within_days: int, ontology: Ontology) -> tuple[DataFrame, DataFrame]:
    """``k, rank, phrase, current, past`` of documents with a speaker (whose texts fit a task), and of those without."""
    names = ["k", "rank", "phrase", "current", "past"]
    types = [docs.schema["k"].dataType, T.IntegerType(), T.StringType(), T.IntegerType(), T.IntegerType()]
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])

    def speaker(t: pa.Table) -> pa.Table:
        rows = signals_of(t.column("d").to_pylist(), t.column("x").to_pylist(), top, within_days, ontology, True)
        return pa.Table.from_arrays(_table(t.column("k").combine_chunks(), rows), names=names)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bodies = b.column("x").to_pylist()
            start = chars = 0
            for i, t in enumerate(bodies):
                chars += len(t or "")
                if chars > HOT_CHARS // 16 or i == len(bodies) - 1:
                    rows = signals_of([], bodies[start : i + 1], top, within_days, ontology, False)
                    yield pa.RecordBatch.from_arrays(_table(b.column("k").slice(start, i + 1 - start), rows), names=names)
                    start, chars = i + 1, 0

    named = docs.filter("s is not null").select("s", "k", "d", "x").groupBy("s").applyInArrow(speaker, schema)
    return named, docs.filter("s is null").select("k", "x").mapInArrow(alone, schema)


def _runs(documents: DataFrame, keep: tuple[str, ...], text_col: str, ontology: Ontology) -> DataFrame:
    """``keep, place, g1, g2``: a row for each run of each document, by the hashes of speaker (``s``) and run; ``place`` orders by size, then position.

    A run needs two words that aren't stopwords and isn't a low-signal phrase.
    """
    stop = texts(ontology.stopwords)
    marked = F.transform(tokens(F.coalesce(F.col(text_col), F.lit(""))), lambda w: F.struct(w.alias("w"), (~F.array_contains(stop, w)).cast("int").alias("k")))
    base = documents.select(*keep, marked.alias("_t"))
    shifted = [F.slice("_t", k + 1, F.greatest(F.size("_t") - k, F.lit(0))) if k else F.col("_t") for k in range(max(SIZES))]
    # one struct per position; beyond the end the shifted arrays give nulls
    rows = base.select(*keep, F.posexplode(F.arrays_zip(*[m.alias(f"c{i}") for i, m in enumerate(shifted)])).alias("pos", "z"))
    named = [F.col("z").getField(f"c{i}") for i in range(max(SIZES))]
    choices = []
    for n in SIZES:
        content = sum((named[i]["k"] for i in range(1, n)), named[0]["k"])
        phrase = F.concat_ws(" ", *[named[i]["w"] for i in range(n)])
        choices.append(F.when(named[n - 1].isNotNull() & (content >= 2), F.struct(F.lit(n).alias("n"), phrase.alias("phrase"))))
    out = rows.select(*keep, "pos", F.explode(F.array_compact(F.array(*choices))).alias("g")).filter(~F.col("g.phrase").isin(ontology.low_signal))
    place = F.shiftleft(F.col("g.n").cast("long"), 32) + F.col("pos")
    return out.select(*keep, place.alias("place"), F.xxhash64("s", "g.phrase").alias("g1"), F.xxhash64("g.phrase", "s", F.lit(1)).alias("g2"))


def _spread(docs: DataFrame, top: int, within_days: int, ontology: Ontology) -> DataFrame:
    """``k, rank, phrase, current, past`` of documents with a speaker, however many."""
    runs = _runs(docs, ("k", "s", "d"), "x", ontology)
    counts = runs.groupBy("k", "d", "g1", "g2").agg(F.count("*").cast("int").alias("current"), F.min("place").alias("place"))
    # by days: a run of a speaker has no more rows in the window than there are days
    daily = counts.groupBy("g1", "g2", "d").agg(F.sum("current").alias("n"))
    before = Window.partitionBy("g1", "g2").orderBy("d").rangeBetween(-within_days, -1)
    pasts = daily.filter("d is not null").withColumn("past", F.sum("n").over(before)).filter("past > 0").drop("n")
    totals = daily.groupBy("g1", "g2").agg(F.sum("n").alias("past"))
    dated = counts.filter("d is not null").join(pasts, ["g1", "g2", "d"], "left").select("k", "place", "current", F.coalesce("past", F.lit(0)).alias("past"))
    undated = counts.filter("d is null").join(totals, ["g1", "g2"]).select("k", "place", "current", (F.col("past") - F.col("current")).alias("past"))
    scored = dated.unionByName(undated).withColumn("r", rarity(F.col("current"), F.col("past")))
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("r"), "place"))).filter(F.col("rank") <= top)
    size, pos = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")
    said = docs.select("k", tokens(F.col("x")).alias("_t"))
    return ranked.join(said, "k").select("k", "rank", F.array_join(F.slice("_t", pos + 1, size), " ").alias("phrase"), "current", F.col("past").cast("int").alias("past"))


def phrase_signals(
    documents: DataFrame, key: str = "doc_id", speaker: str = "speaker_name", day: str = "speech_date", text_col: str = "normalized_text",
    within_days: int = 730, top: int = 20, ontology: Ontology = DEFAULT, hot_chars: int = HOT_CHARS,
) -> DataFrame:
    """The ``top`` rarest runs of each document.

    ``key, rank, phrase_text, normalized_phrase, semantic_key, current_count, historical_count, rarity_score``.
    History is the speaker's documents of the ``within_days`` days before (not the same day); a document
    without date has all other documents of its speaker for history, one without speaker none. Ties go to
    shorter runs, then to earlier ones.
    """
    docs = documents.select(F.col(key).alias("k"), F.col(speaker).alias("s"), F.datediff(F.col(day), F.lit("1970-01-01").cast("date")).alias("d"), F.col(text_col).alias("x"))
    size = F.sum(F.length("x")).alias("chars")
    hot = materialize(docs.filter("s is not null").groupBy("s").agg(size).filter(F.col("chars") > hot_chars).select("s"), "hot-speakers")
    few, alone = _gathered(docs.join(hot, "s", "left_anti"), top, within_days, ontology)
    many = _spread(docs.join(hot, "s", "left_semi"), top, within_days, ontology)
    plain = normalized_phrase(F.col("phrase"))
    return few.unionByName(alone).unionByName(many).select(
        F.col("k").alias(key), "rank", F.col("phrase").alias("phrase_text"), plain.alias("normalized_phrase"), semantic_key(plain).alias("semantic_key"), F.col("current").alias("current_count"),
        F.col("past").alias("historical_count"), F.round(rarity(F.col("current"), F.col("past")), 4).alias("rarity_score"),
    )
