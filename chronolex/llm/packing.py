"""Best-two-fit packing of whole items into containers of fixed capacity.

The sizes are integers up to the capacity, so the corpus enters the packing as
a histogram: one count per size, at most ``capacity`` rows however many items
there are. Best-two-fit runs on the histogram: a container is filled greedily
with the largest items that fit; then its smallest item is exchanged for the
two unpacked items that fill the widened gap most tightly. A filling is used as
often as the counts allow before the next is sought, so the plan has about as
many entries as there are sizes, not as there are containers. Items then take
their places by rank within their size; the ranks come from the counts of parts
(by hashed key), so no size is gathered in one task.

Defined results: an item above the capacity is cut into full containers of its
own and a rest that is packed like an item; which of the items of one size
goes where is decided by their keys, whatever the cluster; an item of size 0 (null or empty
text) takes no container (``container_id`` null, piece 0); equal items are told
apart by their rank; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.llm.bpe import TOKENIZER_PATH, count_tokens
from chronolex.plans.materialize import materialize


#: Parts that the items of one size are ranked in.
PARTS = 1024


@dataclass
class Filling:
    """``times`` containers from number ``first`` on, each with the items ``sizes`` (size: how many)."""

    first: int
    times: int
    sizes: dict[int, int]


def best_two_fit(counts: dict[int, int], capacity: int) -> list[Filling]:
    """Fillings that use up ``counts`` (size: number of items; sizes 1..capacity)."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError(f"size {size} does not fit 1..{capacity}")
        left[size] += n
    numbers = np.arange(capacity + 1)
    fillings, first = [], 0
    while left.any():
        # largest size with an item left, at or below each number
        fits = np.maximum.accumulate(np.where(left > 0, numbers, 0))
        used: dict[int, int] = {}
        gap = limit = capacity
        while limit and (size := int(fits[limit])):
            used[size] = min(int(left[size]), gap // size)
            gap -= used[size] * size
            limit = min(gap, size - 1)
        if gap:
            smallest = min(used)
            pair = _two(left, used, smallest, gap + smallest)
            if pair:
                used[smallest] -= 1
                if not used[smallest]:
                    del used[smallest]
                for size in pair:
                    used[size] = used.get(size, 0) + 1
        times = min(int(left[s]) // n for s, n in used.items())
        fillings.append(Filling(first, times, used))
        first += times
        for s, n in used.items():
            left[s] -= times * n
    return fillings


def _two(left: np.ndarray, used: dict[int, int], least: int, room: int) -> tuple[int, int] | None:
    """The two free items with the largest sum in ``(least, room]``."""
    free = left[: room + 1].copy()
    for s, n in used.items():
        if s <= room:
            free[s] -= n
    sizes = np.nonzero(free > 0)[0]
    if not len(sizes):
        return None
    fits = np.maximum.accumulate(np.where(free > 0, np.arange(room + 1), 0))
    partner = fits[room - sizes]
    # an item can only be its own partner if there are two of it
    alone = (partner == sizes) & (free[sizes] < 2)
    partner[alone] = np.where(sizes[alone] > 0, fits[np.maximum(sizes[alone] - 1, 0)], 0)
    total = np.where(partner > 0, sizes + partner, 0)
    k = int(total.argmax())
    return (int(sizes[k]), int(partner[k])) if least < total[k] <= room else None


def _places(fillings: dict[int, list[Filling]]) -> dict[tuple[int, int], np.ndarray]:
    """For each (spec, size) the rows ``rank from, containers' first number, how many per container``, by rank."""
    rows: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    for spec, plan in fillings.items():
        ranks: dict[int, int] = {}
        for f in plan:
            for size, n in f.sizes.items():
                at = ranks.get(size, 0)
                rows.setdefault((spec, size), []).append((at, f.first, n))
                ranks[size] = at + n * f.times
    return {k: np.array(v, dtype=np.int64) for k, v in rows.items()}


def pack(sized: DataFrame, capacities: dict[int, int], id_col: str = "doc_id") -> DataFrame:
    """``spec_id, id_col, piece_no, n_tokens, container_id`` for ``sized`` (``id_col, n_tokens``).

    ``capacities`` maps spec ids to capacities; ``container_id`` counts from 0 within a spec.
    """
    spark = sized.sparkSession
    specs = F.array(*[F.struct(F.lit(int(s)).alias("spec_id"), F.lit(int(c)).cast("long").alias("cap")) for s, c in sorted(capacities.items())])
    key = sized.schema[id_col].dataType
    base = sized.select(F.col(id_col).alias("k"), F.coalesce(F.col("n_tokens").cast("long"), F.lit(0)).alias("n"))
    # An item within the capacity is one piece; a larger one is n // cap full pieces and a rest.
    items = (
        base.select("k", "n", F.explode(specs).alias("s"))
        .select("k", "s.spec_id", "s.cap", F.expr("n div s.cap").alias("full"), F.expr("n % s.cap").alias("rest"))
        .select("k", "spec_id", "cap", F.expr("sequence(0, full - if(rest = 0 and full > 0, 1, 0))").alias("p"), "full", "rest")
        .select("k", "spec_id", F.explode("p").alias("piece_no"), "full", "rest", "cap")
        .select("k", "spec_id", F.col("piece_no").cast("int").alias("piece_no"), F.when(F.col("piece_no") < F.col("full"), F.col("cap")).otherwise(F.col("rest")).alias("n"))
    )
    # Ranks run within parts by key, so no size is gathered in one task and the place of an item depends on keys alone.
    kept = materialize(items.withColumn("part", F.pmod(F.xxhash64("k"), F.lit(PARTS)).cast("int")), "pack-items")
    counted = kept.filter("n > 0").groupBy("part", "spec_id", "n").count()
    # The rank that each part's first item of a size has: running sums over the parts' counts.
    by_size = "partition by spec_id, n order by part rows between unbounded preceding and 1 preceding"
    starts = counted.select("part", "spec_id", "n", F.expr(f"coalesce(sum(count) over ({by_size}), 0)").alias("start"))
    histogram: dict[int, dict[int, int]] = {}
    for r in counted.groupBy("spec_id", "n").agg(F.sum("count").alias("c")).collect():  # at most capacity rows a spec
        histogram.setdefault(r["spec_id"], {})[r["n"]] = r["c"]
    plan = spark.sparkContext.broadcast(_places({s: best_two_fit(h, capacities[s]) for s, h in histogram.items()}))

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = np.full(len(rows), -1, dtype=np.int64)
            for (spec, size), at in rows.groupby(["spec_id", "n"]).indices.items():
                table = plan.value[(int(spec), int(size))]
                rank = rows["rank"].to_numpy()[at]
                hit = table[np.searchsorted(table[:, 0], rank, side="right") - 1]
                out[at] = hit[:, 1] + (rank - hit[:, 0]) // hit[:, 2]
            yield pd.DataFrame({"spec_id": rows["spec_id"], "k": rows["k"], "piece_no": rows["piece_no"], "n": rows["n"], "container_id": out})

    schema = T.StructType([T.StructField("spec_id", T.IntegerType()), T.StructField("k", key), T.StructField("piece_no", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("container_id", T.LongType())])
    ranked = (
        kept.filter("n > 0")
        .withColumn("i", F.expr("row_number() over (partition by part, spec_id, n order by k, piece_no) - 1"))
        .join(starts, ["part", "spec_id", "n"])
        .select("spec_id", "k", "piece_no", "n", (F.col("start") + F.col("i")).alias("rank"))
    )
    placed = ranked.mapInPandas(assign, schema)
    without = kept.filter("n = 0").select("spec_id", "k", "piece_no", "n", F.lit(None).cast("long").alias("container_id"))
    return placed.unionByName(without).select("spec_id", F.col("k").alias(id_col), "piece_no", F.col("n").alias("n_tokens"), "container_id")


def pack_documents(df: DataFrame, capacities: dict[int, int], id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = TOKENIZER_PATH) -> DataFrame:
    """:func:`pack` with the sizes of the texts in tokens."""
    return pack(count_tokens(df, id_col, text_col, vocabulary_path), capacities, id_col)
