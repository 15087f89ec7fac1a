"""Near-duplicate texts by a multi-index Hamming join of b-bit signatures.

A text is the set of its runs of ``width`` words. Its signature has
``CHUNKS * SYMBOLS`` symbols of 16 bits, each the low bits of one min-wise
hash, so the share of equal symbols estimates the Jaccard similarity. The
signature is split into chunks. If two signatures differ in at most
``(ERRORS + 1) * CHUNKS - 1`` symbols, by pigeonhole some chunk has at most
``ERRORS`` differences; every chunk is entered in its index once per choice of
positions that may differ, so all such pairs meet in some bucket: the join
misses none of them (31 of 96 symbols by default). Pairs at the edge of the
threshold whose signatures are farther apart than that still meet with high
probability, for each of the 16 chunks is another chance: a pair at similarity
0.7 is missed about once in 6,000, one at 0.76 once in a million. Pairs that
meet must pass, inside the join, the distance of one bit of every symbol
(:data:`FARTHEST_BITS`; never more than that of the symbols, so no pair within the guarantee is
stopped), then the signature distance :data:`FARTHEST`, then the
exact similarity of their whole sets.

Scale: texts with the same set are one class from the start, only its
representative enters the join, and every index entry is three longs and an int. A bucket holds texts
that share five independent minima, so unrelated texts hardly ever meet (at
similarity 0.05 about 3 pairs in 100,000), and of those that do about one in a
hundred leaves the join; the planner splits skewed buckets.
Exact sets are made only for texts in a surviving pair.

Defined results: words are white-space separated and lower-cased; null texts
and texts with fewer than ``width`` words have no runs and are in no pair and
no class; repeated rows of one id count as one document; columns beside id and
text are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.plans.components import connected_components
from chronolex.plans.materialize import materialize

CHUNKS, SYMBOLS, ERRORS = 16, 6, 1
#: Largest signature distance that goes on to the exact check: 5 deviations beyond the mean at similarity 0.7.
FARTHEST = 52
#: The like for the one bit a symbol that index entries carry: at least the guaranteed distance of symbols;
#: of pairs 45 symbols apart, which similarity 0.7 makes once in 6,000, one in 1,000 is farther.
FARTHEST_BITS = 33
_N = CHUNKS * SYMBOLS
_rng = np.random.Generator(np.random.PCG64(20240229))
_MULTIPLY = _rng.integers(0, 2**64, _N, dtype=np.uint64) | np.uint64(1)
_XOR = _rng.integers(0, 2**64, _N, dtype=np.uint64)
_MIX = _rng.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)
#: Characters of text handled at once within a task.
_CHARS = 1_000_000
#: Word hashes kept within a task; emptied beyond it.
_WORDS = 300_000


def _finish(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Words(dict):
    def __missing__(self, word: str) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "replace"))
        return h


class Runs:
    """Hashes of the distinct runs of ``width`` words of each text."""

    def __init__(self, width: int):
        self.width, self.words = width, _Words()

    def of(self, text: str | None) -> np.ndarray:
        words = text.lower().split() if text else []
        n = len(words) - self.width + 1
        if n <= 0:
            return np.empty(0, dtype=np.uint64)
        if len(self.words) > _WORDS:
            self.words.clear()
        h = np.fromiter(map(self.words.__getitem__, words), dtype=np.uint64, count=len(words))
        x = np.zeros(n, dtype=np.uint64)
        for k in range(self.width):
            x = _finish(x * _MIX[0] + h[k : k + n])
        return np.unique(x)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``CHUNKS * SYMBOLS`` 16-bit symbols per (non-empty) set."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.empty((len(sets), _N), dtype=np.uint16)
    for j in range(_N):
        least = np.minimum.reduceat((flat ^ _XOR[j]) * _MULTIPLY[j], starts)
        out[:, j] = (least >> np.uint64(16)).astype(np.uint16)
    return out


def index_keys(signature: np.ndarray) -> np.ndarray:
    """The index entries of each signature: per chunk one for each position left out."""
    chunks = signature.reshape(-1, CHUNKS, SYMBOLS).astype(np.uint64)
    keys = []
    for c in range(CHUNKS):
        for out in range(SYMBOLS):
            x = np.full(len(chunks), c * SYMBOLS + out + 1, dtype=np.uint64)
            for s in range(SYMBOLS):
                if s != out:
                    x = _finish(x * _MIX[1] + chunks[:, c, s])
            keys.append(x)
    return np.stack(keys, axis=1)


def bits(signature: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The low bit of every symbol of each signature: a long of 64 and an int of 32."""
    packed = np.packbits((signature & 1).astype(np.uint8), axis=1)
    return packed[:, :8].copy().view(np.int64).ravel(), packed[:, 8:].copy().view(np.int32).ravel()


def _batches(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start = chars = 0
    for i, t in enumerate(texts):
        chars += len(t) if t else 0
        if chars > _CHARS:
            yield start, i + 1
            start, chars = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def _sign(df: DataFrame, width: int) -> DataFrame:
    """``id, k1, k2, sig`` of every text with runs; (k1, k2) tells sets apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(width)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _batches(texts):
                sets = [runs.of(t) for t in texts[a:b]]
                rows = [a + i for i, s in enumerate(sets) if len(s)]
                sets = [s for s in sets if len(s)]
                if not sets:
                    continue
                whole = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
                sig = signatures(sets).view(np.int16)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(rows)),
                        pa.array(np.array([w >> 64 for w in whole], dtype=np.uint64).view(np.int64)),
                        pa.array(np.array([w & (2**64 - 1) for w in whole], dtype=np.uint64).view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, sig.size + 1, _N, dtype=np.int32)), pa.array(sig.reshape(-1))),
                    ],
                    names=["id", "k1", "k2", "sig"],
                )

    schema = T.StructType(
        [T.StructField("id", df.schema["id"].dataType), T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("sig", T.ArrayType(T.ShortType()))]
    )
    return df.mapInArrow(run, schema)


def _index(classes: DataFrame) -> DataFrame:
    """``key, id, x, y``: all index entries of the representatives; x and y are bits of the signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int16).view(np.uint16).reshape(-1, _N)
            for a in range(0, len(sig), 1000):
                keys = index_keys(sig[a : a + 1000])
                x, y = (np.repeat(part, keys.shape[1]) for part in bits(sig[a : a + 1000]))
                ids = batch.column(0).take(pa.array(np.repeat(np.arange(a, a + len(keys)), keys.shape[1])))
                columns = [pa.array(keys.reshape(-1).view(np.int64)), ids, pa.array(x), pa.array(y)]
                yield pa.RecordBatch.from_arrays(columns, names=["key", "id", "x", "y"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("id", classes.schema["id"].dataType), T.StructField("x", T.LongType()), T.StructField("y", T.IntegerType())])
    return classes.select("id", "sig").mapInArrow(run, schema)


def _sets(df: DataFrame, width: int) -> DataFrame:
    """``id, runs``: the exact sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(width)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in _batches(texts):
                sets = [runs.of(t) for t in texts[a:b]]
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
                values = np.concatenate(sets).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["id", "runs"])

    return df.mapInArrow(run, T.StructType([T.StructField("id", df.schema["id"].dataType), T.StructField("runs", T.ArrayType(T.LongType()))]))


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "normalized_text", width: int = 5, min_percent: int = 80) -> tuple[DataFrame, DataFrame]:
    """``(members, links)``: ``id, class_id`` of every text with runs, and ``a, b`` of the classes alike enough.

    A class is the texts with the same set; its id is its least document id.
    """
    texts = df.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    signed = materialize(_sign(texts, width), "signatures")
    # few bytes of each row are grouped; of rows repeated whole the least stays
    rep = signed.groupBy("k1", "k2").agg(F.min("id").alias("class_id"))
    members = materialize(signed.select("id", "k1", "k2").join(rep, ["k1", "k2"]).select("id", "class_id").distinct(), "members")
    classes = materialize(signed.join(members.filter("id = class_id").select("id").distinct(), "id", "left_semi").dropDuplicates(["id"]).select("id", "sig"), "classes")
    index = _index(classes)
    left, right = (index.select("key", F.col("id").alias(c), F.col("x").alias("x" + c), F.col("y").alias("y" + c)) for c in "ab")
    near_bits = F.bit_count(F.col("xa").bitwiseXOR(F.col("xb"))) + F.bit_count(F.col("ya").bitwiseXOR(F.col("yb")).cast("long").bitwiseAND(F.lit(0xFFFFFFFF))) <= FARTHEST_BITS
    met = left.join(right, "key").filter((F.col("a") < F.col("b")) & near_bits).select("a", "b").distinct()
    # distance of the signatures
    apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + x)
    near = (
        met.join(classes.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
        .join(classes.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        .filter(apart <= FARTHEST)
        .select("a", "b")
    )
    near = materialize(near, "near")
    wanted = near.select(F.col("a").alias("id")).union(near.select(F.col("b").alias("id"))).distinct()
    sets = _sets(texts.join(wanted, "id", "left_semi").dropDuplicates(["id"]), width)
    both = near.join(sets.select(F.col("id").alias("a"), F.col("runs").alias("ra")), "a").join(sets.select(F.col("id").alias("b"), F.col("runs").alias("rb")), "b")
    common = both.select("a", "b", F.size(F.array_intersect("ra", "rb")).alias("c"), (F.size("ra") + F.size("rb")).alias("n"))
    return members, common.filter(F.col("c") * 100 >= min_percent * (F.col("n") - F.col("c"))).select("a", "b")


def similar_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "normalized_text", width: int = 5, min_percent: int = 80) -> DataFrame:
    """``doc_a, doc_b``: every pair of documents alike enough, copies expanded."""
    members, links = similar_classes(df, id_col, text_col, width, min_percent)
    links = links.union(members.filter("id = class_id").select(F.col("id").alias("a"), F.col("id").alias("b")))
    left = members.select(F.col("class_id").alias("a"), F.col("id").alias("x"))
    right = members.select(F.col("class_id").alias("b"), F.col("id").alias("y"))
    pairs = links.join(left, "a").join(right, "b").filter("a <> b or x < y")
    return pairs.select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"))


def similar_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "normalized_text", width: int = 5, min_percent: int = 80) -> DataFrame:
    """``id_col, class_id, group_id, n_links``: one row per document with runs, nothing expanded.

    ``group_id`` is the least document of the connected group; ``n_links`` counts the documents alike.
    """
    members, links = similar_classes(df, id_col, text_col, width, min_percent)
    links = materialize(links, "links")
    size = members.groupBy("class_id").agg(F.count("*").alias("size"))
    both = links.union(links.select("b", "a"))
    linked = both.join(size.withColumnRenamed("class_id", "b"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("size").alias("others"))
    groups = connected_components(links).select(F.col("id").alias("class_id"), F.col("component").alias("group_id"))
    per_class = size.join(linked, "class_id", "left").join(groups, "class_id", "left")
    return members.join(per_class, "class_id").select(
        F.col("id").alias(id_col), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), (F.col("size") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
