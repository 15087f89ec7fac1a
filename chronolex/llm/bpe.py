"""Byte-level BPE of a whole corpus by merge replay.

A text is cut into words by the tokenizer's public pattern; only the distinct
words of the corpus are encoded. An inverted index maps each pair
of neighbouring symbols to the positions where it stands in those words. The
merges are replayed in rank order; each takes the positions of its pair from
the index and touches just the two neighbours of every position.

:func:`encode_corpus` reads every text once. Texts are coded by chunks: each word is a number in
the chunk's own list of distinct words. The lists meet by word, so the words
of the corpus are spread over the tasks and each is replayed once; their
ids go back to the chunks, where numbers become ids by array operations. A
chunk is bounded in characters (a longer text is a chunk of its own), so no word,
however common, has more rows than there are chunks. Nothing but the
vocabulary file (a megabyte or two, fixed) is broadcast.

:func:`count_tokens`, for operators that need lengths only, replays the words of
each chunk in place and shuffles nothing.

Defined results: a null and an empty text have no ids; strings of special
tokens are ordinary text; text is taken whole, whatever its length; a repeated
row gives a repeated result; columns beside id and text are ignored.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.plans.materialize import materialize

#: Where the public tokenizers lie; pass another path to use other files.
TOKENIZER_PATH = "/opt/tokenizers/byte_bpe_50k.json"

#: White space of the pattern (the Unicode property; Python's own ``\\s`` also has \\x1c-\\x1f).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_ANY = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: Words kept encoded between batches of a task; beyond it the memory is emptied and filled anew.
CACHE_WORDS = 150_000
#: Characters of text handled at once within a task.
CHUNK_CHARS = 4_000_000
#: Entries of chunks' word lists that are replayed at once within a task.
REPLAY_ROWS = 200_000


def split_words(text: str) -> list[str]:
    """The words of a text by the tokenizer's pattern; joined they give the text."""
    return (_ASCII if text.isascii() else _ANY).findall(text)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable bytes stand for
    themselves, the others for the letters from 256 on, in order."""
    letters, extra = {}, 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            letters[chr(b)] = b
        else:
            letters[chr(extra)] = b
            extra += 1
    return letters


class MergeReplay:
    """Encodes words by replaying all merges of a vocabulary over an inverted index."""

    def __init__(self, vocabulary: bytes):
        model = json.loads(vocabulary)["model"]
        ids, letters = model["vocab"], _byte_letters()
        self.of_byte = [0] * 256
        for letter, byte in letters.items():
            self.of_byte[byte] = ids[letter]
        made = set(self.of_byte)
        self.merges: list[tuple[int, int, int]] = []
        self.byte_length = np.ones(max(ids.values()) + 1, dtype=np.int32)
        for m in model["merges"]:
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b, c = ids[left], ids[right], ids[left + right]
            if a not in made or b not in made:
                raise ValueError(f"merge of {left!r} and {right!r} comes before its parts")
            made.add(c)
            self.merges.append((a << 20 | b, b, c))
            self.byte_length[c] = self.byte_length[a] + self.byte_length[b]
        self.known: dict[str, tuple[int, ...]] = {}

    def encode(self, words: Iterable[str]) -> list[tuple[int, ...]]:
        """Ids of each distinct word."""
        symbol: list[int] = []
        starts: list[int] = []
        before: list[int] = []
        after: list[int] = []
        of_byte = self.of_byte
        index: dict[int, list[int]] = {}
        for w in words:
            start = len(symbol)
            starts.append(start)
            symbol.extend([of_byte[b] for b in w.encode("utf-8", "replace")])
            end = len(symbol)
            before.extend(range(start - 1, end - 1))
            after.extend(range(start + 1, end + 1))
            if end > start:
                before[start] = after[end - 1] = -1
                for p in range(start, end - 1):
                    key = symbol[p] << 20 | symbol[p + 1]
                    if key in index:
                        index[key].append(p)
                    else:
                        index[key] = [p]
        take = index.pop
        for key, b, c in self.merges:
            places = take(key, None)
            if places is None:
                continue
            a = key >> 20
            if a == b:
                places.sort()  # a run of one symbol merges from its left end
            for p in places:
                q = after[p]
                if q < 0 or symbol[p] != a or symbol[q] != b:
                    continue
                symbol[p], symbol[q] = c, -1
                r = after[p] = after[q]
                if r >= 0:
                    before[r] = p
                    index.setdefault(c << 20 | symbol[r], []).append(p)
                o = before[p]
                if o >= 0:
                    index.setdefault(symbol[o] << 20 | c, []).append(o)
        result = []
        starts.append(len(symbol))
        for start, end in zip(starts, starts[1:]):
            out, p = [], start if end > start else -1
            while p >= 0:
                out.append(symbol[p])
                p = after[p]
            result.append(tuple(out))
        return result

    def learn(self, texts: Iterable[list[str]]) -> dict[str, tuple[int, ...]]:
        """Word to ids for all words of the texts."""
        fresh = set(chain.from_iterable(texts)).difference(self.known)
        if len(self.known) + len(fresh) > CACHE_WORDS:
            self.known = {}
            fresh = set(chain.from_iterable(texts))
        if fresh:
            fresh_words = list(fresh)
            self.known.update(zip(fresh_words, self.encode(fresh_words)))
        return self.known


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Row ranges with about :data:`CHUNK_CHARS` characters each; a longer text stands alone."""
    start = chars = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and chars + n > CHUNK_CHARS:
            yield start, i
            start, chars = i, 0
        chars += n
    if start < len(texts):
        yield start, len(texts)


def read_vocabulary(path: str = TOKENIZER_PATH) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _coded(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``chunk, id, codes`` of every row, and ``chunk, words`` once a chunk: a word's code is its place there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                code: dict[str, int] = defaultdict()
                code.default_factory = code.__len__  # a new word takes the next number
                each = [np.fromiter(map(code.__getitem__, split_words(t)), dtype=np.int32) if t else np.empty(0, dtype=np.int32) for t in texts[a:b]]
                n = b - a
                codes = pa.ListArray.from_arrays(pa.array(_offsets(map(len, each))), pa.array(np.concatenate(each)))
                words = pa.array([None] * n, pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([chunk] * n, pa.int64()), batch.column(0).slice(a, n), codes, words], names=names)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.nulls(1, batch.column(0).type), pa.nulls(1, codes.type), pa.array([list(code)], words.type)], names=names)
                chunk += 1

    names = ["chunk", "id", "codes", "words"]
    fields = [T.LongType(), df.schema[id_col].dataType, T.ArrayType(T.IntegerType()), T.ArrayType(T.StringType())]
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, T.StructType([T.StructField(n, t) for n, t in zip(names, fields)]))


def _offsets(lengths: Iterable[int]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(np.fromiter(lengths, dtype=np.int64))]).astype(np.int32)


def _ragged(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of ``flat`` end to end."""
    shift = starts - (np.cumsum(lengths) - lengths)
    return flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()))]


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = TOKENIZER_PATH) -> DataFrame:
    """``id_col, ids``: the ids of every row's whole text; null and empty texts give an empty list."""
    spark = df.sparkSession
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    # written once, so that the numbers of chunks and words hold for all that read on
    coded = materialize(_coded(df, id_col, text_col), "coded-texts")

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known, last = MergeReplay(vocabulary.value), [()], None

        def encoded(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            nonlocal known, last
            t = pa.Table.from_batches(rows)
            words = t.column("word").to_pylist()
            new = np.fromiter((w != v for w, v in zip(words, chain([last], words))), dtype=bool, count=len(words))
            fresh = [words[i] for i in np.nonzero(new)[0].tolist()]
            known, last = known[-1:] + model.encode(fresh), words[-1]
            flat, offsets = np.fromiter(chain.from_iterable(known), dtype=np.int32), _offsets(map(len, known))
            which = np.cumsum(new)
            lengths = np.diff(offsets)[which]
            ids = pa.ListArray.from_arrays(pa.array(_offsets(lengths)), pa.array(_ragged(flat, offsets[which].astype(np.int64), lengths.astype(np.int64))))
            columns = [t.column(c).combine_chunks() for c in ("chunk", "code")]
            return pa.RecordBatch.from_arrays([*columns, ids], names=["chunk", "code", "ids"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= REPLAY_ROWS:
                yield encoded(held)
                held = []
        if any(b.num_rows for b in held):
            yield encoded(held)

    # sorted, so that rows of one word come together and it is replayed once
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    listed = coded.filter("words is not null").select("chunk", F.posexplode("words").alias("code", "word"))
    lexicon = listed.repartition(tasks, "word").sortWithinPartitions("word").select("chunk", "code", "word").mapInArrow(replay, "chunk long, code int, ids array<int>")
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def decode(texts: pa.Table, words: pa.Table) -> pa.Table:
        ids, order = words.column("ids").combine_chunks(), np.argsort(words.column("code").to_numpy())
        offsets = ids.offsets.to_numpy().astype(np.int64)
        flat, starts, lengths = ids.values.to_numpy(), offsets[:-1][order], np.diff(offsets)[order]
        codes = texts.column("codes").combine_chunks()
        which = codes.values.to_numpy()[codes.offsets[0].as_py() : codes.offsets[-1].as_py()]
        ends = np.concatenate([[0], np.cumsum(lengths[which])])
        at = ends[codes.offsets.to_numpy() - codes.offsets[0].as_py()].astype(np.int32)
        out = pa.ListArray.from_arrays(pa.array(at), pa.array(_ragged(flat, starts[which], lengths[which]).astype(np.int32)))
        return pa.Table.from_arrays([texts.column("id"), out], names=schema.names)

    texts = coded.filter("words is null").select("chunk", "id", "codes")
    return texts.groupBy("chunk").cogroup(lexicon.groupBy("chunk")).applyInArrow(decode, schema)


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = TOKENIZER_PATH) -> DataFrame:
    """``id_col, n_tokens``: the length of every row's encoding, without carrying the ids."""
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(vocabulary.value)
        for batch in batches:
            texts, counts = batch.column(1).to_pylist(), []
            for a, b in chunks(texts):
                words = [split_words(t) if t else [] for t in texts[a:b]]
                known = replay.learn(words)
                counts += [sum(map(len, map(known.__getitem__, w))) for w in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[id_col, "n_tokens"])

    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
