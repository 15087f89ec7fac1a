"""Splitting of long texts at natural boundaries by pointer doubling.

A text's tokens give its legal boundaries: ends of paragraphs, of sentences and
of words, and, within words that may reach beyond a piece's room or have more than
:data:`LONG_WORD` tokens, ends of tokens that end a character.
Every boundary is joined to its farthest legal successor: the piece that starts
``overlap`` tokens before the boundary may hold ``limit`` tokens and ends at
the best boundary in reach. The successor tables of all texts of a batch form
one array; squaring it (a pointer's pointer) doubles the number of cuts known
per round, so all cuts of all texts come out in log2(pieces) array operations.

Defined results: only texts of more than ``limit`` tokens are cut; a piece has
at most ``limit`` tokens of the text's own encoding; the overlap is exact,
save where it would split a character (then up to three tokens more). A paragraph end is taken
if it fills the piece by at least half, else a sentence end, else a word end;
failing these any such end in that order, and a token end only if there is none.
An overlap within :data:`LEAST_ROOM` tokens of the limit is refused (a character may have four
tokens and the overlap three more), so every boundary has a successor.
Null, empty and short texts give no rows. Rows are independent, so repeated rows give
repeated pieces and no text is gathered with another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronolex.llm.bpe import TOKENIZER_PATH, MergeReplay, chunks, read_vocabulary, split_words

_PARAGRAPH = re.compile(rb"[^\s](?=[^\S\n]*\n[^\S\n]*\n)")
#: Full stop, question and exclamation mark with closing quotes before white space, or their East Asian forms.
_SENTENCE = re.compile(rb"[.!?](?:[\"')\]]|\xe2\x80[\x99\x9d])*(?=\s)|\xe3\x80\x82|\xef\xbc[\x81\x9f]")
KINDS = ("paragraph", "sentence", "word", "token")
#: Words of more tokens may be cut inside.
LONG_WORD = 8
#: What the limit must leave beside the overlap: the tokens of a character and of the part of one the overlap may take in.
LEAST_ROOM = 7


def successors(n: int, ends: np.ndarray, starts: np.ndarray, kinds: list[np.ndarray], limit: int, least: int) -> np.ndarray:
    """For each boundary ``ends[i]`` of a text of ``n`` tokens the index of the next cut.

    ``starts[i]`` is where a piece after a cut at ``ends[i]`` begins; ``kinds``
    are the indices into ``ends`` of each kind, best first.
    """
    reach = np.searchsorted(ends, starts + limit, side="right") - 1
    here = np.arange(len(ends))
    best = np.full(len(ends), -1)
    for fill in (least, 0):
        floor = np.maximum(np.searchsorted(ends, starts + fill, side="left"), here + 1)
        for kind in kinds:
            if not len(kind):
                continue
            at = np.searchsorted(kind, reach, side="right") - 1
            found = np.where(at >= 0, kind[np.maximum(at, 0)], -1)
            best = np.where((best < 0) & (found >= floor), found, best)
    last = len(ends) - 1
    best[starts + limit >= n] = last
    best[last] = last
    if (best < 0).any():
        raise ValueError("a boundary has no successor within the limit")
    return best


def cuts(successor: np.ndarray, roots: np.ndarray) -> np.ndarray:
    """All boundaries reached from ``roots`` by following ``successor``, by squaring."""
    reached = np.zeros(len(successor), dtype=bool)
    reached[roots] = True
    while True:
        before = int(reached.sum())
        reached[successor[reached]] = True
        if int(reached.sum()) == before:
            return reached
        successor = successor[successor]


class Boundaries:
    """Where a text may be cut: token positions ``ends`` with their kinds, and the byte position of every token."""

    def __init__(self, text: str, ids: np.ndarray, word_sizes: np.ndarray, byte_length: np.ndarray, room: int):
        """``room``: the least number of tokens a piece may reach beyond the boundary before it."""
        n = len(ids)
        self.raw = text.encode("utf-8", "replace")
        buffer = np.frombuffer(self.raw + b" ", dtype=np.uint8)
        self.at_byte = np.concatenate([[0], np.cumsum(byte_length[ids], dtype=np.int64)])
        whole = (buffer[self.at_byte] & 0xC0) != 0x80  # a character begins here
        self.whole_at = np.maximum.accumulate(np.where(whole, np.arange(n + 1), 0))
        legal = np.zeros(n + 1, dtype=bool)
        word_ends = np.cumsum(word_sizes)
        legal[0] = legal[n] = True
        legal[word_ends] = True
        for k in np.nonzero(word_sizes > min(LONG_WORD, room))[0]:
            legal[word_ends[k] - word_sizes[k] : word_ends[k]] = True
        self.ends = np.nonzero(legal & whole)[0]
        places = self.at_byte[self.ends]

        def hit(pattern: re.Pattern) -> np.ndarray:
            found = np.array([m.end() for m in pattern.finditer(self.raw)], dtype=np.int64)
            at = np.searchsorted(places, found)
            return np.unique(at[places[np.minimum(at, len(places) - 1)] == found])

        self.kinds = [hit(_PARAGRAPH), hit(_SENTENCE), np.nonzero(buffer[places] <= 32)[0], np.arange(len(self.ends))]
        self.kind = np.full(len(self.ends), 3)
        for code in (2, 1, 0):
            self.kind[self.kinds[code]] = code


def split_texts(replay: MergeReplay, texts: list[str | None], limits: dict[int, tuple[int, int]]) -> Iterator[tuple]:
    """``spec_id, row, piece_no, start_byte, end_byte, n_tokens, cut_at, text`` of the pieces of some texts."""
    smallest = min(limit for limit, _ in limits.values())
    room = min(limit - overlap for limit, overlap in limits.values()) - 3
    words = [split_words(t) if t else [] for t in texts]
    known = replay.learn(words)
    long = []
    for row, w in enumerate(words):
        each = list(map(known.__getitem__, w))
        ids = np.fromiter(chain.from_iterable(each), dtype=np.int32)
        if len(ids) > smallest:
            long.append((row, len(ids), Boundaries(texts[row], ids, np.fromiter(map(len, each), dtype=np.int64, count=len(each)), replay.byte_length, room)))
    for spec, (limit, overlap) in limits.items():
        tables, parts, base = [], [], 0
        for row, n, b in long:
            if n <= limit:
                continue
            starts = b.whole_at[np.maximum(b.ends - overlap, 0)]
            tables.append(successors(n, b.ends, starts, b.kinds, limit, limit // 2) + base)
            parts.append((row, b, starts, base))
            base += len(b.ends)
        if not tables:
            continue
        reached = cuts(np.concatenate(tables), np.array([p[3] for p in parts]))
        for row, b, starts, first in parts:
            cut = np.nonzero(reached[first : first + len(b.ends)])[0]
            token_from, token_to = starts[cut[:-1]], b.ends[cut[1:]]
            places = zip(b.at_byte[token_from].tolist(), b.at_byte[token_to].tolist(), (token_to - token_from).tolist(), b.kind[cut[1:]].tolist())
            for no, (x, y, size, kind) in enumerate(places):
                yield spec, row, no, x, y, size, KINDS[kind] if y < b.at_byte[-1] else "end", b.raw[x:y].decode()


def split_corpus(df: DataFrame, limits: dict[int, tuple[int, int]], id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str = TOKENIZER_PATH) -> DataFrame:
    """Pieces of all texts above a limit.

    ``limits``: spec id to (limit, overlap) in tokens. Gives ``spec_id, id_col,
    piece_no, start_byte, end_byte, n_tokens, cut_at, text``; byte positions are
    those of the UTF-8 form; ``cut_at`` is the kind of boundary the piece ends at.
    """
    for limit, overlap in limits.values():
        if not 0 <= overlap <= limit - LEAST_ROOM:
            raise ValueError("the overlap must leave room in the limit")
    vocabulary = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary_path))
    key = df.schema[id_col].dataType
    schema = T.StructType(
        [T.StructField("spec_id", T.IntegerType()), T.StructField(id_col, key), T.StructField("piece_no", T.IntegerType())]
        + [T.StructField(c, T.LongType()) for c in ("start_byte", "end_byte", "n_tokens")]
        + [T.StructField("cut_at", T.StringType()), T.StructField("text", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = MergeReplay(vocabulary.value)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in chunks(texts):
                rows = list(split_texts(replay, texts[a:b], limits))
                if not rows:
                    continue
                spec, row, no, x, y, n, kind, text = zip(*rows)
                keys = batch.column(0).take(pa.array([a + r for r in row]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(spec, pa.int32()), keys, pa.array(no, pa.int32()), pa.array(x, pa.int64()), pa.array(y, pa.int64()), pa.array(n, pa.int64()), pa.array(kind), pa.array(text, pa.string())],
                    names=schema.names,
                )

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)
