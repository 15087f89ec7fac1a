"""Encoding, packing and splitting against the reference tokenizer and brute force."""

from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chronolex.llm import bpe, packing, splitting

TEXTS = [None, "", " ", "plain words, and more words.", "<|endoftext|> is text", "naïve café — 日本語のテキスト。次の文。", "a" * 3000, "x\r\n\r\n\ty  z ", "don't we'll 1234 ½", "é ‍ 😀😀", "\x1c \x1d", "plain words, and more words."]


@pytest.fixture(scope="module")
def replay():
    return bpe.MergeReplay(bpe.read_vocabulary())


@pytest.fixture(scope="module")
def known():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(bpe.TOKENIZER_PATH)
    t.encode_special_tokens = True
    return t


def ids_of(replay, text):
    words = bpe.split_words(text)
    assert "".join(words) == text
    table = replay.learn([words])
    return [i for w in words for i in table[w]]


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_replay_equals_the_public_tokenizer(replay, known, text):
    assert ids_of(replay, text) == known.encode(text, add_special_tokens=False).ids


def test_encode_corpus(spark, known):
    rows = [(i, t, "clash") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    got = {r.doc_id: r.ids for r in bpe.encode_corpus(df).collect()}
    assert got == {i: known.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(TEXTS)}
    assert bpe.encode_corpus(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in bpe.count_tokens(df).collect()} == {i: len(x) for i, x in got.items()}


def test_cache_overflow_does_not_change_ids(replay, monkeypatch):
    before = ids_of(replay, "some words here and there")
    monkeypatch.setattr(bpe, "CACHE_WORDS", 2)
    assert ids_of(replay, "other text") and ids_of(replay, "some words here and there") == before


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_best_two_fit_uses_every_item_once(counts):
    left, next_container = dict(counts), 0
    for f in packing.best_two_fit(counts, 40):
        assert f.first == next_container and f.times > 0
        next_container += f.times
        assert sum(s * n for s, n in f.sizes.items()) <= 40
        for s, n in f.sizes.items():
            left[s] -= n * f.times
    assert not any(left.values())


def test_exchange_fills_the_gap_more_tightly():
    # greedy takes 6 and 3 of 10; 3 gives way to 2 and 2
    first = packing.best_two_fit({6: 1, 3: 1, 2: 2}, 10)[0]
    assert first.sizes == {6: 1, 2: 2}


def test_as_few_containers_as_best_fit_decreasing():
    rng = np.random.default_rng(6)
    for top in (60, 100):
        sizes = sorted(rng.integers(1, top + 1, 3000).tolist(), reverse=True)
        gaps: list[int] = []
        for s in sizes:
            fit = min((g for g in gaps if g >= s), default=None)
            gaps.append((100 if fit is None else gaps.pop(gaps.index(fit))) - s)
        used = sum(f.times for f in packing.best_two_fit(dict(zip(*np.unique(sizes, return_counts=True))), 100))
        assert used <= len(gaps) * 1.01


def test_pack(spark):
    sizes = [(i, n) for i, n in enumerate([0, None, 7, 7, 7, 3, 3, 100, 101, 250, 60, 40] + [5] * 300)]
    df = spark.createDataFrame(sizes, "doc_id long, n_tokens long").repartition(5)
    rows = packing.pack(df, {1: 100, 2: 64}).collect()
    for spec, capacity in ((1, 100), (2, 64)):
        own = [r for r in rows if r.spec_id == spec]
        filled, total = defaultdict(int), defaultdict(int)
        for r in own:
            total[r.doc_id] += r.n_tokens
            if r.container_id is None:
                assert r.n_tokens == 0
            else:
                filled[r.container_id] += r.n_tokens
        assert dict(total) == {i: n or 0 for i, n in sizes}
        assert max(filled.values()) <= capacity and sorted(filled) == list(range(len(filled)))
        assert len(filled) <= sum(n or 0 for _, n in sizes) / capacity * 1.1 + 1
        assert all(len([r for r in own if r.doc_id == i]) == max(1, -(-(n or 0) // capacity)) for i, n in sizes)
    assert packing.pack(df.limit(0), {1: 100}).count() == 0


def check_pieces(replay, text, pieces, limit, overlap):
    raw = text.encode()
    n = len(ids_of(replay, text))
    assert pieces[0].start_byte == 0 and pieces[-1].end_byte == len(raw)
    for p in pieces:
        assert 0 < p.n_tokens <= limit and raw[p.start_byte : p.end_byte].decode() == p.text
        assert len(ids_of(replay, p.text)) <= limit or len(p.text.split()) < 3
    for p, q in zip(pieces, pieces[1:]):
        assert p.start_byte < q.start_byte <= p.end_byte < q.end_byte
        assert overlap <= len(ids_of(replay, raw[q.start_byte : p.end_byte].decode())) + 3
    assert n > limit


def test_split(spark, replay):
    prose = "\n\n".join("A sentence of some words goes here. Another one follows it, with a comma! " * k for k in (2, 5, 1, 9))
    texts = [None, "", "short", prose, prose, "word " * 400, "z9" * 900, "日本語のテキスト" * 80, "😀" * 300, "line\n" * 300]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spec_id int")
    limits = {3: (64, 16), 4: (40, 0)}
    by = defaultdict(list)
    for r in splitting.split_corpus(df, limits).orderBy("piece_no").collect():
        by[r.spec_id, r.doc_id].append(r)
    for spec, (limit, overlap) in limits.items():
        long = {i for i, t in enumerate(texts) if t and len(ids_of(replay, t)) > limit}
        assert {d for s, d in by if s == spec} == long
        for i in long:
            assert [p.piece_no for p in by[spec, i]] == list(range(len(by[spec, i])))
            check_pieces(replay, texts[i], by[spec, i], limit, overlap)
    assert [p.text for p in by[3, 3]] == [p.text for p in by[3, 4]]
    assert {p.cut_at for p in by[3, 5]} == {"word", "end"} and "token" in {p.cut_at for p in by[3, 6]}
    assert "paragraph" in {p.cut_at for p in by[3, 3]}
    assert splitting.split_corpus(df.limit(0), limits).count() == 0


PIECES = ["word ", "naïve café — ", "日本語のテキスト。", "😀é", "é ‍ 😀", "a" * 40, "z9" * 20, "\n\n", "One. Two! ", "\t \r\n", "Żółć ", "ถ้อยคำ", "½½½"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(PIECES), min_size=1, max_size=60), st.text(max_size=30), st.integers(7, 40), st.data())
def test_pieces_cover_the_text_within_limit_and_overlap(replay, parts, extra, limit, data):
    overlap = data.draw(st.integers(0, limit - splitting.LEAST_ROOM))
    text = "".join(parts) + extra
    raw = text.encode("utf-8", "replace")
    n = len(ids_of(replay, text))
    pieces = list(splitting.split_texts(replay, [None, text, ""], {5: (limit, overlap), 6: (limit + 9, overlap)}))
    for spec, most in ((5, limit), (6, limit + 9)):
        own = [p for p in pieces if p[0] == spec]
        assert bool(own) == (n > most) and all(p[1] == 1 for p in own)
        if own:
            assert own[0][3] == 0 and own[-1][4] == len(raw) and [p[2] for p in own] == list(range(len(own)))
            assert all(0 < p[5] <= most and raw[p[3] : p[4]].decode() == p[7] for p in own)
            at = np.concatenate([[0], np.cumsum(replay.byte_length[ids_of(replay, text)])])
            token = {int(x): i for i, x in enumerate(at)}
            for p, q in zip(own, own[1:]):
                assert p[3] < q[3] <= p[4] < q[4] and overlap <= token[p[4]] - token[q[3]] <= overlap + 3 or q[3] == 0


def test_an_overlap_without_room_is_refused(spark):
    with pytest.raises(ValueError):
        splitting.split_corpus(spark.createDataFrame([(1, "x")], "doc_id long, text string"), {1: (20, 14)})


def test_doubling_equals_following():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(2, 60))
        step = np.minimum(np.arange(n) + rng.integers(1, 7, n), n - 1)
        at, expected = 0, {0}
        while at != n - 1:
            at = int(step[at])
            expected.add(at)
        assert set(np.nonzero(splitting.cuts(step, np.array([0])))[0].tolist()) == expected
