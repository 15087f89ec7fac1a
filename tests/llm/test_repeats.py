"""Near-duplicates and repeated lines against brute force."""

import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from chronolex.llm import near_duplicates, repeated_lines

RNG = random.Random(11)
WORDS = [f"w{i}" for i in range(400)]


def variants() -> list[str]:
    out = []
    for _ in range(25):
        base = [RNG.choice(WORDS) for _ in range(RNG.randint(30, 200))]
        out.append(" ".join(base))
        for _ in range(RNG.randint(0, 3)):
            other = list(base)
            for _ in range(RNG.randint(0, 6)):
                other[RNG.randrange(len(other))] = RNG.choice(WORDS)
            out.append("  ".join(other).title())
    return out


def runs(text, width):
    w = (text or "").lower().split()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


@pytest.fixture(scope="module")
def documents(spark):
    texts = [None, "", "two words", "one two three", "ONE  two\nthree", "one two three"] + variants() + ["same text of several words"] * 12
    return list(enumerate(texts)), spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, normalized_text string, id string").repartition(4)


@pytest.mark.parametrize("width,percent", [(3, 70), (5, 80)])
def test_similar_pairs(documents, width, percent):
    rows, df = documents
    sets = {i: s for i, t in rows if (s := runs(t, width))}
    expected = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) * 100 >= percent * len(sets[a] | sets[b])}
    got = [(r.doc_a, r.doc_b) for r in near_duplicates.similar_pairs(df, width=width, min_percent=percent).collect()]
    assert len(got) == len(set(got)) and set(got) == expected
    groups = {r.doc_id: r for r in near_duplicates.similar_groups(df, width=width, min_percent=percent).collect()}
    links = Counter(x for p in expected for x in p)
    assert {i: r.n_links for i, r in groups.items()} == {i: links[i] for i in sets}
    for a, b in expected:
        assert groups[a].group_id == groups[b].group_id
    assert all(r.class_id <= i and r.group_id <= r.class_id for i, r in groups.items())


def test_empty_and_repeated(documents):
    _, df = documents
    assert near_duplicates.similar_pairs(df.limit(0)).count() == 0
    twice = df.filter("doc_id in (3, 4)")
    assert [(r.doc_a, r.doc_b) for r in near_duplicates.similar_pairs(twice.union(twice), width=3, min_percent=70).collect()] == [(3, 4)]


def test_pigeonhole():
    """Signatures within the guaranteed distance share an index entry."""
    rng = np.random.default_rng(1)
    n = near_duplicates.CHUNKS * near_duplicates.SYMBOLS
    for _ in range(200):
        a = rng.integers(0, 2**16, n, dtype=np.uint16)
        b = a.copy()
        at = rng.choice(n, (near_duplicates.ERRORS + 1) * near_duplicates.CHUNKS - 1, replace=False)
        b[at] ^= np.uint16(1)
        ka, kb = near_duplicates.index_keys(np.stack([a, b]))
        assert set(ka.tolist()) & set(kb.tolist())


def form(line):
    import re

    return re.sub(r"[0-9]+", "0", re.sub(r"[ \t]+", " ", line.lower())).strip("-–—*•|·>»:.,; ")


def test_repeated_lines(spark):
    legal, share = "© 2020  Bank. All rights", "» Share\tthis"
    docs = []
    for i in range(40):
        lines = [f"unique line {chr(97 + i % 26)}{chr(97 + i // 26)} here"] + [legal.replace("2020", str(2000 + i)), "", share] * (i % 4 == 0) + ["---", "- - -"] + (["Share this", "SHARE THIS:"] if i < 4 else [])
        docs.append((i, "A" if i < 30 else "B" if i < 38 else None, "\n".join(lines)))
    docs += [(90, "A", None), (91, "B", ""), (92, "C", legal), (93, "C", legal), (94, "D", "\n".join(["rare"] * 9))]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, source string, normalized_text string, line_no int, h1 int").repartition(3)
    seen, total = defaultdict(set), Counter()
    for i, s, t in docs:
        if s:
            total[s] += 1
            for x in (t or "").split("\n"):
                seen[s, form(x)].add(i)
    expected = {(i, n) for i, s, t in docs if s for n, x in enumerate((t or "").split("\n")) if form(x) and len(seen[s, form(x)]) >= 5 and len(seen[s, form(x)]) * 100 >= 5 * total[s]}
    assert expected and {(r.doc_id, r.line_no) for r in repeated_lines.find_repeated_lines(df).collect()} == expected
    clean = {r.doc_id: (r.text, r.removed) for r in repeated_lines.remove_repeated_lines(df).collect()}
    for i, _, t in docs:
        gone = {n for d, n in expected if d == i}
        assert clean[i] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone), len(gone))
    sequences = {(r.source, tuple(r.lines)): r.docs for r in repeated_lines.frequent_sequences(df).collect()}
    assert sequences["A", ("© 0 bank. all rights", "share this")] == 8 and ("A", ("share this",)) in sequences
    assert all(n <= len(seen[s, x]) for (s, lines), n in sequences.items() for x in lines)
    assert repeated_lines.find_repeated_lines(df.limit(0)).count() == 0


def test_long_runs_of_edge_characters(spark):
    df = spark.createDataFrame([(i, "A", "-" * 50_000 + "x\n" + "." * 20_000) for i in range(6)], "doc_id long, source string, normalized_text string")
    assert {r.line_no for r in repeated_lines.find_repeated_lines(df).collect()} == {0}


def test_bits_follow_the_symbols():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 2**16, (1, 96), dtype=np.uint16)
    b = a.copy()
    b[0, :10] ^= np.uint16(1)
    b[0, 80:] ^= np.uint16(2)
    b[0, 90:] ^= np.uint16(1)
    x, y = near_duplicates.bits(np.concatenate([a, b]))
    assert int(np.uint64(x[0] ^ x[1])).bit_count() == 10 and int(np.uint32(y[0] ^ y[1])).bit_count() == 6
    assert near_duplicates.FARTHEST_BITS >= (near_duplicates.ERRORS + 1) * near_duplicates.CHUNKS - 1


def test_sequences_of_any_length(spark):
    block = [f"line {chr(97 + i)} of the block" for i in range(11)]
    docs = [(i, "A", "\n".join([f"opening {chr(97 + i)}", *block, f"closing {chr(97 + i)}"])) for i in range(6)]
    df = spark.createDataFrame(docs, "doc_id long, source string, normalized_text string")
    got = {tuple(r.lines): r.docs for r in repeated_lines.frequent_sequences(df).collect()}
    assert got == {tuple(block[a:b]): 6 for a in range(11) for b in range(a + 1, 12)}


def sequences_by_hand(docs, gap):
    """Frequent sequences and the lines of their occurrences, by brute force."""
    total, seen = Counter(s for _, s, _ in docs if s), defaultdict(set)
    for k, (_, s, t) in enumerate(docs):
        for x in (t or "").split("\n"):
            if s and form(x):
                seen[s, (form(x),)].add(k)
    good = lambda s, ids: len(ids) >= 5 and len(ids) * 100 >= 5 * total[s]
    single = {x for x, ids in seen.items() if good(x[0], ids)}
    spans, lines = defaultdict(set), set()
    for k, (_, s, t) in enumerate(docs):
        kept = [(n, x) for n, x in enumerate(form(x) for x in (t or "").split("\n")) if x]
        kept = [(i, n, x) for i, (n, x) in enumerate(kept) if (s, (x,)) in single]
        for a in range(len(kept)):
            for b in range(a, len(kept)):
                if b > a and kept[b][0] - kept[b - 1][0] > gap + 1:
                    break
                spans[s, tuple(x for _, _, x in kept[a : b + 1])].add((k, *(n for _, n, _ in kept[a : b + 1])))
    frequent = {}
    for (s, x), at in spans.items():
        if good(s, ids := {o[0] for o in at}):
            frequent[s, x] = len(ids)
            lines |= {(docs[o[0]][0], n) for o in at for n in o[1:]}
    return frequent, lines


@pytest.mark.parametrize("gap", [0, 1])
def test_sequences_with_gaps(spark, gap):
    rng = random.Random(gap)
    docs = [(i, rng.choice("AAB") if i % 17 else None, "\n".join(rng.choice(["Share this", "", "Page 7", "© 2020", f"own {chr(97 + i % 26)} {chr(97 + i // 26)} {j * 'x'}"]) for j in range(12))) for i in range(60)]
    docs.append((60, "A", "a\nb\n\nPage 1\nPage 2\nPage 3"))
    df = spark.createDataFrame(docs, "doc_id long, source string, normalized_text string").repartition(3)
    frequent, lines = sequences_by_hand(docs, gap)
    got = {(r.source, tuple(r.lines)): r.docs for r in repeated_lines.frequent_sequences(df, gap=gap).collect()}
    assert got == frequent and max(len(x) for _, x in got) >= 3
    found = [(r.doc_id, r.line_no) for r in repeated_lines.find_repeated_lines(df, gap=gap).collect()]
    assert set(found) == lines and len(found) == len(lines)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rows = [(1, "A", "same line\nother\nlast")] * 5
    df = spark.createDataFrame(rows, "doc_id long, source string, normalized_text string")
    assert sorted((r.doc_id, r.line_no) for r in repeated_lines.find_repeated_lines(df).collect()) == [(1, n) for n in range(3) for _ in range(5)]
    assert {tuple(r.lines): r.docs for r in repeated_lines.frequent_sequences(df).collect()}[("same line", "other", "last")] == 5
