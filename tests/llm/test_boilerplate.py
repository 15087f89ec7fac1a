"""Minimum cuts against brute force, and labelling of pages and plain texts."""

import itertools
import random

from chronolex.llm import boilerplate

BODY = [
    "Inflation has eased since the spring, although shelter costs remain high in most of the districts we visit every year.",
    "We asked about hiring in the region. Several owners said that the market for skilled labor is as tight as it has been since records began.",
    "The committee will act as appropriate, and it will look at the whole of the data before it decides. Nothing in this is new to those who listened.",
]
FURNITURE = ["Skip to main content", "Share this page: mail, print, link", "Get our weekly digest in your inbox", "Privacy notice / Accessibility / Site map", "Advertisement safer vaults for your town"]


def page(i: int) -> str:
    body = "".join(f"<p class=b>{t}<br>" for t in BODY[i % 3 :] + BODY[: i % 3])
    return f"<html><body><ul><li><a href=/>Skip to main content</a></ul><div class=nav>{FURNITURE[1]}</div><h2>Prices and wages</h2>{body}<p class=f>{FURNITURE[2 + i % 3]}</p><p class=f>© {2000 + i} A Bank</p></body></html>"


def test_minimum_cut_is_minimal():
    rng = random.Random(2)
    for _ in range(200):
        n = rng.randint(1, 8)
        odds = [rng.uniform(-2, 2) for _ in range(n)]
        edges = [(rng.randrange(n), rng.randrange(n), rng.uniform(0, 2)) for _ in range(rng.randint(0, 12))]
        cost = lambda x: sum(-o for o, v in zip(odds, x) if v) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: B023, E731
        best = min(map(cost, itertools.product([False, True], repeat=n)))
        assert abs(cost(boilerplate.minimum_cut(odds, edges)) - best) < 1e-6
    assert boilerplate.minimum_cut([], []) == []


def test_find_boilerplate(spark):
    pages = spark.createDataFrame([(i, page(i), "x") for i in range(60)] + [(90, None, "x"), (91, "plain text", "x")], "id long, raw_content string, line_no string")
    wrapped = "Skip to main content\n\nInflation has eased since the spring, although shelter costs remain\nhigh in most of the districts we visit every year. Several owners said\nthat the market for skilled labor is tight.\n\nGet our weekly digest in your inbox"
    texts = [
        (1, 3, "\n".join(["Skip to main content", "", *BODY, "", "Get our weekly digest in your inbox"])),
        (2, 90, wrapped), (3, None, wrapped), (4, 91, None), (5, 1, ""), (6, 2, "\n \n"), (7, 555, BODY[0]), (3, None, wrapped),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, source_document_id long, normalized_text string").repartition(2)
    got = sorted((r.doc_id, r.line_no) for r in boilerplate.find_boilerplate(docs, pages).collect())
    assert got == sorted([(1, 0), (1, 6), (2, 0), (2, 6), (3, 0), (3, 6), (3, 0), (3, 6)])
    assert boilerplate.find_boilerplate(docs.limit(0), pages).count() == 0
    # without labelled pages only the cues speak
    assert boilerplate.find_boilerplate(docs, pages.limit(0)).filter("doc_id = 7").count() == 0


def test_main_body(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc"), (2, None), (3, "x")], "doc_id long, normalized_text string")
    found = spark.createDataFrame([(1, 0), (1, 2)], "doc_id long, line_no int")
    assert {r.doc_id: r.text for r in boilerplate.main_body(docs, found).collect()} == {1: "b", 2: None, 3: "x"}


def test_lenient_pages():
    blocks = boilerplate.read_page("<title>no</title><div class='a b'>one &amp; two<p>three<ul><li><a href=x>four</a></div>five<script>var x='<p>no';</script><nav>six</nav")
    assert [b.text for b in blocks][:4] == ["one & two", "three", "four", "five"]
    assert boilerplate.read_page("") == [] and boilerplate.block_roles([]) == []


def test_all_words_of_a_long_line_speak():
    words = "the board said that growth in the region had been held back by the weather".split()
    line = " ".join(words + ["copyright"] + words)
    assert "in:copyright" in boilerplate.features(line) and "in:copyright" not in boilerplate.features("copyright " + line.replace("copyright ", ""))
    plain = boilerplate.fit([], [])
    assert plain.odds(line) > plain.odds(line.replace("copyright", "weather"))


def test_the_sample_is_bounded(spark):
    pages = spark.createDataFrame([(i, page(i)) for i in range(20)], "id long, raw_content string")
    assert boilerplate.train(pages).weights and boilerplate.train(pages, most=0).weights == boilerplate.fit([], []).weights
    assert boilerplate.train(pages, chars=100).weights == boilerplate.fit([], []).weights
