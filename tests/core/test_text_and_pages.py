"""Text primitives, normalization and page reading."""

import datetime as dt

from pyspark.sql import functions as F

from chronolex.functions import text as X
from chronolex.operators import normalize as N
from chronolex.sources import html


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values) or "x string"
    return spark.createDataFrame([tuple(values.values()) or ("",)], schema).select(column.alias("v")).first().v


def test_primitives(spark):
    assert one(spark, X.clean_text(F.col("t")), t="  a\r\nb\n\n\n\nc  \t d 　") == "a\n\nb\n\nc d"
    assert one(spark, X.trim_ws(F.col("t")), t=" x y\n\t") == "x y"
    assert one(spark, X.count_of(F.col("t"), "aa"), t="aaaaa") == 2
    assert one(spark, X.count_all(F.col("t"), ["labor market", "labor markets"]), t="labor markets") == 2
    assert one(spark, X.sentences(F.col("t")), t="One. Two!  Three?\nfour.five") == ["One.", "Two!", "Three?", "four.five"]
    assert one(spark, X.blocks(F.col("t")), t="\n\na\n\n \n\nb\n") == ["a", "b"]
    assert one(spark, X.tokens(F.col("t")), t="It's A well-known Ünit x1 I") == ["it's", "well-known", "nit"]
    assert one(spark, X.slug(F.col("t")), t="--Söme Näme 2!") == "s_me_n_me_2" and one(spark, X.slug(F.col("t")), t="***") == "unknown_speaker"
    assert one(spark, X.word_count(F.col("t")), t=" a b  c ") == 3 and one(spark, X.word_count(F.col("t")), t=None) in (0, -1)


def test_sources_and_types(spark):
    assert one(spark, N.detect_source(F.col("u")), u="https://www.federalreserve.gov/x") == "Board of Governors"
    assert one(spark, N.detect_source(F.col("u")), u="https://Other.example/x") == "other.example"
    assert one(spark, N.detect_source(F.col("u")), u=None) is None and one(spark, N.detect_source(F.col("u")), u="no url") is None
    kind = lambda t, title="", u="": one(spark, N.detect_document_type(F.col("t"), F.col("title"), F.col("u")), t=t, title=title, u=u)
    assert kind("Remarks at the press conference") == "press_conference" and kind("x", "Q&A with staff") == "qa_transcript" and kind("minutes") == "statement"
    assert kind("a" * 2000 + "testimony") == "unknown" and kind("", u="https://x/speech/1") == "speech"


def test_dates_and_speakers(spark):
    date = lambda t: one(spark, N.extract_date(F.col("t")), t=t)
    assert date("on 2024-02-31 and March  3, 2020 and 2019-01-01") == dt.date(2020, 3, 3) and date("2021-05-06") == dt.date(2021, 5, 6)
    assert date("no date") is None and date(None) is None and date("x" * 5000 + "2021-05-06") is None
    speaker = lambda t: one(spark, N.extract_speaker(F.col("t")), t=t)
    assert speaker("\n lower case line\nFederal Reserve Board\nJane Q. Doe\nOther") == "Jane Q. Doe" and speaker("a\nb") is None


def test_refine_and_suppress(spark):
    long = "A paragraph that is long enough to stay on its own. " * 4
    text = "\n\n".join(["Federal Reserve Board", "March 3, 2020", "The Title", "May 2020", "Share on X", long.strip(), "Back to Top", "gone"])
    assert one(spark, N.refine_page_text(F.col("t"), F.col("h")), t=text, h="The Title") == "May 2020\n\n" + long.strip()
    assert one(spark, N.refine_page_text(F.col("t"), F.col("h")), t="short\n\nlast update", h=None) == "short\n\nlast update"
    keep = lambda t, kind, s=None, who=None: one(spark, N.suppress_blocks(F.col("t"), F.col("k"), F.col("s"), F.col("w")), t=t, k=kind, s=s, w=who)
    assert keep("New.\n\nVoting for the monetary policy action were all.", "press_release") == "New."
    assert keep("New.\n\nFor media inquiries, call 202-555-0000", "press_release", "Board of Governors") == "New."
    assert keep("New.\n\nFor media inquiries, call 202-555-0000", "press_release", "Other") == "New.\n\nFor media inquiries, call 202-555-0000"
    assert keep("Let me say a few words about it", "press_conference") == "Let me say a few words about it"
    assert keep("a\n\n\n\nb", "speech") == "a\n\n\n\nb"


def test_segments(spark):
    df = spark.createDataFrame([(1, "Hello.\n\nQ. Why?\n\nAnswer: so.\n\nQuestion: and?", "Jane"), (2, None, "J"), (3, " ", "J")], "doc_id int, normalized_text string, speaker_name string")
    rows = [tuple(r)[1:4] for r in N.segments(df).orderBy("doc_id", "segment_index").collect()]
    assert rows == [(0, "Jane", "body"), (1, "Question", "question"), (2, "Jane", "answer"), (3, "Question", "question")]


PAGE = """<html><head><title>Site title</title><meta property="article:published_time" content="2025-11-07T10:00"></head><body><header><h3 class="title">In header</h3></header>
<div class="heading"><p class="article__time">November 8, 2025</p><h3 class=title><em>Machines and
 the Economy</em></h3><p class="speaker"><a>Governor Jane Doe</a></p></div>
<div class="col-xs-12 col-sm-8 col-md-8"><p>First <strong>bold</strong><br>part.</p><p>Second part{}.</p><nav><p>Menu</p></nav></div></body></html>"""


def test_pages(spark):
    found = html.read(PAGE.format(" again" * 100), "https://www.federalreserve.gov/speech.htm")
    assert found["title"] == "Machines and the Economy" and found["speaker"] == "Governor Jane Doe" and found["dates"] == ["2025-11-07T10:00", "November 8, 2025"]
    assert found["text"].startswith("First bold part.\n\nSecond part again") and "Menu" not in found["text"]
    root = html.parse("<div class='a b'>x</div><div class=c>y<p>1<p>2</div><b></i>tail")
    assert [e.text() for e in html.select(root, ".a.b + .c")] == ["y 1 2"] and [e.text() for e in html.select(root, ".c p")] == ["1 2", "2"]
    pages = spark.createDataFrame([(1, "https://www.federalreserve.gov/a/speech.htm", PAGE.format(" again" * 100)), (2, "https://x.example/only-url/", "<p>tiny"), (3, "u", None)], "id int, source_url string, raw_content string")
    rows = {r.id: r for r in N.normalize_pages(html.parse_pages(pages, keep=("id", "source_url"))).collect()}
    assert rows[1].speech_date == dt.date(2025, 11, 7) and rows[1].source == "Board of Governors" and rows[1].document_type == "speech"
    assert rows[2].title == "only-url" and rows[2].normalized_text == "tiny" and set(rows) == {1, 2}


def test_markdown(spark):
    rows = [("# Hi\n\nSome text of 2024-01-02.", {"title": "T", "speaker_name": "S", "document_type": "speech", "speech_date": "2023-05-06"}), ("Jane Doe\n\ntext 2024-01-02", {"document_type": "nonsense"}), (None, None)]
    out = N.normalize_markdown(spark.createDataFrame(rows, "markdown_text string, metadata map<string,string>")).collect()
    assert (out[0].title, out[0].speaker_name, out[0].speech_date, out[0].document_type) == ("T", "S", dt.date(2023, 5, 6), "speech")
    assert (out[1].speaker_name, out[1].speech_date, out[1].document_type) == ("Jane Doe", dt.date(2024, 1, 2), "unknown")
    assert out[2].normalized_text == "" and out[2].word_count == 0
