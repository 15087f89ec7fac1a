"""Names: parsing, distances, merging and rematching."""

import pytest

from chronolex.llm import names

REGISTER = [
    (5, "Reporter Skelozyn", "Reporter"), (9, "Akio Skelozyn", None), (3, "A. Skelozyn", "Reporter"),
    (11, "William Delwivick", "Vice Chair"), (12, "Delwivick, WW", None), (13, "Wiliam Delwivick", "Vice Chair"),
    (20, "Abigail Tavsulow", None), (21, "Gabriela Tavsulow", None), (22, "Priya Tavtristad", None),
    (30, "Reserve Bank of Willet Springs", "Institution"), (31, "RESERVE BANK OF GREYWATER", "Institution"), (29, "Greywater Reserve Bank", "Institution"),
    (40, "Joint Committee on Money and Credit", "Institution"), (50, None, None), (51, "  ", None),
]
CASES = {
    "Akio Skelozyn": 3, "SKELOZYN Akio": 3, "Skelozyn, Akio": 3, "A. Skelozyn": 3, "Akio Skelozin": 3, "Dr. A. Skelozyn": 3, "Akio Skel0zyn *": 3,
    "Bill Delwivick": 11, "Delwivick, Bill W.": 11, "W.W. Delwivick": 11, "Vice Chair Delwivick": 11, "William  De1wivick": 11, "WILLIAM DELWIVICK": 11, "William Delwivick (Continental Reserve Board)": 11, "William Delwivick, Vice Chair": 11, "Wililam Delwvick": 11,
    "Abby Tavsulow": 20, "A. Tavsulow": 20, "G. Tavsulow": 21, "Priya Tavsulow": None, "Tavsulow": None, "Professor Tavsulow": None,
    "R.B.W.S.": 30, "RBWS": 30, "Willet Springs Reserve Bank": 30, "Res. Bk. of Willet Springs": 30, "The Reserve Bank of Willet Springs (staff)": 30, "Reserve Bank of Willet Spraings": 30, "Reserve Bank of Greywateer": 29,
    "J.C.M.C.": 40, "Joint Committee on Money and Credit, press office": 40, "Reserve Bank of Somewhere": None, "Nobody Here": None, "": None, "  ": None, None: None, "***": None, "李": None,
}


def test_link_documents(spark):
    register = spark.createDataFrame(REGISTER, "id long, name string, title string").withColumnRenamed("x", "y")
    docs = [(i, n, 1) for i, n in enumerate(CASES)] + [(100, "Akio Skelozyn", 1), (101, "Akio Skelozyn", 1)]
    documents = spark.createDataFrame(docs, "doc_id long, speaker_name string, id int").repartition(3)
    got = {r.doc_id: r.speaker_id for r in names.link_documents(documents, register).collect()}
    expected = {i: v for i, v in enumerate(CASES.values()) if v is not None} | {100: 3, 101: 3}
    assert {list(CASES)[i] if i < 100 else i: v for i, v in got.items()} == {list(CASES)[i] if i < 100 else i: v for i, v in expected.items()}
    assert names.link_documents(documents, register.limit(0)).count() == 0
    assert names.link_documents(documents.limit(0), register).count() == 0


@pytest.mark.parametrize("a,b,d", [("abc", "abc", 0), ("abc", "acb", 1), ("abc", "ab", 1), ("abc", "xbcy", 2), ("abc", "xyz", 3), ("", "ab", 2)])
def test_edits(a, b, d):
    assert names.edits(a, b, 5) == d and names.edits(a, b, d) == d
    if d:
        assert names.edits(a, b, d - 1) == d


def test_two_edits_share_a_key():
    for a, b in (("delwivick", "delwvik"), ("holquist", "hollqust"), ("espelock", "sepelokc")):
        assert names.deletions(a) & names.deletions(b)


def test_richer_profiles_match_more(spark):
    # the nickname comes with a spelling; the second variant is within reach of the first only
    register = spark.createDataFrame([(1, "Robert Wylxaford", None)], "id long, name string, title string")
    documents = spark.createDataFrame([(1, "Rob Wylxafrod"), (2, "R. Wylxafrod")], "doc_id long, speaker_name string")
    assert {r.doc_id: r.speaker_id for r in names.link_documents(documents, register).collect()} == {1: 1, 2: 1}


def test_short_forms_and_acronyms(spark):
    assert names._given("lindi", "lindiwe") == 0.5 and names._given("li", "lindiwe") == 9 and names._given("bob", "robert") == 0.25
    assert names.parse("A.B.C.D.E.F.G.H.")["letters"] == "abcdefgh" and names.parse("SMITHSON")["family"] == "smithson"
    register = spark.createDataFrame([(1, "Ida Smith", None), (2, "Joint Committee on Money and Credit of Upper Hills Valley Town", "Institution")], "id long, name string, title string")
    documents = spark.createDataFrame([(1, "SMITH"), (2, "JCMCUHVT"), (3, "J.C.M.C.U.H.V.T."), (4, "ZZTOP")], "doc_id long, speaker_name string")
    assert {r.doc_id: r.speaker_id for r in names.link_documents(documents, register).collect()} == {1: 1, 2: 2, 3: 2}
