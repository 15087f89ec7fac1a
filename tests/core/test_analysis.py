"""Fingerprints, phrases, comparisons, shifts and artifact queries."""

import datetime as dt
import math
import random
import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from chronolex.functions import ontology as O
from chronolex.operators import artifacts, compare, fingerprint, phrases, shifts
from chronolex.plans.components import connected_components
from chronolex.plans.corpus import Corpus, phrases_of

TEXTS = [
    "Inflation remains elevated. Inflation may be persistent. Prices might rise further and inflation is a concern.",
    "Employment is strong. Jobs growth appears to be slowing. The labor market is balanced, and wages are moderating. We are careful.",
    "Inflation is moderating. Prices are declining and there is progress on inflation. Inflation is improving.",
    "Nothing to see here.",
    "",
]


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def documents(spark):
    rows = [
        (1, "k1", "Ann", "One", day(0), TEXTS[0]), (2, "k2", "Ann", "Two", day(10), TEXTS[1]), (3, "k3", "Ann", "Three", day(100), TEXTS[2]), (4, "k4", "Ann", "Four", None, TEXTS[0]),
        (5, "k5", "Bob", "Five", day(5), TEXTS[3]), (6, "k6", None, "Six", day(5), TEXTS[0]), (7, "k7", "Bob", "Seven", day(5), TEXTS[4]), (8, "k8", "Bob", "Eight", day(6), None), (9, "k9", "Ann", "Nine", None, TEXTS[3]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, document_key string, speaker_name string, title string, speech_date date, normalized_text string")
    return df.withColumn("document_type", F.lit("speech")).withColumn("created_at", F.to_timestamp("speech_date"))


@pytest.fixture(scope="module")
def corpus(documents):
    return Corpus.of(documents)


def test_fingerprint(corpus):
    rows = {(r.doc_id, r.theme): r for r in corpus.themes.collect()}
    inflation = rows[1, "INFLATION"]
    assert (inflation.hits, inflation.matched, inflation.stance, inflation.trajectory, inflation.emphasis_score) == (4, 3, "very_concerned", "worsening", 7)
    assert inflation.key_hedges == ["may", "might"] and inflation.hedging_level == "light" and inflation.confidence == "moderate"
    assert rows[3, "INFLATION"].stance == "very_optimistic" and rows[3, "INFLATION"].trajectory == "improving"
    assert rows[2, "LABOR_MARKETS"].hits == 4 and (5, "INFLATION") not in rows and not [k for k in rows if k[0] in (7, 8)]
    for r in rows.values():
        for e in r.evidence:
            assert TEXTS[{1: 0, 2: 1, 3: 2, 4: 0, 6: 0}[r.doc_id]][e.start_char : e.end_char] == e.quote
    tones = {r.doc_id: r.overall_tone for r in corpus.docs.collect()}
    assert tones[2] == "cautious" and tones[5] == "measured" and tones[8] == "measured"


def test_headers(documents):
    notes = {r.doc_id: r.uncertainty_notes for r in fingerprint.headers(documents).collect()}
    assert notes[1] == [O.DRAFT_NOTE] and notes[5] == [O.DRAFT_NOTE, O.NO_THEME_NOTE] and set(notes) == set(range(1, 10))


def test_answers(spark, corpus):
    good = '{"themes": {"X": {"stance": "neutral", "trajectory": "stable", "emphasis_score": 4, "hedging_level": "none", "confidence": "high", "evidence": ["q"]}}, "overall_tone": "calm"}'
    rows = [(1, "text\n```json\n" + good + "\n``` more"), (2, "```\n" + good + "\n```"), (3, good.replace("4", "11")), (4, good.replace('"stance": "neutral", ', "")), (5, "no"), (6, None), (7, good)]
    parsed = fingerprint.response_themes(spark.createDataFrame(rows, "doc_id long, raw_response string"))
    got = {r.doc_id: r for r in parsed.collect()}
    assert set(got) == {1, 2, 7} and got[1].quotes == ["q"] and got[1].uncertainty == "medium" and got[1].key_hedges == []
    both = fingerprint.with_fallback(parsed, parsed, corpus.themes)
    assert {(r.doc_id, r.extractor) for r in both.collect()} == {(1, "model"), (2, "model"), (7, "model"), (3, "heuristic"), (4, "heuristic"), (6, "heuristic")}
    prompt = fingerprint.render_prompt("{a}-{b}-{a}", {"a": F.lit(None), "b": F.lit(3)})
    assert spark.range(1).select(prompt.alias("p")).first().p == "-3-"


def grams(text):
    toks = [t.lower() for t in re.findall(r"[A-Za-z][A-Za-z\-']+", text or "")]
    out = Counter()
    for n in (2, 3, 4, 5):
        for i in range(len(toks) - n + 1):
            w = toks[i : i + n]
            if sum(t not in O.STOPWORDS for t in w) >= 2 and " ".join(w) not in O.LOW_SIGNAL:
                out[" ".join(w)] += 1
    return out


def test_phrases(documents):
    rows = documents.collect()
    got = {}
    for r in phrases.phrase_signals(documents, top=20).orderBy("doc_id", "rank").collect():
        got.setdefault(r.doc_id, []).append((r.phrase_text, r.current_count, r.historical_count, r.rarity_score))
    for d in rows:
        if d.speaker_name is None:
            earlier = []
        elif d.speech_date is None:
            earlier = [x for x in rows if x.speaker_name == d.speaker_name and x.doc_id != d.doc_id]
        else:
            earlier = [x for x in rows if x.speaker_name == d.speaker_name and x.speech_date and 1 <= (d.speech_date - x.speech_date).days <= 730]
        past = sum((grams(x.normalized_text) for x in earlier), Counter())
        ranked = [(p, c, past[p], c / (past[p] + 1) * math.log(c + 1.5)) for p, c in grams(d.normalized_text).items()]
        ranked.sort(key=lambda x: -x[3])
        assert got.get(d.doc_id, []) == [(p, c, h, round(r, 4)) for p, c, h, r in ranked[:20]]
    top = phrases.phrase_signals(documents, top=1).first()
    assert len(top.semantic_key) == 12


def test_hot_speakers_get_the_same_phrases(spark, documents):
    words = "the rate of growth and inflation may rise in the spring federal reserve policy".split()
    rng = random.Random(3)
    rows = [(100 + i, rng.choice(["Ann", "Bob", None]), rng.choice([None, *map(day, (0, 3, 3, 500, 731, 1400))]), " ".join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, speaker_name string, speech_date date, normalized_text string").unionByName(documents.select("doc_id", "speaker_name", "speech_date", "normalized_text"))
    gathered, spread = (sorted(map(tuple, phrases.phrase_signals(df, hot_chars=n).collect())) for n in (phrases.HOT_CHARS, 0))
    assert gathered == spread and len(gathered) > 500 and max(r[6] for r in gathered) > 3
    assert phrases.phrase_signals(df.limit(0)).count() == 0


def test_history_lowers_rarity(spark):
    r = [spark.range(1).select(phrases.rarity(F.lit(3), F.lit(h)).alias("r")).first().r for h in (0, 1, 5)]
    assert r == sorted(r, reverse=True) and r[0] == pytest.approx(3 * math.log(4.5))


def test_previous(corpus):
    assert {r.doc_id: r.base_doc_id for r in compare.previous_documents(corpus.docs).collect()} == {1: None, 2: 1, 3: 2, 4: 3, 9: 3, 5: None, 7: None, 8: 7}


def test_previous_of_undated_only(spark):
    docs = spark.createDataFrame([(1, "A", None, None), (2, "A", None, None), (3, "B", None, None)], "doc_id long, speaker_name string, speech_date date, created_at timestamp")
    assert {r.doc_id: r.base_doc_id for r in compare.previous_documents(docs).collect()} == {1: 2, 2: 1, 3: None}


def test_comparisons(corpus):
    rows = {(r.doc_id, r.comparison_type): r for r in corpus.comparisons().collect()}
    assert {k[0] for k in rows} == {2, 3, 4, 8, 9}
    assert rows[2, "t_minus_1"].orphaned == ["INFLATION"] and "LABOR_MARKETS" in rows[2, "t_minus_1"].new_themes
    # the stressed labor theme is 90 days old for document 3: in 24 months, not in 75 days
    assert "LABOR_MARKETS" in rows[3, "window_24m"].orphaned and rows[3, "window_75d"].orphaned == []
    assert rows[8, "t_minus_1"].summary == "No material changes detected" and rows[8, "window_75d"].window_days == 75
    assert len({r.comparison_key for r in rows.values()}) == len(rows)
    changes = compare.compare_to_previous(corpus.docs, corpus.themes).filter("doc_id = 4 and theme = 'INFLATION'").first()
    assert changes.change_type == "more_concerned" and changes.strength == "high" and changes.summary.startswith("stance moved from very_optimistic to very_concerned; trajectory moved")


def test_comparisons_carry_phrases(corpus, documents):
    ranked = {}
    for r in phrases.phrase_signals(documents).orderBy("doc_id", "rank").collect():
        ranked.setdefault(r.doc_id, []).append(r.phrase_text)
    rows = corpus.comparisons().collect()
    for r in rows:
        expected = ranked.get(r.doc_id, [])[:10]
        assert [x.phrase_text for x in r.phrase_anomalies] == expected and r.n_phrases == len(expected)
        assert (f"{len(expected)} phrase anomalies" in r.summary) == bool(expected)
    assert {r.n_phrases for r in rows if r.doc_id in (2, 8)} == {0, 10}


def test_window_summaries(corpus):
    got = {r.doc_id: r.summary for r in compare.window_summaries(corpus.docs, corpus.themes, 75, "75d").collect()}
    assert got[1] == "No documents available for 75d." and got[2] == "75d: dominant themes INFLATION; dominant tone confident." or got[2].startswith("75d: dominant themes INFLATION")
    assert got[8] == "75d: dominant themes none; dominant tone measured."


assessment = st.tuples(st.sampled_from([*O.STANCES, "odd"]), st.sampled_from([*O.TRAJECTORIES, "odd"]), st.integers(1, 10), st.sampled_from([*O.HEDGING_LEVELS, "odd"]), st.sampled_from(["low", "medium", "high", "", "odd"]))


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(assessment, assessment), min_size=1, max_size=30))
def test_change_invariants(spark, pairs):
    kind = "struct<stance:string,trajectory:string,emphasis_score:int,hedging_level:string,uncertainty:string>"
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    there = {r.i: r for r in compare.theme_changes(spark.createDataFrame(rows, f"i int, before {kind}, after {kind}")).collect()}
    back = {r.i: r for r in compare.theme_changes(spark.createDataFrame([(i, b, a) for i, a, b in rows], f"i int, before {kind}, after {kind}")).collect()}
    same = compare.theme_changes(spark.createDataFrame([(i, a, a) for i, a, _ in rows], f"i int, before {kind}, after {kind}"))
    assert same.count() == 0 and set(there) == set(back)
    for i, r in there.items():
        assert (r.stance_delta, r.trajectory_delta, r.emphasis_delta, r.hedging_delta) == tuple(-x for x in (back[i].stance_delta, back[i].trajectory_delta, back[i].emphasis_delta, back[i].hedging_delta))
        assert r.severity == back[i].severity and r.summary


def test_shifts(corpus):
    pairs = compare.previous_documents(corpus.docs).filter("base_doc_id is not null")
    got = {(r.doc_id, r.theme): (r.shift_type, r.significance) for r in shifts.ordered_shifts(shifts.detect_shifts(pairs, corpus.themes)).collect()}
    assert got[2, "INFLATION"] == ("ORPHANED_CONCEPT", "HIGH") and got[2, "LABOR_MARKETS"][0] == "NEW_THEME" and got[4, "INFLATION"] == ("HAWKISH_DRIFT", "HIGH")
    same = corpus.docs.select(F.col("doc_id").alias("base_doc_id"), "doc_id")
    assert shifts.detect_shifts(same, corpus.themes).count() == 0
    full = shifts.consistency(corpus.themes, corpus.themes).collect()
    assert full and all(r.score == 1 for r in full)


def test_verified(spark, documents):
    quotes = spark.createDataFrame([(1, " Inflation may be persistent. "), (1, "never said"), (77, "x"), (8, "x")], "doc_id long, quote string")
    assert [r.verified for r in shifts.verify_quotes(quotes, documents).orderBy("doc_id", "quote").collect()] == [True, False, False, False]


def test_artifacts(corpus, documents):
    timeline = artifacts.speaker_timeline(corpus.docs, corpus.themes, 10, "Ann").orderBy("rn").collect()
    assert [r.doc_id for r in timeline] == [3, 2, 1, 9, 4]
    # documents without date come first under a limit
    assert sorted(r.doc_id for r in artifacts.speaker_timeline(corpus.docs, corpus.themes, 3, "Ann").collect()) == [3, 4, 9]
    assert artifacts.latest_snapshot(corpus.docs, corpus.themes, "Ann").first().doc_id == 9
    orphaned = artifacts.orphaned_concepts(corpus.docs, corpus.themes, speaker="Ann").orderBy("rn").collect()
    assert orphaned[0].theme == "LABOR_MARKETS" and [s.doc_id for s in orphaned[0].supporting] == [2]
    drift = {r.theme: r for r in artifacts.theme_drift(corpus.docs, corpus.themes, speaker="Ann").collect()}
    assert drift["INFLATION"].n == 3 and drift["INFLATION"].stance_path == ["very_concerned", "very_concerned", "very_optimistic"]
    assert {r.theme for r in artifacts.theme_drift(corpus.docs, corpus.themes, speaker="Ann", anchor="latest", window_days=20).collect()} == {r.theme for r in corpus.themes.filter("doc_id = 3").collect()}
    brief = artifacts.speaker_brief(corpus.docs, corpus.themes, corpus.comparisons(), phrases_of(documents), theme="INFLATION")
    said = {r.speaker_name: r.highlights for r in artifacts.highlights(brief).collect()}
    assert len(said["Ann"]) == 4 and said["Ann"][2].startswith("Theme drift focus: INFLATION") and set(said) == {"Ann", "Bob"}
    before = artifacts.documents_before(corpus.docs, "Ann", 100, "2024-01-11", 730).collect()
    assert [r.doc_id for r in before] == [1]


def test_documents_before_of_all_speakers(documents, spark, tmp_path):
    from chronolex.queries import q11_documents_before

    documents.withColumn("speech_date", F.date_sub("speech_date", 15)).write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.speaker_name, r.doc_id, r.speech_date) for r in q11_documents_before(spark, str(tmp_path)).collect()}
    assert got == {("Ann", 1, "2023-12-17"), ("Ann", 2, "2023-12-27"), ("Bob", 5, "2023-12-22"), ("Bob", 7, "2023-12-22"), ("Bob", 8, "2023-12-23")}


def test_infer_theme(spark):
    rows = spark.createDataFrame([("Where are RATES going?",), ("jobs and inflation",), ("hello",), (None,)], "q string")
    assert [r.t for r in rows.select(artifacts.infer_theme(F.col("q")).alias("t")).collect()] == ["POLICY_STANCE", "INFLATION", None, None]


def test_versions(spark):
    rows = [(1, 10, "v1", "m", dt.datetime(2024, 1, 1)), (1, 11, "v2", "m", dt.datetime(2024, 1, 2)), (1, 12, "v2", "m", dt.datetime(2024, 1, 2)), (2, 13, "v1", "n", None)]
    df = spark.createDataFrame(rows, "doc_id int, fingerprint_id int, prompt_version string, model_version string, created_at timestamp")
    assert sorted(r.fingerprint_id for r in artifacts.latest_versions(df).collect()) == [12, 13]
    assert [r.fingerprint_id for r in artifacts.latest_versions(df, "v1", "m").collect()] == [10]


def test_empty_tables(documents):
    c = Corpus.of(documents.limit(0))
    assert c.comparisons().count() == 0 and c.themes.count() == 0
    assert artifacts.theme_drift(c.docs, c.themes).count() == 0 and phrases.phrase_signals(documents.limit(0)).count() == 0


def test_similarity_search_asks_with_every_twentieth(spark, tmp_path):
    from chronolex.queries import x1_concept_similarity

    vectors = {i: [math.sin(i * k + k) for k in range(1, 9)] for i in range(5, 645)} | {700: None, 720: [0.0] * 8}
    spark.createDataFrame([(i, v, i % 3) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.query_id, r.vec_id): (r.similarity, r.label) for r in x1_concept_similarity(spark, str(tmp_path)).collect()}
    kept = {i: v for i, v in vectors.items() if v and any(v)}
    norm = {i: math.sqrt(sum(x * x for x in v)) for i, v in kept.items()}
    expected = {(q, i): sum(x * y for x, y in zip(kept[q], kept[i])) / norm[q] / norm[i] for q in kept if q % 20 == 0 for i in kept}
    assert {q for q, _ in got} == set(range(20, 645, 20))
    assert set(got) == {k for k, s in expected.items() if s >= 0.2}
    assert all(s == pytest.approx(expected[k], abs=1e-4) and label == k[1] % 3 for k, (s, label) in got.items())


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (200, 200), (102, 100)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
