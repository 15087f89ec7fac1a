"""Stores, readers, streaming, HTTP, command line and the driver's entry points."""

import json

import pytest

from chronolex.service import cli, contract, http
from chronolex.service.facade import TextService
from chronolex.sources import readers, store
from chronolex.streaming.incremental import stream_pages

BODY = "Inflation remains elevated and inflation is persistent. Prices are a concern. " * 8


def page(title, body=BODY):
    return f"<html><head><title>{title}</title><meta name=author content='Ann Other'><meta name=date content='{title}'></head><body><main><p>{body}</p></main></body></html>"


def test_append_is_idempotent(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = spark.createDataFrame([("h1", "b"), ("h1", "a"), ("h2", "c")], "source_hash string, source_url string")
    assert s.read("source_documents") is None
    s.append("source_documents", rows, ["source_url"])
    s.append("source_documents", rows.union(spark.createDataFrame([("h3", "d")], rows.schema)))
    assert sorted(tuple(r) for r in s.read("source_documents").collect()) == [("h1", "a"), ("h2", "c"), ("h3", "d")]
    assert s.lookup("source_documents", source_hash="h2").first().source_url == "c" and s.lookup("source_documents", source_hash="no").count() == 0
    with pytest.raises(ValueError):
        s.lookup("documents", a=1)
    seen = store.skip_existing(spark.createDataFrame([(" a ",), ("",), ("z",), (None,)], "source_url string"), s.read("source_documents"))
    assert {(r.source_url, r.skipped) for r in seen.collect()} == {("a", True), ("z", False)}


def test_speakers_and_hydration(spark):
    names = spark.createDataFrame([("Ann Other",), ("ANN OTHER",), (None,), ("New One",)], "speaker_name string")
    known = spark.createDataFrame([(2, "ann_other", "Second"), (1, "ann_other", "Ann Other")], "id int, speaker_key string, name string")
    assert {tuple(r) for r in store.get_or_create_speakers(names, known).collect()} == {("ann_other", "Ann Other", False), ("new_one", "New One", True)}
    loose = spark.createDataFrame([("odd", "html", "2024-01-02T03:04"), (None, "odd", "no")], "document_type string, content_type string, speech_date string")
    assert [(r.document_type, r.content_type, str(r.speech_date)) for r in store.hydrate_documents(loose).collect()] == [("unknown", "html", "2024-01-02"), ("unknown", "unknown", "None")]
    assert store.hydrate_segments(spark.createDataFrame([("odd",), ("answer",)], "segment_type string")).collect()[0].segment_type == "body"


def test_hydrated_fingerprints_and_comparisons(spark):
    heads = spark.createDataFrame(
        [(1, "d1", "v1", "m", "calm", "2024-01-01", "f1"), (1, "d1", "v2", "m", "cautious", "2024-02-01", "f2"), (2, "d2", "v1", "m", "calm", None, "f3")],
        "doc_id long, document_key string, prompt_version string, model_version string, overall_tone string, created_at string, fingerprint_id string",
    )
    themes = spark.createDataFrame([(1, "v2", "m", "X", "neutral", 3), (1, "v1", "m", "Y", "neutral", 4)], "doc_id long, prompt_version string, model_version string, theme string, stance string, emphasis_score int")
    got = {r.doc_id: r for r in store.hydrate_fingerprints(heads, themes).collect()}
    assert got[1].overall_tone == "cautious" and set(got[1].themes) == {"X"} and got[1].themes["X"].emphasis_score == 3 and got[2].themes == {}
    assert set(store.hydrate_fingerprints(heads, themes, "v1").filter("doc_id = 1").first().themes) == {"Y"}
    loose = spark.createDataFrame([("odd", None, ["a"]), ("window_75d", ["b"], None)], "comparison_type string, orphaned array<string>, new_themes array<string>")
    assert [tuple(r) for r in store.hydrate_comparisons(loose).collect()] == [("t_minus_1", [], ["a"]), ("window_75d", ["b"], [])]


def test_append_to_a_partitioned_table(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    rows = lambda *r: spark.createDataFrame(list(r), "source_hash string, day string")
    s.append("source_documents", rows(("a", "1"), ("b", "2")), ["day"], ["day"])
    s.append("source_documents", rows(("a", "1"), ("c", "1"), ("c", "1")), ["day"], ["day"])
    assert sorted((r.source_hash, str(r.day)) for r in s.read("source_documents").collect()) == [("a", "1"), ("b", "2"), ("c", "1")]


def test_scheduled_run(tmp_path):
    class Service:
        def ingest_urls(self, urls, skip_existing):
            return {"urls": urls, "skip": skip_existing}

        def run_manifest(self, manifest):
            return manifest

    (tmp_path / "u.txt").write_text("# no\n\n https://a \n")
    (tmp_path / "m.json").write_text('{"urls": []}')
    assert cli.run(["schedule", "--urls-file", str(tmp_path / "u.txt"), "--no-skip-existing"], lambda _t: Service())["data"] == {"urls": ["https://a"], "skip": False}
    assert cli.run(["schedule", "--manifest", str(tmp_path / "m.json")], lambda _t: Service())["data"] == {"urls": []}
    with pytest.raises(SystemExit):
        cli.run(["schedule"], lambda _t: Service())


def test_readers(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("# c\n\n https://a \nhttps://b\n")
    assert [r.source_url for r in readers.read_url_list(spark, str(tmp_path / "urls.txt")).collect()] == ["https://a", "https://b"]
    assert readers.read_url_list(spark, str(tmp_path / "urls.txt"), skip_comments=False).count() == 3
    (tmp_path / "m.json").write_text(json.dumps({"urls": ["u1", "u2"], "markdown_files": [{"path": "x.md", "metadata": {"title": "T"}}, {"path": "y.md"}]}))
    urls, files = readers.read_manifest(spark, str(tmp_path / "m.json"))
    assert [(r.source_url, r.skip_existing) for r in urls.collect()] == [("u1", True), ("u2", True)] and [(r.path, r.metadata) for r in files.collect()] == [("x.md", {"title": "T"}), ("y.md", {})]
    (tmp_path / "a.md").write_text("Ann Other\n\nA statement of 2024-05-06.")
    doc = readers.read_markdown(spark, str(tmp_path / "a.md"), {"title": "Given"}).first()
    assert (doc.title, doc.speaker_name, doc.document_type, doc.source_type) == ("Given", "Ann Other", "statement", "markdown_file")
    (tmp_path / "b.pdf").write_bytes(b"one|two")
    assert readers.read_pdf(spark, str(tmp_path), lambda raw: raw.decode().split("|")).first().text == "one\n\ntwo"


def test_stream(spark, tmp_path):
    files, s = tmp_path / "in", store.Store(spark, str(tmp_path / "store"))
    files.mkdir()

    def drop(name, rows):
        (files / name).write_text("".join(json.dumps({"id": i, "source_url": u, "raw_content": page(t)}) + "\n" for i, (u, t) in enumerate(rows)))
        stream_pages(spark, str(files), s, str(tmp_path / "cp")).awaitTermination()

    drop("1.json", [("https://x.example/1", "2024-01-02"), ("https://x.example/1b", "2024-01-02")])
    assert s.read("documents").count() == 1  # the same content twice
    drop("2.json", [("https://x.example/1", "2024-01-02"), ("https://x.example/2", "2024-01-03")])
    first = s.read("documents").orderBy("source_url").collect()
    assert len(first) in (1, 2) and first[0].speaker_name == "Ann Other"
    assert s.read("theme_assessments").filter("theme = 'INFLATION'").count() == len(first) and s.read("fingerprints").count() == len(first) and s.read("document_segments").count() >= 1


def test_stream_stores_the_whole_analysis(spark, tmp_path):
    from chronolex.operators import phrases
    from chronolex.plans.corpus import Corpus

    files, s = tmp_path / "in", store.Store(spark, str(tmp_path / "store"))
    files.mkdir()
    bodies = [BODY, BODY + "Jobs and employment are strong."]
    for i, body in enumerate(bodies):
        row = {"id": i, "source_url": f"https://x.example/{i}", "raw_content": page(f"2024-01-0{i + 2}", body)}
        (files / f"{i}.json").write_text(json.dumps(row) + "\n")
        stream_pages(spark, str(files), s, str(tmp_path / "cp")).awaitTermination()
    docs = s.read("documents")
    assert docs.count() == 2 and docs.select("speaker_name").distinct().count() == 1
    # each arrived after what it is compared with, so the stream's rows are those of the whole corpus
    c = Corpus.of(docs)
    whole = {(r.comparison_key, r.summary, r.n_changes, r.n_phrases) for r in c.comparisons().collect()}
    kept = s.read("comparison_results").collect()
    assert len(kept) == 3 and {(r.comparison_key, r.summary, r.n_changes, r.n_phrases) for r in kept} == whole
    assert all(r.n_changes == len(r.theme_changes) and r.uncertainty_notes and "phrase anomalies" in r.summary for r in kept)
    signals = {(r.doc_id, r["rank"], r.phrase_text, r.historical_count) for r in phrases.phrase_signals(docs).collect()}
    assert {(r.doc_id, r["rank"], r.phrase_text, r.historical_count) for r in s.read("phrase_observations").collect()} == signals
    assert max(n for *_, n in signals) > 0
    assert [r.name for r in s.read("speakers").collect()] == ["Ann Other"]
    runs = s.read("analysis_runs").collect()
    assert {r.target_id for r in runs} == {r.document_key for r in docs.collect()} and len(runs) == 2 and all(json.loads(r.parsed_output)["overall_tone"] for r in runs)


@pytest.fixture(scope="module")
def service(spark):
    pages = {f"https://x.example/{i}": page(f"2024-0{i}-02", BODY + f"Number {i} is special this time. " * i) for i in (1, 2, 3)}
    svc = TextService(spark, fetch=pages.__getitem__)
    assert svc.ingest_urls([*pages, " "])["ingested"] == 3
    assert svc.ingest_urls(list(pages))["skipped"] == 3
    return svc


def test_service(service):
    status, said = http.dispatch(service, "GET", "/speaker/timeline?speaker_name=Ann%20Other&limit=2")
    assert status == 200 and said["ok"] and said["data"]["count"] == 2
    status, said = http.dispatch(service, "POST", "/speaker/question", json.dumps({"speaker_name": "Ann Other", "question": "What of prices?"}).encode())
    assert status == 200 and said["data"]["theme_focus"] == "INFLATION" and said["data"]["highlights"]
    assert http.dispatch(service, "GET", "/speaker/brief?speaker_name=Nobody")[1]["data"]["latest"] is None
    assert http.dispatch(service, "GET", "/speaker/drift?speaker_name=Ann+Other&theme=INFLATION")[1]["data"]["theme_drift"][0]["n"] == 3
    for path in ("comparisons", "orphaned", "phrases", "latest"):
        assert http.dispatch(service, "GET", f"/speaker/{path}?speaker_name=Ann+Other")[0] == 200
    added = http.dispatch(service, "POST", "/ingest/markdown", json.dumps({"markdown_text": "Bea\n\nJobs and employment. Jobs.", "metadata": {"speaker_name": "Bea"}}).encode())[1]
    assert len(added["data"]["document_keys"]) == 1
    assert cli.run(["latest", "Bea"], lambda _t: service)["data"]["document"]["themes"] == ["LABOR_MARKETS"]


def test_errors():
    assert http.dispatch(None, "GET", "/nothing")[0] == 404 and http.dispatch(None, "POST", "/health")[0] == 404
    status, said = http.dispatch(None, "GET", "/speaker/drift")
    assert status == 400 and said["error"]["message"] == "speaker_name is required" and not said["ok"]
    assert http.dispatch(None, "POST", "/speaker/question", b"{}")[1]["error"]["message"] == "speaker_name and question are required"
    assert http.dispatch(None, "GET", "/health")[1]["data"] == {"ok": True}
    described = http.dispatch(None, "GET", "/openapi.json")[1]
    assert set(described["paths"]) == set(contract.ROUTES) and described["openapi"].startswith("3.")
    assert contract.error("m", "o", "http", 500, "d")["error"] == {"message": "m", "detail": "d"}


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 40
    df = e.entry(spark)
    assert df.columns and df.count() >= 0


def test_rest_stands_without_the_subpackage():
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    code = "import sys; sys.modules['chronolex.llm'] = None\nimport __spark_entry__ as e\nassert not any(k.startswith('p1_') for k in e.queries()) and 'q6_theme_drift' in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True, timeout=120)
    for f in (root / "chronolex").rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "chronolex.llm" not in f.read_text() or f.name == "__init__.py"


def test_report_and_adhoc(spark):
    from chronolex.plans.corpus import compare_adhoc
    from chronolex.service.report import gates, html_report

    one = lambda i, t: spark.createDataFrame([(i, t)], "doc_id long, normalized_text string")
    changes, new, gone = compare_adhoc(one(1, "Inflation is moderating. Inflation is improving. Jobs. Jobs."), one(2, BODY), one(3, "Growth. Growth. Growth. Demand."))
    rows = [r.asDict() for r in changes.select("theme", "change_type", "strength").collect()]
    assert rows == [{"theme": "INFLATION", "change_type": "more_optimistic", "strength": "high"}]
    assert [r.theme for r in new.collect()] == ["LABOR_MARKETS"] and [r.theme for r in gone.collect()] == ["GROWTH_OUTLOOK"]
    page = html_report("A <b>", "so", {"Changes": rows, "None": []}, gates(0.95, 1.0, 1))
    assert "A &lt;b&gt;" in page and "more_optimistic" in page and "control: failed" in page and "consistency: passed" in page
