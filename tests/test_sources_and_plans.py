import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_module
from ledgerloom import cli
from ledgerloom.config import EngineConfig
from ledgerloom.functions import templates
from ledgerloom.functions.vectors import embed_text
from ledgerloom.operators import models, programs
from ledgerloom.operators.models import FirstNumbersModel
from ledgerloom.plans import filings as filing_plan
from ledgerloom.plans import qa as qa_plan
from ledgerloom.sources import filings, qa, results
from ledgerloom.streaming.ingest import follow_filings, index_continuously

CFG = EngineConfig()
REF = dt.datetime(2024, 1, 1)

EXAMPLES = [
    {
        "id": "A/1",
        "pre_text": ["Cash was 30 and debt was 10 in the year.", " "],
        "post_text": ["Nothing else."],
        "table": [["Item", "2020"], ["Cash", 30], ["Debt", "1,010"]],
        "qa": {"question": "How much did cash exceed debt in the year?", "answer": "20", "program": ["x = 1", "y = 2"]},
        "gold_inds": {"text_0": "Cash was 30"},
    },
    {
        "uid": "B/2",
        "pre_text": ["Sales were 7 while costs were 4 that quarter."],
        "qa": {"question": "Sales minus costs that quarter?", "answer": "about 3", "program": "subtract(7, 4)", "gold_inds": {"t": "x"}},
    },
    {"pre_text": ["Words only."], "qa": {"question": "What words only?", "answer": "none"}},
]


@pytest.fixture
def data(tmp_path):
    (tmp_path / "validation.json").write_text(json.dumps(EXAMPLES))
    (tmp_path / "train.json").write_text(json.dumps(EXAMPLES[:1]))
    return str(tmp_path)


def test_question_sets(spark, data):
    rows = {r.question: r for r in qa.load_split(spark, data, "validation").collect()}
    first, second, third = (rows[e["qa"]["question"]] for e in EXAMPLES)
    assert first.id == "A/1" and first.table[1] == ["Cash", "30"] and first.program == "x = 1\ny = 2"
    assert second.id == "B/2" and second.table == [] and second.program == "subtract(7, 4)"
    assert second.gold_inds == {"t": "x"} and third.id == "2" and third.program is None
    assert qa.load_all_splits(spark, data).groupBy("split").count().count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        qa.load_split(spark, data, "test").count()
    with pytest.raises(ValueError):
        qa.example_by_id(qa.load_split(spark, data, "train"), "nope")
    numbers = qa.example_numbers(qa.load_split(spark, data, "train")).first().numbers
    assert numbers == [30.0, 10.0, 2020.0, 30.0, 1010.0]


PAGE = "<html><body><p>{}</p><table><tr><th>Item</th><th>Value</th></tr><tr><td>Cash</td><td>{}</td></tr></table></body></html>"


@pytest.fixture
def filing_root(tmp_path):
    root = tmp_path / "filings"
    for ticker, kind, name, text, value in [
        ("AAA", "10-K", "0001-24-000001_2023-12-01", "Alpha sold 5 phones worth $120.5 million", 120.5),
        ("AAA", "10-Q", "0001-24-000002_2021-06-01", "Alpha older report on phones 77", 77),
        ("BBB", "10-K", "0002-24-000001_2023-11-01", "Beta mines 900 tons of copper", 900),
    ]:
        folder = root / ticker / kind
        folder.mkdir(parents=True, exist_ok=True)
        (folder / f"{name}.html").write_bytes(PAGE.format(text, value).encode() + b"\xff")
    return str(root)


def test_local_filings(spark, filing_root):
    rows = {(r.ticker, r.filing_type): r for r in filings.local_filings(spark, filing_root).collect()}
    assert len(rows) == 3
    row = rows[("AAA", "10-K")]
    assert (row.accession_number, row.filing_date) == ("0001-24-000001", "2023-12-01")
    assert row.html.endswith("</html>")
    assert filings.local_filings(spark, filing_root, "BBB").count() == 1


FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom"><title>x</title>
<entry><link href="https://x/data/1/0000320193-23-000106/0000320193-23-000106-index.htm"/><updated>2023-11-03T00:00:00-04:00</updated></entry>
<entry><link href="https://x/short-1"/><updated>2023-11-04T23:59:00-04:00</updated></entry>
<entry><updated>2023-11-04T00:00:00-04:00</updated></entry></feed>"""


def test_feed(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    rows = filings.read_feed(spark, str(tmp_path / "feed.xml")).collect()
    assert [tuple(r) for r in rows] == [("0000320193-23-000106", "2023-11-03")]


def test_download_falls_back_to_text(spark):
    listed = spark.createDataFrame(
        [("T", "320", "10-K", f"0000-23-{i}", f"2023-0{i}-01") for i in range(1, 4)],
        "ticker string, cik string, filing_type string, accession_number string, filing_date string",
    )
    pages = {
        "https://www.sec.gov/Archives/edgar/data/320/0000231/0000-23-1-index.html": b"<p>one</p>",
        "https://www.sec.gov/Archives/edgar/data/320/0000232/0000-23-2.txt": b"two",
    }
    got = {r.accession_number: r for r in filings.download_filings(listed, pages.get, 0).collect()}
    assert got["0000-23-1"].html == "<p>one</p>" and got["0000-23-2"].url.endswith(".txt")
    assert got["0000-23-1"].filepath == "T/10-K/0000-23-1_2023-01-01.html" and len(got) == 2
    assert [r.accession_number for r in filings.latest_listed(listed, 2).orderBy("filing_date").collect()] == ["0000-23-2", "0000-23-3"]


def test_company_number(one):
    assert one(filings.company_number(F.lit("a CIK=0000320193&x")), filings.company_number(F.lit("none"))) == ("320193", None)


def examples(spark, data):
    return qa.load_split(spark, data, "validation")


def test_evidence_is_the_questions_own(spark, data):
    chunks = qa_plan.index_examples(examples(spark, data)).persist()
    found = qa_plan.find_evidence(qa_plan.ask_examples(examples(spark, data)), chunks, CFG, own_question=True)
    for row in found.collect():
        assert 0 < len(row.evidence) <= CFG.top_k
        assert all(e.doc_key.startswith(row.query_id) for e in row.evidence)
        kinds = [e.doc_type for e in row.evidence]
        assert kinds == sorted(kinds, key=["table", "text", "table_summary"].index)


def test_index_follows_the_file(spark, data):
    """Ids sort otherwise than the examples stand in the file."""
    rows = spark.createDataFrame([(1, "z", ["p0", " ", "p2"], ["q0"], [["a"], ["1"]]), (2, "b", [], ["r"], [])],
        "place long, id string, pre_text array<string>, post_text array<string>, table array<array<string>>")
    examples = rows.withColumn("question", F.lit("q?"))
    got = qa_plan.index_examples(examples, CFG).orderBy("ord").collect()
    assert [r.ord for r in got] == list(range(6))
    assert [r.doc_id for r in got] == ["z_pre_0", "z_pre_2", "z_post_0", "z_table", "z_table_summary", "b_post_0"]
    loaded = qa.load_split(spark, data, "validation")
    assert {r.id for r in qa.first_examples(loaded, 2).collect()} == {"A/1", "B/2"}


def test_evaluation_and_comparison(spark, data, tmp_path):
    predictions, metrics = qa_plan.evaluate(examples(spark, data), FirstNumbersModel)
    got = {r.question_id: r for r in predictions.collect()}
    assert got["B/2"].predicted_answer == 3.0 and got["B/2"].execution_success
    assert not got["2"].execution_success and got["2"].error_message
    summary = metrics.first()
    assert summary.total_examples == 3 and summary.n_skipped == 1 and summary.exact_matches >= 1
    out = str(tmp_path / "out")
    results.save_results(predictions, metrics, out, "validation")
    saved = spark.read.json(f"{out}/validation_predictions")
    assert saved.filter("predicted_answer = -999.0").count() == 1
    assert "n_skipped" in spark.read.json(f"{out}/validation_metrics").columns
    report = qa_plan.compare(examples(spark, data), FirstNumbersModel)
    results.save_comparison(report, out)
    assert spark.read.json(f"{out}/baseline_vs_proposed").count() == 5
    assert results.metrics_text(metrics).filter("metric = 'exact_match'").first().value.endswith("%")


class SeedModel:
    """Answers differ by sample; the third one wins twice."""

    def generate(self, prompt, temperature, sample):
        if sample == 2:
            raise RuntimeError("no capacity")
        return f"REASONING: r\nPROGRAM:\nanswer = {30 if sample in (3, 5) else 10}"


def test_sampled_vote_keeps_every_run(spark, data):
    chunks = qa_plan.index_examples(examples(spark, data))
    asked = qa_plan.ask_examples(examples(spark, data)).filter("query_id = 'A/1'")
    got = qa_plan.answer_questions(asked, chunks, SeedModel, CFG, own_question=True).first()
    assert got.success and got.program in ("answer = 30", "answer = 10")
    assert len(got.samples) == 5 and got.samples[1].error.endswith("no capacity")
    assert got.variables == {"answer": got.answer}


class FixedAfterError:
    """Writes a wrong program first and a right one when told the problem."""

    def generate(self, prompt, temperature, sample):
        return "PROGRAM: answer = add(5, 4)" if "USABLE NUMBERS\n5.0, 4.0" in prompt else "PROGRAM: x = foo(5)"


def test_repair_feeds_the_error_back(spark):
    question = spark.createDataFrame([("q", "sum?"), ("r", "none?")], "question_id string, question string").select(
        "*",
        F.array(F.struct(F.lit("5 and 4").alias("content"), F.lit(0.5).alias("score"), F.lit("text").alias("doc_type"))).alias("evidence"),
        F.when(F.col("question_id") == "q", F.array(F.lit(5.0), F.lit(4.0))).otherwise(F.array(F.lit(5.0))).alias("available"),
    )
    got = {r.question_id: r for r in programs.write_with_repair(question, FixedAfterError, CFG).collect()}
    assert got["q"].run.final_answer == 9.0 and got["q"].error is None
    assert got["r"].error == "Error executing line 'x = foo(5)': Unknown operation: foo"


def test_filings_end_to_end(spark, filing_root, tmp_path):
    root = str(tmp_path / "index")
    index = filing_plan.build_index(spark, filing_root, root, REF, CFG, model=FirstNumbersModel)
    asked = spark.createDataFrame(
        [("q1", "alpha phones sold", "aaa"), ("q2", "copper tons", None), ("q3", "alpha phones", "ZZZ")],
        "query_id string, query string, ticker string",
    )
    got = {r.query_id: r for r in filing_plan.ask_filings(asked, index, FirstNumbersModel, REF, CFG).collect()}
    assert got["q1"].success and {c.ticker for c in got["q1"].citations} == {"AAA"}
    assert {c.filing_type for c in got["q1"].citations} == {"10-K"}  # the older one is past the age limit
    assert got["q1"].verification.verified
    assert got["q2"].citations[0].ticker == "BBB"
    assert not got["q3"].success and got["q3"].error == "No relevant filings found"
    before, of_a = index.chunks.count(), index.chunks.filter("ticker = 'AAA'").count()
    again = filing_plan.build_index(spark, filing_root, root, REF, CFG, ticker="BBB")
    assert again.chunks.count() == before
    (page,) = list((pathlib.Path(filing_root) / "BBB").rglob("*.html"))
    page.write_text("<html><body><p>Everything was sold, nothing is left in store.</p></body></html>")
    changed = filing_plan.build_index(spark, filing_root, root, REF, CFG, ticker="BBB")
    texts = [r.content for r in changed.chunks.filter("ticker = 'BBB'").collect()]
    assert texts and all("sold" in t for t in texts)  # nothing of the first text stays
    assert changed.chunks.filter("ticker = 'AAA'").count() == of_a


def test_stream_equals_batch(spark, filing_root, tmp_path):
    root, mark = str(tmp_path / "streamed"), str(tmp_path / "mark")
    query = index_continuously(follow_filings(spark, filing_root, 1), root, mark, REF, CFG)
    query.awaitTermination(120)
    assert query.exception() is None
    streamed = {r.doc_key: r.content for r in filing_plan.read_index(spark, root).chunks.collect()}
    batch = filing_plan.build_index(spark, filing_root, str(tmp_path / "batch"), REF, CFG)
    assert streamed == {r.doc_key: r.content for r in batch.chunks.collect()}
    rerun = index_continuously(follow_filings(spark, filing_root, 1), root, mark, REF, CFG)
    rerun.awaitTermination(120)
    assert filing_plan.read_index(spark, root).chunks.count() == len(streamed)


def test_markdown_files(spark, filing_root, tmp_path):
    out = str(tmp_path / "md")
    results.save_markdown(filings.local_filings(spark, filing_root), out)
    saved = spark.read.text(out, wholetext=True)
    assert saved.filter("ticker = 'BBB'").first().value.startswith("Beta mines 900 tons of copper")


def test_model_check(spark):
    rows = spark.createDataFrame([("5 units", ["held 5 units. "])], "answer string, texts array<string>")
    assert filing_plan.check_with_model(rows, FirstNumbersModel).first().verified
    with pytest.raises(ValueError):
        models.HostedModel("other", "m")


def test_wrapped_models(one):
    vectors = models.embedder(lambda texts: [[float(len(t)), 1.0] for t in texts], 2)
    scorer = models.cross_scores(lambda pairs: [len(a) + len(b) for a, b in pairs])
    assert one(vectors(F.col("t")), scorer(F.col("t"), F.lit("ab")), t="abc") == ([3.0, 1.0], 5.0)


def test_templates(one):
    text = one(templates.fill("a {x} b {y} {x}", x=F.lit("{y}"), y=F.lit("2")))
    assert text == "a {y} b 2 {y}"
    assert one(templates.fill("plain")) == "plain"
    evidence = F.array(F.struct(F.lit("c").alias("content"), F.lit(0.12345).alias("score"), F.lit("text").alias("doc_type")))
    assert one(templates.evidence_text(evidence)) == "[Evidence 1] (score: 0.123)\nType: text\nContent: c\n"
    assert one(templates.with_context(F.lit("p"), F.lit("c"))) == "Context:\nc\n\np"


def test_config(tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"numerical_tolerance": "1e-3", "top_k": "7", "rerank_enabled": true}')
    cfg = EngineConfig.from_json(str(path))
    assert cfg.numerical_tolerance == 1e-3 and cfg.top_k == 7 and cfg.rerank_enabled
    with pytest.raises(ValueError):
        EngineConfig.from_mapping({"nope": 1})
    assert EngineConfig().baseline().bm25_weight == 0.0


def test_command_line(spark, data, filing_root, tmp_path, capsys):
    out = str(tmp_path / "results")
    assert cli.main(["evaluate", "--data", data, "--output", out, "--num-examples", "2"]) == 0
    assert "exact_match" in capsys.readouterr().out
    asked = ["--query", "How much did cash exceed debt?", "--question-id", "A/1"]
    assert cli.main(["qa", "--data", data, *asked]) == 0
    capsys.readouterr()
    kept = ["--cache", str(tmp_path / "answers")]
    shown = []
    for _ in range(2):
        assert cli.main(["qa", "--data", data, *asked, *kept]) == 0
        shown.append(capsys.readouterr().out)
    assert "false" in shown[0] and "true" in shown[1]
    root = str(tmp_path / "cli-index")
    assert cli.main(["filings", "--filings", filing_root, "--index", root, "--build-index", "--query", "copper"]) == 0
    with pytest.raises(SystemExit):
        cli.main(["qa", "--data", data])


def test_registered_queries_have_sql_with_the_same_names():
    queries, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(queries)
    own = {n for n in queries if not n.startswith("op") and n != "pipeline"}
    assert own - set(sql) == {"html_to_markdown", "answer_questions"}


def test_entry_point(spark):
    result = entry_module.entry(spark)
    assert result.columns == ["query_id", "doc_key", "score", "rank"] and result.count() == 200
