"""Expected values of the pipeline's operators, brute force where there is no SQL, and the registered SQL itself."""

import itertools
import json
import math
import os
import random
import subprocess
import sys
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from citeloom import queries
from citeloom.functions import text as tx
from citeloom.operators import bm25, chunks, claims, engines, faults, ingest, judge, maxscore, metrics, queueing, report
from citeloom.plans import staging
from citeloom.plans.ranking import places
from citeloom.sources import jsonl
from citeloom.streaming import judging

SF = "/root/testdata/sf0.001"


def one(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.v for r in df.select("i", column(F.col("t")).alias("v")).orderBy("i").collect()]


def test_sentences(spark):
    got = one(spark, tx.sentences, "The U.S. market grew. Then it fell.", "Dr. Smith signed it.", "Really? [1] It did.", "a 3.5 b. c", None)
    assert got == [["The U.S. market grew.", "Then it fell."], ["Dr. Smith signed it."], ["Really?", "[1] It did."], ["a 3.5 b. c"], None]
    text = "The U.S. market grew. Then it fell. (It did.) “Yes.” 3 of them, e.g. Two. Mr. A. B. Cee said no. Fine! ok? Yes"
    assert one(spark, tx.sentences, text, "No end") == [["The U.S. market grew.", "Then it fell.", "(It did.) “Yes.” 3 of them, e.g. Two.", "Mr. A. B. Cee said no. Fine! ok?", "Yes"], ["No end"]]


def test_markers_and_numbers(spark):
    assert one(spark, tx.marker_numbers, "Both [1][3]. Comma [1, 2].", "none") == [[1, 3, 2], []]
    assert one(spark, tx.strip_markers, "Revenue grew [1] .", "A [1][2] and B [3].") == ["Revenue grew.", "A and B."]
    assert one(spark, tx.numbers, "12% or 12.0, 1,200 and 70-80; 0.50") == [["12", "1", "200", "70", "-80", "0.5"]]
    assert one(spark, tx.negated, "It didn't", "It was not", "fine") == [False, True, False]


@pytest.mark.parametrize("answer, aspect, want", [("capacity 240 MWh", "240", True), ("1240 MWh", "240", False), ("Megawatt-hours!", "megawatt hours", True), ("x", "", False), ("", "y", False), ("it is 3.5", "3.5", True)])
def test_covers(spark, answer, aspect, want):
    df = spark.createDataFrame([(answer, aspect)], "a string, b string")
    assert df.select(tx.covers(F.col("a"), F.col("b"))).first()[0] is want


def test_clean_text(spark):
    page = "Main menu\nEditors of this page collect many lines of text here.\nConstruction began in 1931 and took five years.[12]\nshort\nThe contents of the reservoir fell by a third.[citation needed]\nReferences:\nAfter the end this is not kept at all."
    assert one(spark, ingest.clean_text, page, "", None) == ["Construction began in 1931 and took five years. The contents of the reservoir fell by a third.", "", None]


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_deduplicate_like_brute_force(spark):
    rng = random.Random(4)
    vocab = [f"t{i}" for i in range(60)]
    texts = []
    for _ in range(25):
        base = rng.sample(vocab, rng.randint(4, 25))
        texts += [" ".join(base), *(" ".join(rng.sample(base, len(base)) [rng.randint(0, 2) :] + rng.sample(vocab, rng.randint(0, 2))) for _ in range(4))]
    texts += ["the and of", "", "the and of", None, texts[0]]
    sets = [set((t or "").split()) - set(tx.STOPWORDS) for t in texts]
    for t in (0.8, 0.4):
        kept = []
        for i, s in enumerate(sets):
            if not s or all(not sets[k] or jaccard(s, sets[k]) < t - 1e-12 for k in kept):
                kept.append(i)
        docs = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
        assert sorted(r.ord for r in ingest.deduplicate(docs, t).where("kept").collect()) == kept
    assert ingest.deduplicate(docs.limit(0)).count() == 0


def test_near_members_hold_every_link(spark):
    """Every row comes out with its class; classes and pairs of classes give back each link between rows."""
    base = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    texts = [base, "The kappa, iota theta: eta zeta epsilon delta gamma beta alpha!", base + " lambda", "other words entirely", "", None, base.replace("kappa", "kappa \u5149"), "the of", "other words; entirely"]
    docs = spark.createDataFrame(list(enumerate(texts)), "ord long, text string")
    got = {r.ord: (r.cls, r.n_links) for r in ingest.near_members(docs).collect()}
    assert got == {0: (0, 3), 1: (0, 3), 2: (2, 3), 3: (3, 1), 4: (4, 0), 5: (5, 0), 6: (0, 3), 7: (7, 0), 8: (3, 1)}
    assert ingest.near_members(docs.limit(0)).count() == 0


def test_near_members_sql(spark):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW corpus AS SELECT * FROM '{SF}/corpus.parquet'")
    df = queries.queries()["ingest_near_members"](spark, SF)
    want = db.execute(f"SELECT doc_index, class_index, n_links FROM ({queries.oracle_sql()['ingest_near_members']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) == spark.read.parquet(f"{SF}/corpus.parquet").count()


def pack(sents, width, overlap):
    """Greedy packing, spelt out."""
    out, cur = [], []
    n = lambda xs: sum(len(x.split()) for x in xs)
    for s in sents:
        if cur and n([*cur, s]) > width:
            out.append(" ".join(cur))
            tail = []
            for p in reversed(cur):
                if tail and n([*tail, p]) > overlap or n([*tail, p, s]) > width:
                    break
                tail.insert(0, p)
            cur = tail
        cur = [*cur, s]
    return [*out, " ".join(cur)] if cur else out


def test_chunks(spark):
    rng = random.Random(6)
    texts = [" ".join(f"S{'x' * 2} " + " ".join(f"w{rng.randint(0, 99)}" for _ in range(rng.randint(2, 18))) + "." for _ in range(rng.randint(2, 25))) for _ in range(30)]
    docs = spark.createDataFrame([(i, "u", None, t) for i, t in enumerate(texts)] + [(900, "u", "t", ""), (901, "u", "t", None), (902, "u", "t", " ".join(map(str, range(100))))], "doc_index long, url string, title string, text string")
    rows = chunks.chunk_documents(docs, [20, 40], 8).orderBy("chunk_words", "doc_index", "chunk_index").collect()
    for width in (20, 40):
        for i, t in enumerate(texts):
            got = [r.text for r in rows if r.doc_index == i and r.chunk_words == width]
            assert got == pack([x + "." for x in t.rstrip(".").split(". ")], width, 8)
    plain = [r.text.split() for r in rows if r.doc_index == 902 and r.chunk_words == 40]
    assert plain[0][32:] == plain[1][:8] and plain[-1][-1] == "99" and not any(r.doc_index in (900, 901) for r in rows)
    for bad in (([0], 0), ([10], 10), ([10], -1)):
        with pytest.raises(ValueError):
            chunks.chunk_documents(docs, *bad)


CORPUS = [
    (0, "n", "Aldermoor", "Aldermoor reported revenue of 412 million dollars in fiscal 2024. It runs 47 distribution centres across the region."),
    (1, "h", "Tressel", "Tressel Grid operates storage of 240 megawatt-hours. The audit found no incidents at the Quarry site during the review period."),
]


@pytest.fixture(scope="module")
def index(spark):
    return report.corpus_index(spark.createDataFrame(CORPUS, "doc_index long, url string, title string, text string"))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("q1", "What revenue did Aldermoor report in fiscal 2024?"), ("q2", "How much storage does Tressel Grid operate?"), ("q3", "the and of"), ("q4", "zebra xylophone")], "qid string, text string")


def test_search_and_engines(spark, index, asked):
    hits = bm25.search(index, asked, 1).collect()
    assert {(r.qid, r.doc_index) for r in hits} == {("q1", 0), ("q2", 1)}
    assert {r.qid for r in bm25.unanswerable(index, asked).collect()} == {"q3", "q4"}
    said = {r.question_id: r for r in engines.extractive(index, asked, 1).collect()}
    assert said["q1"].answer_text == "Aldermoor reported revenue of 412 million dollars in fiscal 2024 [1]."
    assert said["q1"].claims[0].citation_ids == [said["q1"].citations[0].id] and said["q4"].answer_text == engines.NOTHING_FOUND
    again = engines.lossy(index, asked.repartition(3), 1).select("question_id", "answer_text")
    assert sorted(again.collect()) == sorted(engines.lossy(index, asked, 1).select("question_id", "answer_text").collect())
    got = engines.model_rag(index, asked, lambda: lambda s, u: 1 / 0).collect()
    assert all("ZeroDivisionError" in r.error for r in got)


def test_registered_validation_asks_every_question(spark, tmp_path):
    spark.createDataFrame(CORPUS, "doc_index long, url string, title string, text string").write.parquet(str(tmp_path / "corpus.parquet"))
    rows = [(3, "q1", "What revenue did Aldermoor report in fiscal 2024?"), (4, "q3", "the and of"), (7, "q4", "zebra xylophone"), (9, "q4", "zebra xylophone")]
    spark.createDataFrame([(*r, ["numeric"], None) for r in rows], "ord long, id string, text string, failure_modes array<string>, aspects array<string>").write.parquet(str(tmp_path / "questions.parquet"))
    found = queries.queries()["validate_problems"](spark, str(tmp_path)).collect()
    assert sorted((r.key, float(r.detail)) for r in found if r.kind == "unanswerable question") == [("q3", 0.0), ("q4", 0.0)]


def test_a_model_is_asked_once(spark, index, asked, tmp_path):
    """One call for each question and width, and answer, time and error of the same call."""

    def client():
        def call(system, user):
            with open(tmp_path / "calls", "a", encoding="utf-8") as f:
                f.write("x")
            if "storage" in user:
                raise TimeoutError("late")
            return "It said so [1]."

        return call

    got = {r.question_id: r for r in engines.model_rag(index, asked, client, 1).collect()}
    assert (tmp_path / "calls").read_text() == "x" * 4
    assert got["q2"].error == "TimeoutError: late" and got["q2"].answer_text == "" and got["q1"].error is None
    assert got["q1"].claims[0].citation_ids == [got["q1"].citations[0].id] and all(r.latency_s >= 0 for r in got.values())


def test_lossy_steps(spark):
    short = ["Revenue was 412 million dollars in fiscal 2024.", "During the spring, it grew by ten units of gas.", "It grew in 2020.", "It grew in 20201 by a lot of units.", "No scope at all", "Sales rose in 2019, while costs of the plant fell in 2020."]
    want = ["Revenue was 412 million dollars.", None, None, None, None, "Sales rose, while costs of the plant fell in 2020."]
    assert one(spark, engines.without_qualifier, *short) == want
    round_ = ["It was 412 million.", "In March 2025 the Boeing 787 flew.", "It sold 7,175 units.", "It has 7 parts.", "It has 40 parts.", "Of 69,980,000 litres", "At 412.7 bar"]
    want = ["It was roughly 410 million.", None, "It sold roughly 7,200 units.", None, None, "Of roughly 70,000,000 litres", "At roughly 410 bar"]
    assert one(spark, lambda t: engines.with_rounded(t, F.lit(0.0)), *round_) == want
    assert one(spark, lambda t: engines.welded(F.lit("It grew."), t), "The company fell.", "Tressel fell.", None) == ["It grew, and the company fell.", "It grew, and Tressel fell.", None]


def injected(spark, fault, snippets, text, cited=("c0",), answer=None, **kw):
    cites = [{"id": f"c{i}", "url": "u", "snippet": x, "title": ""} for i, x in enumerate(snippets)]
    row = (1, "q", "e", text if answer is None else answer, [{"id": "x", "question_id": "q", "text": text, "citation_ids": list(cited)}], cites, None, None)
    df = spark.createDataFrame([row], f"ord long, question_id string, engine string, answer_text string, claims {claims.CLAIMS}, citations {claims.CITATIONS}, latency_s double, error string")
    return faults.inject(df, fault, **kw).first()


BASE = "Aldermoor reported revenue of 412 million dollars in fiscal 2024."


@pytest.mark.parametrize(
    "fault, snippets, text, fires",
    [
        ("numeric-drift", [BASE], BASE, True), ("numeric-drift", ["Other text."], BASE, False), ("numeric-drift", ["up to 240 units"], "It makes up to 240 units.", False), ("numeric-drift", ["It was 412."], "It was 412 units.", False),
        ("numeric-drift", ["It has 10+ sites"], "It has 10+ sites.", False), ("numeric-drift", ["The Boeing 787 flew"], "The Boeing 787 flew.", False),
        ("wrong-source", [BASE, "Other."], BASE, True), ("wrong-source", [BASE], BASE, False), ("dropped-citation", [BASE], BASE, True), ("padded-claim", [BASE], BASE, True),
        ("entity-swap", ["Aldermoor Corp reported revenue of 2,500 million dollars. Tressel Grid reported revenue of 98 million dollars.", "Tressel Grid is large."], "Aldermoor Corp reported revenue of 2,500 million dollars.", True),
        ("entity-swap", ["Aldermoor Corp reported revenue of 412 million dollars.", "Tressel Grid is large."], "Aldermoor Corp reported revenue of 412 million dollars.", False),
        ("polarity-flip", ["The audit found no incidents at the Quarry site during the review period."], "The audit found no incidents at the Quarry site during the review period.", True),
        ("polarity-flip", ["The audit found incidents at the Quarry site."], "The audit found no incidents at the Quarry site during the review period.", False),
        ("polarity-flip", ["The audit may have found no incidents at the Quarry site."], "The audit may have found no incidents at the Quarry site.", False),
        ("polarity-flip", ["The plant is no longer used at the Quarry site."], "The plant is no longer used at the Quarry site.", False),
    ],
)
def test_faults(spark, fault, snippets, text, fires):
    r = injected(spark, fault, snippets, text)
    assert bool(r.oracle) is fires
    if not fires:
        assert r.claims[0]["text"] == text and r.answer_text == text and len(r.claims[0].citation_ids) == 1


def test_what_faults_write(spark):
    r = injected(spark, "entity-swap", ["Aldermoor Corp reported revenue of 2,500 million dollars. Tressel Grid reported revenue of 98 million dollars.", "Tressel Grid is large."], "Aldermoor Corp reported revenue of 2,500 million dollars.", answer="First. Aldermoor Corp reported revenue of 2,500 million dollars [1].")
    assert r.answer_text == "First. Tressel Grid reported revenue of 2,500 million dollars [1]." and r.oracle[0].verdict == "contradicted"
    r = injected(spark, "polarity-flip", ["The company never disclosed the agreement."], "The company never disclosed the agreement.", answer="The company never disclosed the agreement [1]. It never said.")
    assert r.claims[0]["text"] == "The company disclosed the agreement." and r.answer_text == "The company disclosed the agreement [1]. It never said."
    r = injected(spark, "polarity-flip", ["Without a permit the crew built the plant."], "Without a permit the crew built the plant.")
    assert r.claims[0]["text"] == "With a permit the crew built the plant."
    r = injected(spark, "numeric-drift", ["It sold 69,980,000 litres"], "It sold 69,980,000 litres.")
    assert r.claims[0]["text"] in {f"It sold {x} litres." for x in ("75,578,400", "80,477,000", "61,582,400", "57,383,600")} and r.answer_text == r.claims[0]["text"]
    assert not injected(spark, "dropped-citation", [BASE], BASE, rate=0.0).oracle and not injected(spark, "dropped-citation", [BASE], None, cited=()).oracle


def test_figures_and_places(spark):
    token = lambda t: F.transform(tx.spots(t, tx.FIGURE), lambda x: F.concat_ws("|", x.before, x.token, x.after))
    assert one(spark, token, "69,980,000 then 3,000 and 412", "a12 年12 “7”", "") == [["|69,980,000| then 3,000 and 412", "69,980,000 then |3,000| and 412", "69,980,000 then 3,000 and |412|"], ["a12 年12 “|7|”"], []]
    shaped = spark.createDataFrame([("75000000", "69,980,000"), ("3.4", "3.1"), ("1234.56", "1,200.5"), ("20", "3.1")], "v string, m string").select(tx.grouped_digits(F.col("v").cast("decimal(30,6)"), F.col("m")).alias("s"))
    assert [r.s for r in shaped.collect()] == ["75,000,000", "3.4", "1,234.6", "20"]
    stated = spark.createDataFrame([("17 nm in 2007", "7"), ("7,175 units", "7"), ("It was 412.", "412"), ("at 3.5 bar", "3.5")], "t string, f string").select(tx.states_figure(F.col("t"), F.col("f")).alias("s"))
    assert [r.s for r in stated.collect()] == [False, True, False, True]


def test_injected_records(spark):
    answers = spark.read.parquet(f"{SF}/answers.parquet")
    done = faults.inject(answers, "dropped-citation")
    labels = faults.oracle_labels(done)
    ids = {c.id for r in done.select("claims").collect() for c in r.claims}
    assert labels.count() > 0 and all(r.claim_id in ids and r.verdict == "uncited" for r in labels.collect())
    assert sorted(map(str, done.collect())) == sorted(map(str, faults.inject(answers.repartition(5), "dropped-citation").collect()))
    with pytest.raises(ValueError):
        faults.inject(answers, "nonsense")
    with pytest.raises(ValueError):
        faults.inject(answers, "padded-claim", rate=2)


def test_decompose(spark):
    cites = [{"id": "", "url": "a", "snippet": "x", "title": None}, {"id": "", "url": "b", "snippet": "y", "title": None}]
    df = spark.createDataFrame([("q", "e", "First [1]. Second [2, 1]. Claims too much [7]. [1]", cites), ("q", "e", None, None)], f"question_id string, engine string, answer_text string, citations {claims.CITATIONS}")
    rows = claims.build_records(df).collect()
    assert [c.text for c in rows[0].claims] == ["First.", "Second.", "Claims too much."]
    assert [len(c.citation_ids) for c in rows[0].claims] == [1, 2, 0] and rows[1].claims == []


@pytest.mark.parametrize(
    "text, snippets, want",
    [
        ("It had revenue of 500 million", ["It had revenue of 412 million"], "contradicted"), ("It had 500", ["bananas grow"], "unsupported"), ("Costs rose 12%", ["Costs rose 12 percent"], "supported"),
        ("No incidents were found here", ["Incidents were found here"], "partial"), ("of the", ["x"], "partial"), ("x", [], "uncited"), ("No zebra ran", ["Apples fell"], "partial"), ("alpha beta", ["alpha"], "partial"),
    ],
)
def test_lexical_judge(spark, text, snippets, want):
    df = spark.createDataFrame([("c", text, ["i"] if snippets else [], snippets)], "claim_id string, text string, citation_ids array<string>, snippets array<string>")
    assert judge.judge_claims(df).first().verdict == want


def test_replies(spark):
    got = one(spark, judge.parse_reply, '{"verdict": " Supported", "rationale": "r"}', "oops", '{"verdict": "maybe"}', None)
    assert [r.verdict for r in got] == ["supported", "partial", "partial", "partial"] and got[1].rationale.startswith("unparseable")
    assert judge.judge_name("llm:x") == "judge:llm:x"


def test_agreement(spark):
    cells = lambda rows: spark.createDataFrame(rows, "human string, judge string, n long")
    a = metrics.agreement(cells([("supported", "supported", 9), ("unsupported", "supported", 1)])).first()
    assert (a.accuracy, a.kappa) == (0.9, 0.0)
    assert metrics.agreement(cells([("supported", "supported", 3)])).first().kappa == 1.0
    assert metrics.agreement(cells([])).first().n == 0
    assert [metrics.labels_needed(h) for h in (0.10, 0.07, 0.05)] == [97, 196, 385]
    counts = spark.createDataFrame([("x", 100, 60, 40, 0), ("y", 5, 5, 0, 0), ("z", 0, 0, 0, 0)], "k string, n long, supported long, partial long, uncited long")
    ends = {r.k: r for r in metrics.bootstrap_scores(counts, ["k"]).collect()}
    worth, rng = [1.0] * 60 + [0.5] * 40, random.Random(0)
    plain = sorted(sum(rng.choices(worth, k=100)) / 100 for _ in range(2000))
    assert abs(plain[50] - ends["x"].lenient_lo) < 0.02 and abs(plain[1950] - ends["x"].lenient_hi) < 0.02 and ends["x"].strict_lo < 0.6 < ends["x"].strict_hi
    assert tuple(ends["y"])[1:3] == (1.0, 1.0) and ends["y"].uncited_hi == 0.0 and set(tuple(ends["z"])[1:]) == {0.0}


def test_places(spark):
    rng = random.Random(8)
    rows = [(rng.choice("ab"), rng.randint(0, 3), rng.randint(0, 20000), i) for i in range(400)]
    got = places(spark.createDataFrame(rows, "g string, c int, o long, i int"), ["g"], {"c": -F.col("c")}, "o", ["i"], "place").collect()
    for g in "ab":
        order = sorted((-r.c, r.o, r.i) for r in got if r.g == g)
        assert [(-r.c, r.o, r.i) for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == order and [r.place for r in sorted((r for r in got if r.g == g), key=lambda r: r.place)] == list(range(1, len(order) + 1))


def test_staging_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})

    class Session:
        sparkContext = Context
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})

    with pytest.raises(RuntimeError, match="share"):
        staging.shared_folder(Session)
    folder = staging.session_folder(spark)
    staging.stage(spark.range(3), "x")
    assert any(n.startswith("x-") for n in os.listdir(folder.removeprefix("file://")))
    code = "from pyspark.sql import SparkSession; from citeloom.plans import staging; s = SparkSession.builder.master('local[1]').config('spark.ui.enabled', 'false').getOrCreate(); staging.stage(s.range(2)); print(staging.session_folder(s))"
    left = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120, check=True).stdout.strip().splitlines()[-1]
    assert "staged-" in left and not os.path.exists(left.removeprefix("file://"))


def test_queue(spark):
    rows = [(i, "q1" if i % 3 else "q2", "e", 0, f"c{i}", "alpha beta gamma", ["s"], ["alpha beta"] if i % 2 else ["alpha beta gamma"]) for i in range(30)]
    cl = spark.createDataFrame(rows, "ord long, question_id string, engine string, claim_index int, claim_id string, text string, citation_ids array<string>, snippets array<string>")
    q = spark.createDataFrame([("q1", ["numeric", "contested"]), ("q2", ["simple"])], "id string, failure_modes array<string>")
    lb = spark.createDataFrame([(f"c{i}", "supported", "oracle:x") for i in range(20)] + [("c29", "supported", "human:a")], "claim_id string, verdict string, labeler string")
    for f, known in ((0.0, 0), (1.0, 20), (0.5, 9)):
        got = queueing.prioritise(cl, q, lb, "human:a", f).collect()
        assert sum(r.known for r in got) == known and sum(not r.known for r in got) == 9
        assert len({r.claim_id for r in got}) == len(got) and {r.mode for r in got} <= {"contested", "simple"}
    with pytest.raises(ValueError):
        queueing.prioritise(cl, q, lb, "x", 2.0)
    with pytest.raises(ValueError):
        queueing.replace_labels(lb, lb, "human:a")
    keys = iter(["x", "s", "k", "q"])
    assert queueing.ask_person(cl.limit(3).collect(), lambda _: next(keys), lambda _: None)[0][1] == "supported"


def test_jsonl(spark, tmp_path):
    p = tmp_path / "labels.jsonl"
    p.write_text('{"claim_id": "a", "verdict": "supported", "labeler": "x"}\n\n{"claim_id": "b", "verdict": "partial", "labeler": "y", "extra": 1}\n')
    assert [r.claim_id for r in jsonl.labels(spark, str(p)).orderBy("ord").collect()] == ["a", "b"]
    assert jsonl.labels(spark, str(tmp_path / "none")).count() == 0
    p.write_text('{"claim_id": broken\n')
    with pytest.raises(Exception, match="labels.jsonl:1: not JSON"):
        jsonl.labels(spark, str(p)).collect()
    many = tmp_path / "many"
    many.mkdir()
    for i, n in enumerate((3, 1, 40)):
        (many / f"part-{i}.json").write_text("".join(json.dumps({"claim_id": f"{i}-{k}", "verdict": "partial", "labeler": "x"}) + "\n\n" * (k == 1) + "\n" * (k != 1) for k in range(n)))
    assert [r.claim_id for r in jsonl.labels(spark, str(many)).orderBy("ord").collect()] == [f"{i}-{k}" for i, n in enumerate((3, 1, 40)) for k in range(n)]
    (many / "part-1.json").write_text('{"claim_id": "a", "verdict": "partial", "labeler": "x"}\n\n{oops\n')
    with pytest.raises(Exception, match="part-1.json:3: not JSON"):
        jsonl.labels(spark, str(many)).collect()
    with pytest.raises(ValueError, match="no answers"):
        jsonl.answers(spark, str(tmp_path / "none"), required=True)
    p.write_text('{"claim_id": "a", "verdict": "maybe", "labeler": "x"}\n')
    with pytest.raises(Exception, match="known verdict"):
        jsonl.labels(spark, str(p)).collect()
    v = tmp_path / "v.json"
    v.write_text(json.dumps({"a": ["Supported", "why"], "b": "partial", "c": ["maybe", ""]}))
    good, bad = jsonl.verdict_map(spark, str(v))
    assert {(r.claim_id, r.verdict, r.rationale) for r in good.collect()} == {("a", "supported", "why"), ("b", "partial", "")} and [r.claim_id for r in bad.collect()] == ["c"]
    out = str(tmp_path / "store")
    assert jsonl.write_jsonl(good.withColumn("labeler", F.lit("j")), out) == 2
    jsonl.merge_labels(jsonl.labels(spark, out), good.withColumn("labeler", F.lit("k")), out)
    assert jsonl.labels(spark, out).count() == 4


def test_stream_judges_like_batch(spark, tmp_path):
    answers = spark.read.parquet(f"{SF}/answers.parquet").where("ord < 40").withColumn("answered_at", F.col("answered_at").cast("timestamp"))
    answers.select("ord", "question_id", "engine", "answer_text", "claims", "citations", "latency_s", "error", "answered_at").write.json(str(tmp_path / "in"))
    q = judging.judged_stream(judging.answers_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("judged").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.claim_id, r.verdict) for r in spark.table("judged").collect())
    assert got == sorted((r.claim_id, r.verdict) for r in judge.judge_claims(claims.claim_rows(answers)).collect())


def ranked_by_hand(docs, asked, k, k1=1.5, b=0.75):
    """Every match scored: ``{(qid, doc_index, chunk_index, score, rank)}`` over chunks ``{(doc_index, chunk_index): tokens}``."""
    avg, df = sum(map(len, docs.values())) / len(docs), Counter(t for d in docs.values() for t in set(d))
    out = set()
    for qid, terms in asked.items():
        idf = {t: m * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)) for t, m in Counter(terms).items()}
        scores = {key: round(sum(w * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * max(len(d), 1) / avg)) for t, w in idf.items()), 6) for key, d in docs.items()}
        best = sorted((-s, *key) for key, s in scores.items() if s > 0)[:k]
        out |= {(qid, doc, chunk, -s, i + 1) for i, (s, doc, chunk) in enumerate(best)}
    return out


def search_case(rng, n_docs, n_asked):
    """Texts of frequent, less frequent and rare words with copies, and questions of all kinds, some equal in their words."""
    often, some, rare = [f"often{i}" for i in range(12)], [f"some{i}" for i in range(60)], [f"rare{i}" for i in range(n_docs)]
    docs = [" ".join([*rng.choices(often, k=rng.randint(0, 9)), *rng.choices(some, k=rng.randint(0, 4)), *rng.choices(rare, k=rng.randint(0, 2))]) for _ in range(n_docs)]
    docs += rng.choices(docs, k=n_docs // 5) + ["", "the of and"]
    asked = [" ".join([*rng.choices(often, k=rng.randint(0, 5)), *rng.choices(some, k=rng.randint(0, 2)), *rng.choices([*rare, "never"], k=rng.randint(0, 2))]) for _ in range(n_asked)]
    asked += [" ".join(reversed(x.split())) for x in rng.choices(asked, k=n_asked // 5)] + ["", "the of", "never"]
    return docs, {f"q{i}": x for i, x in enumerate(asked)}


def test_search_like_scoring_every_match(spark, monkeypatch):
    docs, asked = search_case(random.Random(5), 300, 150)
    texts = spark.createDataFrame([(90 + 30 * (i % 2), i, i % 3, "u", "t", x) for i, x in enumerate(docs)], "chunk_words int, doc_index long, chunk_index int, url string, title string, text string").repartition(3)
    questions = spark.createDataFrame([*asked.items(), (None, "some1 often2 rare3")], "qid string, text string")
    index = bm25.build_index(texts)
    tokens = lambda x: [t for t in x.split() if t not in tx.STOPWORDS]
    every = {q: tokens(x) for q, x in asked.items()} | {None: ["some1", "often2", "rare3"]}
    want = {k: {(r[0], 90 + 30 * odd, *r[1:]) for odd in (0, 1) for r in ranked_by_hand({(i, i % 3): tokens(x) for i, x in enumerate(docs) if i % 2 == odd}, every, k)} for k in (1, 4)}
    for k, block, part in ((1, bm25.BLOCK_TOKENS, bm25.QUERY_BYTES), (4, 100, 4000)):  # whole; small blocks and queries in parts
        monkeypatch.setattr(bm25, "BLOCK_TOKENS", block)
        monkeypatch.setattr(bm25, "QUERY_BYTES", part)
        got = [tuple(r) for r in bm25.search(index, questions, k).collect()]
        assert len(got) == len(set(got)) and set(got) == want[k] and len(got) > 200 * k
    assert bm25.search(index, questions.where("qid in ('q180', 'none')"), 3).collect() == []


def test_search_writes_no_matches(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(30)]
    docs = [(90, i, 0, "u", "t", " ".join(rng.choices(words, k=25))) for i in range(1500)]
    asked = [(f"q{i}", " ".join(rng.choices(words, k=8))) for i in range(1000)]  # nearly every chunk has one of the words
    index = bm25.build_index(spark.createDataFrame(docs, "chunk_words int, doc_index long, chunk_index int, url string, title string, text string"))
    used = lambda: sum(x.totalShuffleWrite() for x in [spark._jsc.sc().statusStore().executorList(True).apply(0)])
    before = used()
    rows = bm25.search(index, spark.createDataFrame(asked, "qid string, text string"))
    assert rows.count() == 3000
    assert used() - before < 400_000  # 1.5 million scored pairs are not handed on


@pytest.mark.parametrize("probed, at_once", [(1, 1), (5, 300), (64, 1_000_000)])
def test_blocks_lose_no_result(monkeypatch, probed, at_once):
    monkeypatch.setattr(maxscore, "PROBED", probed)
    monkeypatch.setattr(maxscore, "AT_ONCE", at_once)
    texts, questions = search_case(random.Random(probed), 200, 60)
    docs, asked = {(i // 2, i % 2): x.split() for i, x in enumerate(texts)}, {q: x.split() for q, x in questions.items()}
    df, avg = Counter(t for d in docs.values() for t in set(d)), sum(map(len, docs.values())) / len(docs)
    rows = [(i, t, m * math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5)), df[t] > 10) for i, q in enumerate(asked) for t, m in Counter(asked[q]).items() if df[t]]
    given = maxscore.Asked(*pa.table([pa.array(x) for x in zip(*rows, strict=True)], ["cls", "term", "w", "often"]).columns)
    batches = pa.table({"d": [k[0] for k in docs], "c": [k[1] for k in docs], "t": list(docs.values())}, pa.schema([("d", pa.int64()), ("c", pa.int32()), ("t", pa.list_(pa.string()))])).to_batches(40)
    held = list(maxscore.blocks(given, iter(batches), 300, avg, 1.5, 0.75))
    assert len(held) > 2 and len(given.sets[0]) - 1 < len(given.cls)
    probes = np.concatenate([np.stack(x.probe(3)) for x in held], axis=1)
    best = [sorted(probes[1][probes[0] == i], reverse=True)[:3] for i in range(len(given.cls))]
    least = np.array([x[2] if len(x) == 3 else -np.inf for x in best])
    names, found = list(asked), {}
    for x in held:
        query, place, score = x.best(least, 3)
        for q, d, c, s in zip(query, *(y.to_pylist() for y in x.keys.take(pa.array(place)).columns), score, strict=True):
            found.setdefault(names[given.cls[q]], []).append((-s, d, c))
    assert {(q, d, c, -s, i + 1) for q, x in found.items() for i, (s, d, c) in enumerate(sorted(x)[:3])} == ranked_by_hand(docs, asked, 3)


def test_registered_sql(spark):
    """Every query with SQL gives the same rows as DuckDB; the others run."""
    db = duckdb.connect()
    for f in os.listdir(SF):
        db.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    sql = queries.oracle_sql()
    tidy = lambda rows: sorted((tuple(round(float(v), 6) if isinstance(v, float) else v for v in r) for r in rows), key=repr)
    for name in ("text_sentences", "claims_decomposed", "judge_lexical", "search_all", "score_leaderboard", "ingest_clean", "chunk_packed", "engine_lossy", "fault_numeric_drift", "fault_polarity_flip", "fault_padded_claim", "queue_prioritised", "source_answers", "validate_problems"):
        df = queries.queries()[name](spark, SF)
        cols = sorted(df.columns)
        got = db.execute(f"SELECT {', '.join(cols)} FROM ({sql[name]})").fetchall()
        assert tidy(tuple(r[c] for c in cols) for r in df.collect()) == tidy(got), name
    assert set(sql) <= set(queries.queries()) and set(queries.queries()) <= set(__spark_entry__.queries())


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["qid", "chunk_words", "doc_index", "chunk_index", "score", "rank"] and rows.count() > 0
    assert all(a < b for a, b in itertools.pairwise(sorted(queries.queries())))


def test_command_line(spark, tmp_path, monkeypatch):
    from citeloom import cli

    monkeypatch.chdir(tmp_path)
    (tmp_path / "corpus.jsonl").write_text("".join(json.dumps({"url": u, "title": t, "text": x * 2}) + "\n" for _, u, t, x in CORPUS))
    (tmp_path / "questions.jsonl").write_text("".join(json.dumps({"id": f"q{i}", "text": t, "failure_modes": ["numeric"], "aspects": ["412"]}) + "\n" for i, t in enumerate(["What revenue did Aldermoor report in fiscal 2024?", "How much storage does Tressel Grid operate?"])))
    monkeypatch.setattr(cli, "SparkSession", type("S", (), {"builder": type("B", (), {"appName": staticmethod(lambda n: type("G", (), {"getOrCreate": staticmethod(lambda: spark)}))})}))
    assert cli.main(["run", "--faults", "dropped-citation"]) == 0
    assert cli.main(["judge"]) == 0 and cli.main(["judge"]) == 0
    labels = jsonl.labels(spark, str(tmp_path / "labels.jsonl")).collect()
    assert {r.labeler for r in labels} == {"judge:lexical", "oracle:dropped-citation"}
    assert len({(r.claim_id, r.labeler) for r in labels}) == len(labels)
    assert cli.main(["report"]) == 0 and "## Leaderboard" in (tmp_path / "report.md").read_text()
    assert cli.main(["score-completeness"]) == 0 and cli.main(["disagree"]) == 0
    assert cli.main(["validate"]) == 1
    n = jsonl.answers(spark, str(tmp_path / "answers.jsonl")).count()
    (tmp_path / "doubles.py").write_text("def engine():\n    return lambda system, user: 'It is so [1].'\n\n\ndef judge():\n    return lambda prompt: '{\"verdict\": \"partial\", \"rationale\": \"r\"}'\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "doubles.py"))
    assert cli.main(["run", "--append", "--engine", "rag", "--client", "doubles:engine", "--widths", "10", "90"]) == 0
    assert jsonl.answers(spark, str(tmp_path / "answers.jsonl")).count() == n + 4
    assert cli.main(["judge", "--judge", "llm:x", "--client", "doubles:judge"]) == 0
    assert "judge:llm:x" in {r.labeler for r in jsonl.labels(spark, str(tmp_path / "labels.jsonl")).collect()}
    assert cli.main(["export", "--out", "sample.json", "--limit", "4"]) == 0 and len(json.loads((tmp_path / "sample.json").read_text())) == 4
    with pytest.raises(SystemExit, match="client"):
        cli.main(["run", "--engine", "rag"])
