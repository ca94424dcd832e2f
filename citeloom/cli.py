"""Command line: ``python -m citeloom.cli COMMAND ...`` over JSON lines."""

from __future__ import annotations

import argparse
import importlib
import json
import os
import sys
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import chunks, claims, engines, faults, ingest, judge, metrics, queueing, report
from citeloom.operators.bm25 import build_index
from citeloom.plans.staging import release, stage
from citeloom.sources import jsonl


def _claims(s: SparkSession, a: argparse.Namespace) -> DataFrame:
    return claims.claim_rows(jsonl.answers(s, a.answers, required=True))


def _client(a: argparse.Namespace):
    """The client factory named by ``--client module:factory``."""
    if not a.client:
        raise SystemExit("a model needs a client: --client module:factory")
    module, _, factory = a.client.partition(":")
    return getattr(importlib.import_module(module), factory)


def run(s: SparkSession, a: argparse.Namespace) -> int:
    """Answers of every engine and width, clean and with faults, and the oracle labels of the faults.

    ``--append`` keeps earlier records. A run with faults replaces all earlier oracle labels, with ``--append`` too. Widths
    are run together; one narrower than the overlap gets an overlap one word short of it.
    """
    asked = jsonl.questions(s, a.questions, required=True).select(F.col("id").alias("qid"), "text")
    docs = jsonl.corpus(s, a.corpus)
    if docs.isEmpty():
        raise ValueError(f"no corpus documents at {a.corpus}")
    cut = [chunks.chunk_documents(docs, [w], min(a.overlap, w - 1)) for w in a.widths]
    index = build_index(reduce(DataFrame.unionByName, cut))
    if a.engine == "rag":
        made = engines.model_rag(index, asked, _client(a), a.top_k)
    else:
        made = {"extractive": engines.extractive, "lossy": engines.lossy}[a.engine](index, asked, a.top_k)
    made = stage(made, "made")  # a model is asked once, however many faults follow
    out, oracle = made.drop("ord"), None
    for fault in a.faults:
        injected = faults.inject(made, fault, a.rate, a.seed)
        labels = faults.oracle_labels(injected)
        out, oracle = out.unionByName(injected.drop("oracle", "ord")), labels if oracle is None else oracle.unionByName(labels)
    if a.append:
        out = stage(jsonl.answers(s, a.answers).drop("ord").unionByName(out), "records")
    print(jsonl.write_jsonl(out, a.answers), "records")
    if oracle is not None:
        jsonl.merge_labels(jsonl.labels(s, a.labels).where(~F.col("labeler").startswith("oracle:")), oracle, a.labels)
    return 0


def judge_answers(s: SparkSession, a: argparse.Namespace) -> int:
    name = judge.judge_name(a.judge)
    old = jsonl.labels(s, a.labels)
    new = judge.pending(_claims(s, a), old, name)
    said = judge.judge_claims(new, name) if name == judge.LEXICAL else judge.judge_with_model(new, _client(a), name)
    jsonl.merge_labels(old, said, a.labels)
    return 0


def make_report(s: SparkSession, a: argparse.Namespace) -> int:
    text = report.build_report(jsonl.questions(s, a.questions), jsonl.answers(s, a.answers), _claims(s, a), jsonl.labels(s, a.labels))
    with open(a.out, "w", encoding="utf-8") as f:
        f.write(text)
    return 0


def disagree(s: SparkSession, a: argparse.Namespace) -> int:
    for line in metrics.disagreements(metrics.valid_labels(jsonl.labels(s, a.labels)), _claims(s, a), judge.judge_name(a.judge)).toJSON().collect():  # at most 20
        print(line)
    return 0


def ingest_pages(s: SparkSession, a: argparse.Namespace) -> int:
    rows = ingest.ingest(jsonl.pages(s, a.pages), "ord", "url", "title", "raw", a.threshold)
    print(jsonl.write_jsonl(rows.where("drop_reason is null").select("url", "title", "text"), a.corpus), "documents")
    rows.groupBy("drop_reason").agg(F.count("*").alias("pages"), F.sum("n_words").alias("words")).show()
    return 0


def score_completeness(s: SparkSession, a: argparse.Namespace) -> int:
    scores = metrics.completeness(jsonl.questions(s, a.questions), jsonl.answers(s, a.answers))
    metrics.coverage(scores, "engine").show(200, False)
    metrics.most_missed(scores).show(20, False)
    return 0


def validate(s: SparkSession, a: argparse.Namespace) -> int:
    corpus = jsonl.corpus(s, a.corpus)
    found = report.problems(jsonl.questions(s, a.questions, required=True), corpus, report.corpus_index(corpus))
    found.show(200, False)
    print({h: metrics.labels_needed(h) for h in (0.10, 0.07, 0.05)})
    return 1 if not found.isEmpty() else 0


def label(s: SparkSession, a: argparse.Namespace) -> int:
    old, all_claims = jsonl.labels(s, a.labels), _claims(s, a)
    if a.no_priority:
        queue = judge.pending(all_claims, old, a.labeler).orderBy("ord", "claim_index").limit(a.limit)
    else:
        order = queueing.prioritise(all_claims, jsonl.questions(s, a.questions), old, a.labeler, a.oracle_fraction).orderBy("turn", "bucket").limit(a.limit)
        queue = order.join(all_claims.select("claim_id", "text", "snippets").dropDuplicates(["claim_id"]), "claim_id").orderBy("turn", "bucket")
    said = queueing.ask_person(queue.toLocalIterator())
    if said:
        jsonl.merge_labels(old, s.createDataFrame([(c, v, a.labeler, "") for c, v in said], jsonl.LABEL), a.labels)
    return 0


def export(s: SparkSession, a: argparse.Namespace) -> int:
    sample = queueing.stratified_sample(_claims(s, a), jsonl.questions(s, a.questions), jsonl.labels(s, a.labels), a.limit, a.seed)
    rows = [r.asDict(recursive=True) for r in sample.collect()]  # at most --limit rows
    with open(a.out, "w", encoding="utf-8") as f:
        json.dump(rows, f, indent=2, ensure_ascii=False)
    strata = {("+" in r["engine"], (r["failure_modes"] or [None])[0]) for r in rows}
    known = sum(r["has_oracle"] for r in rows)
    print(f"{len(rows)} claims, {known} with an oracle's verdict, {len(rows) - known} without, of {len(strata)} strata")
    return 0


def import_verdicts(s: SparkSession, a: argparse.Namespace) -> int:
    good, bad = jsonl.verdict_map(s, a.out)
    bad.show(200, False)
    if good.isEmpty() and bad.isEmpty():
        raise ValueError(f"no verdicts at {a.out}")
    rows = queueing.replace_labels(jsonl.labels(s, a.labels), good, a.labeler)
    jsonl.merge_labels(rows.limit(0), rows, a.labels)
    return 0


COMMANDS = {"run": run, "judge": judge_answers, "report": make_report, "disagree": disagree, "ingest": ingest_pages, "score-completeness": score_completeness, "validate": validate, "label": label, "export": export, "import": import_verdicts}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="citeloom")
    p.add_argument("command", choices=COMMANDS)
    for name in ("questions", "answers", "labels", "corpus", "pages", "out"):
        p.add_argument(f"--{name}", default=f"{name}.jsonl" if name != "out" else "report.md")
    p.add_argument("--engine", choices=["extractive", "lossy", "rag"], default="extractive")
    p.add_argument("--client", default="", help="module:factory of the client of a model engine or judge")
    p.add_argument("--append", action="store_true", help="keep earlier answer records")
    p.add_argument("--oracle-fraction", type=float, default=0.35)
    p.add_argument("--no-priority", action="store_true", help="label in the order of the records")
    p.add_argument("--faults", nargs="*", default=[], choices=faults.FAULTS)
    p.add_argument("--widths", nargs="*", type=int, default=[90])
    p.add_argument("--overlap", type=int, default=20)
    p.add_argument("--top-k", type=int, default=3)
    p.add_argument("--rate", type=float, default=1.0)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--limit", type=int, default=60)
    p.add_argument("--threshold", type=float, default=0.8)
    p.add_argument("--judge", default="lexical")
    p.add_argument("--labeler", default="human:me")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    for name in ("questions", "answers", "labels", "corpus", "pages", "out"):  # the JVM may have another working folder
        path = getattr(a, name)
        setattr(a, name, path if "://" in path else os.path.abspath(path))
    session = SparkSession.builder.appName("citeloom").getOrCreate()
    done = COMMANDS[a.command](session, a)
    release(session)
    return done


if __name__ == "__main__":
    sys.exit(main())
