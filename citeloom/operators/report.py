"""Dataset problems, and the report in Markdown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators import bm25, chunks, metrics
from citeloom.operators.judge import VERDICTS
from citeloom.plans.staging import spread

# Failure modes in their order.
MODES = ["simple", "multi_hop", "numeric", "negation", "recency", "contested"]


def duplicates(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("key")).agg(F.count("*").alias("n")).where("n > 1 and key is not null")


def mode_coverage(questions: DataFrame) -> DataFrame:
    """``(mode, n, thin)``: questions per failure mode; fewer than three are thin."""
    n = questions.select(F.explode("failure_modes").alias("mode")).groupBy("mode").agg(F.count("*").alias("n"))
    return n.withColumn("thin", F.col("n") < 3)


def problems(questions: DataFrame, corpus: DataFrame, index: bm25.Index | None = None) -> DataFrame:
    """``(kind, key, detail)`` of everything that would skew results."""
    row = lambda df, kind, key, detail: df.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))
    once = questions.groupBy("id").agg(F.min_by("text", "ord").alias("text"), F.min_by("aspects", "ord").alias("aspects"))
    found = [
        row(duplicates(questions, "id"), "duplicate question id", F.col("key"), F.col("n")),
        row(duplicates(corpus, "url"), "duplicate corpus url", F.col("key"), F.col("n")),
        row(corpus.where(F.size(tx.words(F.coalesce("text", F.lit("")))) < 20), "short document", F.col("doc_index"), F.size(tx.words(F.coalesce("text", F.lit(""))))),
        row(mode_coverage(questions).where("thin"), "thin failure mode", F.col("mode"), F.col("n")),
    ]
    with_none = once.agg(F.count_if(F.coalesce(F.size("aspects"), F.lit(0)) <= 0).alias("none"), F.count("*").alias("n"))
    found.append(row(with_none.where("none > 0 and none < n"), "questions without aspects", F.lit("aspects"), F.col("none")))
    if index is not None:
        found.append(row(bm25.unanswerable(index, once.select(F.col("id").alias("qid"), "text")), "unanswerable question", F.col("qid"), F.col("best")))
    return reduce(DataFrame.unionByName, found)


def corpus_index(corpus: DataFrame, width: int = 90, overlap: int = 20) -> bm25.Index:
    return bm25.build_index(chunks.chunk_documents(spread(corpus), [width], overlap))


def markdown(header: list[str], rows: list[list]) -> str:
    """A fixed-width table."""
    cells = [header, *[[str(c) for c in r] for r in rows]]
    wide = [max(len(r[i]) for r in cells) for i in range(len(header))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in wide) + "|", *map(line, cells[1:])])


def _table(df: DataFrame, columns: list[str], percent: tuple[str, ...] = ()) -> str:
    """Of tables with a row per engine, labeler, mode, verdict or fault; a value that is absent is ``-``."""
    shown = df.select(*[F.coalesce(tx.percent(F.col(c)) if c in percent else F.col(c).cast("string"), F.lit("-")).alias(c) for c in columns])
    rows = [list(r) for r in shown.collect()]
    return markdown(columns, rows) if rows else "_no data_"


def calibration(labels: DataFrame, judges: list[str]) -> list[list]:
    """``[judge, n, accuracy, kappa, reading]`` of every judge against people, the best kappa first."""
    kind, rows = metrics.labeler_kind(F.col("labeler")), []
    for j in judges:
        a = metrics.agreement(metrics.confusion(metrics.compared(labels, kind == "human", F.col("labeler") == j)))
        rows.append(list(a.select("n", tx.percent(F.col("accuracy")).alias("a"), "kappa", tx.kappa_reading(F.col("kappa")).alias("r")).first()))
    return [[j, n, acc, f"{k:.3f}", r] for j, (n, acc, k, r) in sorted(zip(judges, rows, strict=True), key=lambda x: -x[1][2])]


def boards(labels: DataFrame, claims: DataFrame) -> DataFrame:
    """Leaderboards with intervals: people pooled as ``human``, every judge by itself; oracles are left out."""
    kind = metrics.labeler_kind(F.col("labeler"))
    pooled = labels.where(kind != "oracle").withColumn("labeler", F.when(kind == "human", "human").otherwise(F.col("labeler")))
    board = metrics.leaderboard(pooled, claims)
    return board.join(metrics.bootstrap_scores(board, ["labeler", "engine"]), ["labeler", "engine"]).orderBy(F.col("labeler") != "human", "labeler", "place")


def said_instead(detection: DataFrame) -> DataFrame:
    """``detection`` with ``judge_said``: the verdicts given and how often, the most frequent first."""
    each = F.array(*[F.struct((-F.col(f"said_{v}")).alias("n"), F.lit(i).alias("i"), F.concat(F.lit(f"{v} x"), F.col(f"said_{v}").cast("string")).alias("t")) for i, v in enumerate(VERDICTS)])
    return detection.withColumn("judge_said", F.array_join(F.transform(F.array_sort(F.filter(each, lambda x: x.n < 0)), lambda x: x.t), ", "))


def build_report(questions: DataFrame, answers: DataFrame, claims: DataFrame, labels: DataFrame) -> str:
    """Totals, calibration, leaderboard with intervals, fault validation, failure modes, verdict mix, completeness.

    Only tables with a row per engine, labeler, mode, verdict or fault are collected. Sections without labels say so.
    """
    labels = metrics.valid_labels(labels)
    kind = metrics.labeler_kind(F.col("labeler"))
    head = metrics.totals(questions, answers, claims, labels).first().asDict()
    out = ["# Attribution report", "", *[f"- {k.replace('_', ' ')}: {v}" for k, v in head.items()]]
    judges = [r.labeler for r in labels.where(kind == "judge").groupBy("labeler").agg(F.min("ord").alias("first")).orderBy("first").collect()]
    out += ["", "## Calibration", ""]
    out += [markdown(["judge", "n", "accuracy", "kappa", "reading"], calibration(labels, judges))] if head["human_labels"] and judges else ["_No labels by people yet: no judge's score is to be trusted before there are._"]
    rates = ["strict", "strict_lo", "strict_hi", "lenient", "lenient_lo", "lenient_hi", "uncited_rate", "uncited_lo", "uncited_hi"]
    out += ["", "## Leaderboard", "", _table(boards(labels, claims), ["labeler", "engine", "n", *rates], tuple(rates))]
    out += ["", "## Fault validation", "", _table(said_instead(metrics.detection(labels)).orderBy("labeler", "fault"), ["labeler", "fault", "n", "n_detected", "rate", "judge_said"], ("rate",))]
    primary = labels.where(kind == "human") if head["human_labels"] else labels.where(F.col("labeler") == (judges[0] if judges else ""))
    name = "human" if head["human_labels"] else judges[0] if judges else "none"
    modes = metrics.by_failure_mode(primary, claims, questions).groupBy("engine").pivot("mode", MODES).agg(F.first("strict")).orderBy("engine")
    out += ["", f"## Failure modes (strict, labels: {name})", "", _table(modes, ["engine", *MODES], tuple(MODES))]
    out += ["", "## Verdict mix", "", _table(metrics.verdict_mix(primary, claims).orderBy("engine"), ["engine", *VERDICTS])]
    scores = metrics.completeness(questions, answers)
    measured = metrics.coverage(scores, "engine")
    out += ["", "## Completeness", ""]
    if questions.where(F.size("aspects") > 0).isEmpty():
        return "\n".join([*out, "_No question declares aspects: completeness is not measured, which is not a score of zero._"]) + "\n"
    out += [_table(measured.orderBy(F.desc("macro"), "engine"), ["engine", "n", "macro", "micro"], ("macro", "micro"))]
    out += ["", "### Most missed", "", _table(metrics.most_missed(scores), ["aspect", "n"])]
    return "\n".join(out) + "\n"
