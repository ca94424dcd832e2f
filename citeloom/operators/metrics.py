"""Scores of labels: faithfulness, agreement, detection of known faults, intervals, completeness."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators.judge import VERDICTS


def valid_labels(labels: DataFrame) -> DataFrame:
    """``(ord, claim_id, verdict, labeler, rationale)`` with spellings trimmed and lowered and only the five verdicts."""
    rows = labels.select("ord", "claim_id", F.lower(F.trim("verdict")).alias("verdict"), F.lower(F.trim("labeler")).alias("labeler"), F.coalesce("rationale", F.lit("")).alias("rationale"))
    return rows.where(F.col("verdict").isin(VERDICTS) & F.col("claim_id").isNotNull() & F.col("labeler").isNotNull())


def labeler_kind(labeler: Column) -> Column:
    return F.when(labeler.startswith("human"), "human").when(labeler.startswith("oracle:"), "oracle").otherwise("judge")


def last_label(labels: DataFrame, *by: str) -> DataFrame:
    """The verdict of the highest ``ord`` per claim (and ``by``)."""
    return labels.groupBy("claim_id", *by).agg(F.max_by("verdict", "ord").alias("verdict"))


def claim_engines(claims: DataFrame) -> DataFrame:
    """``(claim_id, engine, question_id)``: of a claim in several records the last record counts."""
    return claims.groupBy("claim_id").agg(F.max_by(F.struct("engine", "question_id"), F.struct("ord", "claim_index")).alias("l")).select("claim_id", "l.engine", "l.question_id")


def faithfulness(labels: DataFrame, *by: str) -> DataFrame:
    """Counts per verdict, ``n``, ``strict``, ``lenient`` (partial counts half) and ``uncited_rate``; zero over nothing."""
    n = F.count("*")
    counts = [F.count_if(F.col("verdict") == v).alias(v) for v in VERDICTS]
    ratio = lambda x: F.round(F.coalesce(F.try_divide(x, n), F.lit(0.0)), 6)
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    return labels.groupBy(*by).agg(n.alias("n"), *counts, ratio(is_("supported")).alias("strict"), ratio(is_("supported") + 0.5 * is_("partial")).alias("lenient"), ratio(is_("uncited")).alias("uncited_rate"))


def leaderboard(labels: DataFrame, claims: DataFrame) -> DataFrame:
    """Faithfulness per labeler and engine; labels of unknown claims are dropped. ``place``: by strict, best first."""
    fact = labels.join(claim_engines(claims), "claim_id")
    scores = faithfulness(fact, "labeler", "engine")
    return scores.withColumn("place", F.row_number().over(Window.partitionBy("labeler").orderBy(F.desc("strict"), "engine")))


def by_failure_mode(labels: DataFrame, claims: DataFrame, questions: DataFrame) -> DataFrame:
    """Faithfulness per engine and failure mode; a claim counts in each of its question's modes."""
    fact = labels.join(claim_engines(claims), "claim_id").join(questions.select(F.col("id").alias("question_id"), F.explode("failure_modes").alias("mode")), "question_id")
    return faithfulness(fact, "engine", "mode")


def verdict_mix(labels: DataFrame, claims: DataFrame) -> DataFrame:
    fact = labels.join(claim_engines(claims), "claim_id")
    return fact.groupBy("engine").pivot("verdict", VERDICTS).count().fillna(0, VERDICTS)


def compared(labels: DataFrame, left: Column, right: Column) -> DataFrame:
    """``(claim_id, human, judge)``: claims labelled on both sides, the last label of each side."""
    a = last_label(labels.where(left)).withColumnRenamed("verdict", "human")
    return a.join(last_label(labels.where(right)).withColumnRenamed("verdict", "judge"), "claim_id")


def confusion(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("human", "judge").agg(F.count("*").alias("n"))


def agreement(cells: DataFrame) -> DataFrame:
    """One row ``(n, accuracy, kappa)`` of a confusion matrix; no pairs give 0, a chance agreement of 1 gives kappa 1."""
    total = cells.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("human") == F.col("judge"), F.col("n"))), F.lit(0)).alias("same"))
    h = cells.groupBy(F.col("human").alias("v")).agg(F.sum("n").alias("h"))
    j = cells.groupBy(F.col("judge").alias("v")).agg(F.sum("n").alias("j"))
    chance = h.join(j, "v").agg(F.coalesce(F.sum(F.col("h") * F.col("j")), F.lit(0)).alias("hj"))
    po, pe = F.try_divide("same", "n"), F.try_divide(F.col("hj"), F.col("n") * F.col("n"))
    kappa = F.when(F.col("n") == 0, 0.0).when(pe >= 1, 1.0).otherwise((po - pe) / (1 - pe))
    return total.crossJoin(chance).select("n", F.round(F.coalesce(po, F.lit(0.0)), 6).alias("accuracy"), F.round(kappa, 6).alias("kappa"))  # one row each


def precision_recall(cells: DataFrame) -> DataFrame:
    """Per verdict: precision, recall and the counts of either side, zero where there are none."""
    spark = cells.sparkSession
    each = spark.createDataFrame([(v,) for v in VERDICTS], "verdict string")
    h = cells.groupBy(F.col("human").alias("verdict")).agg(F.sum("n").alias("n_human"), F.sum(F.when(F.col("human") == F.col("judge"), F.col("n")).otherwise(0)).alias("hit"))
    j = cells.groupBy(F.col("judge").alias("verdict")).agg(F.sum("n").alias("n_judge"))
    rows = each.join(h, "verdict", "left").join(j, "verdict", "left").fillna(0)
    ratio = lambda d: F.round(F.coalesce(F.try_divide(F.col("hit"), F.col(d)), F.lit(0.0)), 6)
    return rows.select("verdict", ratio("n_judge").alias("precision"), ratio("n_human").alias("recall"), "n_human", "n_judge")


def detection(labels: DataFrame) -> DataFrame:
    """Per judge and fault: oracle labels met by the judge, how many with the same verdict, and the rate."""
    oracle = labels.where(F.col("labeler").startswith("oracle:")).select("claim_id", F.regexp_replace("labeler", "^oracle:", "").alias("fault"), F.col("verdict").alias("truth"))
    judges = last_label(labels.where(labeler_kind(F.col("labeler")) == "judge"), "labeler")
    met = oracle.join(judges, "claim_id")
    hit = F.count_if(F.col("truth") == F.col("verdict"))
    said = [F.count_if(F.col("verdict") == v).alias(f"said_{v}") for v in VERDICTS]
    return met.groupBy("labeler", "fault").agg(F.count("*").alias("n"), hit.alias("n_detected"), F.round(hit / F.count("*"), 6).alias("rate"), *said)


def disagreements(labels: DataFrame, claims: DataFrame, judge: str, limit: int = 20) -> DataFrame:
    """The first ``limit`` claims, by id, on which humans and ``judge`` differ (a report)."""
    pairs = compared(labels, F.col("labeler").startswith("human"), F.col("labeler") == judge).where("human != judge")
    text = claims.groupBy("claim_id").agg(F.max_by("text", F.struct("ord", "claim_index")).alias("text"))
    return pairs.join(text, "claim_id", "left").select("claim_id", "human", "judge", F.coalesce("text", F.lit("")).alias("text")).orderBy("claim_id").limit(limit)


def labels_needed(half_width: float, confidence_z: float = 1.96, p: float = 0.5) -> int:
    if not 0 < half_width < 1:
        raise ValueError("half_width must be in (0, 1)")
    return int(confidence_z**2 * p * (1 - p) / half_width**2) + 1


def bootstrap_scores(scores: DataFrame, by: list[str], n_boot: int = 2000, confidence: float = 0.95, seed: int = 0) -> DataFrame:
    """``by`` + ``(strict_lo, strict_hi, lenient_lo, lenient_hi, uncited_lo, uncited_hi)``: percentile intervals.

    A resample of n claims is a multinomial draw of the verdict counts, so any number of claims costs the same; groups of no
    claims have zeros.
    """
    alpha = (1 - confidence) / 2
    ends = [int(alpha * n_boot), min(int((1 - alpha) * n_boot), n_boot - 1)]
    columns = [f"{c}_{e}" for c in ("strict", "lenient", "uncited") for e in ("lo", "hi")]

    def run(batches):
        for b in batches:
            out = []
            for n, counts in zip(b["n"], b[["supported", "partial", "uncited"]].to_numpy(), strict=True):
                if not n:
                    out.append([0.0] * len(columns))
                    continue
                drawn = np.random.default_rng(seed).multinomial(n, [*(counts / n), max(0.0, 1 - counts.sum() / n)], n_boot) / n
                out.append([v for x in (drawn[:, 0], drawn[:, 0] + drawn[:, 1] / 2, drawn[:, 2]) for v in np.sort(x)[ends]])
            yield pd.concat([b[by], pd.DataFrame(out, columns=columns, index=b.index)], axis=1)

    schema = ", ".join([*(f"`{c}` {scores.schema[c].dataType.simpleString()}" for c in by), *(f"{c} double" for c in columns)])
    return scores.select(*by, "n", "supported", "partial", "uncited").mapInPandas(run, schema)


def totals(questions: DataFrame, answers: DataFrame, claims: DataFrame, labels: DataFrame) -> DataFrame:
    """One row of the report's head counts."""
    one = [questions.agg(F.countDistinct("id").alias("questions")), answers.agg(F.count("*").alias("runs")), claims.agg(F.countDistinct("claim_id").alias("claims")),
        labels.agg(F.count("*").alias("labels"), F.count_if(F.col("labeler").startswith("human")).alias("human_labels"), F.count_distinct(F.when(labeler_kind(F.col("labeler")) == "judge", F.col("labeler"))).alias("judges"))]
    return reduce(lambda a, b: a.crossJoin(b), one)  # one row each


# -- completeness ------------------------------------------------------------------------------------------------


def completeness(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """``(ord, question_id, engine, n_aspects, covered, missed, fraction)`` of answers to questions with aspects."""
    asked = questions.where(F.size("aspects") > 0).select(F.col("id").alias("question_id"), "aspects")
    met = answers.select("ord", "question_id", "engine", F.coalesce("answer_text", F.lit("")).alias("answer")).join(asked, "question_id")
    covered = F.filter("aspects", lambda a: tx.covers(F.col("answer"), F.coalesce(a, F.lit(""))))
    missed = F.filter("aspects", lambda a: ~tx.covers(F.col("answer"), F.coalesce(a, F.lit(""))))
    return met.select("ord", "question_id", "engine", F.size("aspects").alias("n_aspects"), covered.alias("covered"), missed.alias("missed")).withColumn("fraction", F.size("covered") / F.col("n_aspects"))


def coverage(scores: DataFrame, *by: str) -> DataFrame:
    """Macro mean of fractions and micro share of aspects."""
    return scores.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.avg("fraction"), 6).alias("macro"), F.round(F.sum(F.size("covered")) / F.sum("n_aspects"), 6).alias("micro"))


def most_missed(scores: DataFrame, limit: int = 10) -> DataFrame:
    """The aspects missed most often, ties in alphabetical order (a top-k report)."""
    return scores.select(F.explode("missed").alias("aspect")).groupBy("aspect").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "aspect").limit(limit)
