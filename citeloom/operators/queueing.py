"""What to label next, and samples for review."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.operators.judge import PARTIAL, SUPPORTED, best_overlap, pending
from citeloom.plans.ranking import places
from citeloom.plans.staging import stage


def ambiguity(overlap: Column) -> Column:
    """1 on a threshold of the rule judge, 0 from half a unit away."""
    return F.greatest(F.lit(0.0), 1 - F.least(F.abs(overlap - PARTIAL), F.abs(overlap - SUPPORTED)) / 0.5)


def claim_ambiguity(claims: DataFrame) -> DataFrame:
    """``claims`` with ``ambiguity``; uncited claims and those without content tokens are clear."""
    tokens = tx.token_set(F.col("text"))
    clear = (F.size("citation_ids") == 0) | (F.size("snippets") == 0) | (F.size(tokens) == 0)
    return claims.withColumn("ambiguity", F.when(clear, 0.0).otherwise(F.round(ambiguity(best_overlap(tokens, F.col("snippets")).overlap), 6)))


def prioritise(claims: DataFrame, questions: DataFrame, labels: DataFrame, labeler: str, oracle_fraction: float = 0.35) -> DataFrame:
    """``(claim_id, mode, ambiguity, known, turn, bucket)``: the labelling queue, in order of turn and bucket.

    Claims not yet labelled by ``labeler``; of those with an oracle's verdict only as many, first come, as make up
    ``oracle_fraction``; most ambiguous first within a mode (a claim's mode is the alphabetically first of its
    question), modes taken in turn, larger ones first.
    """
    if not 0 <= oracle_fraction <= 1:
        raise ValueError("oracle_fraction must be in [0, 1]")
    oracle = labels.where(F.col("labeler").startswith("oracle:")).select("claim_id").distinct().withColumn("known", F.lit(True))
    modes = questions.select(F.col("id").alias("question_id"), F.array_min("failure_modes").alias("mode"))
    seen = claim_ambiguity(pending(claims, labels, labeler)).select("claim_id", "question_id", "ord", "claim_index", "ambiguity").join(oracle, "claim_id", "left").join(modes, "question_id", "left")
    open_ = stage(seen.select("claim_id", "ord", "claim_index", "ambiguity", F.coalesce("known", F.lit(False)).alias("known"), F.coalesce("mode", F.lit("unknown")).alias("mode")), "open")
    unknown = open_.agg(F.count_if(~F.col("known"))).first()[0]
    queue = open_
    if unknown and oracle_fraction < 1:
        first = places(open_.where("known"), [], {}, "ord", ["claim_index", "claim_id"], "place")
        some = first.where(F.col("place") <= math.floor(unknown * oracle_fraction / (1 - oracle_fraction))).drop("place")
        queue = stage(open_.where("not known").unionByName(some), "queue")
    sizes = queue.groupBy("mode").agg(F.count("*").alias("n")).withColumn("bucket", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("n"), "mode")))
    turns = places(queue, ["mode"], {"clear": -F.col("ambiguity"), "known": F.col("known")}, "ord", ["claim_index", "claim_id"], "turn")
    return turns.join(F.broadcast(sizes.select("mode", "bucket")), "mode").select("claim_id", "mode", "ambiguity", "known", "turn", "bucket")  # at most seven modes


def stratified_sample(claims: DataFrame, questions: DataFrame, labels: DataFrame, n: int = 60, seed: int = 0) -> DataFrame:
    """A review sample over (clean or faulty engine, first failure mode): ``max(1, n // strata)`` of each, cut to ``n``.

    Order is by a hash of claim and seed, so the sample does not depend on partitions.
    """
    asked = questions.select(F.col("id").alias("question_id"), F.col("text").alias("question"), "failure_modes")
    rows = claims.join(asked, "question_id").withColumn("family", F.when(F.contains("engine", F.lit("+")), "faulty").otherwise("clean")).withColumn("mode", F.get("failure_modes", F.lit(0)))
    strata = rows.select("family", "mode").distinct().agg(F.count("*").alias("strata"))
    key = lambda seed: F.md5(F.concat_ws("|", F.lit(seed), "claim_id", "ord"))
    # the literal bound keeps at most n rows of a stratum per task before the shuffle
    ranked = rows.withColumn("r", F.row_number().over(Window.partitionBy("family", "mode").orderBy(key(seed), "claim_index"))).where(F.col("r") <= n)
    picked = ranked.crossJoin(F.broadcast(strata)).where(F.col("r") <= F.greatest(F.lit(1), F.floor(F.lit(n) / F.col("strata"))))  # one row
    oracle = labels.where(F.col("labeler").startswith("oracle:")).select("claim_id").distinct().withColumn("has_oracle", F.lit(True))
    out = picked.orderBy(key(seed + 1), "claim_index").limit(n).join(oracle, "claim_id", "left")
    return out.select("claim_id", "engine", "question", "failure_modes", F.col("text").alias("claim"), F.col("snippets").alias("cited_snippets"), F.coalesce("has_oracle", F.lit(False)).alias("has_oracle"))


def replace_labels(labels: DataFrame, new: DataFrame, labeler: str) -> DataFrame:
    """``labels`` with those of ``labeler`` replaced by ``new`` (``claim_id, verdict, rationale``)."""
    if labeler.startswith("human"):
        raise ValueError("verdicts of people are not imported")
    kept = labels.where(F.col("labeler") != labeler).select("claim_id", "verdict", "labeler", "rationale")
    return kept.unionByName(new.select("claim_id", "verdict", F.lit(labeler).alias("labeler"), F.left(F.coalesce("rationale", F.lit("")), F.lit(400)).alias("rationale")))


def ask_person(queue, read=input, write=print) -> list[tuple[str, str]]:
    """A labelling session over rows ``(claim_id, text, snippets)``: s, p, u, c, n label, k skips, q ends."""
    keys = {"s": "supported", "p": "partial", "u": "unsupported", "c": "contradicted", "n": "uncited"}
    out = []
    for row in queue:
        write(f"\n{row.text}\n" + "\n".join(f"  [{i}] {s}" for i, s in enumerate(row.snippets, 1)))
        while True:
            key = read("s/p/u/c/n, k skip, q quit: ").strip().lower()
            if key == "q":
                return out
            if key in keys:
                out.append((row.claim_id, keys[key]))
            if key in keys or key == "k":
                break
    return out
