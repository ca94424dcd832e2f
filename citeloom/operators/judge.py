"""Judging a claim against its cited snippets: a rule classifier as one expression, and a pluggable model client."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as tx

# The verdicts in their order, and the thresholds of the rules.
VERDICTS = ["supported", "partial", "unsupported", "contradicted", "uncited"]
SUPPORTED, PARTIAL = 0.75, 0.40
LEXICAL = "judge:lexical"


def best_overlap(tokens: Column, snippets: Column) -> Column:
    """``struct<overlap, snippet>`` of the first snippet with the largest share of the claim's tokens; empty at none."""
    scored = F.transform(snippets, lambda s, i: F.struct(F.coalesce(F.try_divide(F.size(F.array_intersect(tokens, tx.token_set(s))), F.size(tokens)), F.lit(0.0)).alias("overlap"), (-i).alias("first"), s.alias("snippet")))
    top = F.array_max(F.transform(scored, lambda x: F.struct(x.overlap.alias("overlap"), x["first"].alias("first"))))
    text = F.element_at(snippets, (1 - top["first"]).cast("int"))
    return F.struct(F.coalesce(top.overlap, F.lit(0.0)).alias("overlap"), F.when(top.overlap > 0, text).otherwise("").alias("snippet"))


def judge_claims(claims: DataFrame, labeler: str = LEXICAL, keys: tuple[str, ...] = ()) -> DataFrame:
    """Labels ``(claim_id, verdict, labeler, rationale, overlap)`` of :func:`claims.claim_rows`, with its columns ``keys``.

    Rules in order: no citation that resolves; no content tokens; figures of the claim in no snippet; negation on one
    side only; overlap. Narrow: one projection, no shuffle and no Python.
    """
    facts = claims.withColumn("tokens", tx.token_set(F.col("text"))).withColumn("best", best_overlap(F.col("tokens"), F.col("snippets")))
    source = F.array_join("snippets", " ")
    facts = facts.withColumn("missing", F.array_sort(F.array_except(tx.numbers(F.col("text")), tx.numbers(source)))).withColumn("figures", F.size(tx.numbers(source)) > 0)
    over = F.col("best.overlap")
    uncited = (F.size("citation_ids") == 0) | (F.size("snippets") == 0)
    empty = F.size("tokens") == 0
    lost = F.size("missing") > 0
    flipped = tx.negated(F.col("text")) != tx.negated(F.col("best.snippet"))
    verdict = (
        F.when(uncited, "uncited").when(empty, "partial").when(lost, F.when((over >= PARTIAL) & F.col("figures"), "contradicted").otherwise("unsupported"))
        .when(flipped, "partial").when(over >= SUPPORTED, "supported").when(over >= PARTIAL, "partial").otherwise("unsupported")
    )
    shown = F.format_string("%.2f", over)
    listed = F.concat(F.lit("["), F.array_join(F.transform("missing", lambda n: F.concat(F.lit("'"), n, F.lit("'"))), ", "), F.lit("]"))
    why = (
        F.when(uncited, "claim carried no resolvable citation").when(empty, "claim had no content tokens to compare")
        .when(lost, F.concat(F.lit("numbers "), listed, F.lit(" in the claim appear in no cited snippet (overlap "), shown, F.lit(")")))
        .when(flipped, F.concat(F.lit("negation polarity differs between claim and snippet (overlap "), shown, F.lit(")")))
        .otherwise(F.concat(F.lit("content-token overlap "), shown))
    )
    overlap = F.when(uncited | empty, F.lit(None).cast("double")).otherwise(over)
    return facts.select(*keys, "claim_id", verdict.alias("verdict"), F.lit(labeler).alias("labeler"), why.alias("rationale"), F.round(overlap, 6).alias("overlap"))


def pending(claims: DataFrame, labels: DataFrame, labeler: str) -> DataFrame:
    """Claims that ``labeler`` has not labelled yet."""
    return claims.join(labels.where(F.col("labeler") == labeler).select("claim_id").distinct(), "claim_id", "left_anti")


def judge_new(claims: DataFrame, labels: DataFrame, labeler: str = LEXICAL) -> DataFrame:
    """``labels`` with the labels of claims not judged yet appended; claims repeated within the run are judged each."""
    new = judge_claims(pending(claims, labels, labeler), labeler).select("claim_id", "verdict", "labeler", "rationale")
    return labels.select("claim_id", "verdict", "labeler", "rationale").unionByName(new)


def parse_reply(reply: Column) -> Column:
    """``struct<verdict, rationale>`` of a model's JSON reply; malformed ones are partial."""
    got = F.from_json(reply, "verdict string, rationale string")
    verdict = F.lower(tx.strip(got.verdict))
    fine = verdict.isin(VERDICTS)
    return F.struct(F.when(fine, verdict).otherwise("partial").alias("verdict"), F.when(fine, F.left(F.coalesce(got.rationale, F.lit("")), F.lit(500))).otherwise(F.concat(F.lit("unparseable judge response: "), F.left(F.coalesce(reply, F.lit("")), F.lit(200)))).alias("rationale"))


def judge_with_model(claims: DataFrame, client: Callable[[], Callable[[str], str]], labeler: str = "judge:llm", cut: int = 4000) -> DataFrame:
    """Labels by an injected client: ``client()`` is built once per task and maps a prompt to a reply."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = client()
        for b in batches:
            prompts = [f"Claim: {t}\n\nSources:\n" + "\n".join(f"[{i}] {s[:cut]}" for i, s in enumerate(ss, 1)) for t, ss in zip(b["text"], b["snippets"], strict=True)]
            yield pd.DataFrame({"claim_id": b["claim_id"], "reply": [call(p) for p in prompts]})

    bare = (F.size("citation_ids") == 0) | (F.size("snippets") == 0)
    asked = claims.where(~bare).select("claim_id", "text", "snippets").mapInPandas(ask, "claim_id string, reply string").select("claim_id", parse_reply(F.col("reply")).alias("p"))
    uncited = claims.where(bare).select("claim_id", F.lit("uncited").alias("verdict"), F.lit("claim carried no resolvable citation").alias("rationale"))
    return asked.select("claim_id", "p.verdict", "p.rationale").unionByName(uncited).withColumn("labeler", F.lit(labeler))


JUDGES = {"lexical": LEXICAL, "baseline": LEXICAL}


def judge_name(spec: str) -> str:
    """``lexical``, ``baseline`` or ``llm[:model]`` to a labeler's name."""
    if spec in JUDGES:
        return JUDGES[spec]
    if spec == "llm" or spec.startswith("llm:"):
        return f"judge:{spec}"
    raise ValueError(f"unknown judge {spec!r}")
