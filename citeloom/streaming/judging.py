"""An extension: judge claims as answer records arrive. The batch operators are reused unchanged on each record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators.claims import ANSWER, claim_rows
from citeloom.operators.judge import LEXICAL, judge_claims


def judged_stream(answers: DataFrame, watermark: str = "1 hour", labeler: str = LEXICAL) -> DataFrame:
    """Labels of a stream of answers ``(ord, answered_at, ...)``; a record delivered again within the watermark is judged once."""
    once = answers.withWatermark("answered_at", watermark).dropDuplicatesWithinWatermark(["ord"])
    return judge_claims(claim_rows(once), labeler).select("claim_id", "verdict", "labeler", "rationale")


def answers_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(f"ord long, {ANSWER}, answered_at timestamp").json(folder)
