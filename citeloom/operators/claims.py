"""Claims of an answer: one per sentence, with the citations its markers name and ids derived from content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as tx

CITATIONS = "array<struct<id:string,url:string,snippet:string,title:string>>"
CLAIMS = "array<struct<id:string,question_id:string,text:string,citation_ids:array<string>>>"
ANSWER = f"question_id string, engine string, answer_text string, claims {CLAIMS}, citations {CITATIONS}, latency_s double, error string"


def stable_citations(citations: Column) -> Column:
    """Citations under their content ids; the order stays, since markers are positions."""
    return F.transform(F.coalesce(citations, F.expr(f"cast(array() as {CITATIONS})")), lambda c: F.struct(tx.citation_id(c.url, c.snippet).alias("id"), c.url.alias("url"), c.snippet.alias("snippet"), c.title.alias("title")))


def decompose(engine: Column, question_id: Column, answer: Column, citations: Column) -> Column:
    """``CLAIMS`` of an answer. Markers out of range are dropped, so a claim may be left uncited; sentences of nothing but
    markers are no claims; the index in the id counts the claims that remain."""
    ids = F.transform(citations, lambda c: c.id)
    cited = lambda s: F.array_distinct(F.transform(F.filter(tx.marker_numbers(s), lambda n: (n >= 1) & (n <= F.size(ids))), lambda n: F.element_at(ids, n)))
    raw = F.transform(tx.sentences(F.coalesce(answer, F.lit(""))), lambda s: F.struct(tx.strip_markers(s).alias("text"), cited(s).alias("citation_ids")))
    kept = F.filter(raw, lambda c: c["text"] != "")
    return F.transform(kept, lambda c, i: F.struct(tx.claim_id(engine, question_id, i, c["text"]).alias("id"), question_id.alias("question_id"), c["text"].alias("text"), c.citation_ids.alias("citation_ids")))


def build_records(answers: DataFrame) -> DataFrame:
    """``answers`` with ``citations`` under stable ids and ``claims`` decomposed anew from ``answer_text``."""
    stable = answers.withColumn("citations", stable_citations(F.col("citations")))
    return stable.withColumn("claims", decompose(F.col("engine"), F.col("question_id"), F.col("answer_text"), F.col("citations")))


def snippets_for(citation_ids: Column, citations: Column) -> Column:
    """The claim's snippets in the order of its ids; unresolved ids are skipped, of equal ids the first citation counts."""
    find = lambda i: F.filter(citations, lambda c: c.id == i)
    found = F.filter(F.transform(F.coalesce(citation_ids, F.array().cast("array<string>")), find), lambda hit: F.size(hit) > 0)
    return F.transform(found, lambda hit: F.coalesce(hit[0].snippet, F.lit("")))


def claim_rows(answers: DataFrame) -> DataFrame:
    """``(ord, question_id, engine, claim_index, claim_id, text, citation_ids, snippets)``, one row per claim."""
    each = answers.select("ord", "question_id", "engine", "citations", F.posexplode("claims").alias("claim_index", "c"))
    none = F.expr(f"cast(array() as {CITATIONS})")
    return each.select("ord", "question_id", "engine", "claim_index", F.col("c.id").alias("claim_id"), F.coalesce("c.text", F.lit("")).alias("text"),
        F.coalesce("c.citation_ids", F.array().cast("array<string>")).alias("citation_ids"), snippets_for(F.col("c.citation_ids"), F.coalesce("citations", none)).alias("snippets"))
