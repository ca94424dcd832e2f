"""Evaluation texts leaking into training text.

Prefix-filtered set join. Words are shingled by five; a passage of ``run`` words is a window of run - 4 shingles that
must all be there, so one of them, its rarest by corpus count, is its necessary prefix. Only these prefixes meet the
documents; positions and lengths bound the place, and the words themselves are compared in the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.lookalike import consistent_form
from citeloom.plans.staging import broadcast_if_small, stage

SHINGLE = 5


def words_of(form: Column) -> Column:
    """Unbroken runs of letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(form), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _shingles(words: Column) -> Column:
    n = F.size(words) - SHINGLE + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(words, i, F.lit(SHINGLE)))))


def leaked_items(documents: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", run: int = 10) -> DataFrame:
    """``(doc_key, item_key, runs)``: documents that share at least ``run`` consecutive words with an item.

    ``runs`` counts the item's windows found. Both texts are brought to their consistent form first. Null, blank and
    short texts match nothing; repeated rows count once; other columns are ignored, so their names cannot clash. Item
    shingles are broadcast only if their measured size allows it; else they are joined by a shuffle.
    """
    if run < SHINGLE:
        raise ValueError(f"run must be at least {SHINGLE}")
    per = run - SHINGLE + 1
    item_words = consistent_form(items.select(F.col(item_key).alias("item"), F.col(text).alias("t")).where("item is not null"), "t", "f").select("item", words_of(F.col("f")).alias("w")).distinct()
    item_words = stage(item_words.withColumn("h", _shingles(F.col("w"))).where("h is not null"), "items")
    vocabulary = stage(item_words.select(F.explode("h").alias("h")).distinct(), "vocabulary")
    docs = documents.select(F.col(doc_key).alias("doc"), F.col(text).alias("t")).where("doc is not null")
    worded = lambda rows: consistent_form(rows, "t", "f").select("doc", words_of(F.col("f")).alias("w"))
    met = worded(docs).where(F.size("w") >= run).select("doc", F.size("w").alias("n"), F.posexplode(_shingles(F.col("w"))).alias("pos", "h")).join(broadcast_if_small(vocabulary, 16), "h", "left_semi")
    met = stage(met.distinct(), "met")  # the documents' shingles that any item has: little is left of the corpus here
    counts = met.groupBy("h").agg(F.count("*").alias("df"))
    spots = item_words.select("item", F.posexplode("h").alias("at", "h")).join(counts, "h")  # a shingle nobody has drops here
    # a window of the item whose shingles are all in the corpus, and the rarest of them
    windows = spots.select("item", "df", "h", "at", F.explode(F.sequence(F.greatest(F.lit(0), F.col("at") - per + 1), F.col("at"))).alias("start"))
    prefixes = windows.groupBy("item", "start").agg(F.count("*").alias("there"), F.min(F.struct("df", "h", "at")).alias("rarest")).where(F.col("there") == per)
    prefixes = stage(prefixes.select("item", "start", F.col("rarest.h").alias("h"), (F.col("rarest.at") - F.col("start")).alias("offset")), "prefixes")
    places = met.join(broadcast_if_small(prefixes, 40), "h").withColumn("from", F.col("pos") - F.col("offset"))
    places = stage(places.where((F.col("from") >= 0) & (F.col("from") + run <= F.col("n"))).select("doc", "item", "start", "from"), "places")
    # exact check of the words in place
    passages = item_words.where(F.size("w") >= run).select("item", "w", F.explode(F.sequence(F.lit(0), F.size("w") - run)).alias("start")).select("item", "start", F.slice("w", F.col("start") + 1, F.lit(run)).alias("passage"))
    kept = places.select("doc").distinct()
    again = worded(docs.join(broadcast_if_small(kept, 16), "doc", "left_semi"))  # few documents have a place: only these are read out once more
    hits = again.join(places, "doc").select("doc", "item", "start", F.slice("w", F.col("from") + 1, F.lit(run)).alias("found")).join(passages, ["item", "start"]).where("found = passage")
    return hits.groupBy("doc", "item").agg(F.countDistinct("start").alias("runs")).select(F.col("doc").alias(doc_key), F.col("item").alias(item_key), "runs")
