"""Samples that match target category proportions.

Quotas come from the counts of categories alone (largest remainder, minimum floors, availability caps); members are the
rows with the smallest random keys of their category. The quota-th smallest key is found through a histogram of key
prefixes, so no category, however large, is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.plans.staging import stage

#: Key prefixes per category: the one in which the quota falls holds about 1 / BINS of the category.
BINS = 4096


def engine_key(engine: Column) -> Column:
    """Spellings that differ in case, outer blanks or ``_`` for ``-`` are one engine."""
    return F.translate(F.lower(F.regexp_replace(engine, r"(?U)^\s+|\s+$", "")), "_", "-")


def categorised(samples: DataFrame) -> DataFrame:
    """``(claim_id, engine_key, failure_mode)``: each claim once, rows exported again dropped; modes or engine may be null."""
    mode = F.when(F.size("failure_modes") > 0, F.col("failure_modes")[0])
    rows = samples.where("claim_id is not null").select("claim_id", F.struct(engine_key(F.col("engine")).alias("engine_key"), mode.alias("failure_mode")).alias("c"))
    return rows.groupBy("claim_id").agg(F.min("c").alias("c")).select("claim_id", "c.engine_key", "c.failure_mode")


def quotas(claims: DataFrame, targets: DataFrame, size: Column) -> DataFrame:
    """One row per target with ``available``, ``wanted``, ``quota`` and the sample size ``s``.

    ``wanted`` = permille * s / 1000. Integer quotas: each target gets its floor of ``wanted``, at least ``min_rows``, at
    most ``available``; rows still missing from the size go to the largest remainders with rows to spare, those in excess
    (through minima) are taken from the smallest remainders above their minimum. What stays unplaced after every target with spare rows gave one more is reported by
    the sum of quotas against ``s``. Null permille or min_rows count as zero. Targets are few; they and the counts are small.
    """
    counts = claims.groupBy("engine_key", "failure_mode").agg(F.count("*").alias("available"))
    total = claims.agg(size.cast("long").alias("s"))
    t = targets.select("engine", "failure_mode", F.coalesce("target_permille", F.lit(0)).alias("target_permille"), F.coalesce("min_rows", F.lit(0)).alias("min_rows")).distinct()
    t = t.withColumn("engine_key", engine_key(F.col("engine")))
    facts = t.join(counts, ["engine_key", "failure_mode"], "left").fillna({"available": 0}).crossJoin(F.broadcast(total))
    wanted = F.col("target_permille") * F.col("s")  # in thousandths
    facts = facts.withColumn("base", F.least("available", F.greatest("min_rows", F.floor(wanted / 1000)))).withColumn("remainder", F.pmod(wanted, F.lit(1000)))
    # spread the difference over the targets, largest remainders first: at most as much as each can still give or take
    everyone = Window.partitionBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    facts = facts.withColumn("asked", F.floor((F.sum(wanted).over(everyone) + 999) / 1000)).withColumn("left", F.least("asked", "s") - F.sum("base").over(everyone))
    facts = facts.withColumn("room", F.when(F.col("left") > 0, F.col("available") - F.col("base")).otherwise(F.greatest(F.lit(0), F.col("base") - F.least("available", "min_rows"))))
    first = F.when(F.col("left") > 0, -F.col("remainder")).otherwise(F.col("remainder"))
    rounds = facts.withColumn("first", first)
    # one unit each in order of remainder, then the rest to whoever has room, in the same order
    turn = Window.partitionBy(F.lit(0)).orderBy("first", "engine", "failure_mode")
    one = F.when(F.col("room") > 0, 1).otherwise(0)
    rounds = rounds.withColumn("unit", F.when(F.sum(one).over(turn) <= F.abs("left"), one).otherwise(0))
    rounds = rounds.withColumn("more", F.abs("left") - F.sum("unit").over(everyone)).withColumn("spare", F.col("room") - F.col("unit"))
    before = F.sum("spare").over(turn) - F.col("spare")
    rounds = rounds.withColumn("extra", F.greatest(F.lit(0), F.least("spare", F.col("more") - before)))
    change = F.col("unit") + F.col("extra")
    quota = F.when(F.col("left") > 0, F.col("base") + change).otherwise(F.col("base") - change)
    return rounds.select("engine", "failure_mode", "engine_key", "target_permille", "min_rows", "s", "available", (wanted / 1000).alias("wanted"), quota.cast("long").alias("quota"))


def smallest_keys(rows: DataFrame, key: str, category: list[str], quota: DataFrame, seed: int = 0, bins: int = BINS) -> DataFrame:
    """The ``quota`` rows of each category with the smallest random keys; ``quota``: one row per category.

    The random key is a hash of ``key`` and ``seed``, ties go by ``key``. Whole bins below the one in which the quota
    falls are taken as they are; only that bin is ranked.
    """
    h = F.conv(F.left(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string"))), F.lit(10)), 16, 10).cast("long")  # 40 bits
    keyed = rows.select(key, *category, h.alias("__h"), F.floor(h / ((1 << 40) // bins)).cast("int").alias("__bin"))
    counts = keyed.groupBy(*category, "__bin").agg(F.count("*").alias("__n"))
    cum = Window.partitionBy(*category).orderBy("__bin")  # at most ``bins`` rows a category
    cut = counts.withColumn("__upto", F.sum("__n").over(cum)).join(F.broadcast(quota.select(*category, F.col("quota").alias("__q"))), category)
    cut = cut.select(*category, "__bin", (F.col("__q") - F.col("__upto") + F.col("__n")).alias("__need"), "__n").where("__need > 0")
    near = keyed.join(cut, [*category, "__bin"])
    whole = near.where("__need >= __n")
    ranked = near.where("__need < __n").withColumn("__r", F.row_number().over(Window.partitionBy(*category, "__bin").orderBy("__h", key))).where("__r <= __need").drop("__r")
    return whole.unionByName(ranked).select(key, *category)


def proportional_sample(samples: DataFrame, targets: DataFrame, share: int = 5, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(sample, report), both staged. ``sample``: ``(claim_id, engine_key, failure_mode)``; ``report``: see :func:`quotas`,
    with ``drawn``, the rows of the sample, and ``short`` where all that is there would not do.

    The size is a ``share``-th of the distinct claims, rounded down; claims of null engine or no mode count in it but are
    in no category. Null claim ids are left out. Empty tables give an empty sample.
    """
    category = ["engine_key", "failure_mode"]
    claims = stage(categorised(samples), "claims")
    asked = stage(quotas(claims, targets, F.floor(F.count("*") / share)), "quotas")
    wanted = asked.groupBy(*category).agg(F.max("quota").alias("quota"))
    sample = stage(smallest_keys(claims.where("engine_key is not null and failure_mode is not null"), "claim_id", category, wanted, seed), "sample")
    drawn = sample.groupBy(*category).agg(F.count("*").alias("drawn"))
    report = asked.join(drawn, category, "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    # what the category still has beside the rows drawn could not make up for what they lack
    lacks = F.greatest(F.col("min_rows"), F.ceil("wanted")) - F.col("drawn")
    return sample, stage(report.withColumn("short", lacks > F.col("available") - F.col("drawn")), "report")
