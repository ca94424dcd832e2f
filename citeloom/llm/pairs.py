"""Pairs of rows within groups, without sending a hot group to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.plans.staging import broadcast_if_small, stage

#: Rows of a group per salt: a group of n rows is spread over ceil(n / SALT_ROWS) tasks.
SALT_ROWS = 2000


def pairs_within(rows: DataFrame, differing: bool, salt_rows: int = SALT_ROWS) -> DataFrame:
    """All pairs ``(a, b)``, ``a < b``, of ``id`` with equal ``grp``; if ``differing``, only of unequal ``variant``.

    ``rows``: a staged table ``(id, grp, variant)`` with unique ids. Groups that can give no pair are dropped before any
    join. The left side of a group is dealt out over salts, the right side repeated once per salt, so the work of a
    group of n rows is shared by about n / salt_rows tasks. The salts of groups are broadcast if their measured size allows
    it, so rows of a hot group need not meet before they are dealt out; else that join is left to the split of skewed
    partitions. Null groups give no pair; an empty input gives no row.
    """
    sizes = rows.groupBy("grp").agg(F.count("*").alias("n"), (F.min("variant") != F.max("variant")).alias("mixed"))
    sizes = sizes.where("grp is not null and n > 1" + (" and mixed" if differing else "")).select("grp", F.ceil(F.col("n") / salt_rows).cast("int").alias("salts"))
    live = rows.join(broadcast_if_small(stage(sizes, "sizes"), F.length(F.col("grp").cast("string")) + 32), "grp")
    left = live.select("grp", F.col("id").alias("a"), F.col("variant").alias("va"), F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    right = live.select("grp", F.col("id").alias("b"), F.col("variant").alias("vb"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    met = left.join(right.hint("shuffle_merge"), ["grp", "salt"]).where("a < b" + (" and va != vb" if differing else ""))
    return met.select("a", "b")
