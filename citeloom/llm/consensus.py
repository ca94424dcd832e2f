"""Consensus from several annotators' labels: confidence-aware truth discovery.

An annotator's error has the upper bound ``u = errors / chi2(alpha / 2, n)`` over the ``n`` items judged, by the
chi-squared distribution of an error variance. Truths minimise the weighted distance to the labels, weights follow from
the truths, in turn. Long-tail annotators, with few labels, get large bounds, hence cautious weights. The weight is the
log-odds of the bound, not its inverse: labels are categories, and an inverse lets one annotator with no error found
outvote any number of good ones, so that every truth becomes that annotator's.
"""

from __future__ import annotations

import math
import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.plans.staging import broadcast_if_small, stage

# The valid verdicts, in their order; ties go to the earlier.
VERDICTS = ["supported", "partial", "unsupported", "contradicted", "uncited"]


def _clean(c: str) -> Column:
    return F.lower(F.regexp_replace(F.col(c), r"(?U)^\s+|\s+$", ""))


def _normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function, by bisection on erf."""
    lo, hi = -10.0, 10.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 0.5 * (1 + math.erf(mid / math.sqrt(2))) < p else (lo, mid)
    return (lo + hi) / 2


def chi_squared_quantile(n: Column, p: float) -> Column:
    """Quantile ``p`` of the chi-squared distribution with ``n`` degrees of freedom (Wilson and Hilferty's form)."""
    z = _normal_quantile(p)
    a = F.lit(2.0) / (9.0 * n)
    return n * F.pow(F.greatest(1 - a + z * F.sqrt(a), F.lit(1e-3)), 3)


def weight_of(n: Column, errors: Column, alpha: float, kinds: int) -> Column:
    """Log-odds of the upper bound of an annotator's error against a guess among ``kinds``; never below a thousandth."""
    bound = F.least(F.greatest(errors, F.lit(0.5)) / chi_squared_quantile(n, alpha / 2), F.lit(0.999))
    return F.greatest(F.log((1 - bound) * (kinds - 1) / bound), F.lit(1e-3))


def latest_votes(labels: DataFrame, valid: list[str] = VERDICTS) -> DataFrame:
    """``(claim_id, labeler, verdict)``: of a labeler's valid labels on a claim the one with the highest ``ord``.

    Null claims, labelers and verdicts, and verdicts outside ``valid``, are left out; spellings are trimmed and lowered.
    """
    rows = labels.select("claim_id", _clean("labeler").alias("labeler"), _clean("verdict").alias("verdict"), "ord").where(F.col("verdict").isin(valid) & F.col("claim_id").isNotNull() & (F.col("labeler") != ""))
    return rows.groupBy("claim_id", "labeler").agg(F.max_by("verdict", F.struct("ord", "verdict")).alias("verdict"))


#: Claims with up to so many votes keep them in one array; larger ones, however large, stay rows.
ARRAY_VOTES = 512


def _split_votes(labels: DataFrame, valid: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(names, small, large), staged. ``names(l, labeler)`` numbers the labelers from 0; ``small(claim_id, n, v)`` has a
    claim's votes ``v`` as ``array<struct<l,r>>``; ``large(claim_id, n, l, r)`` has a row per vote. ``r`` is the rank."""
    order = F.create_map(*[x for i, v in enumerate(valid) for x in (F.lit(v), F.lit(i))])
    votes = stage(latest_votes(labels, valid).select("claim_id", "labeler", order[F.col("verdict")].alias("r")), "votes")
    # labelers are numbered in one task: eight bytes of weight each must fit a broadcast anyway
    numbered = votes.groupBy("labeler").count().select("labeler", (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("labeler")) - 1).alias("l"))
    names = stage(numbered, "labelers")
    coded = votes.join(broadcast_if_small(names, 64), "labeler").select("claim_id", "l", "r")
    sizes = votes.groupBy("claim_id").agg(F.count("*").alias("n"))
    sized = stage(coded.join(sizes, "claim_id"), "votes")
    small = sized.where(F.col("n") <= ARRAY_VOTES).groupBy("claim_id", "n").agg(F.collect_list(F.struct("l", "r")).alias("v"))
    return names, stage(small, "small"), sized.where(F.col("n") > ARRAY_VOTES)


def _decided(sums: Column) -> Column:
    """``struct<truth, votes_for, confidence, same>`` of ``array<struct<r, w, k>>``: weight and number of votes by verdict."""
    best = F.array_max(F.transform(sums, lambda x: F.struct(F.round(x.w, 9).alias("w"), (-x.r).alias("first"), x.k.alias("k"), x.w.alias("won"))))
    total = F.aggregate(sums, F.lit(0.0), lambda a, x: a + x.w)
    same = F.aggregate(sums, F.lit(0).cast("long"), lambda a, x: a + x.k * (x.k - 1))
    return F.element_at(F.transform(F.array(best), lambda b: F.struct((-b["first"]).alias("truth"), b.k.alias("votes_for"), (b.won / total).alias("confidence"), same.alias("same"))), 1)


def _truths(small: DataFrame, large: DataFrame, weights: DataFrame, kinds: int) -> tuple[DataFrame, DataFrame]:
    """The claims of either kind with ``t`` (see :func:`_decided`). ``weights``: one row, the array ``w`` by labeler.

    Small claims are decided where they lie; only the large are summed up by a shuffle, one row per claim and verdict.
    """
    near = small.crossJoin(F.broadcast(weights))  # one row
    by_rank = F.transform(F.sequence(F.lit(0), F.lit(kinds - 1)), lambda r: F.element_at(F.transform(F.array(F.filter("v", lambda x: x.r == r)), lambda mine: F.struct(r.alias("r"), F.aggregate(mine, F.lit(0.0), lambda a, x: a + F.get("w", x.l)).alias("w"), F.size(mine).cast("long").alias("k"))), 1))
    near = near.select("claim_id", "n", "v", _decided(F.filter(by_rank, lambda x: x.k > 0)).alias("t"))
    sums = large.crossJoin(F.broadcast(weights)).groupBy("claim_id", "n", "r").agg(F.sum(F.get("w", F.col("l"))).alias("w"), F.count("*").alias("k"))
    far = sums.groupBy("claim_id", "n").agg(_decided(F.collect_list(F.struct("r", "w", "k"))).alias("t"))  # a few verdicts a claim
    return near, far


def truth_discovery(labels: DataFrame, min_labelers: int = 3, alpha: float = 0.05, max_steps: int = 100, valid: list[str] = VERDICTS) -> tuple[DataFrame, DataFrame]:
    """(consensus, reliability).

    ``consensus``: ``(claim_id, verdict, n_labelers, votes_for, agreement, confidence)`` for every claim with a valid
    vote; ``agreement`` is the share of pairs of votes that agree (null for one vote), ``confidence`` the winner's share
    of the weights. ``reliability``: ``(labeler, n, errors, weight, accuracy)``, over claims with at least
    ``min_labelers`` votes, where others' votes bear on the truth. Ties go to the earlier verdict of ``valid``. Empty
    input gives empty results. Votes are gathered by claim once; a step then reads them in place with the weights of all
    labelers as one broadcast array (eight bytes each) and shuffles only counts per labeler. Truths that still change
    after ``max_steps`` are reported by a warning.
    """
    names, small, large = _split_votes(labels, valid)
    newcomer = weight_of(F.lit(1.0), F.lit(0.0), alpha, len(valid))
    ones = lambda df, w: df.agg(F.transform(F.array_sort(F.collect_list(F.struct("l", w.alias("w")))), lambda x: x.w).alias("w"))
    judged, judged_large = small.where(F.col("n") >= min_labelers), large.where(F.col("n") >= min_labelers)
    known, before, settled = None, None, False
    for _ in range(max_steps):
        now = ones(names if known is None else known, F.lit(1.0) if known is None else F.col("w"))
        near, far = _truths(judged, judged_large, now, len(valid))
        each = near.select("t.truth", F.explode("v").alias("x")).select("x.l", (F.col("x.r") != F.col("truth")).cast("long").alias("wrong"))
        each = each.unionByName(judged_large.join(far, "claim_id").select("l", (F.col("r") != F.col("t.truth")).cast("long").alias("wrong")))
        counted = each.groupBy("l").agg(F.count("*").alias("n"), F.sum("wrong").alias("errors"))
        met = counted.withColumn("w", weight_of(F.col("n").cast("double"), F.col("errors").cast("double"), alpha, len(valid)))
        # labelers seen only on claims with few votes get the weight of a newcomer: one label, half an error
        known = stage(names.join(met, "l", "left").select("l", "labeler", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("errors", F.lit(0)).alias("errors"), F.coalesce("w", newcomer).alias("w")), "weights")
        mark = known.agg(F.coalesce(F.sum(F.xxhash64("l", "errors").cast("decimal(30,0)")), F.lit(0))).first()
        settled = mark == before
        if settled:
            break
        before = mark
    if not settled:
        warnings.warn(f"truths still change after {max_steps} steps", stacklevel=2)
    near, far = _truths(small, large, ones(known, F.col("w")), len(valid))
    rows = near.select("claim_id", "n", "t").unionByName(far)
    verdicts, n = F.array(*map(F.lit, valid)), F.col("n")
    consensus = rows.select("claim_id", verdicts[F.col("t.truth")].alias("verdict"), n.alias("n_labelers"), "t.votes_for", F.when(n > 1, F.col("t.same") / (n * (n - 1))).alias("agreement"), "t.confidence")
    reliability = known.select("labeler", "n", "errors", F.col("w").alias("weight"), F.when(F.col("n") > 0, 1 - F.col("errors") / F.col("n")).alias("accuracy"))
    return consensus, reliability


def nominal_alpha(labels: DataFrame, valid: list[str] = VERDICTS) -> DataFrame:
    """One row ``(claims, votes, alpha)``: Krippendorff's alpha for nominal labels, null where it is undefined."""
    counts = latest_votes(labels, valid).groupBy("claim_id", "verdict").count()
    units = counts.groupBy("claim_id").agg(F.sum("count").alias("m"), F.sum(F.col("count") * (F.col("count") - 1)).alias("same")).where("m > 1")
    observed = units.agg(F.count("*").alias("claims"), F.sum("m").alias("votes"), F.sum((F.col("m") * (F.col("m") - 1) - F.col("same")) / (F.col("m") - 1)).alias("apart"))
    totals = counts.join(units.select("claim_id"), "claim_id", "left_semi").groupBy("verdict").agg(F.sum("count").alias("k"))
    expected = totals.agg(F.sum("k").alias("nn"), F.sum(F.col("k") * F.col("k")).alias("sq"))
    n = F.col("nn")
    return observed.crossJoin(expected).select("claims", F.coalesce("votes", F.lit(0)).alias("votes"),
        F.when((n > 1) & (n * n > F.col("sq")), 1 - (n - 1) * F.col("apart") / (n * n - F.col("sq"))).cast(T.DoubleType()).alias("alpha"))
