"""Mixing sources to target weights by entropy balancing.

Sizes are tokens of a public tokenizer. From a base rate of one copy each, document rates are exponentially tilted by
size, ``rate = min(cap, exp(lambda * size))`` with one multiplier per source: of all rates under the cap that reach the
source's tokens, those of the least relative entropy to the base. Newton steps on the convex dual solve the token
constraints over all documents, aggregated in the cluster (a step sees one row per source). Rates are rounded to copies
along running totals, so that the shares are met to about a document.
"""

from __future__ import annotations

import base64
import math
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.plans.ranking import places
from citeloom.plans.staging import spread, stage

#: Vocabulary file of a public byte-level BPE, as ranks.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to that vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=4)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Tokens of a text column under a public vocabulary file; null has none."""

    @F.pandas_udf(T.LongType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(vocabulary).encode_ordinary
        for texts in batches:
            yield texts.map(lambda t: len(encode(t)) if t else 0).astype("int64")

    return count(text)


def _key(source: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(source, r"^[\s ]+|[\s ]+$", "")))


def sized_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc, src, tokens)``, staged: the tokenizer runs once over all documents."""
    rows = spread(documents.select(key, text, source)).select(F.col(key).alias("doc"), _key(F.col(source)).alias("src"), token_count(F.col(text), vocabulary).alias("tokens"))
    return stage(rows, "sized")


def source_facts(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: its documents and tokens, the tokens of all documents, its share asked and its cap."""
    total = sized.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total"))
    have = sized.groupBy("src").agg(F.sum("tokens").alias("have"), F.count("*").alias("docs"))
    asked = targets.where("source is not null").select("source", _key(F.col("source")).alias("src"), "target_permille", "max_repeats").distinct()
    rows = asked.join(have, "src", "left").crossJoin(F.broadcast(total))  # one row
    return rows.select("source", "src", "target_permille", "max_repeats", F.coalesce("have", F.lit(0)).alias("tokens"), F.coalesce("docs", F.lit(0)).alias("docs"), "total")


def _rate(multiplier: str = "multiplier") -> Column:
    """Tilted rate of a size under its cap; ``multiplier`` is per mean size, null (a goal of no tokens) is never drawn."""
    z = F.col(multiplier) * F.col("tokens") / F.col("mean")
    return F.coalesce(F.least(F.col("max_repeats").cast("double"), F.exp(F.least(z, F.lit(50.0)))), F.lit(0.0))


def multipliers(hist: DataFrame, steps: int = 60) -> dict[str, tuple[float | None, float]]:
    """``{src: (multiplier, mean size)}`` whose rates reach the goals: Newton steps on the dual, kept between known bounds.

    ``hist``: ``(src, max_repeats, goal, tokens, count)``. The tokens drawn grow with the multiplier, so every step bounds
    it from one side; a step that would leave the bounds halves them instead, as one does where every rate stands at its
    cap and the slope is zero. A source that is not there with all its rates at the cap is out of reach: its multiplier is
    infinite. Sources that have not settled after ``steps`` are reported by a warning.
    """
    facts = [(F.sum(F.col("count") * F.col("tokens")) / F.sum("count")).alias("mean"), F.sum(F.col("count") * F.col("tokens")).alias("have"), F.max("max_repeats").alias("cap"), F.min("tokens").alias("least")]
    sources = hist.groupBy("src", "goal").agg(*facts).collect()  # one row per target
    found = {r.src: (math.log(r.goal / r.have) if r.goal > 0 else None, r.mean) for r in sources}
    full = {r.src: (math.log(r.cap) * r.mean / r.least if r.cap > 0 else -math.inf) for r in sources}  # from here on every rate is at its cap
    goals, bounds = {r.src: r.goal for r in sources if r.goal > 0}, {r.src: (-math.inf, math.inf) for r in sources}
    for r in sources:
        if r.src in goals and found[r.src][0] > full[r.src]:
            found[r.src] = (full[r.src], r.mean)
    for _ in range(steps if goals else 0):
        params = hist.sparkSession.createDataFrame([(s, *found[s]) for s in goals], "src string, multiplier double, mean double")
        tilted = hist.join(F.broadcast(params), "src").withColumn("r", _rate()).withColumn("free", (F.exp(F.col("multiplier") * F.col("tokens") / F.col("mean")) <= F.col("max_repeats")).cast("double"))
        drawn = F.col("count") * F.col("r") * F.col("tokens")
        moments = tilted.groupBy("src").agg(F.sum(drawn).alias("drawn"), F.sum(drawn * F.col("free") * F.col("tokens") / F.col("mean")).alias("slope")).collect()  # one row per target
        for r in moments:
            at, mean = found[r.src]
            gap = goals[r.src] - r.drawn
            if abs(gap) <= 1e-9 * goals[r.src]:
                del goals[r.src]
                continue
            if gap > 0 and at >= full[r.src]:
                found[r.src] = (math.inf, mean)
                del goals[r.src]
                continue
            lo, hi = bounds[r.src] = (at, bounds[r.src][1]) if gap > 0 else (bounds[r.src][0], at)
            furthest = max(2.0, abs(at))
            to = at + max(-furthest, min(furthest, gap / r.slope if r.slope > 0 else math.copysign(furthest, gap)))
            if not lo < to < hi:
                to = (lo + hi) / 2
            found[r.src] = (min(to, full[r.src]), mean)
        if not goals:
            break
    if goals:
        warnings.warn(f"mixture not settled after {steps} steps: {sorted(goals)}", stacklevel=2)
    return found


def _copies(rated: DataFrame) -> DataFrame:
    """``rated(doc, src, tokens, r)``, staged, with its rates rounded to ``copies``.

    Systematic rounding: along a source's documents, by size and then by hash, the running total of the rates' fractions
    gives a copy whenever it passes a whole number. So a source misses its tokens by about one document, not by chance.
    Totals come from counts per size; only a document's place among those of its size is ranked, in blocks of hashes.
    """
    frac = F.col("r") - F.floor("r")
    along = Window.partitionBy("src").orderBy("tokens")  # a row per size
    sizes = rated.groupBy("src", "tokens").agg(F.count("*").alias("n"), F.max(frac).alias("f"))
    upto = lambda c: F.sum(c).over(along) - c
    starts = sizes.select("src", "tokens", "f", upto(F.col("n")).alias("before"), upto(F.col("n") * F.col("f")).alias("base"))
    placed = places(rated.withColumn("h", F.pmod(F.xxhash64("doc"), F.lit(1 << 20))), ["src"], {"t": F.col("tokens")}, "h", ["doc"], "place")
    at = placed.join(starts, ["src", "tokens"]).withColumn("j", F.col("place") - F.col("before"))
    mark = lambda j: F.floor(F.col("base") + j * F.col("f") + 0.5)
    return at.select("doc", "src", "tokens", (F.floor("r") + mark(F.col("j")) - mark(F.col("j") - 1)).cast("long").alias("copies")).where("copies > 0")


def entropy_balanced(documents: DataFrame, targets: DataFrame, steps: int = 60, vocabulary: str = VOCABULARY, sized: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies, report). ``copies``: ``(doc, src, tokens, copies)``, one row per document chosen at least once.

    ``report``: one row per target with the share asked, the share reached and whether the target is out of reach, which
    shows in the mixture itself: every row is repeated to its cap and the tokens drawn are still too few. The size of the
    mixture is the size of all documents. One constraint per source, its tokens, fixes its multiplier: longer documents
    are drawn more often where a source must grow and less often where it must shrink. Documents of null or unlisted
    sources, and those without tokens, count in the total and are never drawn. Empty tables give empty results.
    """
    sized = sized if sized is not None else sized_documents(documents, vocabulary=vocabulary)
    facts = stage(source_facts(sized, targets), "facts")
    caps = facts.groupBy("src").agg(F.max("max_repeats").alias("max_repeats"), F.max("target_permille").alias("target_permille"), F.max("total").alias("total"))
    # the sizes of a source, counted: Newton steps run over this histogram, which holds what they need of all documents
    known = sized.join(F.broadcast(caps), "src").where("tokens > 0")  # a row per target
    hist = stage(known.groupBy("src", "max_repeats", "target_permille", "total", "tokens").count(), "sizes")
    goal = (F.col("target_permille") / 1000 * F.col("total")).alias("goal")
    found = multipliers(hist.select("src", "max_repeats", goal, "tokens", "count"), steps)
    params = hist.sparkSession.createDataFrame([(s, *v) for s, v in found.items()], "src string, multiplier double, mean double")
    rated = stage(known.join(F.broadcast(params), "src").select("doc", "src", "tokens", _rate().alias("r")), "rated")
    copies = stage(_copies(rated), "copies")
    drawn = copies.groupBy("src").agg(F.sum(F.col("copies") * F.col("tokens")).alias("drawn"), F.max("copies").alias("most"))
    all_drawn = copies.agg(F.coalesce(F.sum(F.col("copies") * F.col("tokens")), F.lit(0)).alias("mixture"))
    rows = facts.join(drawn, "src", "left").crossJoin(F.broadcast(all_drawn)).withColumn("drawn", F.coalesce("drawn", F.lit(0)))  # one row
    at_cap = F.col("drawn") == F.col("max_repeats") * F.col("tokens")
    report = rows.select(
        "source", "target_permille", "max_repeats", "docs", "tokens", "drawn", F.coalesce("most", F.lit(0)).alias("most_copies"),
        F.round(F.when(F.col("total") > 0, 1000 * F.col("drawn") / F.col("total")), 3).alias("permille_of_goal"),
        F.round(F.when(F.col("mixture") > 0, 1000 * F.col("drawn") / F.col("mixture")), 3).alias("permille_of_mixture"),
        (at_cap & (1000 * F.col("drawn") < F.col("target_permille") * F.col("total"))).alias("short"))
    return copies, stage(report, "report")
