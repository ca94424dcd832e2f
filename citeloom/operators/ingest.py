"""From captured pages to a corpus: clean, reject thin pages, drop near-duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as tx
from citeloom.plans.staging import stage

# Lines that start so are page furniture.
BOILERPLATE = ["jump to content", "main menu", "main page", "navigation", "see also", "references", "external links", "further reading", "retrieved from", "categories:", "category:", "edit", "contents", "current events", "random article", "from wikipedia", "this article"]
# A line that is one of these ends the prose.
FOOTERS = ["see also", "references", "external links", "further reading", "bibliography", "notes", "citations", "sources", "footnotes", "gallery"]
MIN_LINE, MIN_WORDS = 25, 60
LINES = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def clean_text(raw: Column) -> Column:
    """Prose of a captured page on one line: footer cut, editorial markers out, short and furniture lines dropped."""
    lines = F.split(raw, LINES)
    heading = F.transform(lines, lambda x: F.lower(F.regexp_replace(tx.strip(x), ":+$", "")))
    footer = F.transform(heading, lambda x: x.isin(FOOTERS))
    at = F.array_position(footer, True)
    body = F.when(at > 0, F.slice(lines, F.lit(1), (at - 1).cast("int"))).otherwise(lines)
    marked = F.transform(body, lambda x: tx.strip(F.regexp_replace(x, r"(?i)\[\s*(?:\d+|citation needed|clarification needed|sic)\s*\]", "")))
    furniture = "^(?:" + "|".join(BOILERPLATE) + ")"
    kept = F.filter(marked, lambda x: (F.length(x) >= MIN_LINE) & ~F.lower(x).rlike(furniture))
    return tx.strip(F.regexp_replace(F.array_join(kept, " "), r"(?U)\s+", " "))


def cleaned_pages(pages: DataFrame, order: str, url: str, title: str, raw: str) -> DataFrame:
    """``(ord, url, title, text, n_words, thin)``. Null raw text is an empty page, hence thin; null titles become empty."""
    t = clean_text(F.coalesce(F.col(raw), F.lit("")))
    rows = pages.select(F.col(order).alias("ord"), F.col(url).alias("url"), F.coalesce(F.col(title), F.lit("")).alias("title"), t.alias("text"))
    n = F.size(tx.words(F.col("text")))
    return rows.withColumn("n_words", n).withColumn("thin", n < MIN_WORDS)


#: Words of a sketch, 64 slots each. More slots tell larger sets apart; any number is exact.
SKETCH_WORDS = 4


def _sketch(tokens: Column) -> tuple[list[Column], Column]:
    """(words over a column ``bits``, that column): the parity of the number of tokens per hash slot, as bits. Two sets
    differ in no fewer members than their sketches in bits."""
    slot = lambda t: F.pmod(F.xxhash64(t), F.lit(64 * SKETCH_WORDS))
    bits = F.transform(tokens, lambda t: F.struct(F.floor(slot(t) / 64).cast("int").alias("word"), F.element_at(F.lit([1 << i if i < 63 else -(1 << 63) for i in range(64)]), (slot(t) % 64 + 1).cast("int")).alias("bit")))

    def word(w: int) -> Column:
        return F.aggregate(F.filter("bits", lambda x: x.word == w), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x.bit)).alias(f"k{w}")

    return [word(w) for w in range(SKETCH_WORDS)], bits


def near_token_pairs(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(a, b)``, ``a < b``: classes of documents whose token sets have a Jaccard similarity of at least ``threshold``.

    ``docs``: ``(cls, tokens)``, distinct token sets. Prefix-filtered set join: tokens in order of rarity, of a set of n
    the first n - ceil(t * n) + 1 are its prefix, sizes must be within t, positions must leave enough tokens to share, and
    sketches must not differ in more bits than near sets in members; all that is tested within the join, before anything
    is shuffled. Candidates are verified on the sets. Empty sets match nothing. Rarity joins tokens by a shuffle; no side
    is broadcast.
    """
    docs = docs.where(F.size("tokens") > 0)
    exploded = docs.select("cls", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
    df = exploded.groupBy("token").agg(F.count("*").alias("df"))
    ordered = exploded.join(df, "token").groupBy("cls", "n").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("o"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    words, bits = _sketch(F.col("o.token"))
    sketched = ordered.withColumn("bits", bits).select("cls", "n", F.slice("o.token", F.lit(1), keep.cast("int")).alias("p"), *words)
    names = [f"k{w}" for w in range(SKETCH_WORDS)]
    prefix = stage(sketched.select("cls", "n", *names, F.posexplode("p").alias("pos", "token")), "prefix")
    side = lambda v: prefix.select("token", *[F.col(c).alias(c + v) for c in ("cls", "n", "pos", *names)])
    x, y = side("x"), side("y")
    both_n = F.col("nx") + F.col("ny")
    need = F.ceil(threshold / (1 + threshold) * both_n - 1e-9)
    differ = reduce(Column.__add__, [F.bit_count(F.col(f"{k}x").bitwiseXOR(F.col(f"{k}y"))) for k in names])
    met = x.join(y.hint("shuffle_merge"), "token").where("clsx < clsy").where((F.least("nx", "ny") >= threshold * F.greatest("nx", "ny") - 1e-9) & (F.least(F.col("nx") - F.col("posx"), F.col("ny") - F.col("posy")) >= need - F.least("posx", "posy")) & (differ <= both_n - 2 * need))
    pairs = met.select(F.col("clsx").alias("a"), F.col("clsy").alias("b")).distinct()
    sets = pairs.join(docs.select(F.col("cls").alias("a"), F.col("tokens").alias("ta")), "a").join(docs.select(F.col("cls").alias("b"), F.col("tokens").alias("tb")), "b")
    both = F.size(F.array_intersect("ta", "tb"))
    return sets.where(both >= threshold * (F.size("ta") + F.size("tb") - both) - 1e-9).select("a", "b")


def near_members(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``(ord, cls, n_links)``: every row of ``docs`` (``ord``, ``text``) with its class and the other rows it is near to.

    Rows of equal token sets, which need not be equal texts, are one class named by its least ``ord``; they are near each
    other and to all rows of the near classes, so classes and pairs of classes hold every link between rows. Rows without
    content tokens are classes of their own without links. Links are summed over classes; pairs of rows are never listed.
    """
    sets = docs.select("ord", F.array_sort(tx.token_set(F.coalesce("text", F.lit("")))).alias("tokens"))
    keyed = stage(sets.select("ord", "tokens", F.when(F.size("tokens") > 0, F.sha2(F.array_join("tokens", " "), 256)).alias("h")), "keyed")
    classes = stage(keyed.where("h is not null").groupBy("h").agg(F.min("ord").alias("cls"), F.first("tokens").alias("tokens"), F.count("*").alias("n_rows")), "classes")
    pairs = stage(near_token_pairs(classes.select("cls", "tokens"), threshold), "pairs")
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.join(classes.select(F.col("cls").alias("b"), "n_rows"), "b").groupBy(F.col("a").alias("cls")).agg(F.sum("n_rows").alias("near"))
    linked = classes.join(near, "cls", "left").select("h", "cls", (F.col("n_rows") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"))
    return keyed.join(linked, "h", "left").select("ord", F.coalesce("cls", "ord").alias("cls"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def first_kept(order: DataFrame, pairs: DataFrame) -> DataFrame:
    """Greedy choice in order of ``cls``: a class is dropped if an earlier *kept* one is near. ``(cls, kept)``.

    The lexicographically first maximal independent set by rounds: undecided nodes without an undecided earlier
    neighbour are kept, their later neighbours dropped. Each round is a written table; only counts reach the driver.
    """
    state = stage(order.select("cls", F.lit(None).cast("boolean").alias("kept")), "state")
    edges = stage(pairs.select(F.col("a").alias("early"), F.col("b").alias("late")), "edges")
    while True:
        open_ = state.where("kept is null").select("cls")
        live = edges.join(open_.withColumnRenamed("cls", "early"), "early", "left_semi").join(open_.withColumnRenamed("cls", "late"), "late", "left_semi")
        keep = open_.join(live.select(F.col("late").alias("cls")), "cls", "left_anti").withColumn("now", F.lit(True))
        drop = live.join(keep.select(F.col("cls").alias("early")), "early", "left_semi").select(F.col("late").alias("cls")).distinct().withColumn("now", F.lit(False))
        state = stage(state.join(keep.unionByName(drop), "cls", "left").select("cls", F.coalesce("kept", "now").alias("kept")), "state")
        if state.where("kept is null").isEmpty():
            return state


def deduplicate(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """``docs`` (``ord``, ``text``, ...) with ``kept``: near-duplicates of an earlier kept document are not.

    Equal token sets are one class, of which the first is the representative, so copies never meet each other. Texts
    without content tokens are all kept. ``ord`` must be unique; null texts count as empty.
    """
    sets = stage(docs.select("ord", F.array_sort(tx.token_set(F.coalesce("text", F.lit("")))).alias("tokens")), "sets")
    keyed = sets.withColumn("h", F.sha2(F.array_join("tokens", " "), 256))
    classes = stage(keyed.where(F.size("tokens") > 0).groupBy("h").agg(F.min("ord").alias("cls"), F.first("tokens").alias("tokens")), "classes")
    chosen = first_kept(classes, near_token_pairs(classes.select("cls", "tokens"), threshold))
    verdict = keyed.join(classes.select("h", "cls"), "h", "left").join(chosen, "cls", "left").select("ord", F.when(F.size("tokens") == 0, True).otherwise(F.col("kept") & (F.col("ord") == F.col("cls"))).alias("kept"))
    return docs.join(verdict, "ord")


def ingest(pages: DataFrame, order: str, url: str, title: str, raw: str, threshold: float = 0.8) -> DataFrame:
    """Cleaned pages with ``drop_reason``: ``thin``, ``duplicate`` or null for those that make the corpus."""
    cleaned = stage(cleaned_pages(pages, order, url, title, raw), "cleaned")
    rich = deduplicate(cleaned.where("not thin"), threshold)
    return rich.select("ord", "url", "title", "text", "n_words", F.when(~F.col("kept"), "duplicate").alias("drop_reason")).unionByName(
        cleaned.where("thin").select("ord", "url", "title", "text", "n_words", F.lit("thin").alias("drop_reason")))
