"""Chunks of documents: fixed word windows, or whole sentences packed under a ceiling of words."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import text as tx


def _windows(words: Column, width: Column, overlap: Column) -> Column:
    """Windows of ``width`` words that advance by width - overlap and stop once the end is reached."""
    n, stride = F.size(words), width - overlap
    last = F.greatest(F.lit(0), F.ceil((n - width) / stride)).cast("int")
    return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(words, i * stride + 1, width), " ")))


def _packed(sents: Column, width: Column, overlap: Column) -> Column:
    """Greedy packing as one fold: on overflow the chunk is emitted and its tail carried into the next one."""
    count = lambda s: F.size(tx.words(s))
    item = "struct<s:string,n:int>"
    empty = f"cast(array() as array<{item}>)"
    lens = F.transform(sents, lambda s: F.struct(s.alias("s"), count(s).alias("n")))

    def carry(cur: Column, n: Column) -> Column:
        state = F.struct(F.expr(empty).alias("got"), F.lit(0).alias("w"), F.lit(False).alias("stop"))

        def step(acc: Column, prev: Column) -> Column:
            stop = acc.stop | ((F.size(acc.got) > 0) & (acc.w + prev.n > overlap)) | (acc.w + prev.n + n > width)
            return F.struct(F.when(stop, acc.got).otherwise(F.concat(F.array(prev), acc.got)).alias("got"), F.when(stop, acc.w).otherwise(acc.w + prev.n).alias("w"), stop.alias("stop"))

        return F.aggregate(F.reverse(cur), state, step, lambda acc: acc.got)

    total = lambda cur: F.aggregate(cur, F.lit(0), lambda a, x: a + x.n)
    text = lambda cur: F.array_join(F.transform(cur, lambda x: x.s), " ")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("out"), F.expr(empty).alias("cur"))

    def add(acc: Column, x: Column) -> Column:
        full = (F.size(acc.cur) > 0) & (total(acc.cur) + x.n > width)
        return F.struct(F.when(full, F.concat(acc.out, F.array(text(acc.cur)))).otherwise(acc.out).alias("out"), F.concat(F.when(full, carry(acc.cur, x.n)).otherwise(acc.cur), F.array(x)).alias("cur"))

    return F.aggregate(lens, start, add, lambda acc: F.when(F.size(acc.cur) > 0, F.concat(acc.out, F.array(text(acc.cur)))).otherwise(acc.out))


def chunk_texts(text: Column, width: Column, overlap: Column) -> Column:
    """Packed chunks; word windows where there are fewer than two sentences or one is wider than the ceiling."""
    words, sents = tx.words(text), tx.sentences(text)
    widest = F.array_max(F.transform(sents, lambda s: F.size(tx.words(s))))
    return F.when((F.size(sents) < 2) | (widest > width), _windows(words, width, overlap)).otherwise(_packed(sents, width, overlap))


def chunk_documents(docs: DataFrame, widths: list[int] | None = None, overlap: int = 20, windows_only: bool = False) -> DataFrame:
    """``(chunk_words, doc_index, chunk_index, url, title, text)`` for every width of the sweep, in one job.

    ``docs``: ``(doc_index, url, title, text)``. Blank and null texts give no chunk. Narrow: no shuffle.
    """
    widths = widths or [90]
    if any(w <= 0 for w in widths):
        raise ValueError("chunk width must be positive")
    if any(not 0 <= overlap < w for w in widths):
        raise ValueError("overlap must be in [0, width)")
    each = docs.where("text is not null").select("doc_index", "url", F.coalesce("title", F.lit("")).alias("title"), "text", F.explode(F.array(*map(F.lit, widths))).alias("chunk_words"))
    w, o = F.col("chunk_words"), F.lit(overlap)
    cut = _windows(tx.words(F.col("text")), w, o) if windows_only else chunk_texts(F.col("text"), w, o)
    return each.select("chunk_words", "doc_index", "url", "title", F.posexplode(cut).alias("chunk_index", "text"))
