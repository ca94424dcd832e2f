"""Splitting oversized items at natural boundaries.

Every place between two characters has a strength: paragraph end, line end, sentence end (as in :mod:`sentences`), blank,
nothing. A sparse table answers, in constant time, which place is the strongest in the window of permissible lengths;
ties go to the right. The next piece starts a stated overlap before the cut, at the strongest place around there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.llm.sentences import segment
from citeloom.plans.staging import spread

NOTHING, SPACE, SENTENCE, LINE, PARAGRAPH = range(5)
#: Characters whose pieces a worker holds before it hands them on.
HELD = 4_000_000


def strengths(text: str, units: list[tuple[int, int]]) -> np.ndarray:
    """Strength of a cut before character i, for i = 0 .. len(text)."""
    code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
    s = np.zeros(len(code) + 1, dtype=np.int8)
    blank = np.isin(code, [9, 32, 0xA0, 0x3000])
    s[1:][blank] = SPACE
    s[[b for _, b in units]] = SENTENCE
    broken = code == 10
    ends = np.array([b for _, b in units if b < len(code) and broken[b]], dtype=np.int64)
    s[ends] = LINE
    s[[b for b in ends if b + 1 < len(code) and broken[b + 1]]] = PARAGRAPH
    return s


class StrongestCut:
    """Range-maximum index over strengths: the place of the strongest cut in [lo, hi], the rightmost of equals."""

    def __init__(self, s: np.ndarray, widest: int) -> None:
        self.n = len(s)
        key = s.astype(np.int64) * self.n + np.arange(self.n)
        self.levels = [key]
        while 2 ** len(self.levels) <= min(widest, self.n):
            last, half = self.levels[-1], 2 ** (len(self.levels) - 1)
            self.levels.append(np.maximum(last[:-half], last[half:]))

    def __call__(self, lo: int, hi: int) -> int:
        k = (hi - lo + 1).bit_length() - 1
        level = self.levels[k]
        return int(max(level[lo], level[hi - 2**k + 1]) % self.n)


def split_text(text: str, units: list[tuple[int, int]], limit: int = 2000, overlap: int = 200) -> list[tuple[int, int, int]]:
    """Pieces (start, end, strength of the cut at the end) of at most ``limit`` characters that cover ``text``."""
    n = len(text)
    if n <= limit:
        return [(0, n, PARAGRAPH)] if n else []
    s = strengths(text, units)
    strongest = StrongestCut(s, limit + 1)
    pieces, start = [], 0
    while n - start > limit:
        end = strongest(start + limit // 2, start + limit)
        if s[end] < SENTENCE:  # rather a shorter piece than a cut inside a unit; far enough for the next start to advance
            early = strongest(min(start + overlap * 3 // 2 + 1, start + limit // 2), start + limit // 2)
            end = early if s[early] >= SENTENCE else end
        pieces.append((start, end, int(s[end])))
        start = strongest(end - overlap - overlap // 2, end - overlap // 2) if overlap else end
    pieces.append((start, n, PARAGRAPH))
    return pieces


def split_oversized(df: DataFrame, key: str, text: str, limit: int = 2000, overlap: int = 200) -> DataFrame:
    """Pieces of the texts longer than ``limit``: ``key, piece, start_char, end_char, cut, longest_unit, piece_text``.

    ``cut`` names the strength of the cut at the piece's end (0 within a word .. 4 paragraph); ``longest_unit`` is the
    length of the text's longest sentence unit: above ``limit``, cutting between units cannot suffice. Null and short
    texts give no row; repeated rows give repeated pieces; other columns are ignored. Narrow, but for spreading few files.
    """
    if not 0 <= overlap <= limit // 4:
        raise ValueError("overlap must be between 0 and a quarter of limit")
    schema = T.StructType([T.StructField("k", df.schema[key].dataType), *[T.StructField(c, T.IntegerType()) for c in ("piece", "start_char", "end_char", "cut", "longest_unit")], T.StructField("piece_text", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in schema]
        for batch in batches:
            out, held = [], 0
            for k, t in zip(batch["k"], batch["t"], strict=True):
                units = segment(t)
                longest = max((b - a for a, b in units), default=0)
                out += [(k, i, a, b, c, longest, t[a:b]) for i, (a, b, c) in enumerate(split_text(t, units, limit, overlap))]
                held += len(t)
                if held > HELD:
                    yield pd.DataFrame(out, columns=names)
                    out, held = [], 0
            yield pd.DataFrame(out, columns=names)

    long = spread(df.select(F.col(key).alias("k"), F.col(text).alias("t"))).where(F.length("t") > limit)
    return long.mapInPandas(run, schema).withColumnRenamed("k", key)
