"""The best chunks of many queries within a block of chunks, without scoring the chunks that cannot be among them.

1. Queries share their frequent terms: each set of these is searched once for all queries that have it.
2. A chunk with none of a query's rare terms scores what its frequent terms give, so only the best chunks of that set can
   count; to these come the chunks in the lists of the query's rare terms.
3. Lists are not walked, and chunks met are dropped, as soon as what they have and what is left to add stays below the
   score that a result needs at least.

What is dropped is certain to be no result, so the outcome is that of scoring every match.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Scores are compared with this room: six places after rounding, and the error of a sum.
ROOM = 2e-6
#: Postings of a query that are looked at to learn which score its results need at least.
PROBED = 64
#: Candidates that are worked on at a time.
AT_ONCE = 1_000_000


def _from_zero(n: np.ndarray) -> np.ndarray:
    """Running totals with a leading zero."""
    return np.concatenate((np.zeros(1, n.dtype), np.cumsum(n)))


def _runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``first[i], first[i] + 1, ...``, ``n[i]`` of them, for each ``i`` in turn."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class Asked:
    """Queries as arrays: ``cls`` in order, and for query ``i`` the terms (places in ``terms``) and weights from ``at[i]`` to
    ``at[i + 1]``. ``sets`` are the different sets of frequent terms, likewise, and ``set_of`` says which one a query has (-1: none)."""

    def __init__(self, cls: pa.ChunkedArray, term: pa.ChunkedArray, weight: pa.ChunkedArray, often: pa.ChunkedArray):
        coded = pa.chunked_array(term.chunks, pa.string()).combine_chunks().dictionary_encode()
        self.terms, tid, cls = coded.dictionary, coded.indices.to_numpy().astype(np.int64), cls.to_numpy()
        by = np.lexsort((tid, cls))
        self.cls, n = np.unique(cls, return_counts=True)
        self.at, self.tid, self.w = _from_zero(n), tid[by], weight.to_numpy()[by]
        often = often.to_numpy()[by]
        self.rare = np.ones(len(self.terms), bool)
        self.rare[self.tid[often]] = False
        pairs = np.rec.fromarrays([self.tid[often], self.w[often]]).tobytes()
        ends = 16 * _from_zero(often.astype(np.int64))[self.at]
        seen: dict[bytes, int] = {}
        self.set_of = np.array([seen.setdefault(pairs[i:j], len(seen)) if i < j else -1 for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], np.int64)
        both = np.frombuffer(b"".join(seen), [("tid", np.int64), ("w", np.float64)])
        self.sets = _from_zero(np.array([len(x) // 16 for x in seen], np.int64)), both["tid"].copy(), both["w"].copy()


class Plan:
    """The terms of queries in the order in which a block looks at them: rare ones first, then by the most that each can add."""

    def __init__(self, at: np.ndarray, tid: np.ndarray, w: np.ndarray, rare: np.ndarray, n: np.ndarray, most: np.ndarray):
        query, adds = np.repeat(np.arange(len(at) - 1), np.diff(at)), w * most[tid]
        by = np.lexsort((-adds, ~rare[tid], query))
        self.at, self.query, self.tid, self.w, self.n = at, query, tid[by], w[by], n[tid[by]]
        total = _from_zero(adds[by])
        self.left = total[at[1:]][query] - total[:-1]  # what a term and those after it can add
        self.after = self.left - adds[by]


class Block:
    """Postings of ``asked``'s terms in some chunks. ``keys``: their keys, in the order in which ties are broken."""

    def __init__(self, asked: Asked, batches: list[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]], avg_len: float, k1: float, b: float):
        keys, n = pa.concat_tables([x[0] for x in batches]), _from_zero(np.array([len(x[1]) for x in batches]))
        by = pc.sort_indices(keys, sort_keys=[(c, "ascending") for c in keys.column_names]).to_numpy()
        self.asked, self.keys, self.size = asked, keys.take(by), max(1, len(by))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        at = np.concatenate([tid.astype(np.int64) * self.size + place[row + lo] for (_, _, row, tid), lo in zip(batches, n[:-1], strict=True)])
        at.sort()
        new = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1]))) if len(at) else np.zeros(0, np.int64)
        tf, self.at = np.diff(np.append(new, len(at))), at[new]
        length = np.concatenate([x[1] for x in batches])[by]
        norm = k1 * (1 - b + b * np.maximum(length, 1) / (avg_len if avg_len > 0 else 1.0))
        self.value = tf * (k1 + 1) / (tf + norm[self.at % self.size])
        self.first = np.searchsorted(self.at, np.arange(len(asked.terms) + 1) * self.size)
        n = np.diff(self.first)
        most = np.zeros(len(n))
        if len(self.at):
            most[n > 0] = np.maximum.reduceat(self.value, self.first[:-1][n > 0])
        self.whole, self.sets = (Plan(*x, asked.rare, n, most) for x in ((asked.at, asked.tid, asked.w), asked.sets))

    def probe(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """``(query, score)``: the ``k`` best scores of each query among a few chunks; a lower bound of its ``k``-th."""
        p = self.whole
        n = np.minimum(p.n, PROBED)
        total = _from_zero(n)
        n = np.where(total[:-1] - total[p.at[:-1]][p.query] < PROBED, n, 0)
        query, _, score = self._best(p, n, np.full(len(p.at) - 1, -np.inf), k)
        return query, score

    def best(self, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query, place in keys, score)``: of each query the ``k`` best chunks, those with scores below ``least`` left out."""
        p, of = self.sets, self.asked.set_of
        own = np.flatnonzero(of >= 0)
        lowest = np.full(len(p.at) - 1, np.inf)
        np.minimum.at(lowest, of[own], least[own])
        name, chunk, score = self._best(p, np.where(p.left >= lowest[p.query] - ROOM, p.n, 0), lowest, k)
        start = np.searchsorted(name, np.arange(len(p.at)))
        n = np.diff(start)[of[own]]
        query, found = np.repeat(own, n), _runs(start[of[own]], n)
        keep = score[found] >= least[query] - ROOM
        p = self.whole
        walked = np.where(self.asked.rare[p.tid] & (p.left >= least[p.query] - ROOM), p.n, 0)
        return self._best(p, walked, least, k, query[keep], chunk[found[keep]])

    def _best(self, p: Plan, n: np.ndarray, least: np.ndarray, k: int, query: np.ndarray | None = None, chunk: np.ndarray | None = None):
        """The best of the chunks that the first ``n`` postings of each term lead to, and of those given, in order of queries."""
        query, chunk = (np.zeros(0, np.int64), np.zeros(0, np.int64)) if query is None else (query, chunk)
        given = np.searchsorted(query, np.arange(len(p.at)))
        work = _from_zero(n)[p.at] + given
        out, lo = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))], 0
        while lo < len(work) - 1:
            hi = max(lo + 1, int(np.searchsorted(work, work[lo] + AT_ONCE, "right")) - 1)
            if work[hi] > work[lo]:
                more = slice(given[lo], given[hi])
                pairs = np.concatenate((self._met(p, slice(p.at[lo], p.at[hi]), n, least), query[more] * self.size + chunk[more]))
                pairs.sort()
                pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))] if len(pairs) else pairs
                out.append(self._ranked(*self._scored(p, pairs // self.size, pairs % self.size, least), k))
            lo = hi
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _met(self, p: Plan, part: slice, n: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Pairs of query and chunk. A chunk counts as met in the first of its query's lists that has it, where it can get no
        more than its part there and what is left after."""
        entry = np.repeat(np.arange(part.start, part.stop), n[part])
        posting = _runs(self.first[p.tid[part]], n[part])
        query = p.query[entry]
        keep = p.w[entry] * self.value[posting] + p.after[entry] >= least[query] - ROOM
        return query[keep] * self.size + self.at[posting[keep]] % self.size

    def _scored(self, p: Plan, query: np.ndarray, chunk: np.ndarray, least: np.ndarray):
        """``(query, chunk, score)`` of the pairs that can reach ``least``."""
        score, done = np.zeros(len(query)), []
        entry = p.at[query]
        while len(query):
            wanted = p.tid[entry] * self.size + chunk
            found = np.minimum(np.searchsorted(self.at, wanted), len(self.at) - 1)
            score = score + np.where(self.at[found] == wanted, p.w[entry] * self.value[found], 0.0)
            able = score + p.after[entry] >= least[query] - ROOM
            last = entry + 1 == p.at[query + 1]
            done.append((query[able & last], chunk[able & last], score[able & last]))
            more = able & ~last
            query, chunk, score, entry = query[more], chunk[more], score[more], entry[more] + 1
        return tuple(np.concatenate(x) for x in zip(*done, strict=True)) if done else (query, chunk, score)

    def _ranked(self, query: np.ndarray, chunk: np.ndarray, score: np.ndarray, k: int):
        score = np.floor(score * 1e6 + 0.5)
        by = np.lexsort((chunk, -score, query))
        by = by[score[by] > 0]
        new = np.concatenate(([True], query[by][1:] != query[by][:-1])) if len(by) else np.zeros(0, bool)
        start = np.flatnonzero(new)
        by = by[np.arange(len(by)) - np.repeat(start, np.diff(np.append(start, len(by)))) < k]
        return query[by], chunk[by], score[by] / 1e6


def blocks(asked: Asked, batches: Iterator[pa.RecordBatch], tokens: int, avg_len: float, k1: float, b: float) -> Iterator[Block]:
    """Blocks of about ``tokens`` tokens from batches of chunks: their keys, and a last column of tokens."""
    held, n = [], 0
    for batch in batches:
        t = batch.column(batch.num_columns - 1)
        length = pc.list_value_length(t).to_numpy(zero_copy_only=False).astype(np.int64)
        tid = pc.fill_null(pc.index_in(t.flatten(), value_set=asked.terms), -1).to_numpy()
        row, known = np.repeat(np.arange(len(length), dtype=np.int32), length), tid >= 0
        held.append((pa.table(batch.columns[:-1], batch.schema.names[:-1]), length, row[known], tid[known]))
        n += len(tid)
        if n >= tokens:
            yield Block(asked, held, avg_len, k1, b)
            held, n = [], 0
    if held:
        yield Block(asked, held, avg_len, k1, b)
