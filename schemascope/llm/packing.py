"""Best-fit packing of token pieces into sequences.

The lengths' histogram has at most ``limit`` entries whatever the input's size,
so the whole plan is made from it on the driver: few-document patterns that
fill a sequence are enumerated over coarse lengths, their repeat counts are
fitted to the histogram by non-negative least squares and rounded down, and
what the patterns leave over is packed best fit, longest first, into gaps and
new sequences. Every step deals with runs of equal lengths, never with single
documents. The executors then look up each piece's place by its length and its
rank among the pieces of that length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import tokens
from .common import stage

#: Rank bits of a (length, rank) key.
_RANK = 48


def patterns(parts: int, most: int = 3) -> np.ndarray:
    """Ways to fill ``parts`` units with at most ``most`` documents, as rows of
    how often each length 1..parts is used."""
    found: list[list[int]] = []

    def add(left: int, top: int, used: list[int]) -> None:
        if left == 0:
            found.append(used)
        elif len(used) < most:
            for x in range(min(left, top), 0, -1):
                if x * (most - len(used)) < left:
                    break
                add(left - x, x, [*used, x])

    add(parts, parts, [])
    out = np.zeros((len(found), parts))
    for i, used in enumerate(found):
        for x in used:
            out[i, x - 1] += 1
    return out


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 600) -> np.ndarray:
    """Least squares of ``a @ x = b`` over x >= 0, by active sets on the normal equations."""
    gram, right = a.T @ a, a.T @ b
    x, on = np.zeros(a.shape[1]), np.zeros(a.shape[1], dtype=bool)
    tol = 1e-9 * max(1.0, float(np.abs(right).max(initial=0)))
    for _ in range(rounds):
        w = np.where(on, -np.inf, right - gram @ x)
        k = int(w.argmax())
        if w[k] <= tol:
            break
        on[k] = True
        while True:
            at = np.flatnonzero(on)
            s = np.linalg.lstsq(gram[np.ix_(at, at)], right[at], rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            old, bad = x[at], s <= 0
            step = (old[bad] / np.maximum(old[bad] - s[bad], 1e-300)).min()
            x[at] = old + step * (s - old)
            on[at[x[at] <= 1e-12]] = False
            x[~on] = 0
            if not on.any():
                break
    return x


class Plan:
    """Where each (length, rank) goes: ``bins`` sequences take ``each`` pieces
    of a length, from a rank, a sequence number and an offset on."""

    def __init__(self, histogram: dict[int, int], limit: int = 4096, units: int = 128, most: int = 3):
        self.limit, self.sequences, self.segments = limit, 0, []
        self.left, self.next = dict(histogram), defaultdict(int)
        self.gaps: dict[int, list[list[int]]] = defaultdict(list)
        self.open: list[int] = []
        self.fitted = self._fit(limit, units, most)
        self._rest()

    def _take(self, length: int, bins: int, each: int, first: int, offset: int) -> None:
        self.segments.append((length, self.next[length], each, first, offset))
        self.next[length] += bins * each
        self.left[length] -= bins * each

    def _gap(self, size: int, first: int, bins: int) -> None:
        if size:
            if not self.gaps[size]:
                insort(self.open, size)
            self.gaps[size].append([first, bins])

    def _fit(self, limit: int, units: int, most: int) -> int:
        units = max(1, min(units, limit))
        unit = -(-limit // units)
        units = limit // unit
        bins: dict[int, list[int]] = defaultdict(list)
        for n in sorted(self.left, reverse=True):
            if -(-n // unit) <= units:
                bins[-(-n // unit)].append(n)
        counts = np.array([sum(self.left[n] for n in bins[b]) for b in range(1, units + 1)], dtype=float)
        if not counts.sum():
            return 0
        table = patterns(units, most)
        weight = np.arange(1, units + 1) / units
        times = nnls((table * weight).T, counts * weight / counts.sum()) * counts.sum()
        for row, x in sorted(zip(table, times, strict=True), key=lambda p: -p[1]):
            need = np.flatnonzero(row)
            n = int(min([x + 1e-6, *(counts[need] // row[need])]))
            if n <= 0:
                continue
            counts[need] -= n * row[need]
            classes = [(self.sequences, n, limit)]
            self.sequences += n
            for b in sorted(need.tolist(), reverse=True):
                for _ in range(int(row[b])):
                    classes = [c for old in classes for c in self._place(bins[b + 1], *old)]
            for first, m, gap in classes:
                self._gap(gap, first, m)
        return self.sequences

    def _place(self, lengths: list[int], first: int, bins: int, gap: int) -> Iterator[tuple[int, int, int]]:
        while bins:
            n = lengths[0]
            if m := min(bins, self.left[n]):
                self._take(n, m, 1, first, self.limit - gap)
                yield first, m, gap - n
                first, bins = first + m, bins - m
            if not self.left[n]:
                lengths.pop(0)

    def _rest(self) -> None:
        for n in sorted(self.left, reverse=True):
            while self.left[n]:
                at = bisect_left(self.open, n)
                if at < len(self.open):
                    gap = self.open[at]
                    first, bins = self.gaps[gap].pop()
                    if not self.gaps[gap]:
                        self.open.pop(at)
                else:
                    gap, first = self.limit, self.sequences
                    bins = -(-self.left[n] // (gap // n))
                    self.sequences += bins
                each = gap // n
                full = min(bins, self.left[n] // each)
                if full:
                    self._take(n, full, each, first, self.limit - gap)
                    self._gap(gap - each * n, first, full)
                    first, bins = first + full, bins - full
                if bins and (some := self.left[n]) and some < each:
                    self._take(n, 1, some, first, self.limit - gap)
                    self._gap(gap - some * n, first, 1)
                    first, bins = first + 1, bins - 1
                if bins:
                    self._gap(gap, first, bins)

    def arrays(self) -> tuple[np.ndarray, ...]:
        s = np.array(sorted(self.segments) or np.zeros((0, 5)), dtype=np.int64).reshape(-1, 5)
        return (s[:, 0] << _RANK) | s[:, 1], s[:, 1], s[:, 2], s[:, 3], s[:, 4]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, limit: int = 4096, most_ranked: int = 1 << 20) -> DataFrame:
    """Place every document's pieces in sequences of at most ``limit`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts give one piece, the end id alone. Repeated rows are
    packed each for itself, very long texts in pieces. Other columns, of any
    name, are ignored; an empty table gives no rows. Which of several pieces of one length takes which place is fixed by
    an id given when the pieces are staged.

    Pieces of one length are ranked in parts of at most about ``most_ranked``
    pieces or a 256th of all. Only the counts by length and part reach the
    driver, and they are broadcast with the plan made from them: ``limit`` and
    256 rows, and one more for each ``most_ranked`` pieces.
    """
    path = tokenizer or tokens.default_tokenizer()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    cut = rows.mapInArrow(lambda it: tokens.pieces(it, path, end_id, limit), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")
    staged = stage(cut.withColumn("uid", F.monotonically_increasing_id()), "pieces")
    histogram = {n: c for n, c in staged.groupBy("length").count().collect()}
    each_part = max(1, min(most_ranked, max(1024, sum(histogram.values()) // 256)))
    parts = np.zeros(limit + 2, dtype=np.int64)
    for n, c in histogram.items():
        parts[n] = -(-c // each_part)
    place_of = np.cumsum(parts) - parts
    table = rows.sparkSession.createDataFrame([(n, int(parts[n])) for n in histogram], "length long, parts int")
    salted = staged.join(F.broadcast(table), "length").withColumn("salt", F.pmod(F.xxhash64("uid"), F.col("parts")).cast("int"))
    by = np.zeros(int(parts.sum()), dtype=np.int64)
    for length, salt, n in salted.groupBy("length", "salt").count().collect():
        by[place_of[length] + salt] = n
    before = np.cumsum(by) - by
    before -= np.repeat(before[place_of[parts > 0]], parts[parts > 0])
    plan = Plan(histogram, limit)
    shared = rows.sparkSession.sparkContext.broadcast((place_of, before, *plan.arrays()))

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, base, keys, start, each, first, offset = shared.value
        for b in batches:
            length, salt, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "salt", "rank"))
            rank = rank.astype(np.int64) - 1 + base[places[length] + salt]
            at = np.searchsorted(keys, (length << _RANK) | rank, side="right") - 1
            past = rank - start[at]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(first[at] + past // each[at]), pa.array(offset[at] + past % each[at] * length)], [*b.schema.names[:5], "sequence_id", "offset"])

    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("uid")))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "salt", "rank").mapInArrow(place, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
