"""Operator 7: best-fit packing by a configuration linear program over the length histogram.

Only the histogram of piece lengths (at most ``capacity`` rows) reaches the
driver. There, lengths are grouped into size classes and the configuration LP
(least number of sequences whose patterns cover all classes) is solved by
multiplicative weights: each round prices the classes, a knapsack dynamic
programme finds the pattern of greatest price, and the classes it covers get
cheaper. The fractional pattern counts are rounded down; what stays is put by
best fit into the space left and into new sequences. All of this works on
counts, so its cost doesn't grow with the corpus. The plan is a bounded table
of slots; each piece finds its slot from its rank among pieces of its length.

Defined results: null text is empty and gives one piece that holds the end
id; texts of any length are read whole; repeated rows and null doc_ids are
packed like any row; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .tokens import encoder

_PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long, shard int, local_rank long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


def cut_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, lean: bool = False) -> DataFrame:
    """Encoded documents cut into pieces of at most ``capacity``, without their ids.

    ``local_rank`` counts the pieces of one length within their task, ``shard``.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, shard = encoder(tokenizer, lean), TaskContext.get().partitionId()
        seen = [0] * (capacity + 1)
        for batch in batches:
            rows, doc_ids = [], iter(batch.column("doc_id").to_pylist())
            for ids, offsets in enc.encode_column(batch.column("text"), end_id):
                wide, cuts = ids.astype("<u4"), offsets.tolist()
                for low, high in zip(cuts, cuts[1:]):
                    doc_id = next(doc_ids)
                    for piece, start in enumerate(range(low, high, capacity)):
                        part = wide[start : min(start + capacity, high)]
                        n = len(part)
                        rows.append((doc_id, piece, start - low, n, zlib.crc32(part), shard, seen[n]))
                        seen[n] += 1
            columns = zip(*rows) if rows else [()] * 7
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32", "shard", "local_rank")
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES)


#: Contents of a sequence: (length, times) runs in order.
Runs = tuple[tuple[int, int], ...]


@dataclass
class _Bins:
    """Open sequences, as counts of equal ones by the space they have left."""

    capacity: int
    by_space: dict[int, list[list]] = field(default_factory=dict)

    def put(self, runs: Runs, space: int, n: int) -> None:
        if n:
            self.by_space.setdefault(space, []).append([runs, n])

    def best_fit(self, size: int, n: int) -> None:
        """Put ``n`` pieces of ``size`` where the least space that takes one is left."""
        for space in sorted(s for s in self.by_space if s >= size):
            waiting = self.by_space.pop(space, [])
            while waiting and n:
                runs, have = waiting.pop()
                each = min(space // size, n)
                used = min(have, n // each)
                self.put((*runs, (size, each)), space - size * each, used)
                n -= used * each
                if have > used:
                    waiting.append([runs, have - used])
            for runs, have in waiting:
                self.put(runs, space, have)
            if not n:
                return
        each = self.capacity // size
        self.put(((size, each),), self.capacity - size * each, n // each)
        if n % each:
            self.put(((size, n % each),), self.capacity - size * (n % each), 1)

    def patterns(self) -> list[tuple[Runs, int]]:
        return [(runs, n) for _, group in sorted(self.by_space.items()) for runs, n in group]


def _classes(counts: dict[int, int], capacity: int, n: int, least: int) -> list[list[int]]:
    """Lengths from ``least`` up in at most ``n`` runs of nearly equal token mass, ascending."""
    sizes = sorted(s for s in counts if least <= s < capacity)
    mass = sum(s * counts[s] for s in sizes)
    out, held = [], 0
    for size in sizes:
        k = min(n - 1, held * n // mass)
        while len(out) <= k:
            out.append([])
        out[k].append(size)
        held += size * counts[size]
    return [x for x in out if x]


def price_pattern(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> np.ndarray:
    """Times of each size in a sequence of greatest total price: unbounded knapsack over the capacity."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    smallest = int(sizes[0])
    for c in range(smallest, capacity + 1):
        fit = int(np.searchsorted(sizes, c, "right"))
        values = best[c - sizes[:fit]] + prices[:fit]
        k = int(values.argmax())
        if values[k] > best[c - 1]:
            best[c], taken[c] = values[k], k
        else:
            best[c] = best[c - 1]
    times = np.zeros(len(sizes), np.int64)
    c = capacity
    while c >= smallest:
        if taken[c] < 0:
            c -= 1
            continue
        times[taken[c]] += 1
        c -= int(sizes[taken[c]])
    return times


def configuration_lp(sizes: np.ndarray, demand: np.ndarray, capacity: int, step: float = 0.3, rounds: int = 2500) -> dict[tuple[int, ...], float]:
    """Patterns and their fractional counts that cover ``demand``, nearly as few as possible.

    Multiplicative weights: a class's price is exp(-coverage) per unit of its
    demand. Each round adds the pattern of greatest price until its scarcest
    class gains ``step``; at the end all counts are scaled to full coverage.
    """
    covered, counts = np.zeros(len(sizes)), {}
    goal = np.log(len(sizes) + 1) / step + 4
    for _ in range(rounds):
        prices = np.exp(covered.min() - covered) / demand
        pattern = price_pattern(sizes, prices, capacity)
        used = pattern > 0
        more = step * (demand[used] / pattern[used]).min()
        covered += more * pattern / demand
        counts[tuple(pattern)] = counts.get(tuple(pattern), 0.0) + more
        if covered.min() >= goal:
            break
    if covered.min() <= 0:
        return {}
    return {p: x / covered.min() for p, x in counts.items()}


def plan(counts: dict[int, int], capacity: int, classes: int = 24, grains: tuple[int, ...] = (3, 2)) -> list[tuple[Runs, int]]:
    """Patterns with their numbers of sequences that hold exactly ``counts`` pieces of each length.

    The LP covers pieces of at least ``capacity / grain``; shorter ones fill
    what its patterns leave. Coarser grains round off less, so grains are
    tried in turn until one meets the bound of total length over capacity.
    """
    least = -(-sum(s * n for s, n in counts.items()) // capacity)
    best: list[tuple[Runs, int]] = []
    for grain in grains:
        patterns = _plan(counts, capacity, classes, max(1, capacity // grain))
        if not best or sum(n for _, n in patterns) < sum(n for _, n in best):
            best = patterns
        if sum(n for _, n in best) <= least:
            break
    return best


def _plan(counts: dict[int, int], capacity: int, classes: int, shortest: int) -> list[tuple[Runs, int]]:
    left = {s: n for s, n in counts.items() if n > 0}
    bins = _Bins(capacity)
    if capacity in left:
        bins.put(((capacity, 1),), 0, left.pop(capacity))
    groups = _classes(left, capacity, classes, shortest)
    if groups:
        sizes = np.array([g[-1] for g in groups])
        demand = np.array([sum(left[s] for s in g) for g in groups], float)
        solved = configuration_lp(sizes, demand, capacity)
        for pattern, x in sorted(solved.items(), key=lambda item: (-item[1], item[0])):
            have = [sum(left.get(s, 0) for s in g) for g in groups]
            n = min([int(x + 1e-9), *(have[g] // times for g, times in enumerate(pattern) if times)])
            if n:
                _fill(bins, left, groups, pattern, n)
    for size in sorted(left, reverse=True):
        if left[size]:
            bins.best_fit(size, left[size])
    return bins.patterns()


def _fill(bins: _Bins, left: dict[int, int], groups: list[list[int]], pattern: tuple[int, ...], n: int) -> None:
    """Open ``n`` sequences of a pattern, with the longest pieces that its classes still have."""
    open_now: list[tuple[Runs, int, int]] = [((), bins.capacity, n)]
    for g in range(len(pattern) - 1, -1, -1):
        for _ in range(pattern[g]):
            pool = [s for s in reversed(groups[g]) if left.get(s)]
            following, k = [], 0
            for runs, space, m in open_now:
                while m:
                    size = pool[k]
                    used = min(m, left[size])
                    following.append(((*runs, (size, 1)), space - size, used))
                    left[size] -= used
                    m -= used
                    if not left[size]:
                        k += 1
            open_now = following
    for runs, space, m in open_now:
        bins.put(runs, space, m)


@dataclass(frozen=True)
class Slots:
    """Where pieces go, by (length, rank): a plan's slots in ascending order of both."""

    key: np.ndarray
    low: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    each: np.ndarray
    n_sequences: int

    @staticmethod
    def of(patterns: list[tuple[Runs, int]]) -> Slots:
        rows, ranks, base = [], {}, 0
        for runs, n in patterns:
            at = 0
            for length, times in runs:
                low = ranks.get(length, 0)
                rows.append((length, low, base, at, times))
                ranks[length] = low + times * n
                at += length * times
            base += n
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        return Slots((table[:, 0] << 44) | table[:, 1], table[:, 1], table[:, 2], table[:, 3], table[:, 4], base)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(self.key, (length.astype(np.int64) << 44) | rank, "right") - 1
        nth = rank - self.low[k]
        return self.sequence[k] + nth // self.each[k], self.offset[k] + nth % self.each[k] * length


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, lean: bool = False) -> DataFrame:
    """Per piece of ``docs`` (doc_id, text): its place in sequences of at most ``capacity`` tokens. ``lean`` is the encoder's."""
    pieces = written(cut_pieces(docs, tokenizer, end_id, capacity, lean), "pieces")
    by_shard = written(pieces.groupBy("shard", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in by_shard.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    slots = Slots.of(plan(histogram, capacity))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_shard.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # as many bases as shards have lengths, which grows with the corpus: never broadcast; pieces without their ids are small
    ranked = pieces.join(bases.hint("merge"), ["shard", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("local_rank") + F.col("base")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            sequence, offset = slots.place(length, batch.column("rank").to_numpy())
            columns = [*(batch.column(c) for c in ("doc_id", "piece", "start")), pa.array(length), batch.column("ids_crc32"), pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, _PLACED)
