"""Operator 5: SimHash near-dedup by a byte-position inverted index with count filtering.

Fingerprints of 64 bits that differ in at most ``d`` bits differ in at most
``d`` of their eight bytes, so they share ``8 - d`` positional bytes or more:
the guaranteed minimum. The index posts each distinct fingerprint under
groups of positional bytes. Posting under single bytes would put a 256th of
the corpus in every list, so the extended prefix form of the same filter is
used: of any ``8 - d`` shared positions, three lie within the first ``d + 3``,
so posting under each choice of three of these positions loses no pair, and
lists stay short. Within a list the shared positional bytes of a pair are
tallied, pairs below the minimum dropped, and the rest verified by their
differing bits, all in one task and vectorised; only a star of each local
cluster is emitted, never the pairs.

Members of a list past ``LONG_LIST`` are posted once more under each position
that their key lacks: a pair shares one byte more than its key has, so this
loses none, and the new lists are a fraction of the old one.

``similar_groups`` asks for a similarity of shingle sets instead of a number of
bits. Fingerprints have 256 bits there and are posted under every pair of
positions within each of four groups of eight positions. A pair that shares
five positional bytes or more shares two in one of the groups, so it meets in
a list: five is the minimum that the count filter asks for. Pairs that differ
in more bits than the similarity leads to, plus two standard deviations, are
dropped as well. A pair counts in the first of its lists only, and a task hands
on a spanning forest of the pairs of all its lists, never the pairs. Before
components are sought, the edges of many tasks are cut to stars in fewer tasks.
The components are canopies: no candidate pair leaves one. Each canopy's members meet once, in
tiles of bounded size, where all candidate pairs that aren't linked yet are
verified on the shingle sets themselves (64-bit hashes). A canopy beyond one
tile has its forest verified first, and what that links to its largest cluster
meets the others alone. Only members of canopies have their sets made and moved,
and only edges that join clusters leave a tile. No number of shared
bytes follows from a Jaccard similarity for certain, so a few links near the
threshold are missed; tests hold recall against brute force.

Defined results: null or wordless texts have fingerprint zero and link like
any other; rows without doc_id belong to their fingerprint's component, whose
id is the smallest doc_id in it (null if it has none); repeated rows come out
once each; texts of any length are read whole; an empty table gives an empty
result; further columns are ignored by ``near_groups`` and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bloom
from .common import blobs, written
from .graph import components, dealt_anew

_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
SEED = 42
#: Most positional bytes in an index key.
_KEY_BYTES = 3
#: Members of a posting list that are compared in one task.
LONG_LIST = 20_000
_CHUNK = 1 << 15
_LOW_BITS, _HIGH_BIT = np.uint64(0x7F7F7F7F7F7F7F7F), np.uint64(0x8080808080808080)


def fingerprint(raw: bytes, width: int) -> int:
    """SimHash of a UTF-8 text's word shingles: each bit set in over half their XXH64 hashes."""
    import xxhash

    words = raw.translate(_UPPER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-width])).tolist()
    stops = (ends[width - 1 :] - 1).tolist()
    votes, n = np.zeros(64, np.int64), len(starts)
    for at in range(0, n, _CHUNK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _CHUNK], stops[at : at + _CHUNK])], ">u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``doc_id, fp``: 64-bit fingerprints, read as signed, of all rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(raw, width) for raw in blobs(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def _choices(max_bits: int) -> list[tuple[int, ...]]:
    """The choices of positions under which 64-bit fingerprints are posted."""
    if not 0 <= max_bits <= 7:
        raise ValueError("max_bits must lie between 0 and 7")
    size = min(_KEY_BYTES, 8 - max_bits)
    return list(combinations(range(max_bits + size), size))


def _byte(position):
    return F.shiftrightunsigned(F.col("fp"), 56 - 8 * position).bitwiseAND(F.lit(255))


def _postings(distinct: DataFrame, max_bits: int) -> DataFrame:
    """``key, fp``: each fingerprint under every choice of index bytes; the key holds the choice and the bytes."""
    keys = []
    for n, chosen in enumerate(_choices(max_bits)):
        key = F.lit(n).cast("long")
        for position in chosen:
            key = F.shiftleft(key, 8).bitwiseOR(_byte(position))
        keys.append(key)
    return distinct.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _postings_again(crowded: DataFrame, max_bits: int) -> DataFrame:
    """Members (key, fp) of long lists under each position that their key lacks; the new key is a hash of all that they share."""
    choices = _choices(max_bits)
    rest = F.array(*[F.array(*[F.lit(p) for p in range(8) if p not in chosen]) for chosen in choices])
    mine = F.element_at(rest, (F.shiftright("key", 8 * len(choices[0])) + 1).cast("int"))
    bytes_of = F.array(*[_byte(p) for p in range(8)])
    again = F.transform(mine, lambda p: F.xxhash64("key", p, F.get(bytes_of, p)))
    return crowded.select(F.explode(again).alias("key"), "fp")


def shared_bytes(apart: np.ndarray) -> np.ndarray:
    """The tally: how many positional bytes each pair shares, from the exclusive or of its words."""
    zero = ~(((apart & _LOW_BITS) + _LOW_BITS) | apart) & _HIGH_BIT
    return np.bitwise_count(zero).sum(-1, dtype=np.int64)


def star(members: np.ndarray, max_bits: int, least: int = 0, step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """Edges (member, root), as row numbers, of the clusters that links within ``max_bits`` form.

    ``members``: distinct fingerprints, a row of unsigned 64-bit words each. A
    breadth-first walk in blocks: each member is compared once with those not
    yet reached, so a dense cluster costs little more than its size.
    ``least`` is the number of shared positional bytes that the count filter asks for.
    """
    left, tails, heads = np.arange(len(members)), [], []
    while len(left):
        root, front, left = left[0], left[:1], left[1:]
        while len(front) and len(left):
            reached = np.zeros(len(left), bool)
            for at in range(0, len(front), 64):
                part = members[front[at : at + 64]]
                open_at = np.flatnonzero(~reached)
                for block in range(0, len(open_at), step):
                    rows = open_at[block : block + step]
                    near = _near(part[:, None, :], members[left[rows]][None, :, :], max_bits, least)
                    reached[rows[near.any(0)]] = True
            front = left[reached]
            tails.append(front)
            heads.append(np.full(len(front), root))
            left = left[~reached]
    return (np.concatenate(tails), np.concatenate(heads)) if tails else (left, left)


def _near(a: np.ndarray, b: np.ndarray, max_bits: int, least: int) -> np.ndarray:
    """Which pairs pass the count filter, ``least`` shared positional bytes, and then differ in ``max_bits`` at most."""
    apart = a ^ b
    close = shared_bytes(apart) >= least
    close[close] = np.bitwise_count(apart[close]).sum(-1, dtype=np.int64) <= max_bits
    return close


def _whole_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """Columns of batches that are sorted by the first, cut so that no list goes on in the next piece."""
    held: list[list[np.ndarray]] = []

    def joined() -> list[np.ndarray]:
        return [np.concatenate(x) for x in zip(*held)]

    for batch in batches:
        if not batch.num_rows:
            continue
        new = [column.to_numpy() for column in batch.columns]
        cut = int(np.searchsorted(new[0], new[0][-1]))  # the last list may go on
        if held and held[-1][0][-1] != new[0][0]:
            yield joined()
            held = []
        if cut:
            held.append([x[:cut] for x in new])
            yield joined()
            held = []
        held.append([x[cut:] for x in new])
    if held:
        yield joined()


def _linked(max_bits: int, long_list: int | None):
    """Reads postings sorted by key; yields edges (a, b), or (a, null, key) for the members of a long list."""

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, fps in _whole_lists(batches):
            fps = fps.view(np.uint64)
            cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
            for k in np.flatnonzero(np.diff(cuts) > 1):
                first, end = cuts[k], cuts[k + 1]
                if long_list is not None and end - first > long_list:
                    columns = [pa.array(fps[first:end].view(np.int64)), pa.nulls(end - first, pa.int64()), pa.array(keys[first:end])]
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "key"])
                    continue
                members = np.unique(fps[first:end])
                tails, heads = star(members[:, None], max_bits, 8 - max_bits)
                if len(tails):
                    columns = [pa.array(members[x].view(np.int64)) for x in (tails, heads)]
                    yield pa.RecordBatch.from_arrays([*columns, pa.nulls(len(tails), pa.int64())], names=["a", "b", "key"])

    return link


def links(distinct: DataFrame, max_bits: int, long_list: int = LONG_LIST) -> DataFrame:
    """Edges (a, b) between values whose components are those of all links within ``max_bits`` among ``distinct`` fp."""

    def found(posted: DataFrame, limit: int | None) -> DataFrame:
        sorted_lists = posted.repartition("key").sortWithinPartitions("key")
        return written(sorted_lists.mapInArrow(_linked(max_bits, limit), "a long, b long, key long"), "links")

    splits = 8 - max_bits > _KEY_BYTES  # else a pair need not share more than its key
    edges = found(_postings(distinct, max_bits), long_list if splits else None)
    crowded = edges.where("b is null").select("key", F.col("a").alias("fp"))
    edges = edges.where("b is not null").select("a", "b")
    if crowded.isEmpty():
        return edges
    return edges.unionByName(found(_postings_again(crowded, max_bits), None).select("a", "b"))


def component_ids(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """``node, component_id`` of ``nodes`` (node, low), a written table: the smallest ``low`` of each node's component.

    Only linked nodes are joined on their root, in a way that lets a component
    of many nodes, and a node of many documents, be split.
    """
    roots = components(edges)
    own = nodes.select(F.col(node).alias("node"), "low")
    lows = roots.join(own, "node").groupBy("root").agg(F.min("low").alias("component_id"))
    linked = roots.join(dealt_anew(lows, "root"), "root").select("node", "component_id").withColumn("linked", F.lit(True))
    id_of = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("low"))
    return dealt_anew(own.join(linked, "node", "left").select("node", id_of.alias("component_id")), "node").withColumnRenamed("node", node)


def near_groups(docs: DataFrame, width: int = 4, max_bits: int = 4, long_list: int = LONG_LIST) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): fingerprint in hex and component_id, the smallest doc_id reachable."""
    prints = written(fingerprints(docs, width), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    ids = component_ids(distinct, links(distinct.select("fp"), max_bits, long_list), "fp")
    return prints.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Lists up to this length are compared in one sweep over many lists.
_SHORT = 16
#: Rows and columns of a block of pairs in longer lists.
_TILE = (128, 2048)
#: Standard deviations by which a pair may exceed the differing bits that its similarity leads to.
_SLACK = 2.0
#: Pairs that a task holds before they are cut to a forest.
_HELD = 1 << 20
#: Members, and their shingles, that are compared in one task.
TILE_MEMBERS, TILE_SHINGLES = 1024, 1 << 22
_GOLDEN, _MIX_1, _MIX_2 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def _scrambled(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(30))) * _MIX_1
    values = (values ^ (values >> np.uint64(27))) * _MIX_2
    return values ^ (values >> np.uint64(31))


def shingle_hashes(raw: bytes, width: int) -> np.ndarray:
    """XXH64 of each word shingle of a UTF-8 text, in its order; a text of fewer words is one shingle."""
    import xxhash

    words = raw.translate(_UPPER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts, stops = [0, *ends[:-width].tolist()], (ends[width - 1 :] - 1).tolist()
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops)), np.uint64, len(starts))


@dataclass(frozen=True)
class Index:
    """Wide fingerprints of ``words`` 64-bit words, posted under each choice of ``key_bytes`` positions within every group of ``group``.

    Two key bytes leave lists of a 65,536th of the corpus at the mean, whose
    pairs are compared in blocks.
    """

    words: int = 4
    group: int = 8
    key_bytes: int = 2

    @cached_property
    def choices(self) -> list[tuple[int, ...]]:
        return [tuple(g + i for i in chosen) for g in range(0, 8 * self.words, self.group) for chosen in combinations(range(self.group), self.key_bytes)]

    @property
    def least(self) -> int:
        """The shared positional bytes from which on a pair is sure to meet in a list."""
        return 8 * self.words // self.group * (self.key_bytes - 1) + 1

    def max_bits(self, similarity: float) -> int:
        """Differing bits up to which a pair of sets of a Jaccard ``similarity`` is looked for."""
        share = np.arccos(2 * similarity / (1 + similarity)) / np.pi
        return int(64 * self.words * share + _SLACK * np.sqrt(64 * self.words * share * (1 - share)))

    def first_choice(self, apart: np.ndarray) -> np.ndarray:
        """Number of the first choice of positions that each pair shares whole, -1 if there is none; rows of exclusive ors."""
        same = (np.ascontiguousarray(apart).view(np.uint8) == 0).reshape(len(apart), 8 * self.words // self.group, self.group)
        enough = same.sum(2) >= self.key_bytes
        at = enough.argmax(1)
        inside = np.argsort(~same[np.arange(len(apart)), at], axis=1, kind="stable")[:, : self.key_bytes]
        number = np.full((self.group,) * self.key_bytes, -1)
        for n, chosen in enumerate(combinations(range(self.group), self.key_bytes)):
            number[chosen] = n
        each = len(self.choices) * self.group // (8 * self.words)
        return np.where(enough.any(1), at * each + number[tuple(inside.T)], -1)


def wide_fingerprint(hashes: np.ndarray, words: int) -> np.ndarray:
    """SimHash of ``words`` 64-bit words: every shingle's hash, scrambled once for each word, votes on each bit."""
    votes, n = np.zeros(64 * words, np.int64), len(hashes)
    for at in range(0, n, _CHUNK):
        part = hashes[at : at + _CHUNK]
        many = np.stack([_scrambled(part + np.uint64((k * int(_GOLDEN)) & ((1 << 64) - 1))) for k in range(words)], axis=1)
        votes += np.unpackbits(many.view(np.uint8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * votes > n).view(np.uint64)


def _lowered(label: np.ndarray, tails: np.ndarray, heads: np.ndarray) -> None:
    """Lowers ``label``, in place, until both ends of each pair (tails, heads) bear the smallest label of their cluster."""
    while True:
        a, b = label[tails], label[heads]
        if (a == b).all():
            break
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label != label[label]).any():
            label[:] = label[label]


def spanning(low: np.ndarray, high: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Those of the pairs (low, high) that form a spanning forest of least ``bits``: one pair fewer than members in each cluster."""
    order = np.argsort(bits, kind="stable")  # a pair's place in it breaks ties
    ends, at = np.unique(np.concatenate((low[order], high[order])), return_inverse=True)
    tails, heads = at[: len(low)], at[len(low) :]
    label, left, chosen = np.arange(len(ends)), np.arange(len(low)), []
    while True:
        a, b = label[tails[left]], label[heads[left]]
        apart = a != b
        left, a, b = left[apart], a[apart], b[apart]
        if not len(left):
            break
        best = np.full(len(ends), len(low))
        np.minimum.at(best, a, left)
        np.minimum.at(best, b, left)
        picked = np.unique(best[best < len(low)])
        chosen.append(picked)
        _lowered(label, tails[picked], heads[picked])
    kept = order[np.concatenate(chosen)] if chosen else order[:0]
    return low[kept], high[kept], bits[kept]


def stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from all nodes of the pairs (a, b) to the smallest node of their cluster."""
    ends, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    label = np.arange(len(ends))
    _lowered(label, at[: len(a)], at[len(a) :])
    rest = np.flatnonzero(label != np.arange(len(ends)))
    return ends[rest], ends[label[rest]]


def _cut(pairs: Iterator[tuple], fewer: Callable, most: int) -> Iterator[pa.RecordBatch]:
    """``pairs``, columns that begin with a and b, cut by ``fewer`` as one, or each time that over half of ``most`` are left of those held; yields a and b."""

    def batch(a: np.ndarray, b: np.ndarray, *_) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    held, n = [], 0
    for part in pairs:
        held.append(part)
        n += len(part[0])
        if n > most:
            held = [fewer(*map(np.concatenate, zip(*held)))]
            n = len(held[0][0])
            if 2 * n > most:
                yield batch(*held[0])
                held, n = [], 0
    if n:
        yield batch(*fewer(*map(np.concatenate, zip(*held))))


def sparse(edges: DataFrame, most: int = _HELD) -> DataFrame:
    """Edges (a, b) of the same components as those of ``edges``, a table: stars of the clusters of each ``most`` edges or so, again while that halves them.

    Up to ``most`` edges, fewer edges than nodes come out.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut(([column.to_numpy() for column in batch.columns] for batch in batches if batch.num_rows), stars, 2 * most)

    n = edges.count()  # from Parquet footers
    while True:
        tasks, before = max(1, -(-n // most)), n
        edges = written(edges.select("a", "b").coalesce(tasks).mapInArrow(each, "a long, b long"), "stars")
        n = edges.count()
        if tasks == 1 or 2 * n > before:
            return edges


def _fitting(prints: np.ndarray, sizes: np.ndarray, low: np.ndarray, high: np.ndarray, index: Index, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs (low, high) that may be similar, and their differing bits: their sizes allow it, they share ``index.least`` positional bytes and differ in few enough bits."""
    fit = np.minimum(sizes[low], sizes[high]) >= similarity * np.maximum(sizes[low], sizes[high]) - 1e-9
    low, high = low[fit], high[fit]
    apart = prints[low] ^ prints[high]
    some = np.flatnonzero(shared_bytes(apart) >= index.least)  # the count filter
    bits = np.bitwise_count(apart[some]).sum(-1, dtype=np.int64)
    some, bits = some[bits <= index.max_bits(similarity)], bits[bits <= index.max_bits(similarity)]
    return low[some], high[some], bits


def _candidates(index: Index, similarity: float):
    """Reads wide postings (key, node, n, words) sorted by key; yields a spanning forest (a, b) of the candidates of all lists.

    A pair counts in the first of its lists only. However many lists and pairs
    a task has, about as many edges as it has nodes come out at most.
    """
    shift = 8 * index.key_bytes

    def close(keys, nodes, sizes, *words) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        prints = np.stack([w.view(np.uint64) for w in words], axis=1)
        cuts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        counts = np.diff(cuts)

        def kept(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            low, high, bits = _fitting(prints, sizes, low, high, index, similarity)
            own = index.first_choice(prints[low] ^ prints[high]) == keys[low] >> shift
            return low[own], high[own], bits[own]

        def forest(pairs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            return spanning(*map(np.concatenate, zip(*pairs)))

        def cut(pairs: list[tuple]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
            low, high, bits = forest(pairs) if pairs else ((), (), ())
            if len(low):
                a, b = nodes[low], nodes[high]
                yield np.minimum(a, b), np.maximum(a, b), bits

        place, size = np.arange(len(keys)) - np.repeat(cuts[:-1], counts), np.repeat(counts, counts)
        rows, found = np.flatnonzero((size > 1) & (size <= _SHORT)), []
        for gap in range(1, _SHORT):
            rows = rows[place[rows] + gap < size[rows]]
            if not len(rows):
                break
            found.append(kept(rows, rows + gap))
        yield from cut(found)
        for k in np.flatnonzero(counts > _SHORT):
            first, end, found = cuts[k], cuts[k + 1], []
            for at in range(first, end, _TILE[0]):
                for other in range(at, end, _TILE[1]):
                    low, high = (x.ravel() for x in np.meshgrid(np.arange(at, min(at + _TILE[0], end)), np.arange(other, min(other + _TILE[1], end)), indexing="ij"))
                    found.append(kept(low[low < high], high[low < high]))
                    if sum(len(x[0]) for x in found) > _HELD:
                        found = [forest(found)]
            yield from cut(found)

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut((pairs for lists in _whole_lists(batches) for pairs in close(*lists)), spanning, _HELD)

    return sweep


def _candidate_edges(nodes: DataFrame, index: Index, similarity: float) -> DataFrame:
    """``a, b``: distinct edges between ``nodes`` (node, n, words), a table, whose components are those of all candidate pairs; a written table."""
    words = [f"w{k}" for k in range(index.words)]

    def key(n: int, chosen: tuple[int, ...]):
        out = F.lit(n).cast("long")
        for i in chosen:
            out = F.shiftleft(out, 8).bitwiseOR(F.shiftrightunsigned(F.col(words[i // 8]), 8 * (i % 8)).bitwiseAND(F.lit(255)))
        return out

    by_first: dict[int, list] = {}
    for n, chosen in enumerate(index.choices):
        by_first.setdefault(chosen[0], []).append(key(n, chosen))
    firsts = F.array(*[key(i, (i,)) for i in by_first])
    keys = F.lit(None)
    for i, own in by_first.items():
        keys = F.when(F.shiftright("first", 8) == i, F.array(*own)).otherwise(keys)
    # a fingerprint moves once for the choices that begin with one position, and is posted under each where it arrives
    moved = nodes.select(F.explode(firsts).alias("first"), "node", "n", *words).repartition("first")
    posted = moved.select(F.explode(keys).alias("key"), "node", "n", *words).sortWithinPartitions("key")
    return written(posted.mapInArrow(_candidates(index, similarity), "a long, b long"), "candidates")


def _tiles(members: DataFrame, edges: DataFrame, sets: DataFrame, similarity: float, most: int, shingles: int) -> tuple[DataFrame, DataFrame | None]:
    """``members`` (node, canopy, n and more) once for each tile (canopy, i, j) that they are compared in, with their block and root, and links that the roots rest on.

    A canopy of at most ``most`` members and ``shingles`` is one tile. In a
    larger one the ``edges`` are verified first. Members that they link to the
    largest cluster need not meet each other: they are dealt over blocks of
    their own, all others over further blocks, and a tile is a pair of blocks
    of which one at least is of the others.
    """
    total = members.groupBy("canopy").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    large = written(total.where((F.col("c") > most) | (F.col("s") > shingles)).select("canopy"), "large")
    if large.isEmpty():
        return members.select("*", *[F.lit(0).alias(x) for x in ("block", "i", "j")], F.col("node").alias("root")), None
    few = dealt_anew(large, "canopy").withColumn("large", F.lit(True))
    known = members.join(few, "canopy", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    inside = edges.join(known.where("large").select(F.col("node").alias("a")), "a", "left_semi")
    linked = sparse(_verified(inside, sets, similarity))
    known = written(known.join(components(linked), "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    parts = known.where("large").groupBy("canopy", "root").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s"))
    first = F.max(F.struct("c", "s", "root"))
    sums = parts.groupBy("canopy").agg(first.alias("top"), F.sum("c").alias("c"), F.sum("s").alias("s"))

    def blocks(count, size):  # a tile has two
        return F.greatest(F.ceil(2 * count / most), F.ceil(2 * size / shingles)).cast("int")

    rest = F.col("c") - F.col("top.c"), F.col("s") - F.col("top.s")
    sums = sums.select("canopy", F.col("top.root").alias("top"), blocks(F.col("top.c"), F.col("top.s")).alias("tops"), F.when(rest[0] > 0, blocks(*rest)).otherwise(0).alias("others"))
    placed = known.join(dealt_anew(sums, "canopy"), "canopy", "left")
    is_top, dealt = F.col("root") == F.col("top"), F.xxhash64("node")
    placed = placed.where("not large or others > 0").withColumn(
        "block", F.when(~F.col("large"), 0).when(is_top, F.pmod(dealt, "tops")).otherwise(F.col("tops") + F.pmod(dealt, F.greatest("others", F.lit(1)))).cast("int")
    )
    with_all = F.sequence(F.when(F.col("large") & is_top, F.col("tops")).otherwise(0), F.when(F.col("large"), F.col("tops") + F.col("others") - 1).otherwise(0))
    placed = placed.withColumn("other", F.explode(with_all))
    return placed.select(*members.columns, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "root"), linked


def _linked_tiles(index: Index, similarity: float):
    """Reads (canopy, i, j, block, root, node, n, shingles, words) sorted by the first three; yields edges (a, b) that join the clusters of each tile.

    All candidates of different roots are verified on their sets. Members of
    one block are compared only in the tile of that block with itself, where
    ``i`` equals ``j``.
    """

    def linked(whole, blocks, roots, nodes, sizes, sets, *words) -> Iterator[pa.RecordBatch]:
        prints = np.stack([w.view(np.uint64) for w in words], axis=1)
        label = np.unique(roots, return_inverse=True)[1]
        parts = [np.frombuffer(x, np.uint64) for x in sets]
        starts = np.cumsum([0, *map(len, parts)])
        numbers, tails, heads = None, [], []
        for row in range(len(nodes) - 1):
            others = row + 1 + np.flatnonzero((label[row + 1 :] != label[row]) & (whole | (blocks[row + 1 :] != blocks[row])))
            _, others, _ = _fitting(prints, sizes, np.full(len(others), row), others, index, similarity)
            if not len(others):
                continue
            if numbers is None:  # shingles of the tile, numbered
                found, numbers = np.unique(np.concatenate(parts), return_inverse=True)
                mine = np.zeros(len(found), bool)
            own = numbers[starts[row] : starts[row + 1]]
            mine[own] = True
            shared = np.array([np.count_nonzero(mine[numbers[starts[x] : starts[x + 1]]]) for x in others])
            mine[own] = False
            close = others[shared >= similarity * (sizes[row] + sizes[others] - shared) - 1e-9]
            joined, first = np.unique(label[close], return_index=True)
            if len(joined):
                tails.append(np.full(len(joined), nodes[row]))
                heads.append(nodes[close[first]])
                label[np.isin(label, joined)] = label[row]
        if tails:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tails)), pa.array(np.concatenate(heads))], names=["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def tile() -> Iterator[pa.RecordBatch]:
            if sum(x.num_rows for x in held) < 2:
                return
            columns = list(zip(*(x.columns[3:] for x in held)))
            numbers = [np.concatenate([x.to_numpy() for x in columns[k]]) for k in range(len(columns)) if k != 4]
            sets = [v.as_buffer() for x in columns[4] for v in x]
            yield from linked(held[0].column(1)[0] == held[0].column(2)[0], *numbers[:4], sets, *numbers[4:])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in range(3)], axis=1)
            cuts = [0, *(1 + np.flatnonzero((keys[1:] != keys[:-1]).any(1))), batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                if held and tuple(held[-1].column(k)[0].as_py() for k in range(3)) != tuple(keys[start].tolist()):
                    yield from tile()
                    held.clear()
                held.append(batch.slice(start, end - start))
        if held:
            yield from tile()

    return each


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` (a, b) whose ``sets`` (node, shingles) have the Jaccard similarity or more, as a table."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.sort(np.concatenate((x, y)), kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                good.append(shared >= similarity * (len(both) - shared) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    one, other = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    return written(pairs.join(one, "a").join(other, "b").select("a", "b", "x", "y").mapInArrow(check, "a long, b long"), "links")


def _shingle_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """``node, shingles`` of ``wanted`` (node, text_id), a written table. Of ``docs`` only texts that a filter of text_id lets pass move."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(raw, width)).tobytes() for raw in blobs(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    maps, bits = bloom.members(wanted, "text_id")
    rows = docs.select(F.xxhash64("text").alias("text_id"), "text")
    possible = bloom.flagged(rows, bloom.positions_of(F.col("text_id"), bits), maps, "possible").where("possible").drop("possible")
    texts = possible.join(wanted, "text_id").groupBy("node").agg(F.first("text").alias("text"))
    return written(texts.mapInArrow(gather, "node long, shingles binary"), "sets")


def similar_groups(docs: DataFrame, width: int = 5, similarity: float = 0.8, index: Index = Index(), members: int = TILE_MEMBERS, shingles: int = TILE_SHINGLES) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): component_id, the smallest doc_id reached over links of ``similarity`` or more."""
    words = [f"w{k}" for k in range(index.words)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, named, sizes = [], [], []
            for raw in blobs(batch.column("text")):
                hashes = shingle_hashes(raw, width)
                found = np.unique(hashes)
                prints.append(wide_fingerprint(hashes, index.words))
                named.append(np.add.reduce(_scrambled(found + _GOLDEN), dtype=np.uint64))
                sizes.append(len(found))
            prints = np.array(prints, np.uint64).reshape(-1, index.words)
            columns = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (np.array(named, np.uint64), *prints.T)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_id"), pa.array(sizes, pa.int64()), *columns], names=["doc_id", "text_id", "n", "node", *words])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"), "text")
    prints = written(rows.mapInArrow(each, "doc_id long, text_id long, n long, node long, " + ", ".join(f"{w} long" for w in words)), "fingerprints")
    # equal shingle sets are one node
    first = [F.min("doc_id").alias("low"), F.min("text_id").alias("text_id"), F.first("n").alias("n"), *[F.first(w).alias(w) for w in words]]
    nodes = written(prints.groupBy("node").agg(*first), "nodes")
    edges = _candidate_edges(nodes, index, similarity)
    canopies = components(sparse(edges)).withColumnRenamed("root", "canopy")
    active = written(canopies.join(nodes.drop("low"), "node"), "active")
    sets = _shingle_sets(docs, active.select("node", "text_id"), width)
    tiles, before = _tiles(active.drop("text_id"), edges, sets, similarity, members, shingles)
    order = ["canopy", "i", "j"]
    tiles = tiles.join(sets, "node").select(*order, "block", "root", "node", "n", "shingles", *words).repartition(*order).sortWithinPartitions(*order)
    linked = written(tiles.mapInArrow(_linked_tiles(index, similarity), "a long, b long"), "links")
    linked = linked if before is None else linked.union(before)
    return prints.select("doc_id", "node").join(component_ids(nodes.select("node", "low"), sparse(linked), "node"), "node").select("doc_id", "component_id")


def keep_one(docs: DataFrame, width: int = 5, similarity: float = 0.8, index: Index = Index()) -> DataFrame:
    """``docs`` with one document of each near-duplicate group, that of the smallest doc_id; all columns stay.

    Rows without doc_id stay, and rows that share a doc_id share its fate. No
    text is moved for it but the few that a filter takes for leaving ones.
    """
    found = written(similar_groups(docs, width, similarity, index), "groups")
    leave = written(found.where("doc_id <> component_id").select("doc_id").distinct(), "leave")
    return bloom.without(docs, [F.col("doc_id").cast("long")], found.select("doc_id"), leave)
