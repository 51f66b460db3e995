"""N-gram Jaccard join by parity sketches, and the connected groups of its links.

Documents are sets of word shingles. For every size band a document is sketched
in ``d + 1`` segments of 64 bits, ``d`` being the most shingles in which two
linked sets of that band can differ. Every shingle flips one bit of one segment,
so each shingle in which two sets differ touches at most one bit: the Hamming
distance of sketches never exceeds the symmetric difference, and of linked sets
at least one segment is equal. Segments are joined by value, candidates pass the
Hamming bound of a second sketch and are then verified on the sets themselves.

The work is dealt in blocks of documents. Within a block, all links between
documents that share a segment are found, copies and known groups needing no
pairs. Between blocks one representative stands for the documents of a block that
share a segment; where that leaves a question open, the rest is compared in
blocks of a bounded size. So no link is lost, and no group is expanded in pairs
without a Hamming bound in front.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from urbanweave.llm.common import ascii_space, forget_others, keyed_texts, lets_go, meeting, slices
from urbanweave.runtime import settle, settle_counted, settle_with, small_side

BAND_RATIO = 1.25
#: A segment of fewer elements is too often empty to be a key by itself.
FULL_SEGMENT = 6
BLOCK_SHINGLES = 1_000_000
PART = 1024
#: Keys of a bucket that are sorted at a time.
MEETING_KEYS = 400_000
#: Pairs of a meeting whose distances are worked out at a time.
MEETING_PAIRS = 250_000
#: Links that a task contracts at a time.
SLICE_EDGES = 200_000
#: Pairs of a document that are judged at once.
FIRST_ROUND = 4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_U = np.uint64
REST = 16
_LOW = _U((1 << REST) - 1)
#: Documents of a block at most; the bits of a node that are its row in the block.
BLOCK_ROWS = 30_000
_ROW_BITS = 16


@dataclass(frozen=True)
class Rule:
    """``words`` per shingle; sets link when ``whole`` * intersection >= ``share`` * union."""

    words: int = 3
    share: int = 90
    whole: int = 100

    def links(self, inter, a, b):
        return self.whole * inter >= self.share * (a + b - inter)

    def partner(self, size: int) -> int:
        """Largest set that can link with one of ``size``."""
        return size * self.whole // self.share

    def apart(self, size: int) -> int:
        """Most elements in which a set of at most ``size`` and a linked one, not smaller, differ."""
        return size * (self.whole - self.share) // self.share


class _Words(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, words: int, known: _Words | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: the lower-cased words' runs of ``words``, or the one shorter run."""
    tokens = ascii_space(text).translate(_LOWER).split()
    if not tokens:
        return np.zeros(0, _U)
    known = _Words() if known is None else known
    hashes = np.array(list(map(known.__getitem__, tokens)), _U)
    size = min(words, len(tokens))
    run = np.full(len(tokens) - size + 1, size, _U)
    for i in range(size):
        run = _mix(run * _U(0x9E3779B97F4A7C15) + hashes[i : len(tokens) - size + 1 + i])
    return np.unique(run)


def bands(largest: int) -> list[tuple[int, int]]:
    """Size bands (first, last) up to ``largest``."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * BAND_RATIO) - 1)
        out.append((low, high))
        low = high + 1
    return out


def _flat(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return (np.concatenate(sets) if sets else np.zeros(0, _U)), np.array([len(s) for s in sets], np.int64)


def sketch(sets: list[np.ndarray], segments: int, seed: int) -> np.ndarray:
    """Parity sketches, one row of ``segments`` words per set: every element flips one bit."""
    out = np.zeros((len(sets), segments), _U)
    step = max(1, 1_000_000 // (64 * segments))
    for at in range(0, len(sets), step):
        values, counts = _flat(sets[at : at + step])
        hashes = _mix(values + _U((seed * 0x9E3779B97F4A7C15 + 1) & 0xFFFFFFFFFFFFFFFF))
        cell = ((hashes >> _U(32)) * _U(segments) >> _U(32)) * _U(64) + (hashes & _U(63))
        row = np.repeat(np.arange(len(counts)), counts)
        flips = np.bincount(row * (64 * segments) + cell.astype(np.int64), minlength=len(counts) * 64 * segments)
        bits = np.packbits((flips & 1).astype(np.uint8), bitorder="little")
        out[at : at + step] = bits.view("<u8").reshape(len(counts), segments)
    return out


def blocking(rule: Rule, low: int, high: int) -> tuple[int, int, list[tuple[int, ...]]]:
    """Blocks, segments of a block, and the sets of its segments that are keys, for sets of ``low`` to ``high`` elements.

    Of ``d + 1`` segments linked sets share one, ``d`` being the most elements in which
    they differ. Where such segments are thin, unrelated sets would share empty ones.
    Then there are so many blocks that one of them holds at most ``t`` differing elements;
    of its four segments all but ``t`` are equal, so every ``4 - t`` of them are a key.
    """
    apart = rule.apart(high)
    if low >= FULL_SEGMENT * (apart + 1):
        return apart + 1, 1, [(0,)]
    spared = min(2, apart)
    return apart // (spared + 1) + 1, 4, list(combinations(range(4), 4 - spared))


def segment_keys(sets: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the non-empty sets, and the set each belongs to; linked sets share one."""
    keys, owners = keys_with_rest(sets, rule)
    return keys & ~_LOW, owners


def keys_with_rest(sets: list[np.ndarray], rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Keys (band, segments, their values) of the non-empty sets, and the set each belongs to.

    A set has the keys of its own band, and of lower bands in which it can be the
    larger set of a linked pair. The low ``REST`` bits of a key are no part of its
    value: they are the other segments of the block, folded. Where the key shows a
    linked pair, these differ in at most two bits.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    keys, owners = [], []
    for number, (low, high) in enumerate(bands(int(sizes.max(initial=0)))):
        inside = np.flatnonzero((sizes >= low) & (sizes <= rule.partner(high)))
        if len(inside):
            blocks, parts, chosen = blocking(rule, low, high)
            words = sketch([sets[i] for i in inside.tolist()], blocks * parts, number + 1)
            place = _mix(np.arange(blocks * parts, dtype=_U) + _U(number << 32))
            plain = words.reshape(len(inside), blocks, parts)
            words = _mix(words + place[None, :]).reshape(plain.shape)
            for some in chosen:
                key, rest = words[:, :, some[0]], np.zeros(plain.shape[:2], _U)
                for i in some[1:]:
                    key = _mix(key * _U(0x9E3779B97F4A7C15) + words[:, :, i])
                for i in set(range(parts)) - set(some):
                    rest ^= plain[:, :, i]
                rest ^= rest >> _U(32)
                rest ^= rest >> _U(16)
                keys.append(((key & ~_LOW) | (rest & _LOW)).ravel())
                owners.append(np.repeat(inside, blocks))
    return (np.concatenate(keys), np.concatenate(owners)) if keys else (np.zeros(0, _U), np.zeros(0, np.int64))


def _common(a: np.ndarray, b: np.ndarray) -> int:
    spot = np.searchsorted(b, a)
    return int((b[np.minimum(spot, len(b) - 1)] == a).sum()) if len(b) else 0


def wide_sketches(sets: list[np.ndarray]) -> list[bytes]:
    """One parity sketch per set, of 512 bits times a power of two, at least as many bits as elements."""
    levels = np.array([max(0, (len(s) - 1).bit_length() - 9) if len(s) else 0 for s in sets], np.int64)
    out: list[bytes] = [b""] * len(sets)
    for level in np.unique(levels).tolist():
        bits = 512 << level
        chosen, step = np.flatnonzero(levels == level), max(1, 1_000_000 // bits)
        for at in range(0, len(chosen), step):
            part = chosen[at : at + step].tolist()
            values, counts = _flat([sets[i] for i in part])
            cell = (_mix(values + _U(1)) & _U(bits - 1)).astype(np.int64) + np.repeat(np.arange(len(part)) * bits, counts)
            flips = np.bincount(cell, minlength=len(part) * bits)
            rows = np.packbits((flips & 1).astype(np.uint8), bitorder="little").reshape(len(part), bits // 8)
            for i, row in zip(part, rows, strict=True):
                out[i] = row.tobytes()
    return out


class Pyramid:
    """Sketches of several widths; a wider one is folded by XOR to the width of the other."""

    def __init__(self, drawn: list[bytes]):
        self.level = np.array([(len(d) // 64).bit_length() - 1 for d in drawn], np.int64)
        self.rows: dict[int, np.ndarray] = {}
        self.place: dict[int, np.ndarray] = {}
        for level in range(int(self.level.max(initial=-1)), -1, -1):
            words = 8 << level
            members = np.flatnonzero(self.level >= level)
            matrix = np.zeros((len(members), words), _U)
            place = np.full(len(drawn), -1)
            place[members] = np.arange(len(members))
            own = np.flatnonzero(self.level == level)
            if len(own):
                matrix[place[own]] = np.frombuffer(b"".join([drawn[i] for i in own.tolist()]), "<u8").reshape(-1, words)
            if level + 1 in self.rows:
                wider = self.rows[level + 1]
                matrix[place[np.flatnonzero(self.level > level)]] = wider[:, :words] ^ wider[:, words:]
            self.rows[level], self.place[level] = matrix, place

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hamming distances of the pairs (a, b): never more than the elements in which the sets differ."""
        out = np.zeros(len(b), np.int64)
        common = np.minimum(self.level[a], self.level[b])
        for level in np.unique(common).tolist():
            here = np.flatnonzero(common == level)
            for at in range(0, len(here), max(1, 100_000 >> level)):
                part = here[at : at + max(1, 100_000 >> level)]
                x, y = (self.rows[level][self.place[level][i[part]]] for i in (a, b))
                out[part] = np.bitwise_count(x ^ y).sum(axis=1)
        return out


def may_link(rule: Rule, size_a, size_b, distance):
    """Whether sizes and the Hamming bound leave a link possible."""
    small, large = np.minimum(size_a, size_b), np.maximum(size_a, size_b)
    # |A ^ B| = a + b - 2 * inter, and a link needs inter >= share * (a + b) / (whole + share).
    most = size_a + size_b - 2 * (-(-rule.share * (size_a + size_b) // (rule.whole + rule.share)))
    return (rule.whole * small >= rule.share * large) & (distance <= most)


class _Forest:
    def __init__(self, size: int):
        self.up = list(range(size))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)


def _groups(keys: np.ndarray, owners: np.ndarray) -> list[np.ndarray]:
    """Distinct sets of owners (two and more, sorted) that share a key."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[heads, len(keys)])
    found = {}
    for head, count in zip(heads[counts > 1].tolist(), counts[counts > 1].tolist(), strict=True):
        members = owners[head : head + count]
        found.setdefault(members.tobytes(), members)
    return list(found.values())


def link_block(sets: list[np.ndarray], groups: list[np.ndarray], rule: Rule, forest: _Forest) -> None:
    """Join in ``forest`` all sets of a group that are linked, directly or by others of it."""
    wide = Pyramid(wide_sketches(sets))
    sizes = np.array([len(s) for s in sets], np.int64)
    tried: set[tuple[int, int]] = set()

    def against(one: int, others: np.ndarray) -> None:
        possible = others[may_link(rule, sizes[one], sizes[others], wide.distances(np.full(len(others), one), others))]
        for other in possible.tolist():
            pair = (min(one, other), max(one, other))
            if pair not in tried and forest.root(one) != forest.root(other):
                tried.add(pair)
                if rule.links(_common(sets[one], sets[other]), len(sets[one]), len(sets[other])):
                    forest.join(one, other)

    for members in groups:
        against(int(members[0]), members[1:])
    for members in groups:
        roots = np.array([forest.root(i) for i in members.tolist()])
        if len(members) > 2 and (roots != roots[0]).any():
            for at, one in enumerate(members[1:-1].tolist(), 1):
                rest = members[at + 1 :]
                against(one, rest[np.array([forest.root(i) for i in rest.tolist()]) != forest.root(one)])


_BLOCK = "kind byte, bucket int, block long, longs binary, more binary"
_NODES, _KEYS, _MEMBERS = 0, 1, 2


def _bytes(values, kind="<i8") -> bytes:
    return np.asarray(values).astype(kind).tobytes()


def _describe_block(block: int, rows: list[tuple], rule: Rule, buckets: int) -> Iterator[tuple]:
    """What a block tells: its documents with their local groups, one key row per bucket, and the further members of keys."""
    sets = [found for _, found, _ in rows]
    forest = _Forest(len(rows))
    first: dict[bytes, int] = {}
    for i, s in enumerate(sets):  # equal sets are linked without a comparison
        if len(s):
            forest.join(first.setdefault(s.tobytes(), i), i)
    marks = np.zeros((2, len(rows)), np.int64)  # 128 bits of the set, for the first document of each
    for data, i in first.items():
        marks[:, i] = np.frombuffer(xxhash.xxh128_digest(data), "<i8")
    kept = np.array(sorted(first.values()), np.int64)
    distinct = [sets[i] for i in kept.tolist()]
    keys, owners = keys_with_rest(distinct, rule)
    inner = _Forest(len(distinct))
    link_block(distinct, _groups(keys >> _U(REST), owners), rule, inner)
    for i, at in enumerate(kept.tolist()):
        forest.join(at, int(kept[inner.root(i)]))

    roots = np.array([forest.root(i) for i in range(len(rows))], np.int64)
    base = block << _ROW_BITS
    ids = [r[0] for r in rows]
    nulls = np.array([i is None for i in ids])
    plain = np.array([0 if i is None else i for i in ids], np.int64)
    node = np.arange(len(rows)) + base
    texts = np.array([r[2] for r in rows], np.int64)
    columns = (node, plain, nulls, [len(s) for s in sets], roots + base, texts, *marks)
    yield _NODES, buckets + block % buckets, block, _bytes(np.stack([np.asarray(c, np.int64) for c in columns])), b"".join(wide_sketches(sets))

    owners = kept[owners]
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    heads = np.r_[True, keys[1:] != keys[:-1]] if len(keys) else np.zeros(0, bool)
    bucket = ((keys >> _U(REST)) % _U(buckets)).astype(np.int64)
    order = np.argsort(bucket[heads], kind="stable")
    first_keys, first_owners, at = keys[heads][order], owners[heads][order], bucket[heads][order]
    # A key whose documents are not all in one local group is open if it is found elsewhere.
    heads_at = np.flatnonzero(heads)
    roots_of = roots[owners]
    mixed = np.zeros(len(heads_at), bool)
    if len(heads_at):
        mixed = np.maximum.reduceat(roots_of, heads_at) != np.minimum.reduceat(roots_of, heads_at)
    flags = mixed[order]
    cuts = np.searchsorted(at, np.arange(buckets + 1))
    for number in np.unique(at).tolist():
        part = slice(int(cuts[number]), int(cuts[number + 1]))
        yield _KEYS, number, block, _bytes(first_keys[part], "<u8"), _bytes(first_owners[part] * 2 + flags[part], "<i4")
    if (~heads).any():
        yield _MEMBERS, buckets + block % buckets, block, _bytes(keys[~heads], "<u8"), _bytes(owners[~heads] + base)


def _blocks(texts: DataFrame, rule: Rule, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        task, seen, known = TaskContext.get().partitionId(), 0, _Words()
        rows, size = [], 0

        def describe():
            if seen >> 24:
                raise OverflowError("a task has more blocks than can be numbered; deal the documents over more partitions")
            out = list(zip(*_describe_block(task << 24 | seen, rows, rule, buckets), strict=True))
            kinds = (pa.int8(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
            names = ["kind", "bucket", "block", "longs", "more"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

        for batch in (part for whole in batches for part in slices(whole)):
            for key, text, text_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append((key, shingles(text, rule.words, known), text_id))
                size += len(rows[-1][1])
                if size >= BLOCK_SHINGLES or len(rows) >= BLOCK_ROWS:
                    yield describe()
                    rows, size, seen = [], 0, seen + 1
        if rows:
            yield describe()

    return texts.mapInArrow(lets_go(run), _BLOCK)


def _nodes(met: DataFrame) -> DataFrame:
    """One row per document."""
    schema = "node long, doc_id long, n_shingles long, root long, text_id long, mark_a long, mark_b long, sketch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, drawn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                node, ids, nulls, sizes, roots, texts, *marks = np.frombuffer(held, "<i8").reshape(8, -1)
                widths = [64 << (max(0, (n - 1).bit_length() - 9) if n else 0) for n in sizes.tolist()]
                ends = np.cumsum(widths).tolist()
                sketches = [drawn[e - w : e] for e, w in zip(ends, widths, strict=True)]
                kinds = [node, pa.array(ids, mask=nulls.astype(bool)), sizes, roots, texts, *marks]
                yield pa.RecordBatch.from_arrays(
                    [*(c if isinstance(c, pa.Array) else pa.array(c) for c in kinds), pa.array(sketches, pa.binary())],
                    names=["node", "doc_id", "n_shingles", "root", "text_id", "mark_a", "mark_b", "sketch"],
                )

    return met.where(F.col("kind") == _NODES).select("longs", "more").mapInArrow(run, schema)


def _twins(nodes: DataFrame) -> DataFrame:
    """(node, twin): the first documents of equal sets in other blocks, with the first one of all."""
    firsts = nodes.where("mark_a <> 0 or mark_b <> 0").select("node", "n_shingles", "mark_a", "mark_b")
    keys = ["n_shingles", "mark_a", "mark_b"]
    return firsts.join(firsts.groupBy(*keys).agg(F.min("node").alias("twin")), keys).where("node <> twin").select("node", "twin")


def _clusters(heads: np.ndarray, counts: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Per row the first row of its cluster: rows of a key whose folded rest differs in at most two bits, directly or by others.

    Links lie within clusters, so a key that many unrelated documents share falls apart.
    """
    out = np.repeat(heads, counts)
    for size in np.unique(counts[counts > 1]).tolist():
        chosen = heads[counts == size]
        if size > 4096:  # one cluster, which loses no link
            continue
        for part in np.array_split(chosen, 1 + len(chosen) * size * size // 1_000_000):
            rows = part[:, None] + np.arange(size)[None, :]
            near = np.bitwise_count(rest[rows][:, :, None] ^ rest[rows][:, None, :]) <= 2
            label = np.broadcast_to(np.arange(size, dtype=np.int16), rows.shape)
            while True:
                low = np.where(near, label[:, None, :], np.int16(size)).min(axis=2)
                if (low == label).all():
                    break
                label = low
            out[rows] = np.take_along_axis(rows, label.astype(np.int64), axis=1)
    return out


_MET = "kind byte, key long, unit long, a long, b long, mixed boolean, longs binary, more binary"


def _met(blocks: DataFrame) -> DataFrame:
    """Keys found in several blocks, and what blocks tell besides, in one shuffle of the blocks.

    Per cluster of a key its representatives ``b`` against the first of them ``a``,
    and whether a block is open; ``key`` is the first one's key with its rest,
    ``unit`` that of ``b``.
    """

    names = ["kind", "key", "unit", "a", "b", "mixed", "longs", "more"]

    def stars(keys: np.ndarray, node: np.ndarray, mixed: np.ndarray) -> pa.Table:
        order = np.lexsort((node, keys >> _U(REST)))
        keys, node, mixed = keys[order], node[order], mixed[order]
        value = keys >> _U(REST)
        heads = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        cluster = _clusters(heads, np.diff(np.r_[heads, len(keys)]), (keys & _LOW).astype(np.uint16))
        open_ = np.zeros(len(keys), bool)
        open_[cluster[mixed]] = True
        rest = np.flatnonzero(cluster != np.arange(len(keys)))
        first = cluster[rest]
        longs = [keys[first].view(np.int64), keys[rest].view(np.int64), node[first], node[rest]]
        empty = pa.nulls(len(rest), pa.binary())
        columns = [pa.array(np.full(len(rest), _KEYS, np.int8)), *map(pa.array, longs), pa.array(open_[first]), empty, empty]
        return pa.table(columns, names=names)

    def meet(table: pa.Table) -> Iterator[pa.Table]:
        told = table.filter(pc.not_equal(table["kind"], _KEYS))
        none = pa.nulls(len(told), pa.int64())
        columns = [told["kind"], none, none, none, none, pa.nulls(len(told), pa.bool_()), told["longs"], told["more"]]
        yield pa.table(columns, names=names)
        table = table.filter(pc.equal(table["kind"], _KEYS))
        if not len(table):
            return
        keys = np.concatenate([np.frombuffer(x.as_buffer(), "<u8") for x in table["longs"]])
        owners = np.concatenate([np.frombuffer(x.as_buffer(), "<i4") for x in table["more"]])
        lengths = [len(x.as_buffer()) // 8 for x in table["longs"]]
        base, table = table["block"].to_numpy() << _ROW_BITS, None
        # Only part of the keys is sorted at a time; equal values have equal high bits.
        bits = max(0, len(keys) // MEETING_KEYS).bit_length()
        high = (keys >> _U(64 - bits)).astype(np.int32) if bits else np.zeros(len(keys), np.int32)
        for number in range(1 << bits):
            at = np.flatnonzero(high == number)
            if len(at):
                block = np.searchsorted(np.cumsum(lengths), at, side="right")
                yield stars(keys[at], (owners[at] >> 1) + base[block], (owners[at] & 1).astype(bool))

    return blocks.groupBy("bucket").applyInArrow(meeting(meet), _MET)


def _members(met: DataFrame) -> DataFrame:
    """(unit, node) of the documents that are not their block's representative of a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, nodes in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.frombuffer(keys, "<i8")), pa.array(np.frombuffer(nodes, "<i8"))], names=["unit", "node"]
                )

    return met.where(F.col("kind") == _MEMBERS).select("longs", "more").mapInArrow(run, "unit long, node long")


def _sets(asked: DataFrame, nodes: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """(node, shingles) of the asked nodes, made once from the texts and written."""
    wanted, rows = settle_counted(nodes.join(asked, "node").select("node", F.col("doc_id").alias("of"), "text_id"))
    # The ids are broadcast only when counted few; else texts and ids meet by a shuffle.
    found = texts.join(small_side(wanted, rows), F.col("doc_id").eqNullSafe(F.col("of")) & (texts.text_id == wanted.text_id))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in (part for whole in batches for part in slices(whole)):
            sets = [_bytes(shingles(t, rule.words, known), "<u8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["node", "shingles"])

    sets = found.select("node", "text").mapInArrow(lets_go(cut), "node long, shingles binary")
    if nodes.groupBy("doc_id", "text_id").count().where("count > 1").limit(1).count():
        sets = sets.dropDuplicates(["node"])  # a repeated row gives its set again; either will do
    return settle(sets)


def _judged(pairs: DataFrame, rows: int, sets: DataFrame, rule: Rule) -> DataFrame:
    """``pairs`` (a, b) with ``linked``. The set of ``b`` travels to ``a``; a hot ``a`` is a skewed join key, which Spark splits."""
    right = sets.join(small_side(pairs, rows), F.col("node") == F.col("b")).select("a", "b", F.col("shingles").alias("set_b"))
    firsts = small_side(pairs.select(F.col("a").alias("node")).distinct(), rows)
    left = sets.join(firsts, "node", "left_semi").select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            verdicts = []
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                a, b = (np.frombuffer(x.as_buffer(), "<u8") for x in (a, b))
                verdicts.append(bool(rule.links(_common(a, b), len(a), len(b))))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(verdicts, pa.bool_())], names=["a", "b", "linked"])

    both = right.join(left, "a").select("a", "b", "set_a", "set_b")
    return settle(both.mapInArrow(lets_go(judge), "a long, b long, linked boolean"))


def _grouped(nodes: DataFrame, groups: tuple[DataFrame, int], *columns: str) -> DataFrame:
    """``columns`` of the nodes and the group they are in so far."""
    side = small_side(groups[0], groups[1])
    return nodes.join(side, nodes.root == side.at, "left").select(*columns, F.coalesce("group", "root").alias("group"))


def _grow(pairs: DataFrame, links: DataFrame, groups: tuple[DataFrame, int], nodes: DataFrame, rows_of: int, texts: DataFrame, rule: Rule):
    """Judge ``pairs`` until each is linked, not linked, or within one group; returns links, groups and the pairs not linked.

    Only pairs whose ends still lie in different groups are judged. Where there are
    few for each document, that is one round. Else the first round takes
    ``FIRST_ROUND`` per document, the next four times as many, and so on, so that most
    pairs of a large group are never needed. ``rows_of`` counts ``nodes``.
    """
    sets, missed, width = None, [], FIRST_ROUND
    while True:
        known = _grouped(nodes, groups, "node")
        for side in "ab":
            pairs = pairs.join(small_side(known.withColumnsRenamed({"node": side, "group": f"group_{side}"}), rows_of), side)
        apart, rows = settle_counted(pairs.where("group_a <> group_b").select("a", "b"))
        if not rows:
            return links, groups, missed
        if sets is None:
            sets = _sets(apart.select(F.explode(F.array("a", "b")).alias("node")).distinct(), nodes, texts, rule)
        lead, ahead = apart, rows
        if rows > width * apart.select("b").distinct().count():
            nth = F.row_number().over(W.partitionBy("b").orderBy("a"))
            lead, ahead = settle_counted(apart.withColumn("nth", nth).where(F.col("nth") <= width).select("a", "b"))
        judged = _judged(lead, ahead, sets, rule)
        missed.append(judged.where("not linked").select("a", "b"))
        ends, met = judged.where("linked"), nodes.select(F.col("node").alias("at"), "root")
        for side in "ab":
            ends = met.withColumnsRenamed({"at": side, "root": f"root_{side}"}).join(small_side(ends, ahead), side)
        links = links.unionByName(settle(ends.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()))
        groups = _connected(links)
        if ahead == rows:
            return links, groups, missed
        pairs, width = apart.join(lead, ["a", "b"], "left_anti"), min(width * 4, 1 << 30)


def _possible(pairs: DataFrame, rows: int, nodes: DataFrame, rule: Rule) -> DataFrame:
    """``pairs``, counted, that sizes and the Hamming bound of the sketches leave possible."""
    of = [nodes.select(F.col("node").alias(x), F.col("n_shingles").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}")) for x in "ab"]
    asked = small_side(pairs.select("b").distinct(), rows)
    pairs = of[0].join(small_side(pairs, rows), "a").join(of[1].join(asked, "b", "left_semi"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 2000)):
            a, b, n_a, n_b = (batch.column(n).to_numpy() for n in ("a", "b", "n_a", "n_b"))
            drawn = Pyramid(batch.column("s_a").to_pylist() + batch.column("s_b").to_pylist())
            at = np.arange(len(a))
            near = may_link(rule, n_a, n_b, drawn.distances(at, at + len(a)))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(near)], names=["a", "b", "near"])

    return pairs.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(lets_go(run), "a long, b long, near boolean")


def _open_pairs(open_keys: DataFrame, stars: DataFrame, members: DataFrame, nodes: DataFrame, known: DataFrame, count: int, rule: Rule, buckets: int) -> DataFrame:
    """Pairs (a, b) of the open keys that lie in different groups so far and may link, each once.

    The documents of a key are dealt into parts of about ``PART``, and each two
    parts meet. The meetings are dealt over ``buckets``; in each, the Hamming bound
    stands in front of any output.
    """
    # Every document of a key once: the first representative, the others, and the further members of blocks.
    ours = settle(stars.join(open_keys, "key", "left_semi"))
    first = ours.groupBy("key").agg(F.min("a").alias("node"))
    units = ours.select("key", F.explode(F.array("key", "unit")).alias("unit")).distinct()
    rows = first.unionByName(ours.select("key", F.col("b").alias("node"))).unionByName(members.join(units, "unit").select("key", "node"))
    placed = settle(rows.join(small_side(known, count), "node"))
    sizes = placed.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("group").alias("low"),
        F.max("group").alias("high"),
        *[F.sum(F.xxhash64("node", F.lit(seed)).cast("decimal(38,0)")).alias(f"same{seed}") for seed in (1, 2)],
    )
    # Keys with the same documents ask the same question, so one of them is enough.
    sizes = sizes.where("low < high").groupBy("n", "same1", "same2").agg(F.min("key").alias("key"))
    parts = settle(sizes.select("key", F.ceil(F.col("n") / F.lit(PART)).cast("int").alias("parts")))
    placed = placed.join(parts.select("key"), "key", "left_semi").join(nodes.select("node", "n_shingles", "sketch"), "node")
    dealt = placed.join(parts, "key").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # Part p meets part q in (p, q): each row goes to all meetings of its part.
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sent = dealt.withColumn("other", other).select(
        "key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "node", "n_shingles", "sketch", "group"
    )

    def meet(table: pa.Table) -> Iterator[pa.Table]:
        key, p, q, part, node = (table[c].to_numpy() for c in ("key", "p", "q", "part", "node"))
        nodes, first, index = np.unique(node, return_index=True, return_inverse=True)
        size, group = (table[c].to_numpy()[first] for c in ("n_shingles", "group"))
        drawn = Pyramid(table["sketch"].take(pa.array(first)).to_pylist())
        order = np.lexsort((node, q, p, key))
        key, p, q, part, index = key[order], p[order], q[order], part[order], index[order]
        heads = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (p[1:] != p[:-1]) | (q[1:] != q[:-1])])
        found, pending, count = [], [], 0
        half: dict[int, tuple[np.ndarray, np.ndarray]] = {}

        def judge():
            a, b = (np.concatenate(x) for x in zip(*pending, strict=True))
            a, b = np.minimum(a, b), np.maximum(a, b)
            apart = np.unique((a * len(nodes) + b)[group[a] != group[b]])  # each pair once, however many keys it shares
            a, b = apart // len(nodes), apart % len(nodes)
            near = may_link(rule, size[a], size[b], drawn.distances(a, b))
            found.append((nodes[a[near]], nodes[b[near]]))

        for head, end in zip(heads.tolist(), [*heads[1:].tolist(), len(key)], strict=True):
            members = index[head:end]
            if p[head] == q[head]:
                if len(members) not in half:
                    half[len(members)] = np.triu_indices(len(members), 1)
                i, j = half[len(members)]
                a, b = members[i], members[j]
            else:
                left, right = members[part[head:end] == p[head]], members[part[head:end] == q[head]]
                a, b = np.repeat(left, len(right)), np.tile(right, len(left))
            pending.append((a, b))
            count += len(a)
            if count > MEETING_PAIRS:
                judge()
                pending, count = [], 0
                half.clear()
        if pending:
            judge()
        a, b = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        yield pa.table([pa.array(a), pa.array(b)], names=["a", "b"])

    # More and smaller groups than keys are dealt into, since rows carry sketches here.
    meetings = sent.withColumn("bucket", F.pmod(F.xxhash64("key", "p", "q"), F.lit(4 * buckets)))
    return meetings.groupBy("bucket").applyInArrow(meeting(meet), "a long, b long").distinct()


def _contracted(edges: DataFrame) -> DataFrame:
    """(u, v), v the smaller: the edges of each slice, every node led to the smallest one that they connect it with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def forest() -> pa.RecordBatch:
            a, b = (np.concatenate(x) for x in zip(*held, strict=True))
            nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
            joined = _Forest(len(nodes))
            for i, j in zip(ends[: len(a)].tolist(), ends[len(a) :].tolist(), strict=True):
                joined.join(i, j)
            low = np.array([joined.root(i) for i in range(len(nodes))], np.int64)
            led = np.flatnonzero(low < np.arange(len(nodes)))
            return pa.RecordBatch.from_arrays([pa.array(nodes[led]), pa.array(nodes[low[led]])], names=["u", "v"])

        for batch in (part for whole in batches for part in slices(whole, SLICE_EDGES)):
            if rows + batch.num_rows > SLICE_EDGES:
                yield forest()
                held, rows = [], 0
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            rows += batch.num_rows
        if held:
            yield forest()

    return edges.mapInArrow(lets_go(run), "u long, v long")


def connect(edges: DataFrame) -> DataFrame:
    """Connected groups of ``edges`` (a, b), written: (at, group), the group being its smallest member."""
    return _connected(edges)[0]


def _connected(edges: DataFrame) -> tuple[DataFrame, int]:
    """``connect``, with the number of its rows.

    Slices of edges are contracted first; one slice is then done. Of several, large
    and small stars alternate (every node points its larger, then all its neighbours
    to the smallest one) until nothing changes. Each step is a grouped minimum and a
    join on the node, and the number of edges never grows.
    """
    counts = {"rows": F.count("u"), "sum": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    edges, rows = settle_counted(edges.select("a", "b"))
    parts = -(-rows // SLICE_EDGES)
    edges, before = settle_with(_contracted(edges.coalesce(max(1, parts))).distinct() if parts > 1 else _contracted(edges.coalesce(1)), **counts)
    while parts > 1:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v").distinct()
        large = settle(large)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(joined.select("u", F.col("m").alias("v")))
        edges, after = settle_with(small.where("u > v").distinct(), **counts)
        if after == before:
            break
        before = after
    tops = edges.select(F.col("v").alias("at"), F.col("v").alias("group")).distinct()
    return settle_counted(edges.select(F.col("u").alias("at"), F.col("v").alias("group")).unionByName(tops))


def components(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, text_id, n_shingles, component_id, stays.

    component_id is the smallest doc_id that links lead to, the row's own
    included; a null doc_id is reached by links but never the smallest unless all
    are null. ``stays`` marks one row per group of linked rows (the smallest
    doc_id, then the first found). A null text and one without words have no
    shingle and stand alone. Repeated rows are linked like any copies. doc_id
    must be an integer; other columns of ``docs`` are not read.
    """
    rule = Rule() if rule is None else rule
    texts = keyed_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_id"))
    spark = docs.sparkSession
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // 20_000)
    found = settle(_met(_blocks(texts, rule, buckets)))
    nodes, count = settle_counted(_nodes(found))
    stars = found.where(F.col("kind") == _KEYS).select("key", "unit", "a", "b", "mixed")
    twins, copied = settle_counted(_twins(nodes))
    # Copies in other blocks are stood for by the first of them, so each pair of texts is judged once.
    met = stars.select("a", "b").distinct()
    for side in "ab":
        met = met.join(small_side(twins.withColumnsRenamed({"node": side, "twin": f"twin_{side}"}), copied), side, "left")
        met = met.withColumn(f"twin_{side}", F.coalesce(f"twin_{side}", side))
    met = settle(met.where("twin_a <> twin_b"))
    pairs, rows = settle_counted(met.select(F.least("twin_a", "twin_b").alias("a"), F.greatest("twin_a", "twin_b").alias("b")).distinct())
    pairs = settle(_possible(pairs, rows, nodes, rule))
    near = pairs.where("near").select("a", "b")
    roots = nodes.select("node", "root")
    copies = roots.join(small_side(twins, copied), "node").select("twin", F.col("root").alias("b"))
    first = roots.withColumnsRenamed({"node": "twin", "root": "a"})
    links = settle(first.join(small_side(copies, copied), "twin").select("a", "b").distinct())
    links, groups, missed = _grow(near, links, _connected(links), nodes, count, texts, rule)

    failed = pairs.where("not near").select("a", "b")
    for part in missed:
        failed = failed.unionByName(part)
    failed, rows = settle_counted(failed.select(F.col("a").alias("low"), F.col("b").alias("high")))
    between = (F.least("twin_a", "twin_b") == F.col("low")) & (F.greatest("twin_a", "twin_b") == F.col("high"))
    known = settle(_grouped(nodes, groups, "node"))
    # A pair that others have joined since leaves no question open.
    apart = met.join(small_side(failed, rows), between, "left_semi").select("a", "b")
    for side in "ab":
        apart = apart.join(small_side(known.withColumnsRenamed({"node": side, "group": f"group_{side}"}), count), side)
    open_pairs, rows = settle_counted(apart.where("group_a <> group_b").select("a", "b"))
    asked = stars.join(small_side(open_pairs, rows), ["a", "b"], "left_semi").select("key")
    open_keys, rows = settle_counted(asked.unionByName(stars.where("mixed").select("key")).distinct())
    rest = _open_pairs(small_side(open_keys, rows), stars, _members(found), nodes, known, count, rule, buckets)
    rest, more = settle_counted(rest.join(pairs.select("a", "b"), ["a", "b"], "left_anti"))
    if more:
        _, groups, _ = _grow(rest, links, groups, nodes, count, texts, rule)

    grouped = _grouped(nodes, groups, "node", "doc_id", "text_id", "n_shingles")
    # Rows of a block meet there first, so a group of any size has one row per block to join.
    best = grouped.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("best"))
    found = grouped.join(best, "group")
    return found.select("doc_id", "text_id", "n_shingles", F.col("best.doc_id").alias("component_id"), (F.col("best.node") == F.col("node")).alias("stays"))


def keep_one(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """Rows of ``docs``, all columns, of which one per group of linked rows stays.

    Rows go by doc_id and a hash of the text. Only of repeated rows (same id and
    text), of which one stays, the copies are parted from each other: the first one
    stays, in the order of all its columns as JSON. Null and empty texts, and texts
    without words, link with nothing and stay.
    """
    judged = components(docs, rule).groupBy("doc_id", "text_id").agg(F.max("stays").alias("any"), F.min("stays").alias("all"))
    judged = settle(judged.where("not all"))
    columns, gone = docs.columns, judged.where("not any").select(F.col("doc_id").alias("gone_id"), F.col("text_id").alias("gone_text"))
    hashed = F.xxhash64(docs["text"])
    same = docs["doc_id"].eqNullSafe(gone.gone_id) & (hashed == gone.gone_text)
    rest = docs.join(small_side(gone, gone.count()), same, "left_anti")
    twice = judged.where("any").select(F.col("doc_id").alias("twice_id"), F.col("text_id").alias("twice_text"))
    copies = twice.count()
    if not copies:
        return rest
    same = rest["doc_id"].eqNullSafe(twice.twice_id) & (F.xxhash64(rest["text"]) == twice.twice_text)
    single = rest.join(small_side(twice, copies), same, "left_anti")
    again = rest.join(small_side(twice, copies), same, "left_semi")
    # Rows travel as one column, so no column of theirs can clash with one made here.
    rows = again.select("doc_id", F.xxhash64("text").alias("text_id"), F.struct(*columns).alias("row"))
    nth = F.row_number().over(W.partitionBy("doc_id", "text_id").orderBy(F.to_json("row")))
    first = rows.select("row", nth.alias("nth")).where("nth = 1").select("row.*")
    return single.unionByName(first).select(*columns)
