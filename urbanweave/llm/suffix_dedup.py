"""Removal of long byte strings that a document with a smaller id has too.

Texts are cut where a window of ``length`` bytes changes its minimizer (the m-gram
of the window with the smallest hash). Equal windows have the same minimizer, so
windows meet by its value: in a first round only the minimizers travel, in a
second one hashes of the strings around those found in several documents, and in
a third one the strings themselves, where strings of a minimizer differ, each from
the blocks of documents with its smallest owner. A minimizer with very many
strings is split further, by the windows themselves. Answers travel as bits, in the
order of what was asked, which every round makes anew from the block.

Where strings of a minimizer differ, their equal windows are found on the
Burrows-Wheeler transform of the strings: intervals of common prefixes are
extended backward, breadth first, which yields the boundaries between suffixes in
order of their common prefix; it stops at ``length``, and what is not parted by
then shares a whole window.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.common import keyed_texts, slices
from urbanweave.runtime import settle_alone

LENGTH = 50
MER = 24
BLOCK_BYTES = 4_000_000
#: Strings of one minimizer above which its windows are dealt further, and bytes of one transform.
MOST_STRINGS, TRANSFORM_BYTES = 4096, 1_000_000
_GRAM = 7  # symbols of 9 bits that one key holds
_LAST = np.iinfo(np.int64).max
_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number (zeros behind the end)."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data),), "<u8", padded.data, strides=(1,)).copy()


def anchors(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH, mer: int = MER, chunk: int = 1 << 17):
    """Runs of windows with one minimizer: first and last window, document, hash of the minimizer.

    ``data`` holds documents end to end; windows lie within a document.
    """
    total, width = len(data) - length + 1, length - mer + 1
    if total < 1:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
    places = np.empty(total, np.int32)
    for at in range(0, total, chunk):
        count = min(chunk, total - at)
        words = _words(data[at : at + count + length - 1])
        n = count + width - 1
        scores = words[:n] * _U(0x9E3779B97F4A7C15)
        for k in sorted({*range(8, mer - 7, 8), mer - 8}):  # the m-gram in words of eight bytes
            scores ^= scores >> _U(31)
            scores += words[k : k + n] * _U(0xC2B2AE3D27D4EB4F)
        scores ^= scores >> _U(29)
        scores *= _U(0xBF58476D1CE4E5B9)
        # The place in the low bits: of equal scores the leftmost wins, in every window alike.
        scores &= _U(0xFFFFFFFFFFF00000)
        scores |= np.arange(n, dtype=_U)
        have = 1
        while have * 2 <= width:
            scores = np.minimum(scores[:-have], scores[have:])
            have *= 2
        if have < width:
            scores = np.minimum(scores[: have - width], scores[width - have :])
        places[at : at + count] = (scores & _U(0xFFFFF)).astype(np.int32) + at
    inside = np.zeros(total + 1, np.int8)
    long = sizes >= length
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, starts[long] + sizes[long] - length + 1, -1)
    inside = np.cumsum(inside[:-1], dtype=np.int8).astype(bool)
    change = places[1:] != places[:-1]
    first = np.flatnonzero(inside & np.r_[True, change | ~inside[:-1]])
    last = np.flatnonzero(inside & np.r_[change | ~inside[1:], True])
    at, keys = places[first].astype(np.int64), np.zeros(len(first), _U)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(0, mer, 8):
        word = np.zeros(len(first), _U)
        for i in range(min(8, mer - k)):
            word |= padded[at + k + i].astype(_U) << _U(8 * i)
        keys = _mix(keys * _U(0x9E3779B97F4A7C15) + word)
    return first, last, np.searchsorted(starts, first, "right") - 1, keys


def shared_window_owners(strings: list[bytes], owners: list[int], length: int = LENGTH) -> list[np.ndarray]:
    """Per string and window of it: the smallest owner of any string with that window."""
    sizes = np.array([len(s) for s in strings], np.int64)
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    joined = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(_U) + _U(1)
    joined[starts + sizes] = 0
    n = len(joined)

    # Order the suffixes (read in a circle) by their first 7, 14, 28, 56 symbols, and more if needed.
    keys, gram = np.zeros(n, _U), min(_GRAM, length)
    for k in range(gram):
        keys = keys << _U(9) | np.roll(joined, -k)
    order = np.argsort(keys)
    sorted_keys = keys[order]
    heads = np.r_[True, sorted_keys[1:] != sorted_keys[:-1]]
    grams = heads.copy()
    have = gram
    while have < length:
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(heads, np.arange(n), 0))
        tied = np.flatnonzero(~heads | ~np.r_[heads[1:], True])
        if not len(tied):
            break
        part = order[tied]
        both = rank[part] * n + rank[(part + have) % n]
        within = np.argsort(both)
        order[tied] = part[within]
        both = both[within]
        heads[tied] = np.r_[True, both[1:] != both[:-1]]
        have *= 2
    row_of = np.empty(n, np.int64)
    row_of[order] = np.arange(n)
    before = (order - 1) % n
    back, symbol = row_of[before], joined[before]  # the row of the suffix one longer, and the symbol it adds

    # Boundaries by increasing common prefix; those below the gram length are known at once.
    common = np.full(n + 1, -1, np.int8 if length < 128 else np.int32)
    common[:-1][grams] = gram - 1
    common[n] = 0
    if length > gram:
        low = np.flatnonzero(grams)
        high = np.r_[low[1:], n]
        for prefix in range(gram, length):
            sizes_of = high - low
            rows = np.repeat(low - np.r_[0, np.cumsum(sizes_of)[:-1]], sizes_of) + np.arange(int(sizes_of.sum()))
            interval = np.repeat(np.arange(len(low)), sizes_of)
            to = back[rows]
            by = np.argsort(to)
            to = to[by]
            part = interval[by] * 512 + symbol[rows[by]].astype(np.int64)
            first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            ends = to[np.r_[first[1:], len(to)] - 1] + 1
            fresh = common[ends] < 0
            common[ends[fresh]] = prefix
            low, high = to[first][fresh], ends[fresh]
            if not len(low):
                break

    groups = np.flatnonzero(common[:-1] >= 0)
    string_of = np.repeat(np.arange(len(strings)), sizes + 1)
    smallest = np.minimum.reduceat(np.array(owners, np.int64)[string_of[order]], groups)
    found = np.empty(n, np.int64)
    found[order] = np.repeat(smallest, np.diff(np.r_[groups, n]))
    return [found[s : s + z - length + 1] for s, z in zip(starts.tolist(), sizes.tolist(), strict=True)]


# Packed columns. A row holds little of each, so what compresses is made once.
@functools.cache
def _zstd(level: int) -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=level)


def _pack(data: bytes, level: int = 1) -> bytes:
    return _zstd(level).compress(data)


def _unpack(packed: bytes, kind: type = np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(packed), kind)


def _pack_rising(values: np.ndarray) -> bytes:
    """Numbers below 2**40 in rising order, as byte planes of their differences."""
    steps = np.diff(values, prepend=_U(0))
    return _pack(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes())


def _unpack_rising(packed: bytes) -> np.ndarray:
    planes = _unpack(packed).reshape(5, -1)
    wide = np.zeros((planes.shape[1], 8), np.uint8)
    wide[:, :5] = planes.T
    return np.cumsum(wide.view("<u8").ravel(), dtype=_U)


def _pack_numbers(values: np.ndarray) -> bytes:
    """Numbers of 64 bits in any order, as their least one and byte planes of what they have above it."""
    low = values.min()
    return low.tobytes() + _pack(np.ascontiguousarray((values.view(_U) - low.view(_U)).view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpack_numbers(packed: bytes) -> np.ndarray:
    planes = _unpack(packed[8:]).reshape(8, -1)
    return (np.ascontiguousarray(planes.T).view(_U).ravel() + np.frombuffer(packed[:8], _U)).view(np.int64)


def _write_blocks(texts: DataFrame) -> DataFrame:
    """Documents in blocks of bounded size: (block, ids, nulls, sizes, bytes), bytes compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            ids = np.array([0 if k is None else k for k, _ in rows], np.int64)
            nulls = np.array([k is None for k, _ in rows], np.uint8)
            sizes = np.array([len(t) for _, t in rows], np.int64)
            data = _pack(b"".join([t for _, t in rows]), 5)
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 20) + seen]), *[pa.array([x], pa.binary()) for x in (ids.tobytes(), nulls.tobytes(), sizes.tobytes(), data)]],
                names=["block", "ids", "nulls", "sizes", "data"],
            )

        for batch in (part for whole in batches for part in slices(whole)):
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                raw = (text or "").encode("utf-8")
                if rows and size + len(raw) > BLOCK_BYTES:
                    yield block()
                    rows, size, seen = [], 0, seen + 1
                rows.append((key, raw))
                size += len(raw)
        if rows:
            yield block()

    return settle_alone(texts.mapInArrow(run, "block long, ids binary, nulls binary, sizes binary, data binary"))


class _Block:
    """A block read back: documents end to end, their owners (null ids last), starts and sizes."""

    def __init__(self, ids: bytes, nulls: bytes, sizes: bytes, data: bytes):
        self.ids, self.nulls = np.frombuffer(ids, np.int64), np.frombuffer(nulls, np.uint8).astype(bool)
        self.owners = np.where(self.nulls, _LAST, self.ids)
        self.sizes = np.frombuffer(sizes, np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = zstandard.decompress(data)
        self.data = np.frombuffer(self.bytes, np.uint8)

    def runs(self, length: int, mer: int):
        return anchors(self.data, self.starts, self.sizes, length, mer)


def _rest(keys: np.ndarray) -> np.ndarray:
    return keys & _U((1 << 40) - 1)


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return (keys >> _U(40)) % _U(buckets)


def _minimizers(blocks: DataFrame, buckets: int, length: int, mer: int) -> DataFrame:
    """Per block and bucket: its minimizers once each, with a mark where several documents of the block have it.

    The mark is 1 plus the logarithm of its occurrences, and 0 where one document has it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(row["ids"], row["nulls"], row["sizes"], row["data"])
                _, _, doc, keys = block.runs(length, mer)
                if not len(keys):
                    continue
                keys = _bucket(keys, buckets) << _U(40) | _rest(keys)
                order = np.argsort(keys)
                keys, owner = keys[order], block.owners[doc[order]]
                heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
                counts = np.diff(np.r_[heads, len(keys)])
                several = np.minimum.reduceat(owner, heads) != np.maximum.reduceat(owner, heads)
                marks = np.where(several, 1 + np.ceil(np.log2(counts)), 0).astype(np.uint8)
                keys = keys[heads]
                cuts = np.searchsorted(keys >> _U(40), np.arange(buckets + 1, dtype=_U))
                full = np.flatnonzero(np.diff(cuts))
                packed = [(_pack_rising(_rest(keys[cuts[b] : cuts[b + 1]])), _pack(marks[cuts[b] : cuts[b + 1]].tobytes())) for b in full.tolist()]
                columns = [pa.array(full.astype(np.int32)), pa.array(np.full(len(full), row["block"]))]
                columns += [pa.array([p[i] for p in packed], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "block", "keys", "marks"])

    return blocks.mapInArrow(run, "bucket int, block long, keys binary, marks binary")


def _answers(table: pa.Table, sizes: list[int], states: np.ndarray) -> pa.Table:
    """A byte for each thing that the rows of ``table`` ask for, ``sizes`` in each; rows with zeros only are left out."""
    bucket, cuts = table["bucket"][0].as_py(), np.r_[0, np.cumsum(sizes)].tolist()
    parts = [(block, states[a:b]) for block, a, b in zip(table["block"].to_pylist(), cuts, cuts[1:], strict=False)]
    parts = [(block, part) for block, part in parts if part.any()]
    return pa.table(
        [pa.array([p[0] for p in parts], pa.int64()), pa.array([bucket] * len(parts), pa.int32()), pa.array([_pack(p[1].tobytes()) for p in parts], pa.binary())],
        names=["block", "bucket", "data"],
    )


_ANSWERS = "block long, bucket int, data binary"


def _shared(minimizers: DataFrame) -> DataFrame:
    """Per block and bucket, a byte for each minimizer: 1 if several documents have it, 2 if it has very many strings besides."""

    def run(table: pa.Table) -> pa.Table:
        lists = [_unpack_rising(x) for x in table["keys"].to_pylist()]
        marks = np.concatenate([_unpack(x) for x in table["marks"].to_pylist()])
        keys = np.concatenate(lists)
        order = np.argsort(keys)
        keys, marks = keys[order], marks[order]
        heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        counts = np.diff(np.r_[heads, len(keys)])
        amount = np.add.reduceat(np.exp2(np.maximum(marks, 1) - 1.0), heads)
        state = np.where((counts > 1) | (np.maximum.reduceat(marks, heads) > 0), np.where(amount >= MOST_STRINGS, 2, 1), 0)
        states = np.empty(len(keys), np.uint8)
        states[order] = np.repeat(state, counts)
        return _answers(table, [len(x) for x in lists], states)

    return minimizers.groupBy("bucket").applyInArrow(run, _ANSWERS)


def fingerprints(data: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Hashes of 64 bits of the strings of ``data`` (of eight bytes and more) at ``first``."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((len(data),), "<u8", padded.data, strides=(1,))
    out = _mix(sizes.astype(_U) * _U(0x9E3779B97F4A7C15))
    for k in range(0, int(sizes.max(initial=0)), 8):
        step = _mix(out) * _U(0xC2B2AE3D27D4EB4F) + words[first + np.minimum(k, sizes - 8)]
        out = np.where(sizes > k, step, out)
    return _mix(out)


def _by_group(groups: np.ndarray, prints: np.ndarray) -> np.ndarray:
    """The order by group, then by hash. Only equal pairs may stand in another order elsewhere."""
    order = np.argsort(prints)
    return order[np.argsort(groups[order], kind="stable")]


class _Strings:
    """Strings of a block around its shared minimizers, each once, and the runs of windows they stand for.

    Strings are told apart by their hashes. Made anew, and in the same order, in
    every round that asks about them or gets answers.
    """

    def __init__(self, block: _Block, told: pa.Table, buckets: int, length: int, mer: int):
        self.told, self.buckets = told, buckets
        first, last, doc, keys = block.runs(length, mer)
        values, spot = np.unique(_bucket(keys, buckets) << _U(40) | _rest(keys), return_inverse=True)
        shared = self.answers("shared", values)[spot]
        ours = np.flatnonzero(shared)
        # Minimizers with many strings: every window is a string of its own, and meets its like by its hash.
        many = shared[ours] > 1
        counts = np.where(many, last[ours] - first[ours] + 1, 1)
        step = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        alone = np.repeat(many, counts)
        self.first = np.repeat(first[ours], counts) + np.where(alone, step, 0)
        self.last = np.where(alone, self.first, np.repeat(last[ours], counts))
        self.owner = block.owners[np.repeat(doc[ours], counts)]
        prints = fingerprints(block.data, self.first, self.last - self.first + length)
        groups = np.where(alone, _bucket(prints, buckets) << _U(40) | _rest(prints), np.repeat(values[spot[ours]], counts))

        order = _by_group(groups, prints)
        groups, prints = groups[order], prints[order]
        heads = np.flatnonzero(np.r_[True, (groups[1:] != groups[:-1]) | (prints[1:] != prints[:-1])]) if len(order) else order
        self.string = np.empty(len(order), np.int64)
        self.string[order] = np.repeat(np.arange(len(heads)), np.diff(np.r_[heads, len(order)]))
        self.smallest = np.minimum.reduceat(self.owner[order], heads) if len(order) else self.owner
        self.groups, self.prints, self.place = groups[heads], prints[heads], order[heads]
        self.counts = (self.last - self.first + 1)[self.place]

    def _rows(self, kind: str) -> list[tuple[int, bytes]]:
        return [(b, d) for k, b, d in zip(*(self.told[c].to_pylist() for c in ("kind", "bucket", "data")), strict=True) if k == kind]

    def answers(self, kind: str, values: np.ndarray) -> np.ndarray:
        """The answers of this kind to what was asked of ``values``, which rise with their buckets."""
        out = np.zeros(len(values), np.uint8)
        for bucket, data in self._rows(kind):
            at, got = int(np.searchsorted(values, _U(bucket << 40))), _unpack(data)
            out[at : at + len(got)] = got
        return out

    def by_bucket(self, chosen: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        cuts = np.searchsorted(self.groups[chosen] >> _U(40), np.arange(self.buckets + 1, dtype=_U))
        for bucket in np.flatnonzero(np.diff(cuts)).tolist():
            yield bucket, chosen[cuts[bucket] : cuts[bucket + 1]]

    def verdicts(self) -> tuple[np.ndarray, np.ndarray]:
        """Strings that a smaller owner has too, and those with the smallest owner in a group of several strings."""
        states = self.answers("verdicts", self.groups)
        return states == 1, np.flatnonzero(states == 2)

    def masks(self, open_strings: np.ndarray) -> np.ndarray:
        """Per window of all strings, one string after the other: whether a smaller owner has it, as far as masks say so."""
        offsets = np.cumsum(self.counts) - self.counts
        lower = np.zeros(int(self.counts.sum()), bool)
        parts = dict(self.by_bucket(open_strings))
        for bucket, data in self._rows("masks"):
            counts = self.counts[parts[bucket]]
            bits = np.unpackbits(_unpack(data), count=int(counts.sum())).astype(bool)
            lower[np.repeat(offsets[parts[bucket]] - (np.cumsum(counts) - counts), counts) + np.arange(len(bits))] = bits
        return lower


def _with_told(blocks: DataFrame, run, schema: str, **told: DataFrame) -> DataFrame:
    """``run`` of each block (its row and what was told of it)."""
    rows = [df.select("block", F.lit(kind).alias("kind"), "bucket", "data") for kind, df in told.items()]
    return blocks.groupBy("block").cogroup(functools.reduce(DataFrame.unionByName, rows).groupBy("block")).applyInArrow(run, schema)


def _hashes(blocks: DataFrame, shared: DataFrame, buckets: int, length: int, mer: int) -> DataFrame:
    """Per block and bucket: groups, hashes and smallest owners in the block of its strings."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(5)]
        if len(left) and len(right):
            row = left.to_pylist()[0]
            found = _Strings(_Block(row["ids"], row["nulls"], row["sizes"], row["data"]), right, buckets, length, mer)
            for bucket, part in found.by_bucket(np.arange(len(found.groups))):
                packed = (_pack_rising(_rest(found.groups[part])), found.prints[part].tobytes(), _pack_numbers(found.smallest[part]))
                for column, value in zip(out, (bucket, row["block"], *packed), strict=True):
                    column.append(value)
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 3)
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["bucket", "block", "groups", "prints", "owners"])

    return _with_told(blocks, run, "bucket int, block long, groups binary, prints binary, owners binary", shared=shared)


def _verdicts(hashes: DataFrame) -> DataFrame:
    """Per block and bucket, a byte for each string: 1 if a smaller owner than the block's has it, else 2 if its group has others."""

    def run(table: pa.Table) -> pa.Table:
        lists = [_unpack_rising(x) for x in table["groups"].to_pylist()]
        groups = np.concatenate(lists)
        prints = np.concatenate([np.frombuffer(x, _U) for x in table["prints"].to_pylist()])
        owners = np.concatenate([_unpack_numbers(x) for x in table["owners"].to_pylist()])
        order = _by_group(groups, prints)
        groups, prints, owners = groups[order], prints[order], owners[order]
        apart = np.r_[True, groups[1:] != groups[:-1]]
        fresh = apart | np.r_[True, prints[1:] != prints[:-1]]
        heads, group_heads = np.flatnonzero(fresh), np.flatnonzero(apart)
        smallest = np.repeat(np.minimum.reduceat(owners, heads), np.diff(np.r_[heads, len(order)]))
        several = np.repeat(np.add.reduceat(fresh.astype(np.int64), group_heads) > 1, np.diff(np.r_[group_heads, len(order)]))
        states = np.empty(len(order), np.uint8)
        states[order] = np.where(owners > smallest, 1, np.where(several, 2, 0))
        return _answers(table, [len(x) for x in lists], states)

    return hashes.groupBy("bucket").applyInArrow(run, _ANSWERS)


def _strings(blocks: DataFrame, shared: DataFrame, verdicts: DataFrame, buckets: int, length: int, mer: int) -> DataFrame:
    """Per block and bucket: open strings (compressed, end to end), their sizes, smallest owners and groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[] for _ in range(6)]
        if len(left) and len(right):
            row = left.to_pylist()[0]
            block = _Block(row["ids"], row["nulls"], row["sizes"], row["data"])
            found = _Strings(block, right, buckets, length, mer)
            _, open_strings = found.verdicts()
            for bucket, part in found.by_bucket(open_strings):
                a, z = found.first[found.place[part]], found.counts[part] + length - 1
                strings = b"".join([block.bytes[x : x + y] for x, y in zip(a.tolist(), z.tolist(), strict=True)])
                packed = (_pack(strings, 3), _pack(z.astype(np.uint32).tobytes()), _pack_numbers(found.smallest[part]), _pack_rising(_rest(found.groups[part])))
                for column, value in zip(out, (bucket, row["block"], *packed), strict=True):
                    column.append(value)
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 4)
        return pa.table([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["bucket", "block", "strings", "sizes", "owners", "groups"])

    return _with_told(blocks, run, "bucket int, block long, strings binary, sizes binary, owners binary, groups binary", shared=shared, verdicts=verdicts)


def _window_masks(strings: DataFrame, length: int) -> DataFrame:
    """Per block and bucket: a bit for each window of its strings, set if a smaller owner than the block's has it."""

    def run(table: pa.Table) -> pa.Table:
        rows, index, owner, group = [], {}, [], []
        for row in table.to_pylist():
            data, owners = zstandard.decompress(row["strings"]), _unpack_numbers(row["owners"])
            ends = np.cumsum(_unpack(row["sizes"], np.uint32).astype(np.int64)).tolist()
            at = []
            for a, b, o, g in zip([0, *ends], ends, owners.tolist(), _unpack_rising(row["groups"]).tolist(), strict=False):
                i = index.setdefault(data[a:b], len(index))
                if i == len(owner):
                    owner.append(o)
                    group.append(g)
                elif o < owner[i]:
                    owner[i] = o
                at.append(i)
            rows.append((row["block"], at, owners))
        texts = list(index)
        counts = np.array([len(t) - length + 1 for t in texts], np.int64)
        # Strings alone in their group have nothing to be compared with.
        order = np.argsort(np.array(group, _U), kind="stable")
        sorted_groups = np.array(group, _U)[order]
        heads = np.flatnonzero(np.r_[True, sorted_groups[1:] != sorted_groups[:-1]])
        several = np.diff(np.r_[heads, len(order)]) > 1
        found: dict[int, np.ndarray] = {}
        pending, size = [], 0

        def transform():
            answers = shared_window_owners([texts[i] for i in pending], [owner[i] for i in pending], length)
            found.update(zip(pending, answers, strict=True))

        for members in np.split(order, heads[1:]) if several.any() else []:
            if len(members) > 1:
                pending += members.tolist()
                size += sum(len(texts[i]) for i in members.tolist())
                if size >= TRANSFORM_BYTES:
                    transform()
                    pending, size = [], 0
        if pending:
            transform()
        masks = []
        owner = np.array(owner, np.int64)
        for _, at, owners in rows:
            at = np.array(at, np.int64)
            lower = np.repeat(owner[at] < owners, counts[at])
            ends = np.cumsum(counts[at])
            for place in np.flatnonzero([i in found for i in at.tolist()]).tolist():
                i = int(at[place])
                lower[ends[place] - counts[i] : ends[place]] = found[i] < owners[place]
            masks.append(_pack(np.packbits(lower).tobytes()))
        bucket = table["bucket"][0].as_py()
        return pa.table(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([bucket] * len(rows), pa.int32()), pa.array(masks, pa.binary())],
            names=["block", "bucket", "data"],
        )

    return strings.groupBy("bucket").applyInArrow(run, _ANSWERS)


def _apply(blocks: DataFrame, buckets: int, length: int, mer: int, **told: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, spans removed (start, end in bytes), the bytes kept."""
    schema = "doc_id long, n_bytes long, starts array<long>, ends array<long>, kept binary"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block = _Block(row["ids"], row["nulls"], row["sizes"], row["data"])
        removed = np.zeros(len(block.data) + 1, np.int32)
        if len(right):
            found = _Strings(block, right, buckets, length, mer)
            lower_strings, open_strings = found.verdicts()
            lower = found.masks(open_strings)
            offsets = np.cumsum(found.counts) - found.counts
            # A document that is not the block's smallest owner of a string has a smaller one there.
            gone = (found.owner > found.smallest[found.string]) | lower_strings[found.string]
            sizes = found.last - found.first + 1
            step = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            gone = np.repeat(gone, sizes) | lower[np.repeat(offsets[found.string], sizes) + step]
            windows = (np.repeat(found.first, sizes) + step)[gone]
            np.add.at(removed, windows, 1)
            np.add.at(removed, windows + length, -1)
        covered = np.cumsum(removed[:-1]) > 0
        # Document borders part the spans, as covered bytes of neighbours may touch.
        border = np.zeros(len(covered) + 1, bool)
        border[block.starts] = True
        edge = covered & np.r_[True, ~covered[:-1] | border[1:-1]] if len(covered) else covered
        stop = covered & np.r_[~covered[1:] | border[1:-1], True] if len(covered) else covered
        starts, ends = np.flatnonzero(edge), np.flatnonzero(stop) + 1
        lows, highs = np.searchsorted(starts, block.starts), np.searchsorted(starts, block.starts + block.sizes)
        out_starts, out_ends, kept = [], [], []
        for a, n, low, high in zip(block.starts.tolist(), block.sizes.tolist(), lows.tolist(), highs.tolist(), strict=True):
            s, e = (starts[low:high] - a).tolist(), (ends[low:high] - a).tolist()
            out_starts.append(s)
            out_ends.append(e)
            text = block.bytes[a : a + n]
            kept.append(b"".join([text[x:y] for x, y in zip([0, *e], [*s, n], strict=True)]))
        longs = pa.list_(pa.int64())
        return pa.table(
            [pa.array(block.ids, mask=block.nulls), pa.array(block.sizes), pa.array(out_starts, longs), pa.array(out_ends, longs), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "starts", "ends", "kept"],
        )

    return _with_told(blocks, run, schema, **told)


def dedup(docs: DataFrame, length: int = LENGTH, mer: int = MER) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, starts and ends of removed spans, and the bytes kept.

    A byte goes if a string of ``length`` bytes that covers it also starts in a
    document with a smaller doc_id, judged on the input. A null text is empty; a
    null doc_id counts as larger than any other; rows with the same doc_id do not
    remove from each other. doc_id must be an integer; other columns of ``docs``
    are not read. ``mer`` (8 to ``length``) only moves work about.
    """
    texts = keyed_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.count() // 20_000)
    blocks = _write_blocks(texts)
    shared = settle_alone(_shared(_minimizers(blocks, buckets, length, mer)))
    verdicts = settle_alone(_verdicts(_hashes(blocks, shared, buckets, length, mer)))
    masks = settle_alone(_window_masks(_strings(blocks, shared, verdicts, buckets, length, mer), length))
    return _apply(blocks, buckets, length, mer, shared=shared, verdicts=verdicts, masks=masks)


def kept_sha256(kept: bytes) -> str:
    return hashlib.sha256(kept).hexdigest()
