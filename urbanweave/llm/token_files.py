"""Token-id files: raw ids in shards, and a minimal perfect hash index per shard.

Shard ``n`` is two files. ``shard-n.ids`` holds the ids of its documents end to
end, little-endian, two bytes each when every id of the shard fits, else four.
``shard-n.idx`` maps a document key to its place: a perfect hash (levels of bit
arrays; a key that is alone in its cell of a level is placed by the rank of that
cell) leads to a slot with a 64-bit fingerprint, the offset and the count. The
keys themselves follow in document order, for reading a shard from end to end.

Files are written under a name of the attempt and moved into place, so a task
that runs again, or twice, leaves the same files.
"""

from __future__ import annotations

import io
import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from urbanweave.llm.common import keyed_texts
from urbanweave.runtime import settle, shared_folder

GAMMA = 2.0
_GROUP_CHARS = 100_000
_ABSENT = -1
_UINT32 = "I"  # four bytes on every platform Spark runs on, little-endian there

# A space with white space, or nothing, behind it. In texts without one, every space
# begins a piece of the byte-level pre-tokenizer, so the parts between are independent.
_RUN = re.compile(r" (?:\s|\Z)")


class _Parts(dict):
    """Ids by part; parts asked for in vain give None and are noted in ``missing``."""

    def __init__(self):
        super().__init__()
        self.missing: set[str] = set()

    def __missing__(self, part: str) -> None:
        self.missing.add(part)


class Encoder:
    """Ids of texts by the tokenizers library; a part between spaces is encoded once per worker.

    Parts are remembered (with the space before them) in two generations of at most
    ``most_parts`` or so: when the younger is full it becomes the older, and parts
    in use move back. Tokenizers of another kind encode every text as a whole.
    ``added_as_text`` reads the strings of special tokens as ordinary text; without
    it they give their own ids, as in a plain call of the library, and a text that
    holds the content of an added token is encoded as a whole.
    """

    def __init__(self, path: str, end_id: int, most_parts: int = 700_000, added_as_text: bool = True):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = added_as_text
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if not (added_as_text and t.special)]
        self.end = np.array([end_id], "<u4").tobytes()
        self.parts, self.older = _Parts(), {}
        self.most = most_parts
        kind = self.tokenizer.pre_tokenizer
        self.by_part = isinstance(kind, ByteLevel) and kind.use_regex and not kind.add_prefix_space and self.tokenizer.normalizer is None
        self.by_part = self.by_part and not any(" " in content for content in self.added)  # parts put together could spell one
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.spaced = np.zeros(max(vocabulary.values()) + 1, bool)
        self.spaced[[i for token, i in vocabulary.items() if token.startswith("Ġ")]] = True

    def _encode(self, text: str) -> bytes:
        coded = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return array(_UINT32, coded[0].ids).tobytes()

    def _apart(self, text: str) -> bool:
        """Whether the parts between spaces can be encoded one by one."""
        return self.by_part and not _RUN.search(text) and not any(content in text for content in self.added)

    def _learn(self, parts: list[str]) -> None:
        """Encode new parts as one text; the ids that begin with a space are the first ones of the parts."""
        if not parts:
            return
        data = self._encode(" " + " ".join(parts))
        firsts = np.flatnonzero(self.spaced[np.frombuffer(data, "<u4")])
        cuts = np.append(firsts * 4, len(data)).tolist()
        self.parts.update(zip(parts, [data[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Per text its ids as little-endian 32-bit integers, end id included; null is an empty text."""
        if len(self.parts) > self.most:
            self.older, self.parts = self.parts, _Parts()
        known = self.parts
        cut = [t.split(" ") if t and self._apart(t) else None for t in texts]
        found = [None if c is None else list(map(known.__getitem__, c[1:])) for c in cut]
        missing, known.missing = known.missing, set()
        kept = {p for p in missing if p in self.older}
        known.update((p, self.older[p]) for p in kept)
        self._learn(list(missing - kept))
        out = []
        for text, parts, ids in zip(texts, cut, found, strict=True):
            if parts is None:
                out.append((self._encode(text) if text else b"") + self.end)
            else:
                head = self._encode(parts[0]) if parts[0] else b""
                out.append(head + b"".join([known[p] if i is None else i for p, i in zip(parts[1:], ids, strict=True)]) + self.end)
        return out

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """``encode_all`` in groups of a bounded number of characters."""
        group, size = [], 0
        for text in texts:
            group.append(text)
            size += len(text or "")
            if size > _GROUP_CHARS:
                yield from self.encode_all(group)
                group, size = [], 0
        yield from self.encode_all(group)


@lru_cache(maxsize=1)
def _encoder(path: str, end_id: int) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    return Encoder(path, end_id, added_as_text=False)


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def key_hashes(keys: np.ndarray, nulls: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """64-bit hashes of (key, null or not, how many equal keys came before): distinct in a shard."""
    return _mix(_mix(keys.view(np.uint64), 101) + nth.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64), 202)


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit values: value -> 0 .. n-1, no stored keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, placed = [], 0
        for bits in levels:
            counts = np.cumsum(bits, dtype=np.int64)
            self.ranks.append(counts - bits + placed)
            placed += int(counts[-1]) if len(counts) else 0
        self.size = placed

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        levels, left, seed = [], hashes, 0
        while len(left):
            cells = (_mix(left, seed) % np.uint64(max(1, int(GAMMA * len(left))))).astype(np.int64)
            counts = np.bincount(cells, minlength=max(1, int(GAMMA * len(left))))
            levels.append((counts == 1).astype(np.uint8))
            left, seed = left[counts[cells] != 1], seed + 1
        return cls(levels)

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slots of the values; a value that was not built in gets any slot, or -1."""
        slots = np.full(len(hashes), _ABSENT, np.int64)
        left = np.arange(len(hashes))
        for seed, (bits, ranks) in enumerate(zip(self.levels, self.ranks, strict=True)):
            cells = (_mix(hashes[left], seed) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[cells] == 1
            slots[left[hit]] = ranks[cells[hit]]
            left = left[~hit]
        return slots


class ShardIndex:
    """Index of a shard: ``find`` gives (offset, count) for key hashes, -1 for absent ones."""

    def __init__(self, hashing: PerfectHash, fingerprints: np.ndarray, offsets: np.ndarray, counts: np.ndarray):
        self.hashing, self.fingerprints, self.offsets, self.counts = hashing, fingerprints, offsets, counts

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots = self.hashing.slots(hashes)
        known = slots >= 0
        known[known] = self.fingerprints[slots[known]] == _mix(hashes[known], 303)
        at = np.where(known, slots, 0)
        if not len(self.offsets):
            return np.full(len(hashes), _ABSENT), np.full(len(hashes), _ABSENT)
        return np.where(known, self.offsets[at], _ABSENT), np.where(known, self.counts[at], _ABSENT)


def _occurrence(keys: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """How many equal keys stand before each of the sorted ``keys``."""
    if not len(keys):
        return np.zeros(0, np.int64)
    fresh = np.r_[True, (keys[1:] != keys[:-1]) | (nulls[1:] != nulls[:-1])]
    first = np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))
    return np.arange(len(keys)) - first


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    if folder.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return (pafs.LocalFileSystem(), folder) if "://" not in folder else pafs.FileSystem.from_uri(folder)


def _put(files: pafs.FileSystem, path: str, data: bytes) -> None:
    mine = f"{path}.{uuid.uuid4().hex}"
    with files.open_output_stream(mine) as out:
        out.write(data)
    files.move(mine, path)


def _index_bytes(keys: np.ndarray, nulls: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    hashes = key_hashes(keys, nulls, _occurrence(keys, nulls))
    hashing = PerfectHash.build(hashes)
    slots = hashing.slots(hashes)
    offsets = np.cumsum(counts) - counts
    by_slot = [np.empty(len(keys), kind) for kind in (np.uint64, np.int64, np.int64)]
    for column, values in zip(by_slot, (_mix(hashes, 303), offsets, counts), strict=True):
        column[slots] = values
    out = io.BytesIO()
    sizes = np.array([len(bits) for bits in hashing.levels], np.int64)
    levels = np.concatenate([np.packbits(bits) for bits in hashing.levels]) if len(sizes) else np.zeros(0, np.uint8)
    np.savez(out, width=width, sizes=sizes, levels=levels, fingerprints=by_slot[0], offsets=by_slot[1], counts=by_slot[2], keys=keys, nulls=nulls)
    return out.getvalue()


def _read_index(files: pafs.FileSystem, path: str) -> tuple[ShardIndex, np.ndarray, np.ndarray, int]:
    with files.open_input_stream(path) as stream:
        held = np.load(io.BytesIO(stream.read()))
        levels, at = [], 0
        for size in held["sizes"]:
            packed = held["levels"][at : at + (size + 7) // 8]
            levels.append(np.unpackbits(packed, count=size))
            at += len(packed)
        index = ShardIndex(PerfectHash(levels), held["fingerprints"], held["offsets"], held["counts"])
        return index, held["keys"], held["nulls"], int(held["width"])


_MANIFEST = "shard int, path string, n_docs long, n_ids long, low long, high long"


def write_token_files(docs: DataFrame, tokenizer_path: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Encode every text, write the shards in ascending doc_id order, return the manifest.

    Manifest rows: shard, path, n_docs, n_ids, low, high (keys of the shard) and
    start, the ids in all shards before it. A null or empty text is just the end
    id; the string of an added token gets its id, as in a plain call of the library.
    Null doc_ids come first; equal doc_ids are told apart by their order (equal
    ones by text). doc_id must be an integer. An empty table gives no
    shard. ``folder`` must be one that all executors share; unset, it is a new
    folder below the shared one of the session. A task streams its shard: it holds
    one batch of texts and the ids of the shard, never all documents.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
    texts = keyed_texts(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = texts.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(*order)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        shard = TaskContext.get().partitionId()
        encoder = _encoder(tokenizer_path, end_id)
        keys, counts, chunks, widest = [], [], [], 0
        for batch in batches:
            coded = list(encoder.encode_batch(batch.column(1).to_pylist()))
            keys += batch.column(0).to_pylist()
            counts += [len(c) // 4 for c in coded]
            ids = np.frombuffer(b"".join(coded), "<u4")
            widest = max(widest, int(ids.max(initial=0)))
            chunks.append(ids.astype("<u2") if widest < 1 << 16 else ids)
        if not keys:
            return
        width = 2 if widest < 1 << 16 else 4
        files.create_dir(root, recursive=True)
        path = f"{root}/shard-{shard:06d}"
        nulls = np.array([k is None for k in keys])
        values = np.array([0 if k is None else k for k in keys], np.int64)
        counted = np.array(counts, np.int64)
        _put(files, f"{path}.ids", b"".join(c.astype(f"<u{width}", copy=False).tobytes() for c in chunks))
        _put(files, f"{path}.idx", _index_bytes(values, nulls, counted, width))
        real = values[~nulls]
        row = [shard, path, len(keys), int(counted.sum()), int(real[0]) if len(real) else None, int(real[-1]) if len(real) else None]
        kinds = (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["shard", "path", "n_docs", "n_ids", "low", "high"]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=names)

    manifest = settle(dealt.mapInArrow(write, _MANIFEST))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one short row per shard
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(manifest: DataFrame, folder: str | None = None) -> DataFrame:
    """Read the shards back, a task per shard: doc_id, nth, start, n_tokens, ids (binary, 32-bit little-endian)."""
    schema = "doc_id long, nth long, start long, n_tokens long, ids binary"
    shards = manifest.select("shard", "path", "start").repartitionByRange(max(1, manifest.count()), "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                files, root = _open(folder or path)
                index, keys, nulls, width = _read_index(files, f"{path}.idx")
                nth = _occurrence(keys, nulls)
                offsets, counts = index.find(key_hashes(keys, nulls, nth))
                with files.open_input_file(f"{path}.ids") as payload:
                    for at in range(0, len(keys), 2000):
                        part = slice(at, at + 2000)
                        ids = [
                            np.frombuffer(payload.read_at(n * width, o * width), f"<u{width}").astype("<u4").tobytes()
                            for o, n in zip(offsets[part].tolist(), counts[part].tolist(), strict=True)
                        ]
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(keys[part], pa.int64(), mask=nulls[part]),
                                pa.array(nth[part], pa.int64()),
                                pa.array(offsets[part] + start, pa.int64()),
                                pa.array(counts[part], pa.int64()),
                                pa.array(ids, pa.binary()),
                            ],
                            names=["doc_id", "nth", "start", "n_tokens", "ids"],
                        )

    return shards.mapInArrow(read, schema)


def look_up(manifest: DataFrame, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Keyed access: (doc_id, start, n_tokens, ids) of the asked keys that exist, all rows of a repeated one.

    Keys are sent to the shards whose key range holds them; the index of each
    shard is opened once for the keys of a task. Null keys match nothing.
    """
    asked = keys.select(F.col(key).cast("long").alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    held = manifest.where(F.col("low").isNotNull()).orderBy("shard").select("path", "start", "low", "high").collect()
    shards = asked.sparkSession.sparkContext.broadcast([tuple(r) for r in held])  # one short entry per shard

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = (np.array([r[i] for r in shards.value], np.int64) for i in (2, 3))
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            first, last = np.searchsorted(high, docs, "left"), np.searchsorted(low, docs, "right")
            to = [(s, d) for d, a, b in zip(docs.tolist(), first.tolist(), last.tolist(), strict=True) for s in range(a, b)]
            columns = [pa.array([shards.value[s][i] for s, _ in to], k) for i, k in ((0, pa.string()), (1, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([d for _, d in to], pa.int64())], names=["path", "start", "doc_id"])

    sent = asked.mapInArrow(route, "path string, start long, doc_id long")
    schema = "doc_id long, start long, n_tokens long, ids binary"

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = None, None
        for batch in batches:
            rows = []
            for path, start, doc in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if opened[0] != path:
                    files, _ = _open(path)
                    opened = path, _read_index(files, f"{path}.idx")
                index, _, _, width = opened[1]
                nth = 0
                while True:
                    hashes = key_hashes(np.array([doc], np.int64), np.array([False]), np.array([nth]))
                    offset, count = (int(x[0]) for x in index.find(hashes))
                    if offset < 0:
                        break
                    with files.open_input_file(f"{path}.ids") as payload:
                        raw = payload.read_at(count * width, offset * width)
                    rows.append((doc, start + offset, count, np.frombuffer(raw, f"<u{width}").astype("<u4").tobytes()))
                    nth += 1
            columns = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "n_tokens", "ids"]
            )

    return sent.repartition("path").sortWithinPartitions("path").mapInArrow(find, schema)


def ids_crc32(ids: bytes) -> int:
    return zlib.crc32(ids)


def default_tokenizer(spark: SparkSession) -> str:
    """Path of the byte-level vocabulary; ``urbanweave.tokenizer.bytes`` in the session names another."""
    import public_tokenizers

    return spark.conf.get("urbanweave.tokenizer.bytes", public_tokenizers.path("byte_bpe_50k.json"))
