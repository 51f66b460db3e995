"""Sampled segmentations over a SentencePiece vocabulary, and their lossless decoding.

A text is cut into units that no piece crosses (a run of spaces with the word
behind it, a line end). Forward filtering over the piece lattice of a unit gives,
for every position, the probabilities of the pieces that may end there; backward
sampling then draws a segmentation. Lattices are kept per distinct unit, and all
units of a batch are sampled together. The draw depends on the seed, the key of
the row and the place of the unit only, so any run gives the same pieces.

The vocabulary is a merge list without probabilities; a piece of rank r weighs
1 / (r + OFFSET). Characters without a piece are spelled by their byte pieces.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from urbanweave.llm.common import keyed_texts, let_go, lets_go, slices

OFFSET = 10.0
SPACE = "▁"
_MOST_EDGES = 500_000
_PART_CHARS = 125_000


class Trie:
    """Pieces as a table of states, walked from all places of a text at once.

    Only states with several steps have a row in the table; most have one step or
    none. The commonest characters have a column of their own there; steps of such
    states by others are looked up in a sorted list.
    """

    COLUMNS = 128

    def __init__(self, ids: dict[str, int]):
        children: list[dict[str, int]] = [{}]
        ends = [-1]
        for piece, number in ids.items():
            state = 0
            for char in piece:
                if char not in children[state]:
                    children[state][char] = len(children)
                    children.append({})
                    ends.append(-1)
                state = children[state][char]
            ends[state] = number
        self.ends = np.array(ends, np.int32)
        common = [c for c, _ in Counter(c for state in children for c in state).most_common(self.COLUMNS)]
        self.columns = np.full(0x110000, -1, np.int16)
        self.columns[[ord(c) for c in common]] = np.arange(len(common))
        several = [state for state, steps in enumerate(children) if len(steps) > 1]
        self.row = np.full(len(children), -1, np.int32)
        self.row[several] = np.arange(len(several))
        self.table = np.full((len(several), self.COLUMNS), -1, np.int32)
        self.only, self.only_to = np.full(len(children), 1 << 21, np.uint32), np.full(len(children), -1, np.int32)
        rare = []
        for state, steps in enumerate(children):
            row = self.row[state]
            for char, to in steps.items():
                column = self.columns[ord(char)]
                if row < 0:
                    self.only[state], self.only_to[state] = ord(char), to
                elif column >= 0:
                    self.table[row, column] = to
                else:
                    rare.append((state << 21 | ord(char), to))
        rare.sort()
        self.rare = np.array([key for key, _ in rare] + [1 << 62], np.int64)
        self.rare_to = np.array([to for _, to in rare] + [-1], np.int32)

    def matches(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and number of every piece found in the code points, in order of the ends."""
        columns = self.columns[codes]
        place, state, depth = np.arange(len(codes)), np.zeros(len(codes), np.int32), 0
        found = []
        while len(place):
            at = place + depth
            inside = at < len(codes)
            place, state, at = place[inside], state[inside], at[inside]
            to = np.where(self.only[state] == codes[at], self.only_to[state], -1)
            row = self.row[state]
            wide = np.flatnonzero(row >= 0)
            column = columns[at[wide]]
            to[wide] = np.where(column >= 0, self.table[row[wide], column], -1)
            others = wide[column < 0]
            if len(others):
                keys = state[others].astype(np.int64) << 21 | codes[at[others]]
                spot = np.searchsorted(self.rare, keys)
                to[others] = np.where(self.rare[spot] == keys, self.rare_to[spot], -1)
            alive = to >= 0
            place, state, depth = place[alive], to[alive], depth + 1
            ends = self.ends[state]
            hit = ends >= 0
            found.append((place[hit], ends[hit], depth))
        slots = np.zeros(len(codes) + 2, np.int64)  # matches by end, then where the next one of that end goes
        for starts, _, length in found:
            slots[starts + length + 1] += 1
        slots = np.cumsum(slots)
        total = int(slots[-1])
        start, end, number = np.empty(total, np.int64), np.empty(total, np.int64), np.empty(total, np.int64)
        for starts, numbers, length in found:  # of one length, no two matches share an end
            at = slots[starts + length]
            start[at], end[at], number[at] = starts, starts + length, numbers
            slots[starts + length] += 1
        return start, end, number


def spellings(path: str) -> list[bytes | None]:
    """Bytes of every id of a model file; None for ids that stand for no text."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    out: list[bytes | None] = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            out.append(bytes([int(piece[1:-1], 16)]))
        else:
            empty = model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
            out.append(None if empty else piece.replace(SPACE, " ").encode("utf-8"))
    return out


class Vocabulary:
    """Pieces of a model file in plain text (spaces as spaces), byte pieces, and log weights."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.spelled = spellings(path)
        self.bytes = [-1] * 256
        ids: dict[str, int] = {}
        for i, data in enumerate(self.spelled):
            if model.is_byte(i):
                self.bytes[data[0]] = i
            elif data is not None:
                ids[data.decode("utf-8")] = i
        if -1 in self.bytes:
            raise ValueError("the vocabulary has no byte pieces; decoding would lose characters")
        if any(" " in piece.lstrip(" ") or "\0" in piece or ("\n" in piece and len(piece) > 1) for piece in ids):
            raise ValueError("a piece crosses a unit")
        self.pieces = frozenset(ids)
        self.trie = Trie(ids)
        rank = np.arange(len(self.spelled)) + OFFSET
        self.weights = -np.log(rank) - np.log((1 / rank).sum())


_UNITS = re.compile(r"\n| *[^ \n]+| +")


def units(text: str) -> list[str]:
    """Parts of the text, with one space put before it, that no piece crosses."""
    return _UNITS.findall(" " + text) if text else []


def lattices(vocabulary: Vocabulary, found: list[str], alpha: float) -> tuple[np.ndarray, ...]:
    """Lattices of units, one behind the other: first and last node of each unit, and the edges.

    A node is a place between characters (or between the bytes of a character
    without a piece). Edges are ordered by the node they end at: ``heads`` is the
    place of the first one per node, and ``cumulative`` the running sum, per node,
    of the probability that this piece ends there, given that some piece does,
    over all segmentations of what stands before. Returned: first, last, heads,
    start nodes, ids, cumulative.
    """
    joined = "\0".join(found)  # no piece holds the separator
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    # Characters without a piece of their own are spelled by bytes.
    known, which = np.unique(codes, return_inverse=True)
    chars = [chr(c) for c in known]
    spelled = np.array([c not in vocabulary.pieces for c in chars])
    sizes = np.array([len(c.encode("utf-8")) if s else 1 for c, s in zip(chars, spelled.tolist(), strict=True)])
    node_after = np.cumsum(sizes[which])  # node behind each character; the separator is a step of its own
    lengths = np.array([len(u) for u in found])
    first_char = np.cumsum(lengths + 1) - (lengths + 1)
    before = np.r_[0, node_after]
    first, last = before[first_char], before[first_char + lengths]

    start_char, end_char, piece = vocabulary.trie.matches(codes)
    # Bytes: one sure edge into each of their nodes.
    inside = np.ones(len(codes), bool)
    inside[(first_char + lengths)[:-1]] = False
    at = np.flatnonzero(spelled[which] & inside)
    byte_ids, byte_nodes = [], []
    for i in at.tolist():
        for k, byte in enumerate(chars[which[i]].encode("utf-8")):
            byte_ids.append(vocabulary.bytes[byte])
            byte_nodes.append(int(before[i]) + k + 1)
    byte_nodes = np.array(byte_nodes, np.int64)

    # Forward filtering, all units side by side, one end place after the other.
    unit_of = np.repeat(np.arange(len(found)), lengths + 1)[: len(codes)]
    longest = int(lengths.max(initial=0))
    small = np.int16 if longest < 1 << 15 else np.int64  # 16-bit numbers are sorted by radix
    level = (end_char - first_char[unit_of[start_char]]).astype(small)
    order = np.argsort(level, kind="stable")
    by_level = np.searchsorted(level[order], np.arange(1, longest + 2))
    level = (at + 1 - first_char[unit_of[at]]).astype(small)
    spelled_order = np.argsort(level, kind="stable")
    spelled_by = np.searchsorted(level[spelled_order], np.arange(1, longest + 2))
    filtered = np.zeros(len(codes) + 1)
    shares = np.zeros(len(piece))
    weights = alpha * vocabulary.weights
    for step in range(longest):
        plain = at[spelled_order[spelled_by[step] : spelled_by[step + 1]]]
        filtered[plain + 1] = filtered[plain]
        edges = order[by_level[step] : by_level[step + 1]]  # of one end they stand together
        if not len(edges):
            continue
        scores = filtered[start_char[edges]] + weights[piece[edges]]
        ends = end_char[edges]
        heads = np.flatnonzero(np.r_[True, ends[1:] != ends[:-1]])
        counts = np.diff(np.r_[heads, len(ends)])
        top = np.maximum.reduceat(scores, heads)
        grown = np.exp(scores - np.repeat(top, counts))
        total = np.add.reduceat(grown, heads)
        shares[edges] = grown / np.repeat(total, counts)
        filtered[ends[heads]] = top + np.log(total)

    # The matches are in order of their ends, so those of one end stand together.
    end_node = np.r_[before[end_char], byte_nodes]
    start_node = np.r_[before[start_char], byte_nodes - 1]
    ids = np.r_[piece, np.array(byte_ids, np.int64)]
    running = np.cumsum(shares)
    heads = np.flatnonzero(np.r_[True, end_char[1:] != end_char[:-1]]) if len(end_char) else np.zeros(0, np.int64)
    counts = np.diff(np.r_[heads, len(end_char)])
    running -= np.repeat(running[heads] - shares[heads], counts)
    running[heads + counts - 1] = 1.0
    cumulative = np.r_[running, np.ones(len(byte_nodes))]
    order = np.argsort(end_node, kind="stable")
    into = np.bincount(end_node, minlength=int(before[-1]) + 1)
    return first, last, np.cumsum(into) - into, start_node[order], ids[order], cumulative[order]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Units(dict):
    """Numbers of known units; units asked for in vain give -1 and are noted in ``missing``."""

    def __init__(self):
        super().__init__()
        self.missing: set[str] = set()

    def __missing__(self, unit: str) -> int:
        self.missing.add(unit)
        return -1


class Sampler:
    """Samples texts; holds the lattices of the units seen, up to a bounded number of edges."""

    def __init__(self, vocabulary: Vocabulary, alpha: float = 1.0, seed: int = 0):
        self.vocabulary, self.alpha, self.seed = vocabulary, alpha, np.uint64(seed)
        self._clear()

    def _clear(self) -> None:
        self.known = _Units()
        self.first, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.heads, self.starts, self.ids, self.cumulative = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0)
        self.edges = self.nodes = 0

    def _put(self, name: str, at: int, values: np.ndarray) -> None:
        """Write ``values`` at a place of a column that grows by doubling."""
        column = getattr(self, name)
        if at + len(values) > len(column):
            column = np.concatenate([column, np.zeros(max(at + len(values), 2 * len(column)) - len(column), column.dtype)])
            setattr(self, name, column)
        column[at : at + len(values)] = values

    def _learn(self, fresh: list[str]) -> None:
        first, last, heads, starts, ids, cumulative = lattices(self.vocabulary, fresh, self.alpha)
        self.known.update(zip(fresh, range(len(self.first), len(self.first) + len(fresh)), strict=True))
        self.first = np.concatenate([self.first, first + self.nodes])
        self.last = np.concatenate([self.last, last + self.nodes])
        self._put("heads", self.nodes, heads + self.edges)
        self._put("starts", self.edges, starts + self.nodes)
        self._put("ids", self.edges, ids)
        self._put("cumulative", self.edges, cumulative)
        self.edges += len(ids)
        self.nodes += len(heads)

    def sample(self, keys: list[int], texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of all texts end to end, and how many each has. ``keys`` are 64-bit hashes of the row keys."""
        if self.edges > _MOST_EDGES:
            self._clear()
        cut = [units(t or "") for t in texts]
        counts = np.array([len(c) for c in cut], np.int64)
        known = self.known
        flat = list(chain.from_iterable(cut))
        which = np.array(list(map(known.__getitem__, flat)), np.int64)
        if known.missing:
            self._learn(list(known.missing))
            known.missing = set()
            for i in np.flatnonzero(which < 0).tolist():
                which[i] = known[flat[i]]
        first = np.cumsum(counts) - counts
        place = np.arange(len(which)) - np.repeat(first, counts)
        row = np.repeat(np.array(keys, np.uint64), counts)
        stream = _mix(row + _mix(place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + self.seed))
        order = np.argsort(which, kind="stable")  # neighbours read the same lattice
        zero = self.first[which]
        active, at = order, self.last[which[order]]
        steps, drawn, length = [], [], np.zeros(len(which), np.int64)
        while len(active):
            jump = np.uint64(len(steps) * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)
            chance = (_mix(stream[active] + jump) >> np.uint64(11)).astype(np.float64) * 2.0**-53
            edge = self.heads[at]
            low = np.arange(len(edge))
            while len(low):
                low = low[self.cumulative[edge[low]] <= chance[low]]
                edge[low] += 1
            steps.append(active)
            drawn.append(self.ids[edge])
            length[active] += 1
            at = self.starts[edge]
            more = at > zero[active]
            active, at = active[more], at[more]
        ends = np.cumsum(length)
        ids = np.empty(int(ends[-1]) if len(ends) else 0, np.int32)
        for i, (units_at, pieces) in enumerate(zip(steps, drawn, strict=True)):
            ids[ends[units_at] - 1 - i] = pieces
        bounds = np.r_[0, ends]
        return ids, bounds[first + counts] - bounds[first]


def row_key(key) -> int:
    return xxhash.xxh64_intdigest(repr(key))


def encode(docs: DataFrame, model_path: str, alpha: float = 1.0, seed: int = 0, given: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id and ids (array of int), a sampled segmentation of the whole text.

    ``alpha`` above 1 prefers likely segmentations more, below 1 less. With
    ``given``, a column of that name has the SHA-256 of the text. A null text has
    null ids, an empty one none. Rows with equal doc_id and text get equal ids; a
    null doc_id is a key like any other. Other columns are not read.
    """
    texts = keyed_texts(docs)
    fields = [texts.schema["doc_id"], T.StructField("ids", T.ArrayType(T.IntegerType()))]
    if given:
        texts = texts.withColumn("given", F.sha2("text", 256))
        fields.append(texts.schema["given"])
    schema = T.StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = Sampler(Vocabulary(model_path), alpha, seed)  # for this task; workers that wait for one hold none
        let_go()
        for batch in (part for whole in batches for part in slices(whole)):
            keys, bodies = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            done = 0
            while done < len(keys):
                upto, size = done, 0
                while upto < len(keys) and (upto == done or size + len(bodies[upto] or "") <= _PART_CHARS):
                    size += len(bodies[upto] or "")
                    upto += 1
                ids, counts = sampler.sample([row_key(k) for k in keys[done:upto]], bodies[done:upto])
                offsets = pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32))
                absent = pa.array([b is None for b in bodies[done:upto]])
                listed = pa.ListArray.from_arrays(offsets, pa.array(ids), type=arrow.field("ids").type, mask=absent)
                columns = [batch.column(0), listed, *batch.columns[2:]]
                part = [c if c is listed else c.slice(done, upto - done) for c in columns]
                yield pa.RecordBatch.from_arrays(part, schema=arrow)
                done = upto

    return texts.mapInArrow(lets_go(run), schema)


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """Rows of ``coded`` with ``text``: the pieces of ``ids`` spelled out, without the space put first. Null ids give null.

    A column ``text`` of ``coded`` is replaced; the others are kept.
    """
    chosen = coded.drop("text")
    schema = T.StructType([*chosen.schema.fields, T.StructField("text", T.StringType())])
    arrow = to_arrow_schema(schema)
    where = chosen.columns.index("ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelled = spellings(model_path)
        for batch in (part for whole in batches for part in slices(whole)):
            texts = []
            for row in batch.column(where):
                ids = row.values
                texts.append(None if ids is None else b"".join([spelled[i] for i in ids.to_numpy().tolist()])[1:].decode("utf-8"))
            columns = [c.cast(f.type) for c, f in zip(batch.columns, arrow, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], schema=arrow)

    return chosen.mapInArrow(lets_go(run), schema)


def default_model(spark: SparkSession) -> str:
    """Path of the piece vocabulary; ``urbanweave.tokenizer.pieces`` in the session names another."""
    import public_tokenizers

    return spark.conf.get("urbanweave.tokenizer.pieces", public_tokenizers.path("piece_bpe_32k.model"))
