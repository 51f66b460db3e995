"""Byte-pair encoding of words by speculation: longest matches, pair checks, exact merging of what fails.

A sequence of tokens is the encoding of a word if and only if every two neighbours
are compatible, that is, if merging the two tokens' symbols alone gives these two
tokens again. So the longest match from each place is taken as a proposal, every
adjacent pair of all proposals is tested at once by walking back the merges on both
sides of the seam, and only words with a pair that fails are merged symbol by symbol.

The tokenizer file must have the shape of word-end vocabularies: BPE with one merge
per token, ``end_of_word_suffix``, NFC, white space and lower case as normalizer, a
split by one pattern, byte-level symbols and no decoder. Other files are refused.
"""

from __future__ import annotations

import heapq
import json
import os
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from urbanweave.llm.common import keyed_texts, slices

#: Words of at most so many bytes are remembered, up to so many words.
REMEMBERED_BYTES = 64
REMEMBERED_WORDS = 200_000
#: Characters of texts that are cut into words at a time (a longer text is one group).
GROUP_CHARS = 2_000_000
#: Fixed value: how a word-end vocabulary cuts normalised text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Up to this code point the character classes and lower case of all Unicode versions agree.
SETTLED = 0x52F
_BEYOND = re.compile(f"[^\0-{chr(SETTLED)}]")
_NEVER = np.int64(1 << 40)


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + others.index(b)) for b in range(256)]


def _settled_words() -> re.Pattern:
    """``PATTERN`` for texts of settled characters, with the classes written out."""
    kinds = [unicodedata.category(chr(c)) for c in range(SETTLED + 1)]
    letters, numbers = ("".join(chr(c) for c, k in enumerate(kinds) if k[0] == kind) for kind in "LN")
    return re.compile(PATTERN.replace(r"\s", "\t-\r \x85\xa0").replace(r"\p{L}", letters).replace(r"\p{N}", numbers))


def _find(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Place of each asked key in the sorted ``keys``, or -1."""
    spot = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
    return np.where(keys[spot] == asked, spot, -1)


class Merges:
    """The merge list of a tokenizer file, as arrays by token id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        model, vocabulary = held["model"], held["model"]["vocab"]
        end = model["end_of_word_suffix"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        cut, level = held["pre_tokenizer"]["pretokenizers"]
        steps = [s["type"] for s in held["normalizer"]["normalizers"]]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges"))
        fits = plain and end and steps == ["NFC", "Replace", "Lowercase"] and held["normalizer"]["normalizers"][1]["pattern"] == {"Regex": "\\s+"}
        fits = fits and held["normalizer"]["normalizers"][1]["content"] == " " and held["decoder"] is None and held["post_processor"] is None
        fits = fits and cut["pattern"] == {"Regex": PATTERN} and cut["type"] == "Split" and cut["behavior"] == "Removed" and cut["invert"] and level["type"] == "ByteLevel"
        fits = fits and not level["use_regex"] and not level["add_prefix_space"] and len({a + b for a, b in merges}) == len(merges)
        fits = fits and not any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in held["added_tokens"])
        if not fits:
            raise ValueError(f"{path} is no word-end vocabulary of the kind read here")
        self.added = {t["content"]: t["id"] for t in held["added_tokens"]}
        size = max([*vocabulary.values(), *self.added.values()]) + 1
        self.tokens = [""] * size
        for token, number in [*vocabulary.items(), *self.added.items()]:
            self.tokens[number] = token
        symbols = byte_symbols()
        # The last byte of a word is a symbol of its own, so words need no end mark.
        self.inner = np.array([vocabulary[s] for s in symbols], np.int64)
        self.last = np.array([vocabulary[s + end] for s in symbols], np.int64)
        self.left, self.right = np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        self.rank = np.full(size, -1, np.int64)
        for rank, (a, b) in enumerate(merges):
            made = vocabulary[a + b]
            self.left[made], self.right[made], self.rank[made] = vocabulary[a], vocabulary[b], rank
        made = np.flatnonzero(self.rank >= 0)
        pairs = (self.left[made] << 32) | self.right[made]
        order = np.argsort(pairs)
        self.pairs, self.made = pairs[order], made[order]
        self.lookup = dict(zip(self.pairs.tolist(), self.made.tolist(), strict=True))
        self._grow_trie(made)

    def _grow_trie(self, made: np.ndarray) -> None:
        """Children and token of each node, for tokens that merging their own symbols gives again."""
        rank = self.rank.tolist()
        spelled: dict[int, list[int]] = {t: [t] for t in np.concatenate((self.inner, self.last)).tolist()}
        for token in sorted(made.tolist(), key=rank.__getitem__):
            spelled[token] = spelled[int(self.left[token])] + spelled[int(self.right[token])]
        # Parts are older than the token, so its own encoding is itself if its two halves keep theirs and fit.
        proper = set(np.concatenate((self.inner, self.last)).tolist())
        ordered = np.array(sorted(made.tolist(), key=rank.__getitem__), np.int64)
        seams = self.compatible(self.left[ordered], self.right[ordered], self.rank[ordered])
        for token, good in zip(ordered.tolist(), seams.tolist(), strict=True):
            if good and int(self.left[token]) in proper and int(self.right[token]) in proper:
                proper.add(token)
        children: dict[int, int] = {}
        tokens = [-1]
        for token in sorted(proper):
            node = 0
            for symbol in spelled[token]:
                key = node * len(rank) + symbol
                node = children.setdefault(key, len(tokens))
                if node == len(tokens):
                    tokens.append(-1)
            tokens[node] = token
        self.deepest = max(len(spelled[t]) for t in proper)
        keys = np.array(sorted(children), np.int64)
        self.edges, self.heads = keys, np.array([children[k] for k in keys.tolist()], np.int64)
        self.ends = np.array(tokens, np.int64)

    def compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge across the seam of tokens ``a`` and ``b`` comes before those that make them.

        Going back from the whole tokens, the younger of the two is opened at the seam;
        what then lies side by side must not merge before that token was made. Of equal
        ranks the left one comes first. Merges across the seam at or after ``limit`` do not count.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), _NEVER) if limit is None else limit.copy()
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = _find(self.pairs, (x << 32) | y)
            crossing = np.where(at >= 0, self.rank[self.made[at]], _NEVER)
            bad = crossing < limit[live]
            out[live[bad]] = False
            rank_x, rank_y = self.rank[x], self.rank[y]
            live, x, y, rank_x, rank_y = (v[~bad & ((rank_x >= 0) | (rank_y >= 0))] for v in (live, x, y, rank_x, rank_y))
            first = rank_x > rank_y
            limit[live] = np.minimum(limit[live], np.where(first, rank_x, rank_y + 1))
            a[live] = np.where(first, self.right[x], x)
            b[live] = np.where(first, y, self.left[y])
        return out

    def propose(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Longest token from each place and the number of its symbols; ``ends`` holds where each place's word ends."""
        place = np.arange(len(symbols))
        token, length = symbols.copy(), np.ones(len(symbols), np.int64)
        node = np.zeros(len(symbols), np.int64)
        for depth in range(self.deepest):
            inside = place + depth < ends[place]
            place, node = place[inside], node[inside]
            at = _find(self.edges, node * len(self.rank) + symbols[place + depth])
            place, node = place[at >= 0], self.heads[at[at >= 0]]
            if not len(place):
                break
            here = self.ends[node]
            token[place[here >= 0]], length[place[here >= 0]] = here[here >= 0], depth + 1
        return token, length

    def merge(self, symbols: list[int]) -> list[int]:
        """Merge neighbours, lowest rank and leftmost first, until no pair is left."""
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        rank, lookup = self.rank, self.lookup
        heap = []

        def ask(i: int) -> None:
            j = after[i]
            if j < size:
                made = lookup.get((symbols[i] << 32) | symbols[j])
                if made is not None:
                    heapq.heappush(heap, (int(rank[made]), i, symbols[i], symbols[j], made))

        for i in range(size - 1):
            ask(i)
        gone = bytearray(size)
        while heap:
            _, i, x, y, made = heapq.heappop(heap)
            j = after[i]
            if gone[i] or j >= size or symbols[i] != x or symbols[j] != y:
                continue
            symbols[i], gone[j], after[i] = made, 1, after[j]
            if after[j] < size:
                before[after[j]] = i
            if before[i] >= 0:
                ask(before[i])
            ask(i)
        return [s for s, g in zip(symbols, gone, strict=True) if not g]

    def merge_short(self, symbols: np.ndarray) -> np.ndarray:
        """``merge`` of many words of the same number of symbols at once, a row each; rows of fewer tokens end in -1."""
        rows, size = symbols.shape
        symbols = np.concatenate((symbols, np.full((rows, 2), -1)), axis=1)

        def asked(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = _find(self.pairs, (x << 32) | y)
            made = np.where((at >= 0) & (x >= 0) & (y >= 0), self.made[at], -1)
            return made, np.where(made >= 0, self.rank[made], _NEVER)

        made, rank = asked(symbols[:, :-1], symbols[:, 1:])
        place, live = np.arange(size + 2), np.arange(rows)
        out = symbols
        while len(live):
            best = rank.argmin(axis=1)
            go = rank[np.arange(len(live)), best] < _NEVER
            out[live[~go]] = symbols[~go]
            live, symbols, made, rank, best = live[go], symbols[go], made[go], rank[go], best[go]
            if not len(live):
                break
            row = np.arange(len(live))
            new = made[row, best]
            # What lies behind the merged pair moves up by one.
            moved = np.minimum(place[None, :] + (place[None, :] > best[:, None]), size + 1)
            symbols = np.take_along_axis(symbols, moved, axis=1)
            made, rank = (np.take_along_axis(v, np.minimum(moved[:, :-1], size), axis=1) for v in (made, rank))
            symbols[row, best] = new
            made[row, best], rank[row, best] = asked(new, symbols[row, best + 1])
            inner = best > 0
            row, best, new = row[inner], best[inner], new[inner]
            made[row, best - 1], rank[row, best - 1] = asked(symbols[row, best - 1], new)
        return out[:, :size]

    def merge_all(self, words: list[np.ndarray]) -> list[bytes]:
        """``merge`` of every word: short ones by length, side by side, long ones alone."""
        out = [b""] * len(words)
        sizes = np.array([len(w) for w in words], np.int64)
        for size in np.unique(sizes[sizes <= REMEMBERED_BYTES]).tolist():
            chosen = np.flatnonzero(sizes == size)
            for part in np.array_split(chosen, 1 + len(chosen) * size // 500_000):
                merged = self.merge_short(np.stack([words[i] for i in part.tolist()])) if len(part) else part
                ends = ((merged >= 0).sum(axis=1) * 4).tolist() if len(part) else []
                for i, ids, end in zip(part.tolist(), merged.astype("<i4"), ends, strict=True):
                    out[i] = ids.tobytes()[:end]
        for i in np.flatnonzero(sizes > REMEMBERED_BYTES).tolist():
            out[i] = np.array(self.merge(words[i].tolist()), "<i4").tobytes()
        return out

    def encode_words(self, words: list[bytes]) -> tuple[list[bytes], int]:
        """Ids of each word (none is empty), four bytes each, and how many words had to be merged."""
        if not words:
            return [], 0
        sizes = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        stops = np.cumsum(sizes)
        symbols = self.inner[data]
        symbols[stops - 1] = self.last[data[stops - 1]]
        token, length = self.propose(symbols, np.repeat(stops, sizes))
        step, taken, at = length.tolist(), [], 0
        while at < len(symbols):  # no token leaves its word
            taken.append(at)
            at += step[at]
        chosen = token[np.array(taken, np.int64)]
        cuts = np.searchsorted(taken, stops)
        seams = np.setdiff1d(np.arange(1, len(chosen)), cuts, assume_unique=True)  # of two tokens of one word
        bad = seams[~self.compatible(chosen[seams - 1], chosen[seams])]
        failed = np.unique(np.searchsorted(cuts, bad, side="right")).tolist()
        ids, ends = chosen.astype("<i4").tobytes(), [0, *(cuts * 4).tolist()]
        out = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
        for i, merged in zip(failed, self.merge_all([symbols[stops[i] - sizes[i] : stops[i]] for i in failed]), strict=True):
            out[i] = merged
        return out, len(failed)


class Encoder:
    """Ids of texts. Words in use are remembered within bounds, which only saves time."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        self.merges = Merges(path)
        self.library = Tokenizer.from_file(path)  # its tables of characters, for texts beyond the settled ones
        self.words = _settled_words()
        added = sorted(self.merges.added, key=len, reverse=True)
        self.apart = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.known: dict[str | int, bytes] = {}

    def cut(self, text: str) -> list[str]:
        """Words of the normalised text."""
        # Lower case goes character by character: a sigma at a word's end has no form of its own.
        normal = unicodedata.normalize("NFC", text).replace("\u03a3", "\u03c3").lower()
        if text.isascii() or not (_BEYOND.search(text) or _BEYOND.search(normal)):
            return self.words.findall(normal)  # white space is in no word, so it need not be made single
        level = dict(zip(byte_symbols(), range(256), strict=True))
        coded = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
        return [bytes(map(level.__getitem__, word)).decode() for word, _ in coded]

    def parts(self, text: str) -> list[str | int]:
        """Words, and ids of added tokens that the text spells out."""
        if self.apart is None or not self.apart.search(text):
            return self.cut(text)
        added = self.merges.added
        return list(chain.from_iterable([added[p]] if p in added else self.cut(p) for p in self.apart.split(text)))

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        if not self.known or len(self.known) > REMEMBERED_WORDS:
            self.known = {i: np.array(i, "<i4").tobytes() for i in self.merges.added.values()}
        known = self.known
        cut = [self.parts(t) if t else [] for t in texts]
        new = list(set(chain.from_iterable(cut)).difference(known))
        ids, _ = self.merges.encode_words([w.encode() for w in new])
        known.update(zip(new, ids, strict=True))
        out = [np.frombuffer(b"".join(map(known.__getitem__, words)), "<i4") for words in cut]
        for word in new:
            if len(word) > REMEMBERED_BYTES:
                del known[word]
        return out


@lru_cache(maxsize=2)
def _encoder(path: str) -> Encoder:
    return Encoder(path)


def _lists(columns: list[np.ndarray]) -> pa.ListArray:
    offsets = np.cumsum([0, *map(len, columns)]).astype(np.int32)
    return pa.ListArray.from_arrays(offsets, np.concatenate(columns) if columns else np.zeros(0, np.int32))


def _groups(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of rows and characters, one row at least."""
    for part in slices(batch, 200):
        start, held = 0, 0
        for at, size in enumerate(pc.binary_length(part.column(column)).to_pylist()):
            if held and held + (size or 0) > GROUP_CHARS:
                yield part.slice(start, at - start)
                start, held = at, 0
            held += size or 0
        yield part.slice(start)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row, as the library gives them without special tokens.

    Null and empty texts and texts of white space have no ids. Repeated rows keep
    rows of their own. Strings of added tokens in a text get their ids. Null ids
    stay null; columns other than doc_id and text are not read. Texts are read
    whole; a task holds the words of one group of texts (``GROUP_CHARS``) or of one
    longer text. The file of ``path`` must lie at that path on every executor.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in (part for whole in batches for part in _groups(whole, 1)):
            ids = encoder.encode_all(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(ids)], names=["doc_id", "ids"])

    texts = keyed_texts(docs)
    return texts.mapInArrow(run, f"doc_id {texts.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(coded: DataFrame, path: str) -> DataFrame:
    """``coded`` (doc_id, ids) with text: the tokens of the ids, special ones too, parted by spaces.

    That is what the library gives for a file without decoder: symbols of bytes and
    word ends stay. No ids (or null) give an empty text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(_encoder(path).merges.tokens)
        for batch in (part for whole in batches for part in slices(whole, 200)):
            ids = pc.fill_null(batch.column(1), pa.scalar([], batch.column(1).type)) if batch.column(1).null_count else batch.column(1)
            ends = np.cumsum([0, *pc.list_value_length(ids).to_pylist()])
            spelled = pa.LargeListArray.from_arrays(ends, tokens.take(pc.list_flatten(ids)))
            texts = pc.binary_join(spelled, " ").cast(pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), texts], names=["doc_id", "ids", "text"])

    coded = coded.select("doc_id", "ids")
    return coded.mapInArrow(run, f"doc_id {coded.schema['doc_id'].dataType.simpleString()}, ids array<int>, text string")


def with_digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and hashes of the ids and the decoded text, of rows of ``decode``."""
    spelled = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return decoded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(spelled, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256")
    )


def default_vocabulary(spark: SparkSession) -> str:
    """Path of the word-end vocabulary; ``urbanweave.tokenizer.words`` in the session names another."""
    import public_tokenizers

    return spark.conf.get("urbanweave.tokenizer.words", public_tokenizers.path("word_bpe_49k.json"))
