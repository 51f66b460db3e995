"""Spelling variants: words one letter apart, each led to its most frequent near word.

Words meet in groups that share a part in which a near pair must agree: of two words
with one error between them, the first or the last half of the shorter one is the same
in both. A group too large is parted again by the same rule over the letters still
free, down to one, so no group is unbounded and no pair is lost.

A group is a bit-sliced position index: for each place and letter, the set of its words
with that letter there, 64 words to a machine word. All words of a task run through it
side by side, keeping four sets a word: no error so far, one replaced letter, one
inserted, one left out. The last two read the index one place ahead or behind.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from urbanweave.llm.common import keyed_texts, slices
from urbanweave.runtime import settle, settle_counted, small_side

SHORTEST, FEWEST, RATIO = 6, 5, 5
#: Words of a group; a larger one is parted.
MOST_WORDS = 1024
#: Different words a task counts before it hands them on.
HELD_WORDS = 300_000
#: Elements (word times machine word of its group) that are worked on at a time.
ELEMENTS = 200_000
_LETTERS = [*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if c in set(_LETTERS) else 32 for c in range(256))


def runs(text: str | None) -> list[bytes]:
    """Maximal runs of A-Z, a-z and U+00C0 to U+00FF, only A-Z lower-cased, in Latin-1; None has none."""
    return [] if text is None else text.encode("latin-1", "replace").translate(_TABLE).split()


def _slipped(run: bytes, seed: int, every: int) -> bytes:
    """``run``, or without one letter where ``every`` divides the checksum of its key and letters."""
    mark = crc32(run if run.isascii() else run.decode("latin-1").encode(), seed)
    return run if mark % every else run[: mark % len(run)] + run[mark % len(run) + 1 :]


def count_words(docs: DataFrame, shortest: int = SHORTEST, fewest: int = FEWEST, slips: int | None = None, held_words: int = HELD_WORDS) -> DataFrame:
    """(word, n): words of at least ``shortest`` letters that occur ``fewest`` times or more in all texts.

    With ``slips``, of one in so many pairs of document and word one letter is left
    out first, by a checksum of doc_id and word (a null id reads as no digits). Null
    and empty texts have no words; repeated rows count again; other columns are not
    read. Tasks hand on counts, so a word in every text is one row per task.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def hand_on() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in (part for whole in batches for part in slices(whole, 200)):
            for key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = Counter(w for w in runs(text) if len(w) >= shortest)
                if slips:
                    seed = crc32(f"{'' if key is None else key}:".encode())
                    for run, n in found.items():
                        word = _slipped(run, seed, slips)
                        if len(word) >= shortest:
                            held[word] += n
                else:
                    held.update(found)
                if len(held) > held_words:
                    yield hand_on()
                    held.clear()
        if held:
            yield hand_on()

    counted = keyed_texts(docs).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= fewest)


# A group: words of ``least`` letters or one more, the same in their first ``head`` and last ``tail``;
# pairs that agree in ``below`` letters or more from the start belong to another group.
_GROUP = ["least", "head", "tail", "below", "shared"]


def _shared() -> Column:
    return F.concat(F.expr("left(word, head)"), F.lit("|"), F.expr("right(word, tail)"))


def _parted(rows: DataFrame) -> DataFrame:
    """Each group in two: pairs that agree in the first half of the free letters, and the others, which do in the last half.

    One error leaves ``free - 1`` letters that agree, so one side has half of them.
    """
    half = ((F.col("least") - F.col("head") - F.col("tail")) / 2).cast("int")
    first = F.struct((F.col("head") + half).alias("head"), F.col("tail").alias("tail"), F.col("below").alias("below"))
    last = F.struct(F.col("head").alias("head"), (F.col("tail") + half).alias("tail"), (F.col("head") + half).alias("below"))
    parts = rows.select("word", "n", "least", F.explode(F.array(first, last)).alias("part")).select("word", "n", "least", "part.*")
    # Where fewer letters agree than the group shares there is no pair left.
    return parts.where("head < below").withColumn("shared", _shared())


def _grouped(vocabulary: DataFrame, shortest: int, most: int) -> DataFrame:
    size = F.length("word")
    leasts = F.explode(F.filter(F.array(size, size - 1), lambda a: a >= shortest))
    rows = vocabulary.select("word", "n", leasts.alias("least")).withColumns({"head": F.lit(0), "tail": F.lit(0), "below": F.lit((1 << 31) - 1)})
    rows, done = settle(_parted(rows)), None
    while True:
        free = F.col("least") - F.col("head") - F.col("tail")
        large, count = settle_counted(rows.groupBy(*_GROUP).count().where((F.col("count") > most) & (free > 1)).select(*_GROUP))
        small = rows.join(small_side(large, count), _GROUP, "left_anti") if count else rows
        done = small.select(*rows.columns) if done is None else done.unionByName(small)
        if not count:
            return done
        rows = settle(_parted(rows.join(small_side(large, count), _GROUP, "left_semi")))


def _cells(keys: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the union of the bits of each."""
    order = np.argsort(keys, kind="stable")
    keys, bits = keys[order], bits[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[heads], (np.bitwise_or.reduceat(bits, heads) if len(heads) else bits)


class PositionIndex:
    """Bit sets of groups of words by (lane, place, letter) and by (lane, length); a lane holds up to 64 words of one group."""

    def __init__(self, words: list[bytes], groups: np.ndarray):
        """``groups`` numbers each word's group, in ascending order."""
        self.sizes = np.array([len(w) for w in words], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        heads = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
        counts = np.diff(np.r_[heads, len(words)])
        lanes = -(-counts // 64)
        nth = np.arange(len(words)) - np.repeat(heads, counts)
        self.first_lane = np.repeat(np.cumsum(lanes) - lanes, counts)
        self.lanes = np.repeat(lanes, counts)
        lane, bit = self.first_lane + nth // 64, np.uint64(1) << (nth % 64).astype(np.uint64)
        self.member = np.full((int(lanes.sum()), 64), -1, np.int64)
        self.member[lane, nth % 64] = np.arange(len(words))
        self.places = int(self.sizes.max()) + 2
        place = np.arange(len(self.letters)) - np.repeat(self.starts, self.sizes)
        self.cells = _cells((np.repeat(lane, self.sizes) * self.places + place) * 256 + self.letters, np.repeat(bit, self.sizes))
        self.lengths = _cells(lane * self.places + self.sizes, bit)

    @staticmethod
    def _look(cells: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> np.ndarray:
        spot = np.minimum(np.searchsorted(cells[0], keys), len(cells[0]) - 1)
        return np.where(cells[0][spot] == keys, cells[1][spot], np.uint64(0))

    def with_letter(self, lane: np.ndarray, place: int, letter: np.ndarray) -> np.ndarray:
        return self._look(self.cells, (lane * self.places + place) * 256 + letter)

    def with_length(self, lane: np.ndarray, length: np.ndarray) -> np.ndarray:
        return self._look(self.lengths, lane * self.places + length)

    def near(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of words of a group one error apart, both ways; ``least`` is each word's shorter length in its group.

        Two words of ``least + 1`` letters are not compared.
        """
        found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
        ends = np.cumsum(self.lanes)
        cuts = np.unique(np.r_[0, np.searchsorted(ends, np.arange(ELEMENTS, int(ends[-1]), ELEMENTS)), len(ends)])
        for a, b in zip(cuts, cuts[1:], strict=False):
            found.append(self._run(np.arange(a, b), least))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _run(self, asked: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts = self.lanes[asked]
        word = np.repeat(asked, counts)
        lane = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts) + self.first_lane[word]
        order = np.argsort(-self.sizes[word], kind="stable")  # words that end first lie last
        word, lane = word[order], lane[order]
        size, start = self.sizes[word], self.starts[word]
        none = np.full(len(word), ~np.uint64(0))
        changed, short = np.zeros(len(word), np.uint64), np.zeros(len(word), np.uint64)
        extra = none.copy()
        live = len(word)
        for place in range(int(size[0])):
            live = int(np.searchsorted(-size[:live], -place, side="left"))
            at, letter = lane[:live], self.letters[start[:live] + place]
            here, ahead = self.with_letter(at, place, letter), self.with_letter(at, place + 1, letter)
            behind = self.with_letter(at, place - 1, letter) if place else np.zeros(live, np.uint64)
            before = none[:live]
            changed[:live] = (changed[:live] & here) | (before & ~here)
            short[:live] = (short[:live] & behind) | before
            none[:live] = before & here
            extra[:live] = (extra[:live] & ahead) | none[:live]
        shorter = size == least[word]
        ones = np.where(
            shorter,
            (changed & self.with_length(lane, size)) | (extra & self.with_length(lane, size + 1)),
            short & self.with_length(lane, size - 1),
        )
        hit = np.flatnonzero(ones)
        bits = np.unpackbits(ones[hit].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, bit = np.nonzero(bits)
        return word[hit[row]], self.member[lane[hit[row]], bit]


def near_words(vocabulary: DataFrame, shortest: int = SHORTEST, most: int = MOST_WORDS) -> DataFrame:
    """(word, near, near_n): every two words of ``vocabulary`` (word, n) with one inserted, deleted or replaced letter, both ways.

    Words are distinct, of Latin-1 letters and at least ``shortest`` of them.
    """
    spark = vocabulary.sparkSession
    rows, count = settle_counted(_grouped(vocabulary, shortest, most))
    buckets = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), count // 4000)

    def find(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in _GROUP])
        words = [w.encode("latin-1") for w in table["word"].to_pylist()]
        names = list(zip(*(table[c].to_pylist() for c in _GROUP), strict=True))
        groups = np.cumsum([0, *(a != b for a, b in zip(names, names[1:], strict=False))])
        n, below = table["n"].to_numpy(), table["below"].to_pylist()
        a, b = PositionIndex(words, groups).near(table["least"].to_numpy())
        own = [words[i][: below[i]] != words[j][: below[i]] for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        a, b = a[np.array(own, bool)], b[np.array(own, bool)]
        column = table["word"]
        return pa.table([column.take(pa.array(a)), column.take(pa.array(b)), pa.array(n[b])], names=["word", "near", "near_n"])

    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*_GROUP), F.lit(buckets)))
    return dealt.groupBy("bucket").applyInArrow(find, "word string, near string, near_n long")


def _roots(forms: DataFrame) -> DataFrame:
    """(start, root): where the forms of (start, root) lead in the end; each round doubles the steps taken."""
    roots, rows = settle_counted(forms)
    while True:
        on = small_side(roots.select(F.col("start").alias("root"), F.col("root").alias("beyond")), rows)
        further, rows = settle_counted(roots.join(on, "root", "left").select("start", F.coalesce("beyond", "root").alias("root"), "beyond"))
        roots = further.select("start", "root")
        if further.where("beyond is not null").limit(1).count() == 0:
            return roots


def variants(vocabulary: DataFrame, ratio: int = RATIO, shortest: int = SHORTEST, most: int = MOST_WORDS) -> DataFrame:
    """Per word of ``vocabulary`` (word, n): form, root, n, n_near and form_n.

    form is the near word of largest n (of equals the first in code-point order) if
    that n is ``ratio`` (above 1) times the word's own or more, else null; root is
    where forms lead in the end, the word itself without form; n_near counts near words.
    """
    if ratio <= 1:
        raise ValueError("a form must be more frequent than its variant")
    vocabulary = settle(vocabulary.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near").alias("form"))).alias("best")
    near = near_words(vocabulary, shortest, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    judged = vocabulary.join(near, "word", "left").withColumn("led", -F.col("best.rank") >= F.col("n") * ratio)
    found = settle(
        judged.select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(F.col("led"), F.col("best.form")).alias("form"),
            F.when(F.col("led"), -F.col("best.rank")).alias("form_n"),
        )
    )
    led, rows = settle_counted(_roots(found.where("form is not null").select(F.col("word").alias("start"), F.col("form").alias("root"))))
    rooted = found.join(small_side(led, rows), found.word == led.start, "left")
    return rooted.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
