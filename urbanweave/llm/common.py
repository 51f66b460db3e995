"""Helpers the text operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def keyed_texts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns an operator works on, so no other column can clash with its own."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))


_FORGETS: list[Callable[[], None]] = []


def forgets(clear: Callable[[], None]) -> None:
    """Register what empties a module's memory of earlier tasks."""
    _FORGETS.append(clear)


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # only of some C libraries


def let_go() -> None:
    """Hand back to the system what this Python worker has freed, which allocators keep otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def lets_go(run: Callable) -> Callable:
    """``run`` over Arrow batches, which lets go at its end: a worker waits for its next task with what the last one left."""

    @functools.wraps(run)
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            let_go()

    return whole


def meeting(meet: Callable[[pa.Table], Iterator[pa.Table]]) -> Callable:
    """``meet`` of the whole of a group, for ``applyInArrow``: its tables leave one by one, and the worker lets go after the last."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in meet(pa.Table.from_batches(list(batches))):
            yield from table.to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from lets_go(whole)(batches)

    return run


def forget_others() -> None:
    """Empty what tasks of other operators have left in this Python worker, which outlives them."""
    for clear in _FORGETS:
        clear()
    let_go()


#: What an executor holds outside the heap of its JVM. A batch is held whole by the JVM and by the Python worker
#: it leaves for; Spark's own bound, 64 MB, is more than the rows of a task. Parquet's vectored reads of files
#: leave buffers as large as a column chunk with every thread that has read one.
FRUGAL = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m", "parquet.hadoop.vectored.io.enabled": "false"}


def be_frugal(spark: SparkSession) -> None:
    """From now on ``FRUGAL``, where the session has no setting of its own.

    Spark looks these up when a query runs, so a job sets them for what it returns too.
    """
    ours = spark.conf.getAll
    for name, value in FRUGAL.items():
        if name not in ours and f"spark.hadoop.{name}" not in ours:
            spark.conf.set(name, value)


def map_batches(df: DataFrame, fields: list, make: Callable[[], Callable[[dict], dict]]) -> DataFrame:
    """Map Arrow batches of ``df`` to rows of ``fields`` (StructFields).

    ``make`` runs once in each task and returns the function that turns the
    columns of a batch (as Python lists) into the columns of the result.
    Batches are bounded in rows and bytes by Spark.
    """
    from pyspark.sql.types import StructType

    schema = StructType(fields)
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = make()
        for batch in (part for whole in batches for part in slices(whole, 1000)):
            columns = dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns), strict=True))
            out = apply(columns)
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(lets_go(run), schema)


#: Items of an array that are worked through at a time.
CHUNK = 256


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def in_chunks(items: Column, first: Column, advance: Callable[[Column, Column], Column], work: Callable[[Column, Column], Column]) -> Column:
    """Array of ``work(chunk, state)`` over an array cut into chunks, ``state`` being what ``advance`` made of all chunks before.

    An aggregate that adds to an array copies it at every step. Here it adds to
    chunks of ``CHUNK`` items only, so long arrays take time in proportion.
    """
    def states(chunks: Column) -> Column:
        empty = F.struct(first.alias("now"), F.filter(F.array(first), lambda s: F.lit(False)).alias("seen"))
        step = lambda s, chunk: F.struct(advance(s["now"], chunk).alias("now"), F.concat(s["seen"], F.array(s["now"])).alias("seen"))
        return F.aggregate(chunks, empty, step, lambda s: s["seen"])

    def worked(chunks: Column) -> Column:
        return F.zip_with(chunks, states(chunks), work)

    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(CHUNK))
        return bind(F.transform(starts, lambda at: F.slice(whole, at, CHUNK)), worked)

    return bind(items, cut)


def slices(batch: pa.RecordBatch, rows: int = 500) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that only few rows are Python objects at a time."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def ascii_space(text: str | None) -> bytes:
    """UTF-8 bytes of a text; None has none. ``bytes.split()`` then cuts at space and U+0009 to U+000D."""
    return b"" if text is None else text.encode("utf-8")


def _lower_word_table() -> bytes:
    """Bytes of lower-cased words as they are, ASCII bytes outside words as a space."""
    table = bytearray(b" " * 128 + bytes(range(128, 256)))
    for code in range(ord("0"), ord("9") + 1):
        table[code] = code
    for code in range(ord("a"), ord("z") + 1):
        table[code] = table[code - 32] = code
    return bytes(table)


_LOWER_WORDS = _lower_word_table()


def lower_words(text: str | None) -> list[bytes]:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z lower-cased, as UTF-8."""
    return [] if text is None else text.encode("utf-8").translate(_LOWER_WORDS).split()


def keep_rows(df: DataFrame, column: str, make: Callable[[], Callable[[list], list[bool]]]) -> DataFrame:
    """Rows of ``df``, with all their columns, for which the function made by ``make`` says so of ``column``."""
    where = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_others()
        keep = make()
        for batch in (part for whole in batches for part in slices(whole)):
            yield batch.filter(pa.array(keep(batch.column(where).to_pylist()), pa.bool_()))

    return df.mapInArrow(lets_go(run), df.schema)
