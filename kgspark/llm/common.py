"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.session import cut

#: Rows and bytes of one Arrow batch; a single larger row is a batch of its own.
BATCH_ROWS = 1024
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of Python stages by rows and bytes; lower settings of the session's owner stay."""
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most, number in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS, int), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES, size)):
        if not 0 < number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """A column of strings, null as empty."""
    return [t or "" for t in batch.column(name).to_pylist()]


@cache
def _trim() -> Callable[[int], int] | None:
    return getattr(ctypes.CDLL(None), "malloc_trim", None)


def let_go() -> None:
    """Give freed memory of this worker back to the machine: workers live on between tasks and would keep their peaks."""
    pa.default_memory_pool().release_unused()
    if trim := _trim():
        trim(0)


Step = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def lean(run: Step) -> Step:
    """``run`` that lets go of its memory when its task ends."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            let_go()

    return out


def chunks(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Cut batches further where a step needs fewer rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI of the shared folder; a bare path is local."""
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + os.path.abspath(uri.removeprefix("file:")))


def extended(schema: T.StructType, ddl: str) -> T.StructType:
    """``schema`` and the fields of ``ddl`` behind it."""
    return T.StructType([*schema.fields, *T.StructType.fromDDL(ddl).fields])


def by_key(df: DataFrame, keys: list[str], work: Callable[[pa.Table, np.ndarray], Iterator[pa.RecordBatch]], ddl: str) -> DataFrame:
    """Call ``work(rows, bounds)`` for runs of whole groups: rows are sorted by the integer ``keys``, and group i is
    ``rows[bounds[i]:bounds[i + 1]]``.

    One shuffle by key. A task holds about 20,000 rows, or one group if that is larger, so groups must be bounded.
    """

    def starts(rows: pa.Table) -> np.ndarray:
        new = np.zeros(rows.num_rows, dtype=bool)
        new[0] = True
        for k in keys:
            x = rows.column(k).to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += b.num_rows
            if size >= 20_000:
                rows = pa.Table.from_batches(held)
                at = starts(rows)
                if len(at) > 1:
                    yield from work(rows.slice(0, int(at[-1])).combine_chunks(), at)
                    rest = rows.slice(int(at[-1])).combine_chunks()
                    held, size = rest.to_batches(), rest.num_rows
        if size:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield from work(rows, np.append(starts(rows), rows.num_rows))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lean(run), ddl)


#: Bits of the filter that ``flagged`` sends to all tasks: 4 MB in 1,024 pieces.
FILTER_BITS = 1 << 25
PIECE_BITS = 1 << 15


def flagged(rows: DataFrame, key: str, ids: DataFrame, name: str) -> DataFrame:
    """``rows`` with the flag ``name``: false where ``key`` certainly isn't among ``ids``, a frame of one column; null keys aren't.

    A filter of a fixed number of bits, one hash an id, is all that is broadcast, however many ids there are. With very many ids more rows are
    flagged than need be; joins behind it stay exact.
    """
    own = rows.schema[key].dataType
    place = lambda c: F.pmod(F.xxhash64(F.lit(11), c.cast(own)), F.lit(FILTER_BITS))
    spot = place(F.col(ids.columns[0]))
    piece, bit, bits = unused("piece", rows.columns), unused("bit", rows.columns), unused("bits", rows.columns)
    pieces = ids.select(F.floor(spot / PIECE_BITS).alias(piece), (spot % PIECE_BITS).alias("at")).groupBy(piece).agg(F.bitmap_construct_agg("at").alias(bits))
    spot = place(F.col(f"`{key}`"))
    marked = rows.withColumn(bit, spot).join(F.broadcast(cut(pieces, FILTER_BITS // PIECE_BITS)), F.floor(F.col(bit) / PIECE_BITS) == F.col(piece), "left")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(F.col(bit) % PIECE_BITS / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.getbit(byte, (F.col(bit) % 8).cast("int")) == 1
    return marked.withColumn(name, F.coalesce(hit & F.col(f"`{key}`").isNotNull(), F.lit(False))).drop(piece, bit, bits)


def _sorted_out(rows: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, str, str, bool]:
    """``rows`` with two flags: may be among ``ids``, and may be there wrongly; and whether any is there wrongly."""
    maybe, wrong = unused("maybe", rows.columns), unused("wrong", rows.columns)
    first = flagged(rows, key, ids, maybe)
    own = unused("of", [key])
    astray = cut(first.where(F.col(maybe)).select(F.col(f"`{key}`")).distinct().join(ids.select(F.col(ids.columns[0]).alias(own)), F.col(f"`{key}`") == F.col(own), "left_anti"))
    if astray.isEmpty():
        return first.withColumn(wrong, F.lit(False)), maybe, wrong, False
    return flagged(first, key, astray, wrong), maybe, wrong, True


def members(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows whose ``key`` is among ``ids``, a frame of one column: a semi join that shuffles keys instead of rows.

    Rows that pass the filter of ``ids``, but not one of those keys that pass it wrongly, are members for certain; only the rest of whole rows goes through
    a join. Null keys are no members.
    """
    marked, maybe, wrong, any_wrong = _sorted_out(rows, key, ids)
    sure = marked.where(F.col(maybe) & ~F.col(wrong)).select(*rows.columns)
    if not any_wrong:
        return sure
    of = unused("of", rows.columns)
    unsure = marked.where(F.col(maybe) & F.col(wrong)).select(*rows.columns)
    return sure.unionAll(unsure.join(ids.select(F.col(ids.columns[0]).alias(of)).hint("shuffle_hash"), F.col(f"`{key}`") == F.col(of), "left_semi"))


def others(rows: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    """The rows that ``members`` leaves, null keys among them."""
    marked, maybe, wrong, any_wrong = _sorted_out(rows, key, ids)
    sure = marked.where(~F.col(maybe)).select(*rows.columns)
    if not any_wrong:
        return sure
    of = unused("of", rows.columns)
    unsure = marked.where(F.col(maybe) & F.col(wrong)).select(*rows.columns)
    return sure.unionAll(unsure.join(ids.select(F.col(ids.columns[0]).alias(of)).hint("shuffle_hash"), F.col(f"`{key}`") == F.col(of), "left_anti"))


def unused(name: str, columns: list[str]) -> str:
    """``name``, with underscores behind it if a column already has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name
