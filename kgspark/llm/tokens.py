"""Token counts by a separator scan over flat token files.

A token file is nothing but ids of 16 or 32 bits, little-endian, with an end-of-document id after each document; there is no index
and no length anywhere. Files are cut into blocks of equal size, each block is searched for the separator in one
vectorised comparison, and a prefix scan over the blocks' summaries (separators so far, place of the last one) stitches
documents that cross block boundaries.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kgspark.llm.bpe import loaded
from kgspark.llm.common import open_fs, small_batches
from kgspark.session import cut, fresh_dir

BLOCK_BYTES = 8 << 20
#: A writer begins a new file beyond this.
FILE_BYTES = 256 << 20


def write_token_files(docs: DataFrame, vocabulary: str, separator: int | None = None, base: str | None = None) -> tuple[str, DataFrame]:
    """Encode every whole text and append it and the separator to flat files of 16-bit ids.

    Returns the folder and ``(doc_id, file, ordinal)``, the order of documents within files. A separator's string within a text is encoded as ordinary
    text, so the separator's id ends documents and nothing else. The list of files is in the returned table alone: files
    of task attempts that don't count are never read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    top = base or fresh_dir(spark, "tokens")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        end = separator if separator is not None else next(iter(bpe.special.values()))
        if bpe.size > 1 << 16 or not 0 <= end < 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        mark = np.array([end], "<u2").tobytes()
        task = TaskContext.get()
        disk, folder = open_fs(top)
        disk.create_dir(folder, recursive=True)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, number, size, ordinal = None, -1, 0, 0
        try:
            for b in batches:
                files, ordinals = [], []
                for t in b.column(1):
                    if out is None or size > FILE_BYTES:
                        if out is not None:
                            out.close()
                        number, size, ordinal = number + 1, 0, 0
                        out = disk.open_output_stream(f"{folder}/{name}-{number:04d}.bin", compression=None)
                    ids = np.frombuffer(bpe.plain(t.as_py() or ""), "<u4").astype("<u2").tobytes()
                    out.write(ids + mark)
                    size += len(ids) + len(mark)
                    files.append(f"{name}-{number:04d}.bin")
                    ordinals.append(ordinal)
                    ordinal += 1
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(files, pa.string()), pa.array(ordinals, pa.int64())], ["doc_id", "file", "ordinal"])
        finally:
            if out is not None:
                out.close()

    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, file string, ordinal long")
    rows.write.parquet(f"{top}/order")
    return top, spark.read.schema(rows.schema).parquet(f"{top}/order")


def scan(files: DataFrame, separator: int, width: int = 2, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Documents of flat token files: ``(file, ordinal, start, n_tokens)``, start and n_tokens in ids.

    ``files`` has one row for each file: ``file``, a URI, and ``bytes``, its size. Ids behind a file's last separator are a last document. Files
    of no ids have no documents; separators in a row are empty documents. A size that isn't a whole number of ids raises.
    """
    spark = files.sparkSession
    small_batches(spark)
    if block_bytes % width:
        raise ValueError("blocks must hold whole ids")
    blocks = (
        files.where("bytes > 0")
        .select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") - 1) / block_bytes))).alias("block"))
        .repartition("file", "block")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, size, block in zip(*(b.column(i).to_pylist() for i in range(3))):
                if size % width:
                    raise ValueError(f"{file}: {size} bytes aren't whole ids")
                disk, path = open_fs(file)
                with disk.open_input_file(path) as f:
                    raw = f.read_at(min(block_bytes, size - block * block_bytes), block * block_bytes)
                first = block * (block_bytes // width)
                ends = np.flatnonzero(np.frombuffer(raw, f"<u{width}") == separator) + first
                last = (block + 1) * block_bytes >= size
                total = size // width
                open_end = last and (not len(ends) or ends[-1] != total - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file]), pa.array([block], pa.int64()), pa.array([ends.tolist()], pa.list_(pa.int64())), pa.array([total if open_end else None], pa.int64())],
                    ["file", "block", "ends", "open_end"],
                )

    found = blocks.mapInArrow(run, "file string, block long, ends array<long>, open_end long").select(
        "file", "block", F.when(F.col("open_end").isNotNull(), F.array_append("ends", F.col("open_end"))).otherwise(F.col("ends")).alias("ends")
    )
    found = cut(found)
    # the prefix scan sees one number pair a block: separators before it, and the place behind the last of them
    so_far = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = found.select("file", "block", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
    before = summary.select(
        "file", "block", F.coalesce(F.sum("n").over(so_far), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(so_far) + 1, F.lit(0)).alias("carry")
    )
    carried = found.join(before, ["file", "block"])
    each = carried.select("file", "base", "carry", "ends", F.posexplode("ends").alias("i", "end"))
    begin = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.element_at("ends", F.greatest("i", F.lit(1))) + 1)
    return each.select("file", (F.col("base") + F.col("i")).alias("ordinal"), begin.alias("start"), (F.col("end") - begin).alias("n_tokens"))


def file_sizes(spark: SparkSession, folder: str, names: DataFrame) -> DataFrame:
    """``(file, name, bytes)`` of the named files of a folder; asked for on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, path = open_fs(folder)
        for b in batches:
            own = b.column(0).to_pylist()
            sizes = [i.size if i.type == fs.FileType.File else None for i in disk.get_file_info([f"{path}/{n}" for n in own])]
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{n}" for n in own], pa.string()), b.column(0), pa.array(sizes, pa.int64())], ["file", "name", "bytes"])

    return names.mapInArrow(run, "file string, name string, bytes long")


def token_counts(docs: DataFrame, vocabulary: str, separator: int = 50_256) -> DataFrame:
    """Write ``docs`` to flat files, scan them and name the documents: ``(doc_id, n_tokens, file, ordinal, start)``.

    One row for each row of ``docs``; null and empty texts have 0 tokens; repeated rows repeat; an empty table gives no rows.
    """
    folder, order = write_token_files(docs, vocabulary, separator)
    files = file_sizes(docs.sparkSession, folder, order.select("file").distinct())
    found = scan(files.select("file", "bytes"), separator)
    named = found.withColumn("name", F.substring_index("file", "/", -1))
    # one row a document on both sides, so never a broadcast, however well the files of either compress
    return order.join(named.drop("file").hint("merge"), (order.file == named.name) & (order.ordinal == named.ordinal)).select(
        "doc_id", "n_tokens", order.file, order.ordinal, "start"
    )
