"""Media columns: content-addressed payloads in tar shards.

Payloads are 8-bit grey images in PNG files, named by the digest of the stored file, in tar shards of bounded size below the
shared folder. Rows carry digest, shard, offset and length, so that a payload is one range read and the rest of a shard is
never touched; metadata columns need only the first 33 bytes of an entry.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import extended, flagged, lean, open_fs, small_batches
from kgspark.session import fresh_dir, written

WIDTH = 64
#: Fixed value: the first eight bytes of a PNG file.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER_BYTES = 33
SHARD_BYTES = 256 << 20
LEVEL = 3


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def payload(text: str | None) -> bytes:
    """UTF-8 bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw.ljust(max(WIDTH, -(-len(raw) // WIDTH) * WIDTH), b"\0")


def to_png(samples: bytes) -> bytes:
    """A grey image 64 samples wide, one byte a sample, without loss."""
    rows = len(samples) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)  # each line after its filter byte 0
    lines[:, 1:] = np.frombuffer(samples, np.uint8).reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def png_header(first: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first 33 bytes alone."""
    if len(first) < HEADER_BYTES or first[:8] != SIGNATURE or first[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    width, height, depth, colour = struct.unpack(">IIBB", first[16:26])
    if struct.unpack(">I", first[29:33])[0] != zlib.crc32(first[12:29]):
        raise ValueError("PNG header is damaged")
    return width, height, depth, colour


def from_png(data: bytes) -> bytes:
    """The samples of an image that ``to_png`` made; checksums are verified."""
    width, height, depth, colour = png_header(data[:HEADER_BYTES])
    if (width, depth, colour) != (WIDTH, 8, 0):
        raise ValueError("not an image of this store")
    at, packed = 8, []
    while at < len(data):
        (n,) = struct.unpack(">I", data[at : at + 4])
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if struct.unpack(">I", data[at + 8 + n : at + 12 + n])[0] != zlib.crc32(kind + body):
            raise ValueError("PNG chunk is damaged")
        if kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, WIDTH + 1)
    if lines[:, 0].any():
        raise ValueError("only unfiltered lines are stored")
    return np.ascontiguousarray(lines[:, 1:]).tobytes()


def feature(samples: bytes) -> str:
    """Mean, spread and entropy of the samples, and an average hash over 8 x 8 fields of the image."""
    x = np.frombuffer(samples, np.uint8)
    n = np.bincount(x, minlength=256)
    p = n[n > 0] / len(x)
    # the image stretched to 8 x 8: fields of 8 columns, rows dealt to 8 bands in order
    rows = len(x) // WIDTH
    lines = x.reshape(rows, 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    band = np.arange(rows) * 8 // rows
    total = np.zeros((8, 8), np.int64)
    np.add.at(total, band, lines)
    mean = total / np.maximum(1, np.bincount(band, minlength=8))[:, None]
    bits = int("".join("1" if v else "0" for v in (mean > mean.mean()).ravel()), 2)
    return f"mean={x.mean():.4f};std={x.std():.4f};entropy={-(p * np.log2(p)).sum():.4f};ahash={bits:016x}"


PLACE = "digest string, shard string, offset long, length long"
#: Bytes of stored payloads that one task reads back, about; a larger payload is a task's alone.
READ_BYTES = 32 << 20
#: Bytes of a shard that are dealt out together; tasks hold some of these runs, so that their loads even out.
RUN_BYTES = 2 << 20
#: Rows of one payload from which they are spread over ``SPREAD`` tasks to meet it.
HOT_ROWS = 1024
SPREAD = 64
#: The payload's digest by built-in functions: its bytes, padded.
KEY = f"unhex(sha2(rpad(cast(text AS binary), cast({WIDTH} * greatest(1, ceil(octet_length(text) / {WIDTH})) AS int), X'00'), 256))"


def packed(rows: DataFrame, top: str, name: str) -> DataFrame:
    """Write the payload of every row's ``text`` to tar shards below ``top``; returns the other columns with digest, shard, offset and length.

    Every task attempt writes shards of its own name, so a repeated attempt can't damage what an earlier one
    wrote; the catalogue, written as ``name`` before this returns, names only the shards of attempts that count.
    """
    small_batches(rows.sparkSession)
    carried = [c for c in rows.columns if c != "text"]
    schema = extended(rows.select(*carried).schema, PLACE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        disk, folder = open_fs(top)
        disk.create_dir(folder, recursive=True)
        own = f"{name}-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}"
        out, shard, at, number = None, "", 0, 0

        def close() -> None:
            if out is not None:
                out.write(b"\0" * 1024)  # two empty blocks end a tar file
                out.close()

        try:
            for b in batches:
                places: list[list] = [[] for _ in range(4)]
                for t in b.column("text"):
                    png = to_png(payload(t.as_py()))
                    digest = hashlib.sha256(png).hexdigest()
                    if out is None or at > SHARD_BYTES:
                        close()
                        shard, at = f"{top}/{own}-{number:04d}.tar", 0
                        number += 1
                        out = disk.open_output_stream(f"{folder}/{shard.rsplit('/', 1)[1]}", compression=None)
                    info = tarfile.TarInfo(f"{digest}.png")
                    info.size = len(png)
                    head = info.tobuf(tarfile.USTAR_FORMAT)
                    out.write(head + png + b"\0" * (-len(png) % 512))
                    for column, v in zip(places, (digest, shard, at + len(head), len(png))):
                        column.append(v)
                    at += len(head) + len(png) + -len(png) % 512
                types = [pa.string(), pa.string(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carried), *(pa.array(x, y) for x, y in zip(places, types))], schema.names)
        finally:
            close()

    path = f"{top}/{name}"
    rows.mapInArrow(lean(run), schema).write.parquet(path)
    return rows.sparkSession.read.schema(schema).parquet(path)


class Stored:
    """Payloads in shards, each once in all, and who holds them.

    ``catalog`` has a row a payload: (id, n_bytes) where one row alone holds it, else ``key``, by which the rows of ``holders`` (id, n_bytes, key) find it.

    Rows are known by the digests of their payloads, which are counted first. Rows whose payload certainly isn't repeated are packed where they
    are read; of the others one text a payload and task is shuffled.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str, base: str | None) -> None:
        top = base or fresh_dir(docs.sparkSession, "media")
        text = F.coalesce(F.col(text_col), F.lit(""))
        rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
        rows = rows.select("id", F.octet_length("text").cast("long").alias("n_bytes"), F.expr(KEY).alias("key"), "text")
        each = written(rows.drop("text"), "media-keys")
        copies = written(each.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), "media-copies")
        again = copies.select("key")
        # a row that is flagged wrongly goes the longer way to the same result
        alone = packed(flagged(rows, "key", again, "again").where("NOT again").select("id", "n_bytes", "text"), top, "alone")
        texts = flagged(rows, "key", again, "again").where("again").groupBy("key").agg(F.first("text").alias("text"))
        shared = packed(texts, top, "shared")
        self.holders = flagged(each, "key", again, "again").where("again").drop("again")
        self.hot = copies.where(F.col("rows") >= HOT_ROWS).select("key")
        self.catalog = alone.withColumn("key", F.lit(None).cast("binary")).unionByName(shared, allowMissingColumns=True)

    def by_row(self, catalog: DataFrame) -> DataFrame:
        """``catalog``, with whatever columns more, for every row that holds a payload instead of for every payload; rows of a hot payload are spread."""
        salted = flagged(self.holders, "key", self.hot, "hot").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("id", "n_bytes"), F.lit(SPREAD)).cast("int")).otherwise(0)).drop("hot")
        salts = F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))
        shared = flagged(catalog.where("key IS NOT NULL").drop("id", "n_bytes"), "key", self.hot, "hot").withColumn("salt", F.explode(salts)).drop("hot")
        found = salted.join(shared, ["key", "salt"]).drop("key", "salt")
        return catalog.where("key IS NULL").drop("key").unionByName(found)


def dealt(catalog: DataFrame) -> DataFrame:
    """The catalogue with its rows dealt to tasks by bytes, neighbours in a shard together and in order."""
    size = catalog.agg(F.sum("length")).first()[0] or 0
    tasks = max(catalog.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES))
    return catalog.repartition(tasks, "shard", F.expr(f"offset DIV {RUN_BYTES}")).sortWithinPartitions("shard", "offset")


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: str | None = None) -> DataFrame:
    """Write every different payload to tar shards, once in all; returns ``(id, digest, shard, offset, length, n_bytes)``, one row for each row.

    Rows of equal payloads share shard and offset. Null texts count as empty; repeated rows and null ids give rows of their own; an empty table gives no rows.
    """
    kept = Stored(docs, id_col, text_col, base)
    return kept.by_row(kept.catalog).select("id", "digest", "shard", "offset", "length", "n_bytes")


class _Shards:
    """Open shards of one task; the last few stay open."""

    def __init__(self) -> None:
        self.open: dict[str, object] = {}

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard not in self.open:
            if len(self.open) >= 8:
                self.open.pop(next(iter(self.open))).close()
            disk, path = open_fs(shard)
            self.open[shard] = disk.open_input_file(path)
        got = self.open[shard].read_at(length, offset)
        if len(got) != length:
            raise ValueError(f"{shard} ends before {offset + length}")
        return got


def with_metadata(catalog: DataFrame) -> DataFrame:
    """The catalogue with width, height, bit_depth and colour_type, from range reads of 33 bytes a row."""
    small_batches(catalog.sparkSession)
    schema = extended(catalog.schema, "width int, height int, bit_depth int, colour_type int")
    at = [catalog.columns.index(c) for c in ("shard", "offset")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards()
        for b in batches:
            heads = [png_header(shards.read(s, o, HEADER_BYTES)) for s, o in zip(*(b.column(i).to_pylist() for i in at))]
            more = [pa.array([h[k] for h in heads], pa.int32()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "width", "height", "bit_depth", "colour_type"])

    return catalog.mapInArrow(run, schema)


def read_back(catalog: DataFrame, payloads: bool = False) -> DataFrame:
    """The catalogue with digests and features of what is stored: payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.

    ``payloads`` adds the payload itself. A stored file whose digest isn't the row's raises.
    """
    small_batches(catalog.sparkSession)
    new = [("payload_bytes", "long"), ("payload_sha256", "string"), ("tail_crc32", "long"), ("media_bytes", "long"), ("media_sha256", "string"), ("feature", "string")]
    new += [("payload", "binary")] * payloads
    schema = extended(catalog.schema, ", ".join(f"{name} {kind}" for name, kind in new))
    at = [catalog.columns.index(c) for c in ("shard", "offset", "length", "digest")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards()
        for b in batches:
            rows: list[list] = [[] for _ in new]
            for shard, offset, length, digest in zip(*(b.column(i).to_pylist() for i in at)):
                stored = shards.read(shard, offset, length)
                found = hashlib.sha256(stored).hexdigest()
                if found != digest:
                    raise ValueError(f"{shard} at {offset} isn't {digest}")
                samples = from_png(stored)
                values = (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-WIDTH:]), len(stored), found, feature(samples), samples)
                for k in range(len(new)):
                    rows[k].append(values[k])
            types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(x, types[t]) for x, (_, t) in zip(rows, new))], [*b.schema.names, *(c for c, _ in new)])

    return catalog.mapInArrow(run, schema)


def media_columns(docs: DataFrame) -> DataFrame:
    """Store all texts as media, then fill columns from headers and from the stored bytes, one row for each row of ``docs``.

    Every payload is stored once and read back once, however many rows hold it, in tasks of about equal bytes.
    Null texts count as empty, whose payload is 64 zeros; equal texts have equal values; long texts are one image as well; an empty table
    gives no rows and no shards.
    """
    kept = Stored(docs, "doc_id", "text", None)
    seen = written(read_back(with_metadata(dealt(kept.catalog))), "media-read")
    return kept.by_row(seen).select(
        F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "shard", "offset", "length", "width", "height", "bit_depth", "colour_type",
    )
