"""SimHash near-duplicates, found with pivot distance tables.

Every fingerprint gets its Hamming distances to a set of reference fingerprints (the pivots), once. By the triangle
inequality two fingerprints within ``radius`` bits differ by at most ``radius`` in every coordinate, so a pair with a
larger difference in any coordinate is discarded without looking at the fingerprints; survivors are verified bit by
bit.

The first coordinates also deal the rows out to tasks: each splits the rows at half the bits, and rows at the lower edge of the upper
side, which may have partners on the lower one, go to both. So two fingerprints within ``radius`` bits always meet
in a cell, and there are as many splits as the number of fingerprints asks for. A cell that stays large, such as one of a large group of near copies, is
cut into blocks of which every two are compared in a task of their own. Links are reduced to a spanning forest before they leave a task.

Texts that share 0.8 of their shingles are about 10 bits apart, and pivot tables deal nothing out at such a radius: in 64 bits nearly all pairs are within it in
every coordinate. ``similar`` therefore deals by samples of the shingles, and the tables only discard pairs within its cells.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import by_key, lean, members, others, small_batches, unused
from kgspark.operators.graph import connected_components
from kgspark.session import written

BITS = 64
SEED = 42
#: Coordinates that only discard pairs, besides those that deal rows out.
DISCARDING = 8
#: Fingerprints of a cell that are compared in one task, about.
CELL = 2048
#: Places of a sketch: each holds a byte of the smallest shingle hash among those of its own range.
PLACES = 256
#: Samples of a text's shingles, and shingles of a sample. Texts that share 0.8 of their shingles have a sample in common with 0.997, 0.9 with 0.99997.
SAMPLES = 8
SAMPLE = 3
#: Bits that fingerprints of the different shingles may differ by at a similarity of 0.8: they differ by 9.7, with a deviation of 2.9, so this is five away.
WIDE = 24


def pivots(count: int) -> np.ndarray:
    """Reference fingerprints by rule: the hashes of their numbers."""
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(count)], dtype=np.uint64)


def shingles(text: str | None, words: int) -> np.ndarray:
    """Hashes of all ``words``-word shingles, repeats included.

    A-Z are lower-cased and words are runs of other characters than space and U+0009-000D. Fewer words than
    ``words`` make one shingle; no word makes none.
    """
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return np.array([digest(b" ".join(parts), SEED)] if parts else [], dtype=np.uint64)
    flat = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = [0, *(ends[: -words] + 1).tolist()]
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())], dtype=np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half the hashes; 0 of none."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    over = bits.sum(axis=0, dtype=np.int64) * 2 > len(hashes)
    return int(np.packbits(over, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, words: int = 3) -> int:
    """Majority bits of the hashes of all ``words``-word shingles, repeats included; 0 where there is no word."""
    return majority(shingles(text, words))


def sketch(hashes: np.ndarray) -> tuple[int, bytes, list[int]]:
    """The fingerprint of the different hashes, their sketch, 0 where a place has none, and the keys of their samples."""
    each = np.unique(hashes)
    if not len(each):
        return 0, bytes(PLACES), []
    at = np.searchsorted(each, np.arange(PLACES, dtype=np.uint64) << np.uint64(BITS - PLACES.bit_length() + 1))
    ends = np.r_[at[1:], len(each)]
    held = each[np.minimum(at, len(each) - 1)]
    places = np.where(at < ends, 1 + held % np.uint64(255), 0).astype(np.uint8)
    keys = []
    for turn in pivots(SAMPLES) | np.uint64(1):
        mixed = each * turn
        low = np.sort(mixed if len(mixed) <= SAMPLE else np.partition(mixed, SAMPLE - 1)[:SAMPLE])
        keys.append(xxhash.xxh64_intdigest(low.astype("<u8").tobytes(), int(turn)))
    return majority(each), places.tobytes(), np.array(keys, np.uint64).view(np.int64).tolist()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of every row; fp is the fingerprint's 64 bits as a signed long."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t.as_py(), words) for t in b.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), f"doc_id {kind}, fp long")


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(doc_id, fp, wide, sketch, keys)`` of every row: its fingerprint, and fingerprint, sketch and samples of its different shingles."""
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            each = [(majority(h), *sketch(h)) for h in (shingles(t.as_py(), words) for t in b.column(1))]
            fp, wide, places, keys = zip(*each) if each else ((), (), (), ())
            prints = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (fp, wide)]
            yield pa.RecordBatch.from_arrays([b.column(0), *prints, pa.array(places, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "fp", "wide", "sketch", "keys"])

    ddl = f"doc_id {kind}, fp long, wide long, sketch binary, keys array<long>"
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(lean(run), ddl)


class _Forest:
    """A spanning forest of pairs of rows that come in any number."""

    def __init__(self, rows: int) -> None:
        self.label = np.arange(rows)
        self.left: list[np.ndarray] = []
        self.right: list[np.ndarray] = []

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.label[a], self.label[b]
            new = x != y
            if not new.any():
                return
            a, b, x, y = a[new], b[new], x[new], y[new]
            # every tree hooks to one smaller tree, by a pair that joins them
            high, low = np.maximum(x, y), np.minimum(x, y)
            order = np.lexsort((low, high))
            first = order[np.flatnonzero(np.r_[True, np.diff(high[order]) != 0])]
            self.left.append(a[first])
            self.right.append(b[first])
            self.label[high[first]] = low[first]
            while not np.array_equal(up := self.label[self.label], self.label):
                self.label = up


def splits(count: int, radius: int) -> int:
    """How many coordinates deal ``count`` fingerprints out so that cells of evenly spread ones hold about ``CELL``."""
    chance = [math.comb(BITS, d) / 2**BITS for d in range(BITS + 1)]
    half = BITS // 2
    shared = sum(chance[half : half + radius])
    upper = sum(chance[half:])
    mean = upper**2 + (1 - upper + shared) * (1 - upper)  # how much of the rows the cell of a row holds
    return max(0, math.ceil(math.log(max(1, count) / CELL) / -math.log(mean)))


def tables(fps: DataFrame, dealing: int, radius: int) -> DataFrame:
    """``(fp, far, cell)``: every fingerprint's distances to all pivots, a byte each, once for each of its cells."""
    ref = pivots(dealing + DISCARDING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy()
            far = np.bitwise_count(fp.view(np.uint64)[:, None] ^ ref)
            row, cell = np.arange(len(fp)), np.zeros(len(fp), np.int64)
            for k in range(dealing):
                d = far[row, k]
                both = np.flatnonzero((d >= BITS // 2) & (d < BITS // 2 + radius))
                cell = np.r_[cell << 1 | (d >= BITS // 2), cell[both] << 1]
                row = np.r_[row, row[both]]
            packed = pa.array([x.tobytes() for x in far], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), packed.take(pa.array(row)), pa.array(cell)], ["fp", "far", "cell"])

    return fps.select("fp").mapInArrow(lean(run), "fp long, far binary, cell long")


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links between different fingerprints at ``radius`` or fewer differing bits, thinned to a spanning forest a task.

    ``fps`` has one row for each different ``fp``. Returns ``(src, dst)``, repeats possible, every pair verified.
    """
    if not 0 < radius < BITS // 2:
        raise ValueError(f"radius must be between 1 and {BITS // 2 - 1}")
    small_batches(fps.sparkSession)
    dealing = splits(fps.count(), radius)
    dealt = written(tables(fps, dealing, radius), "pivots")
    sizes = dealt.groupBy("cell").agg(F.count("*").alias("rows"))
    return compared(dealt, sizes, radius)


def similar(texts: DataFrame, least: float = 0.8, radius: int = WIDE) -> DataFrame:
    """Links between fingerprints of texts that share ``least`` or more of their different shingles, thinned like those of ``links``.

    ``texts`` has ``fp``, ``wide``, ``sketch`` and ``keys``. Texts with a sample in common meet in a cell; pairs are discarded by the pivot distances of ``wide``,
    then by ``wide`` itself, which repetitions don't change as they change ``fp``, and verified by their sketches: the share of equal places among those that either has, whose deviation at 0.8 is 0.025.
    """
    small_batches(texts.sparkSession)
    ref = pivots(DISCARDING)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = np.bitwise_count(b.column(1).to_numpy().view(np.uint64)[:, None] ^ ref)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in far], pa.binary())], [*b.schema.names, "far"])

    each = texts.groupBy("fp", "wide", "sketch").agg(F.first("keys").alias("keys"))
    each = written(each.mapInArrow(lean(run), "fp long, wide long, sketch binary, keys array<long>, far binary"), "simhash-sketches")
    sizes = written(each.select(F.explode("keys").alias("cell")).groupBy("cell").agg(F.count("*").alias("rows")).where("rows > 1"), "simhash-cells")
    # most texts are alone in all their cells, and of them nothing is shuffled
    dealt = members(each.select("fp", "wide", "sketch", "far", F.explode("keys").alias("cell")), "cell", sizes.select("cell"))
    return compared(dealt, sizes, radius, least)


def compared(dealt: DataFrame, sizes: DataFrame, radius: int, least: float | None = None) -> DataFrame:
    """Compare the rows of each cell, in blocks if they are many, every two of which meet once; ``sizes`` has the rows of each cell."""
    sizes = sizes.select("cell", F.ceil(F.col("rows") / (2 * CELL)).cast("int").alias("blocks"))
    each = dealt.join(sizes, "cell").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    partners = F.when(F.col("blocks") > 1, F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("own"))).otherwise(F.array("own"))
    each = each.withColumn("other", F.explode(partners))
    each = each.select(*dealt.columns, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))

    def work(rows: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        far = np.frombuffer(b"".join(rows.column("far").to_pylist()), np.uint8).reshape(len(group), -1).astype(np.int8)
        order = np.lexsort((far[:, -1], group))  # the last coordinate dealt nothing
        fp, far = rows.column("fp").to_numpy()[order], far[order]
        bits = (fp if least is None else rows.column("wide").to_numpy()[order]).view(np.uint64)
        if least is not None:
            places = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(len(group), -1)[order]
        forest = _Forest(len(fp))
        alive, step = np.arange(len(fp)), 1
        while len(alive):
            alive = alive[alive + step < len(fp)]
            # rows are sorted, so what is too far in this coordinate stays so
            alive = alive[(group[alive + step] == group[alive]) & (far[alive + step, -1] - far[alive, -1] <= radius)]
            i = alive[forest.label[alive] != forest.label[alive + step]]
            for k in range(far.shape[1] - 1):
                i = i[np.abs(far[i, k] - far[i + step, k]) <= radius]
            i = i[np.bitwise_count(bits[i] ^ bits[i + step]) <= radius]
            if least is not None and len(i):
                x, y = places[i], places[i + step]
                i = i[((x == y) & (x > 0)).sum(axis=1) >= least * ((x | y) > 0).sum(axis=1)]
            if len(i):
                forest.add(i, i + step)
            step += 1
        if forest.left:
            yield pa.RecordBatch.from_arrays([pa.array(fp[np.concatenate(forest.left)]), pa.array(fp[np.concatenate(forest.right)])], ["src", "dst"])

    return by_key(each, ["cell", "low", "high"], work, "src long, dst long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2, words: int = 3) -> DataFrame:
    """``(doc_id, fingerprint, component_id)``, one row for each row of ``docs``.

    ``component_id`` is the smallest id reachable by links between fingerprints at ``radius`` or fewer differing bits,
    the row's own included. Rows of equal text have equal fingerprints and so share a component. Null and empty texts
    have fingerprint 0 and link like any other. A null id stays in the result and never names a component unless all
    ids of the component are null. Repeated rows give repeated result rows. An empty table gives no rows.
    """
    prints = written(fingerprints(docs, id_col, text_col, words), "simhash")
    each = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    found = connected_components(links(each.select("fp"), radius))
    # components are named by fingerprint; rename them by the smallest id among their rows
    named = each.join(found, each.fp == found.id, "left").select("fp", "least", F.coalesce("component", "fp").alias("class"))
    names = named.groupBy("class").agg(F.min("least").alias("component_id"))
    by_print = named.join(names, "class").select(F.col("fp").alias("key"), "component_id")
    return prints.join(by_print, prints.fp == by_print.key).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, radius: int = 2, words: int = 5, least: float = 0.8) -> DataFrame:
    """One row of each group of near copies stays, that of the smallest id, with all columns as they are.

    Near copies have fingerprints within ``radius`` bits or share ``least`` of their different ``words``-word shingles, by ``similar``'s estimate.

    Rows of one id but other texts are documents of their own: of those in one group the one of the smaller hash of the text stays. Of rows that agree
    in id and text the one stays whose other columns hash to the smallest number. A row without an id can't be named as anyone's copy and stays.
    Null and empty texts are copies of each other. An empty table stays empty. Whatever names the other columns of ``docs`` have, they don't
    clash with this operator's.

    Texts aren't shuffled but for rows that repeat: what goes is known by hashes of id and text, which are joined alone.
    """
    key = unused("key", docs.columns)
    keyed = docs.withColumn(key, F.xxhash64(F.lit(17), "doc_id", "text"))
    some = keyed.where("doc_id IS NOT NULL")
    prints = written(sketches(some, key, "text", words).withColumnRenamed("doc_id", "key"), "simhash")
    ids = some.select(F.col(key).alias("row"), "doc_id")
    found = connected_components(links(prints.select("fp").distinct(), radius).unionAll(similar(prints.select("fp", "wide", "sketch", "keys"), least)))
    classes = prints.groupBy("key", "fp").agg(F.count("*").alias("rows")).join(found, F.col("fp") == found.id, "left").select("key", "rows", F.coalesce("component", "fp").alias("class"))
    named = written(classes.join(ids.distinct(), F.col("key") == F.col("row")).select("key", "rows", "class", "doc_id"), "simhash-classes")
    first = named.groupBy("class").agg(F.min(F.struct("doc_id", "key")).alias("first")).select(F.col("first.key").alias("first"))
    stays = written(named.join(first, F.col("key") == F.col("first"), "left").select("key", "rows", F.col("first").isNotNull().alias("stays")), "simhash-kept")
    # a row without an id has a key too, which is no key of these
    once = others(keyed, key, stays.where("NOT stays OR rows > 1").select("key"))
    again = stays.where("stays AND rows > 1").select("key")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    whole = F.struct(*columns)
    repeated = members(keyed, key, again).groupBy(key).agg(F.min_by(whole, F.xxhash64(*columns)).alias("whole")).select("whole.*")
    return once.select(*columns).unionAll(repeated)
