"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text and quantiles of perplexity by language.

The model is one of byte n-grams of order 5. Trusted documents are counted in each task and the counts summed in shards by
n-gram; continuation counts, discounts and joins with the counts of contexts turn them into tables of discounted probabilities and of left-over masses, which
grow with the trusted text and stay sharded: no task, and not the driver, holds the model.

Scoring joins those tables with the n-grams of the documents. Every task packs its documents into blocks in the shared folder
and sends each block's distinct n-grams, sorted and compressed, to the shards; a shard holds its part of the tables and answers one
block after the other; the answers meet at the block, whose texts are read where they were written. So neither texts nor
repeated n-grams are shuffled, and memory is bounded by a block and a shard.

Two models of half the trusted text each are fitted, and every document is scored by the one that hasn't seen it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import extended, lean, let_go, members, open_fs, small_batches, unused
from kgspark.session import cut, fresh_dir, written

ORDER = 5
SYMBOLS = 256
#: Share of a language's trusted documents that its threshold lets pass.
QUANTILE = 0.995
#: Bytes at the language's mean that every document is scored with besides its own: short texts stay near the mean.
PRIOR_BYTES = 48
#: Trusted documents that a language needs for a threshold of its own.
LEAST_TRUSTED = 50
STEP = 1e-3
#: Bytes of text that a block holds, about; one longer document is a block of its own.
BLOCK_BYTES = 8_000_000
#: How many times that a block holds where texts aren't carried on: larger blocks repeat fewer n-grams.
LONE = 2
#: Entries of the model's tables in a shard, about.
SHARD_ROWS = 250_000
#: Distinct n-grams that a counting task holds before it passes them on.
HELD = 1_000_000
_PIECE = 1_000_000
_BEGIN = b"\n" * (ORDER - 1)


def grams_of(texts: list[bytes]) -> np.ndarray:
    """The n-gram of order 5 that ends at each byte of each text, as a number of 40 bits; a text begins after line ends."""
    raw = np.frombuffer(_BEGIN + b"".join(t + _BEGIN for t in texts), np.uint8).astype(np.int64)
    n = len(raw) - ORDER + 1
    out = raw[:n].copy()
    for i in range(1, ORDER):
        out <<= 8
        out |= raw[i : i + n]
    # what ends in the padding between texts isn't counted
    ends = np.cumsum([len(t) for t in texts]) + np.arange(len(texts)) * (ORDER - 1)
    keep = np.ones(n, bool)
    for i in range(ORDER - 1):
        at = ends + i
        keep[at[at < n]] = False
    return out[keep]


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def fold() -> Column:
    """0 or 1 by text, so that copies of a text fall together."""
    return F.pmod(F.xxhash64(F.lit(3), F.coalesce("text", F.lit(""))), F.lit(2)).cast("int")


def _pieces(texts: list[bytes]) -> Iterator[list[bytes]]:
    """Texts in lists of a few megabytes."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t)
        if size > _PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def count(docs: DataFrame) -> DataFrame:
    """``(fold, gram, n)`` of all rows' whole texts: counted in each task first, then summed in shards by n-gram."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            folds = b.column(1).to_numpy()
            texts = [encoded(t) for t in b.column(0).to_pylist()]
            for f in (0, 1):
                for piece in _pieces([t for t, k in zip(texts, folds) if k == f and t]):
                    g, n = np.unique(grams_of(piece), return_counts=True)
                    both = np.concatenate([grams, g | f << 8 * ORDER])
                    grams, at = np.unique(both, return_inverse=True)
                    sums = np.bincount(at, np.concatenate([sums, n])).astype(np.int64)
                    if len(grams) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(sums)], ["gram", "n"])
                        grams, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(grams):
            yield pa.RecordBatch.from_arrays([pa.array(grams), pa.array(sums)], ["gram", "n"])

    sums = docs.select("text", fold()).mapInArrow(lean(run), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    return sums.select(F.shiftright("gram", 8 * ORDER).cast("int").alias("fold"), F.col("gram").bitwiseAND((1 << 8 * ORDER) - 1).alias("gram"), "n")


def discounts(counts: DataFrame) -> dict[int, tuple[float, float, float]]:
    """The three discounts of modified Kneser-Ney by fold, from the counts of counts; absolute ones where those are degenerate."""
    found: dict[int, dict[int, int]] = {0: {}, 1: {}}
    for r in counts.where("n <= 4").groupBy("fold", "n").agg(F.count("*").alias("k")).collect():  # four rows a fold
        found[r.fold][r.n] = r.k
    out = {}
    for f, of in found.items():
        n1, n2, n3, n4 = (of.get(i, 0) for i in range(1, 5))
        out[f] = 0.5, 0.75, 0.9
        if all((n1, n2, n3, n4)):
            y = n1 / (n1 + 2 * n2)
            d = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
            out[f] = tuple(min(max(x, 0.05), i + 0.95) for i, x in enumerate(d))
    return out


def _key(f, kind: int, gram):
    """Fold, kind of entry and bytes as one long: kind is twice the order, for left-over masses one more."""
    return ((f << 4 | kind) << 8 * ORDER) | gram


def fit(counts: DataFrame) -> DataFrame:
    """The sharded tables ``(key, value)`` of all orders and both folds of ``(fold, gram, n)``.

    An n-gram of order k has a discounted probability, a context of k - 1 bytes a left-over mass for the order below. The highest order has raw
    counts, lower ones have continuation counts: in how many contexts an n-gram follows. All joins are of count tables, by context.
    """
    levels = {ORDER: counts}
    for k in range(ORDER - 1, 0, -1):
        levels[k] = cut(levels[k + 1].groupBy("fold", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram")).agg(F.count("*").alias("n")))
    out: DataFrame | None = None
    for k, level in levels.items():
        d = discounts(level)
        by = lambda i: F.when(F.col("fold") == 0, d[0][i]).otherwise(d[1][i])  # noqa: B023, E731
        off = F.when(F.col("n") == 1, by(0)).when(F.col("n") == 2, by(1)).otherwise(by(2))
        head = F.shiftright("gram", 8)
        contexts = cut(level.groupBy("fold", head.alias("context")).agg(F.sum("n").alias("total"), F.sum(off).alias("over")))
        own = level.withColumn("context", head).join(contexts, ["fold", "context"])
        key = lambda kind, gram: F.shiftleft(F.shiftleft(F.col("fold").cast("long"), 4).bitwiseOR(F.lit(kind).cast("long")), 8 * ORDER).bitwiseOR(F.col(gram)).alias("key")
        rows = own.select(key(2 * k, "gram"), ((F.col("n") - off) / F.col("total")).alias("value"))
        rows = rows.unionAll(contexts.select(key(2 * k + 1, "context"), (F.col("over") / F.col("total")).alias("value")))
        out = rows if out is None else out.unionAll(rows)
    return written(out, "kneser-ney")


def asked(grams: np.ndarray, f: int) -> list[np.ndarray]:
    """What a block's sorted distinct n-grams need of fold ``f``: for each order the n-grams' and the contexts' keys, ascending."""
    out = []
    for k in range(1, ORDER + 1):
        own = np.unique(grams & ((1 << 8 * k) - 1)) if k < ORDER else grams
        out += [_key(f, 2 * k, own), _key(f, 2 * k + 1, np.unique(own >> 8))]
    return out


def log_probabilities(grams: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """Log probabilities of sorted distinct n-grams from the answers to ``asked``; NaN stands for what the tables don't hold."""
    lower, short = np.full(1, 1.0 / SYMBOLS), np.zeros(1, np.int64)
    for k in range(1, ORDER + 1):
        own = np.unique(grams & ((1 << 8 * k) - 1)) if k < ORDER else grams
        mass = np.nan_to_num(values[2 * k - 1].astype(np.float64), nan=1.0)
        back = lower[np.searchsorted(short, own & ((1 << 8 * (k - 1)) - 1))]
        lower = np.nan_to_num(values[2 * k - 2].astype(np.float64)) + mass[np.searchsorted(np.unique(own >> 8), own >> 8)] * back
        short = own
    return np.log(lower)


_ZSTD = pa.Codec("zstd", compression_level=3)
#: For texts, which are written once and read once.
_TEXT_LEVEL = 9


def _packed(x: np.ndarray) -> bytes:
    """Long numbers go byte by byte, first all the lowest ones: the high bytes of differences are mostly zero."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), 8).T) if x.dtype == np.int64 else x
    return len(x).to_bytes(8, "little") + _ZSTD.compress(raw.tobytes(), asbytes=True)


def _unpacked(raw: bytes, kind: type) -> np.ndarray:
    size = int.from_bytes(raw[:8], "little")
    if not size:
        return np.zeros(0, kind)
    out = np.frombuffer(_ZSTD.decompress(raw[8:], decompressed_size=size * np.dtype(kind).itemsize, asbytes=True), np.uint8)
    return np.ascontiguousarray(out.reshape(8, size).T).view(np.int64).reshape(size) if kind is np.int64 else out.view(kind)


def _steps(x: np.ndarray) -> np.ndarray:
    """Sorted keys as their differences, which pack well."""
    return np.diff(x, prepend=np.int64(0))


def _shard(keys: np.ndarray, shards: int) -> np.ndarray:
    mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((mixed >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


def _dealt(keys: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """The places of ``keys`` by shard, in order of keys within each."""
    of = _shard(keys, shards)
    order = np.argsort(of, kind="stable")
    bounds = np.searchsorted(of[order], np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(bounds)):
        yield int(s), order[bounds[s] : bounds[s + 1]]


def _blocks(docs: DataFrame, folder_uri: str, model_of: tuple[int, int], shards: int, block_bytes: int) -> DataFrame:
    """``(block, shard, part, keys, values)``: documents (text and fold last) written as blocks, and what these ask of the shards."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, folder = open_fs(folder_uri)
        disk.create_dir(folder, recursive=True)
        held: list[pa.RecordBatch] = []
        grams, texts, size = [np.zeros(0, np.int64)] * 2, ([], []), 0

        def merge() -> None:
            for f in (0, 1):
                for piece in _pieces(texts[f]):
                    grams[f] = np.union1d(grams[f], grams_of(piece))
                texts[f].clear()

        def close() -> pa.RecordBatch:
            name = uuid.uuid4().hex
            meta = {f"grams{f}": _packed(_steps(grams[f])) for f in (0, 1)}
            schema = held[0].schema.with_metadata(meta)
            with disk.open_output_stream(f"{folder}/{name}.arrow", compression=None) as sink, pa.ipc.new_file(sink, schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=_TEXT_LEVEL))) as out:
                for b in held:
                    out.write_batch(pa.RecordBatch.from_arrays(b.columns, schema=schema))
            keys = np.concatenate([k for f in (0, 1) for k in asked(grams[f], model_of[f])])
            parts = list(_dealt(keys, shards)) or [(0, np.zeros(0, np.int64))]
            return pa.RecordBatch.from_arrays(
                [pa.array([name] * len(parts)), pa.array([s for s, _ in parts], pa.int32()), pa.array([1] * len(parts), pa.int32()), pa.array([_packed(_steps(keys[at])) for _, at in parts], pa.binary()), pa.nulls(len(parts), pa.binary())],
                ["block", "shard", "part", "keys", "values"],
            )

        for b in batches:
            if not b.num_rows:
                continue
            start = 0
            for i, (t, f) in enumerate(zip(b.column(b.num_columns - 2).to_pylist(), b.column(b.num_columns - 1).to_pylist())):
                raw = encoded(t)
                texts[f].append(raw)
                size += len(raw)
                if size > block_bytes:
                    held.append(b.slice(start, i + 1 - start))
                    merge()
                    yield close()
                    let_go()
                    held, grams, size, start = [], [np.zeros(0, np.int64)] * 2, 0, i + 1
            if start < b.num_rows:
                held.append(b.slice(start))
            if sum(map(len, texts[0])) + sum(map(len, texts[1])) > _PIECE:
                merge()
        if held:
            merge()
            yield close()

    return docs.mapInArrow(lean(run), "block string, shard int, part int, keys binary, values binary")


def _parts_of(model: DataFrame, shards: int) -> DataFrame:
    """The model's tables in the same form, part 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, values = b.column(0).to_numpy(), b.column(1).to_numpy().astype(np.float32)
            order = np.argsort(keys)
            keys, values = keys[order], values[order]
            parts = list(_dealt(keys, shards))
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(parts), pa.string()), pa.array([s for s, _ in parts], pa.int32()), pa.array([0] * len(parts), pa.int32()), pa.array([_packed(_steps(keys[at])) for _, at in parts], pa.binary()), pa.array([_packed(values[at]) for _, at in parts], pa.binary())],
                ["block", "shard", "part", "keys", "values"],
            )

    packed = model.select("key", "value").repartition(max(1, shards // 4)).mapInArrow(lean(run), "block string, shard int, part int, keys binary, values binary")
    return packed


def _answers(rows: DataFrame, shards: int) -> DataFrame:
    """``(block, shard, values)``: a shard's tables come first, then it answers block by block; NaN for what they don't hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, loaded = -1, True
        keys: list[np.ndarray] | np.ndarray = []
        values: list[np.ndarray] | np.ndarray = []
        for b in batches:
            blocks, shards_, out = [], [], []
            for block, s, part, k, v in zip(*(b.column(i).to_pylist() for i in range(5))):
                if s != shard:
                    shard, loaded, keys, values = s, False, [], []
                mine = np.cumsum(_unpacked(k, np.int64))
                if part == 0:
                    keys.append(mine)
                    values.append(_unpacked(v, np.float32))
                    continue
                if not loaded:
                    keys, values = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.int64), (values, np.float32)))
                    order = np.argsort(keys)
                    keys, values, loaded = keys[order], values[order], True
                got = np.full(len(mine), np.nan, np.float32)
                if len(keys) and len(mine):
                    at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
                    hit = keys[at] == mine
                    got[hit] = values[at[hit]]
                blocks.append(block)
                shards_.append(s)
                out.append(_packed(got))
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.string()), pa.array(shards_, pa.int32()), pa.array(out, pa.binary())], ["block", "shard", "values"])

    return rows.repartition(shards, "shard").sortWithinPartitions("shard", "part", "block").mapInArrow(lean(run), "block string, shard int, values binary")


@dataclass
class Model:
    """The sharded tables, and which fold's model scores the documents of fold 0 and of fold 1."""

    tables: DataFrame
    model_of: tuple[int, int]


def fit_folds(trusted: DataFrame) -> Model | None:
    """Two models, each of one half of the trusted texts; None where there is no trusted text.

    A document is scored by the half that it isn't in, whether it is trusted or not, so trusted documents' scores are those of unseen text and their
    quantiles hold for others. Where one half is empty the other serves for all.
    """
    counts = cut(count(trusted))
    there = {r.fold for r in counts.select("fold").distinct().collect()}  # two at most
    if not there:
        return None
    return Model(fit(counts), (1 if 1 in there else 0, 0 if 0 in there else 1))


def scored(docs: DataFrame, model: Model, columns: list[str], nll: str = "nll", length: str = "length") -> DataFrame:
    """``columns`` of ``docs`` with ``nll`` (sum over the whole text, nats) and ``length`` (bytes of UTF-8); these mustn't be among ``columns``."""
    spark = docs.sparkSession
    small_batches(spark)
    rest = docs.select(*[F.col(f"`{c}`") for c in columns])
    picked = docs.select(*[F.col(f"`{c}`") for c in columns], F.col("text").alias(unused("text", columns)), fold().alias(unused("fold", columns)))
    if "text" in columns:  # carried once
        picked = docs.select(*[F.col(f"`{c}`") for c in columns if c != "text"], "text", fold().alias(unused("fold", columns)))
    folder_uri = fresh_dir(spark, "quality-blocks")
    shards = max(8, -(-model.tables.count() // SHARD_ROWS))
    blocks = written(_blocks(picked, folder_uri, model.model_of, shards, BLOCK_BYTES if "text" in columns else LONE * BLOCK_BYTES), "quality-asked")
    answers = _answers(blocks.unionAll(_parts_of(model.tables, shards)), shards)
    model_of, names = model.model_of, [*columns, nll, length]

    def finish(block: str, parts: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        disk, folder = open_fs(folder_uri)
        with disk.open_input_file(f"{folder}/{block}.arrow") as f:
            file = pa.ipc.open_file(f)
            grams = [np.cumsum(_unpacked(file.schema.metadata[b"grams%d" % k], np.int64)) for k in (0, 1)]
            sets = [asked(grams[k], model_of[k]) for k in (0, 1)]
            keys = np.concatenate([x for own in sets for x in own])
            values = np.full(len(keys), np.nan, np.float32)
            for s, at in _dealt(keys, shards):
                values[at] = _unpacked(parts[s], np.float32)
            cuts = np.split(values, np.cumsum([len(x) for own in sets for x in own])[:-1])
            logs = [log_probabilities(grams[k], cuts[2 * ORDER * k : 2 * ORDER * (k + 1)]) if len(grams[k]) else np.zeros(0) for k in (0, 1)]
            for i in range(file.num_record_batches):
                b = file.get_batch(i)
                texts = [encoded(t) for t in b.column(b.num_columns - 2).to_pylist()]
                folds = b.column(b.num_columns - 1).to_numpy()
                lengths = np.array([len(t) for t in texts], np.int64)
                sums = np.zeros(len(texts))
                for k in (0, 1):
                    mine = np.flatnonzero((folds == k) & (lengths > 0))
                    for piece in np.split(mine, np.flatnonzero(np.diff(np.cumsum(lengths[mine]) // _PIECE)) + 1) if len(mine) else ():
                        found = logs[k][np.searchsorted(grams[k], grams_of([texts[j] for j in piece]))]
                        sums[piece] = -np.add.reduceat(found, np.cumsum(lengths[piece]) - lengths[piece])
                        del found
                given = {n: b.column(b.schema.get_field_index(n)) for n in columns}
                yield pa.RecordBatch.from_arrays([*given.values(), pa.array(sums), pa.array(lengths)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, parts = None, {}
        for b in batches:
            for name, s, v in zip(*(b.column(i).to_pylist() for i in range(3))):
                if name != block:
                    if block is not None:
                        yield from finish(block, parts)
                        let_go()
                    block, parts = name, {}
                parts[s] = v
        if block is not None:
            yield from finish(block, parts)

    return answers.repartition("block").sortWithinPartitions("block", "shard").mapInArrow(lean(run), extended(rest.schema, f"`{nll}` double, `{length}` long"))


@dataclass
class Limits:
    """Mean and threshold of nats a byte by language; ``None`` holds for other languages."""

    by_lang: dict[str | None, tuple[float, float]]
    other: tuple[float, float]

    def column(self, which: int) -> Column:
        out = F.lit(self.other[which])
        for lang, pair in self.by_lang.items():
            out = F.when(F.col("lang").eqNullSafe(F.lit(lang)), pair[which]).otherwise(out)
        return out

    def shrunk(self, nll: str = "nll", length: str = "length") -> Column:
        return (F.col(nll) + PRIOR_BYTES * self.column(0)) / (F.col(length) + PRIOR_BYTES)


def limits(scores: DataFrame, trusted_ids: DataFrame, quantile: float = QUANTILE, nll: str = "nll", length: str = "length") -> Limits | None:
    """Thresholds from all trusted documents' scores, by exact quantiles of a histogram of fixed step for each language."""
    rows = scores.select("doc_id", "lang", F.col(nll).alias("nll"), F.col(length).alias("length")).where("length > 0")
    own = rows.join(trusted_ids.hint("merge"), F.col("doc_id") == F.col("trusted_id"), "left_semi")
    means = own.groupBy("lang").agg(F.sum("nll").alias("nll"), F.sum("length").alias("length"), F.count("*").alias("rows")).collect()
    if not means:
        return None
    all_mean = sum(r.nll for r in means) / sum(r.length for r in means)
    first = Limits({r.lang: (r.nll / r.length, 0.0) for r in means if r["rows"] >= LEAST_TRUSTED}, (all_mean, 0.0))
    bins = own.groupBy("lang", F.floor(first.shrunk() / STEP).alias("bin")).agg(F.count("*").alias("n")).collect()  # bounded by the step

    def at(rows: list) -> float:
        need, seen = quantile * sum(r.n for r in rows), 0
        for r in sorted(rows, key=lambda r: r.bin):
            seen += r.n
            if seen >= need:
                return (r.bin + 1) * STEP
        raise AssertionError

    return Limits({lang: (pair[0], at([r for r in bins if r.lang == lang])) for lang, pair in first.by_lang.items()}, (all_mean, at(bins)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids that every label of theirs calls good."""
    return labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("trusted_id")).agg(F.min("quality").alias("q")).where("q = 1").select("trusted_id")


def _prepared(docs: DataFrame, labels: DataFrame, columns: list[str], quantile: float, nll: str, length: str) -> tuple[Limits, DataFrame] | None:
    good = cut(trusted_ids(labels))
    model = fit_folds(members(docs.select("doc_id", "text"), "doc_id", good))
    if model is None:
        return None
    scores = written(scored(docs, model, columns, nll, length), "quality")
    found = limits(scores, good, quantile, nll, length)
    return None if found is None else (found, scores)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(doc_id, lang, length, log_perplexity, score, threshold, kept)``, one row for each row of ``docs``.

    ``log_perplexity`` is the mean of nats a byte, ``score`` the same with a prior at the language's mean, and a document is
    kept if its score is at most its language's threshold. Null and empty texts have no perplexity and are rejected. Documents
    of a language, or of none, with few trusted documents are held to the threshold over all trusted documents. Without
    trusted text there is no model and all documents are kept, with null figures. Ties with the threshold are kept; repeated rows repeat;
    an empty table gives no rows.
    """
    ready = _prepared(docs, labels, ["doc_id", "lang"], quantile, "nll", "length")
    if ready is None:
        none = F.lit(None).cast("double")
        return docs.select("doc_id", "lang", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("length"), none.alias("log_perplexity"), none.alias("score"), none.alias("threshold"), F.lit(True).alias("kept"))
    found, scores = ready
    some = F.col("length") > 0
    return scores.select(
        "doc_id", "lang", "length", F.when(some, F.col("nll") / F.col("length")).alias("log_perplexity"),
        F.when(some, found.shrunk()).alias("score"), found.column(1).alias("threshold"), (some & (found.shrunk() <= found.column(1))).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns, whatever their names.

    Null and empty texts go; repeated rows stay or go together; without trusted text all rows stay; an empty table stays empty.
    """
    nll, length = unused("nll", docs.columns), unused("length", docs.columns)
    ready = _prepared(docs, labels, docs.columns, quantile, nll, length)
    if ready is None:
        return docs
    found, scores = ready
    return scores.where((F.col(length) > 0) & (found.shrunk(nll, length) <= found.column(1))).select(*[F.col(f"`{c}`") for c in docs.columns])
