"""Byte-level BPE with a segment tree over the ranks of adjacent pairs.

Each leaf holds ``rank * width + position`` of the pair that starts there, every inner node the smallest of its 16 children: the root is the
leftmost pair of lowest rank. A merge changes three leaves, each in logarithmic time, until no leaf holds a
mergeable pair. A run of a million letters therefore takes n log n steps, not n squared. A piece of up to 16 pairs, as most are, is a tree of
one node.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import extended, lean, small_batches

#: White space of Unicode, which the splitting pattern's \s means (Python's \s has U+001C-001F besides).
SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the public splitting pattern of byte-level BPE.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
NONE = 1 << 62
#: Children of a node.
FAN = 16
#: Pieces that a worker remembers; it forgets all of them when it has that many.
REMEMBERED = 400_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary file."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class Bpe:
    """Encoder and decoder of one vocabulary file; made once per worker."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec.get("normalizer") or spec["pre_tokenizer"] != {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only plain byte-level vocabularies are supported")
        vocab: dict[str, int] = spec["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_letters())}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        size = 1 + max([*vocab.values(), *self.special.values()])
        self.bytes: list[bytes] = [b""] * size
        for token, i in vocab.items():
            self.bytes[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()
        self.of_byte = [vocab[c] for c in byte_letters()]
        self.size = size
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[a] * size + vocab[b], rank)
            self.made.append(vocab[a + b])
        self.known: dict[str, bytes] = {}
        self.split = regex.compile(PATTERN).findall

    @cached_property
    def at_special(self):
        return regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one piece."""
        of_byte = self.of_byte
        ids = [of_byte[b] for b in piece]
        if len(ids) < 2:
            return ids
        size = self.size
        get = self.ranks.get
        ranks = [get(a * size + b, NONE) for a, b in zip(ids, ids[1:])]
        return self._one_node(ids, ranks) if len(ranks) <= FAN else self._tree(ids, ranks)

    def _one_node(self, ids: list[int], ranks: list[int]) -> list[int]:
        """Few pairs: the root's children are the leaves, and closing a gap keeps them in order of position."""
        size, get, made = self.size, self.ranks.get, self.made
        while (root := min(ranks)) != NONE:
            at = ranks.index(root)
            ids[at] = now = made[root]
            del ids[at + 1], ranks[at]
            if not ranks:
                break
            if at < len(ranks):
                ranks[at] = get(now * size + ids[at + 1], NONE)
            if at:
                ranks[at - 1] = get(ids[at - 1] * size + now, NONE)
        return ids

    def _tree(self, ids: list[int], ranks: list[int]) -> list[int]:
        size, get, made = self.size, self.ranks.get, self.made
        n = len(ids)
        levels = [[NONE if r == NONE else r * n + i for i, r in enumerate(ranks)]]
        while len(levels[-1]) > FAN:
            low = levels[-1]
            levels.append([min(low[i : i + FAN]) for i in range(0, len(low), FAN)])
        top = levels[-1]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            low = levels[0]
            low[i] = value
            for high in levels[1:]:
                i //= FAN
                least = min(low[i * FAN : i * FAN + FAN])
                if high[i] == least:
                    break
                high[i] = least
                low = high

        while (root := min(top)) != NONE:
            rank, at = divmod(root, n)
            gone = after[at]
            ids[at] = now = made[rank]
            ids[gone] = -1
            after[at] = follow = after[gone]
            if gone < n - 1:
                put(gone, NONE)
            if follow < n:
                before[follow] = at
                rank = get(now * size + ids[follow], NONE)
                put(at, NONE if rank == NONE else rank * n + at)
            else:
                put(at, NONE)
            if (back := before[at]) >= 0:
                rank = get(ids[back] * size + now, NONE)
                put(back, NONE if rank == NONE else rank * n + back)
        return [i for i in ids if i >= 0]

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.at_special is None:
            return self.plain(text)
        if not any(s in text for s in self.special):
            return self.plain(text)
        return b"".join(self.special[p].to_bytes(4, "little") if k % 2 else self.plain(p) for k, p in enumerate(self.at_special(text)))

    def plain(self, text: str) -> bytes:
        known = self.known
        pieces = self.split(text)
        try:
            return b"".join([known[p] for p in pieces])
        except KeyError:
            pass
        if len(known) > REMEMBERED:
            known.clear()
        out = []
        for p in pieces:
            if (got := known.get(p)) is None:
                got = np.array(self.merge(p.encode()), dtype="<u4").tobytes()
                if len(p) <= 64:
                    known[p] = got
            out.append(got)
        return b"".join(out)

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<u4").tolist()

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that aren't UTF-8 become U+FFFD."""
        table = self.bytes
        return b"".join([table[i] for i in ids]).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def loaded(path: str) -> Bpe:
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of every whole text, ``array<int>``; null texts count as empty.

    A special token's string within a text becomes its id, as the tokenizers library has it. An existing column of
    the name ``ids_col`` is replaced. Repeated rows and empty tables need no care: the operator works row by row.
    """
    small_batches(docs.sparkSession)
    schema = extended(docs.drop(ids_col).schema, f"`{ids_col}` array<int>")
    text_at = docs.drop(ids_col).columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            flat, ends = [], [0]
            for t in b.column(text_at):
                got = bpe.encode_bytes(t.as_py() or "")
                flat.append(got)
                ends.append(ends[-1] + len(got) // 4)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, ids_col])

    return docs.drop(ids_col).mapInArrow(lean(run), schema)


def encode_checked(docs: DataFrame, path: str, text_col: str = "text") -> DataFrame:
    """All columns but the text, ``ids`` and ``n_tokens``; every text is decoded again, and one that doesn't come back raises.

    Null and empty texts have no ids; repeated rows repeat; an empty table gives no rows; texts are encoded whole. Columns named ``ids`` and
    ``n_tokens`` are replaced.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(text_col, "ids", "n_tokens")
    picked = docs.select(*[F.col(f"`{c}`") for c in rest.columns], F.col(f"`{text_col}`"))
    schema = extended(rest.schema, "ids array<int>, n_tokens long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            flat, ends = [], [0]
            for t in b.column(b.num_columns - 1):
                text = t.as_py() or ""
                got = bpe.encode_bytes(text)
                if bpe.decode(np.frombuffer(got, "<u4").tolist()) != text:
                    raise ValueError("a text doesn't survive encoding and decoding")
                flat.append(got)
                ends.append(ends[-1] + len(got) // 4)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(flat), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids, pa.array(np.diff(ends), pa.int64())], [*b.schema.names[:-1], "ids", "n_tokens"])

    return picked.mapInArrow(lean(run), schema)


def decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and the text of the ids; null ids give a null text."""
    small_batches(coded.sparkSession)
    schema = extended(coded.drop(text_col).schema, f"`{text_col}` string")
    ids_at = coded.drop(text_col).columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            out = [None if x is None else bpe.decode(x) for x in b.column(ids_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, text_col])

    return coded.drop(text_col).mapInArrow(lean(run), schema)


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Digests of the ids and of the text decoded from them, in one pass: ``keep``, n_tokens, ids_sha256, decoded_sha256.

    The ids themselves stay in the worker; nothing is shuffled. One result row for each row, repeated ones too; null texts count as empty, whose
    digests are those of no bytes; texts are encoded whole, however long; an empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(path)
        for b in batches:
            counts, codes, backs = [], [], []
            for t in b.column(len(keep)):
                ids = bpe.encode_bytes(t.as_py() or "")
                counts.append(len(ids) // 4)
                codes.append(hashlib.sha256(ids).hexdigest())
                text = bpe.decode(np.frombuffer(ids, "<u4").tolist())
                backs.append(hashlib.sha256(text.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(codes), pa.array(backs)],
                [*keep, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(
        lean(run), f"{fields}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
