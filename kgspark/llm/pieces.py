"""SentencePiece encoding of the merge type by a table over prefixes.

The merges of a text end in one sequence of pieces; that of a prefix is the same sequence without what follows, so each prefix that ends between two characters has one last
piece. It is the only piece that ends there (an automaton lists them) and is compatible with the last piece of what stands before it: merging
the two pieces' characters alone gives the two again. Ids are read off the table backwards.
"""

from __future__ import annotations

import codecs
import hashlib
import re
import struct
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import extended, lean, small_batches

#: Fixed values of the public format: the mark that stands for a space, and kinds of pieces.
MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Words that a worker remembers: it keeps those of the last two times this many that it saw. Pairs: it forgets all when it has that many.
REMEMBERED = 400_000
PAIRS = 500_000

codecs.register_error("each_byte", lambda e: ("�" * (e.end - e.start), e.end))


def fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of a protocol buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        at += size
        yield key >> 3, raw[at - size : at]


def whole_words(path: str) -> list[str]:
    """A model file's pieces that begin a word, without their mark."""
    with open(path, "rb") as f:
        names = [dict(fields(v))[1].decode() for k, v in fields(f.read()) if k == 1]
    return [name[1:] for name in names if name.startswith(MARK)]


class Pieces:
    """Encoder and decoder of one model file; made once per worker."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            model = list(fields(f.read()))
        normal = dict(next((fields(v) for k, v in model if k == 3), ()))
        trainer = dict(next((fields(v) for k, v in model if k == 2), ()))
        if trainer.get(3, 1) != 2 or normal.get(1, b"identity") != b"identity" or normal.get(4, 1) or not normal.get(3, 1) or not normal.get(5, 1):
            raise ValueError("only merge models without normalisation, with a space put in front, are supported")
        self.names: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        for k, v in model:
            if k == 1:
                piece = dict(fields(v))
                self.names.append(piece[1].decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                self.kinds.append(piece.get(3, NORMAL))
        if {USER, UNUSED} & {*self.kinds}:
            raise ValueError("models with user-defined or unused pieces aren't supported")
        self.ids = {name: i for i, (name, kind) in enumerate(zip(self.names, self.kinds)) if kind == NORMAL}
        self.cost = {name: -scores[i] for name, i in self.ids.items()}
        self.controls = frozenset(i for i, kind in enumerate(self.kinds) if kind == CONTROL)
        self.letters = frozenset(name for name in self.ids if len(name) == 1)
        if any(not self.letters.issuperset(name) for name in self.ids):
            raise ValueError("pieces of characters that aren't pieces aren't supported")
        self.of_byte = [self.names.index(f"<0x{b:02X}>") for b in range(256)]
        # no piece goes on behind a mark that follows a letter: what a mark begins is encoded by itself
        if any(re.search(f"[^{MARK}]{MARK}", name) for name in self.ids):
            raise ValueError("pieces that hold a space inside aren't supported")
        self.words = re.compile(f"{MARK}+[^{MARK}]*").findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[int, bool] = {}

    def merged(self, text: str) -> list[str]:
        """The merges done one by one, lowest cost first and leftmost of equal ones: for a few characters, and as a check."""
        parts, cost = list(text), self.cost.get
        far = float("inf")
        ranks = [cost(a + b, far) for a, b in zip(parts, parts[1:])]
        while ranks and (least := min(ranks)) < far:
            at = ranks.index(least)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = cost(parts[at] + parts[at + 1], far)
            if at:
                ranks[at - 1] = cost(parts[at - 1] + parts[at], far)
        return parts

    @cached_property
    def automaton(self) -> ahocorasick.Automaton:
        """Of all pieces that merging their own characters gives; others never occur."""
        out = ahocorasick.Automaton()
        for name, i in self.ids.items():
            if len(name) == 1 or self.merged(name) == [name]:
                out.add_word(name, (len(name), i))
        out.make_automaton()
        return out

    def compatible(self, first: int, second: int) -> bool:
        """Whether the two pieces next to each other stay what they are."""
        if len(self.pairs) >= PAIRS:
            self.pairs.clear()
        a, b = self.names[first], self.names[second]
        got = self.pairs[first * len(self.names) + second] = self.merged(a + b) == [a, b]
        return got

    def word(self, word: str) -> list[int]:
        """Ids of a text without a mark behind a letter."""
        n, size = len(word), len(self.names)
        last, begin = [-1] * (n + 1), list(range(-1, n))  # by end of prefix; -1 stands for a character of no piece, and for the start
        known = [False] * (n + 1)
        known[0] = True
        if not self.letters.issuperset(word):
            for at, c in enumerate(word, 1):
                known[at] = c not in self.letters
        remembered, compatible = self.pairs.get, self.compatible
        for end, (length, i) in self.automaton.iter(word):
            end += 1
            if known[end]:
                continue
            start = end - length
            if known[start]:
                if (before := last[start]) >= 0:
                    if (fits := remembered(before * size + i)) is None:
                        fits = compatible(before, i)
                    if not fits:
                        continue
                last[end], begin[end], known[end] = i, start, True
        out, at = [], n
        while at:
            if (i := last[at]) >= 0:
                out.append(i)
            else:
                out.extend(self.of_byte[b] for b in reversed(word[at - 1].encode()))
            at = begin[at]
        out.reverse()
        return out

    def split(self, text: str) -> list[str]:
        """Words of a text that begins with a mark, each without its mark if it has one and goes on; others as they are."""
        if MARK + MARK not in text and text[-1] != MARK:
            return text.split(MARK)[1:]
        return [w if w.startswith(MARK, 1) or len(w) == 1 else w[1:] for w in self.words(text)]

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian 32-bit integers."""
        if not text:
            return b""
        words = self.split(MARK + text.replace(" ", MARK))
        found = self.known
        if len(found) >= REMEMBERED:
            self.older, self.known = found, {}
            found = self.known
        new, older = set(words).difference(found), self.older
        for w in new:
            found[w] = older.get(w) or struct.pack(f"<{len(ids := self.word(w if w[0] == MARK else MARK + w))}i", *ids)
        out = b"".join([found[w] for w in words])
        for w in new:
            if len(w) > 64:
                del found[w]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_bytes(text), dtype="<i4").tolist()

    @cached_property
    def shown(self) -> list[bytes]:
        """What each id gives when decoded; that of control pieces isn't used."""
        as_bytes = {i: bytes([b]) for b, i in enumerate(self.of_byte)}
        plain = {UNKNOWN: " ⁇ ".encode()}
        return [as_bytes.get(i) or plain.get(kind, name.replace(MARK, " ").encode()) for i, (name, kind) in enumerate(zip(self.names, self.kinds))]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids without the space put in front; each byte that isn't UTF-8 becomes U+FFFD, and control pieces part characters."""
        shown, first = self.shown, True
        out = []
        for run in self._between_controls(ids):
            raw = b"".join([shown[i] for i in run])
            if first and self.names[run[0]].startswith(MARK):
                raw = raw[1:]
            first = False
            out.append(raw.decode("utf-8", "each_byte"))
        return "".join(out)

    def _between_controls(self, ids: list[int]) -> list[list[int]]:
        if self.controls.isdisjoint(ids):
            return [ids] if ids else []
        runs: list[list[int]] = [[]]
        for i in ids:
            if i in self.controls:
                runs.append([])
            else:
                runs[-1].append(i)
        return [run for run in runs if run]


_loaded: dict[str, Pieces] = {}


def loaded(path: str) -> Pieces:
    if path not in _loaded:
        _loaded[path] = Pieces(path)
    return _loaded[path]


def encode(docs: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of ``docs`` and the ids of every whole text, ``array<int>``, without begin or end ids.

    Null and empty texts have no ids; repeated rows repeat; an empty table gives no rows; a column of the name ``ids_col`` is replaced.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(ids_col)
    text_at = rest.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for b in batches:
            coded = [pieces.encode_bytes(t.as_py() or "") for t in b.column(text_at)]
            ends = np.cumsum([0, *(len(x) // 4 for x in coded)])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(coded), "<i4")))
            yield pa.RecordBatch.from_arrays([*b.columns, ids], [*b.schema.names, ids_col])

    return rest.mapInArrow(lean(run), extended(rest.schema, f"`{ids_col}` array<int>"))


def decode(coded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """All columns and the text of the ids; null ids give a null text, no ids an empty one; a column of the name ``text_col`` is replaced."""
    small_batches(coded.sparkSession)
    rest = coded.drop(text_col)
    ids_at = rest.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        for b in batches:
            out = [None if x is None else pieces.decode(x) for x in b.column(ids_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, text_col])

    return rest.mapInArrow(lean(run), extended(rest.schema, f"`{text_col}` string"))


def round_trip(docs: DataFrame, path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Digests of the ids and of the text decoded from them, in one pass: ``keep``, n_tokens, ids_sha256, decoded_sha256.

    The digest of ids is that of their decimal forms, joined by commas. One result row for each row, repeated ones too; null texts count as empty, whose
    digests are those of no bytes; texts are encoded whole, however long; an empty table gives no rows. Nothing is shuffled.
    """
    small_batches(docs.sparkSession)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = loaded(path)
        decimal = [str(i) for i in range(len(pieces.names))]
        for b in batches:
            counts, codes, backs = [], [], []
            for t in b.column(len(keep)):
                ids = pieces.encode(t.as_py() or "")
                counts.append(len(ids))
                codes.append(hashlib.sha256(",".join([decimal[i] for i in ids]).encode()).hexdigest())
                backs.append(hashlib.sha256(pieces.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(codes), pa.array(backs)], [*keep, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text")).mapInArrow(
        lean(run), f"{kinds}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
