"""Secret scans: base patterns, and runs that a Markov model of random strings explains better than one of identifiers.

Both models are first-order character chains with add-one smoothing, trained on the driver from labelled samples: strings drawn at random, and
words of a public vocabulary in usual compounds. A run is reported
where the log-likelihood ratio for each character exceeds a threshold, which is higher for short runs. Of a run that base
spans overlap, what they leave is judged.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import lean, small_batches
from kgspark.llm.pieces import whole_words

KINDS = ("assign", "access", "hex", "markov")
#: The base patterns; ASCII letters of the first group in either case.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
SHORTEST = 16
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: Rules and padding count as one character.
REPEATED = re.compile(r"([+/_=-])\1{2,}")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
#: Nats for each character that a run must be likelier under the random model.
MARGIN = 0.35
#: Characters from which on the margin holds as it is; shorter runs need as many nats in all.
FULL = 24

#: The public vocabulary whose whole words make the samples of ordinary identifiers, and what it must be for the model to be the same everywhere.
WORDS = "piece_bpe_32k.model"
WORDS_SHA256 = "dadfd56d766715c61d2ef780a525ab43b8e6da4de6865bda3d95fdef5e134055"


@lru_cache(maxsize=1)
def vocabulary_words() -> tuple[str, ...]:
    """Words of several languages and of program texts, in the vocabulary's order: its pieces of two and more ASCII letters that begin a word."""
    import public_tokenizers

    path = public_tokenizers.path(WORDS)
    with open(path, "rb") as f:
        if hashlib.sha256(f.read()).hexdigest() != WORDS_SHA256:
            raise ValueError(f"{path} isn't the vocabulary that the model is made from")
    return tuple(w for w in whole_words(path) if len(w) > 1 and w.isascii() and w.isalpha())


def labelled_samples(seed: int = 7, each: int = 20_000) -> list[tuple[str, int]]:
    """Samples with label 1 (random strings of the usual key alphabets) and 0 (words in usual compounds, some with numbers, and stretches of the alphabet).

    Drawn from a fixed vocabulary by a fixed seed: the same in every process.
    """
    draw = random.Random(seed)
    alnum = LETTERS[:62]
    alphabets = [alnum, alnum, alnum + "+/", alnum + "_-", LETTERS[:26] + LETTERS[52:62], LETTERS[26:62], LETTERS[26:52], LETTERS[:26], "0123456789abcdef", "0123456789ABCDEF"]
    out = [("".join(draw.choices(draw.choice(alphabets), k=draw.randint(16, 64))), 1) for _ in range(each)]
    words = vocabulary_words()
    for k in range(each):
        if k % 50 == 0:
            start = draw.randrange(20)
            text = LETTERS[26 + start : 26 + draw.randint(start + 5, 26)]
        else:
            parts = draw.choices(words, k=draw.randint(1, 5))
            text = "".join(p.title() for p in parts) if draw.random() < 0.3 else draw.choice("_-/=+.").join(parts)
        if draw.random() < 0.3:
            text += draw.choice(["", "_", "-", "/"]) + str(draw.randrange(10 ** draw.randint(1, 8)))
        out.append((draw.choice([text, text, text.lower(), text.upper()]), 0))
    return out


class Markov:
    """Log-likelihood ratios of two first-order chains over ``LETTERS``."""

    def __init__(self, samples: Iterable[tuple[str, int]]) -> None:
        at = {c: i for i, c in enumerate(LETTERS)}
        n = len(LETTERS)
        counts = np.ones((2, n + 1, n))
        for text, label in samples:
            last = n
            for c in text:
                if (i := at.get(c)) is None:
                    last = n
                    continue
                counts[label, last, i] += 1
                last = i
        log = np.log(counts / counts.sum(axis=2, keepdims=True))
        self.ratio = log[1] - log[0]
        self.index = np.full(128, -1, dtype=np.int64)
        self.index[[ord(c) for c in LETTERS]] = range(n)

    def score(self, run: str) -> float:
        """Mean log-likelihood ratio of a run of ``LETTERS``, in nats a character."""
        i = self.index[np.frombuffer(run.encode("ascii"), np.uint8)]
        return float(self.ratio[np.r_[len(LETTERS), i[:-1]], i].mean())


@lru_cache(maxsize=4)
def default_model() -> Markov:
    return Markov(labelled_samples())


def _left(a: int, b: int, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int]]:
    """The parts of ``a`` to ``b`` that no span of ``taken`` covers."""
    for c, d, _ in sorted(taken):
        if c < b and a < d:
            if a < c:
                yield a, c
            a = max(a, d)
    if a < b:
        yield a, b


_HEX_AS_X = bytes(120 if chr(c) in "0123456789abcdef" else 32 for c in range(256))
_RUN_AS_X = bytes(120 if chr(c) in LETTERS else 32 for c in range(256))


def spans(text: str | None, model: Markov | None = None, margin: float = MARGIN) -> list[tuple[int, int, str]]:
    """All spans ``(start, end, kind)`` of a whole text in code points, base ones and added ones, by start and then kind as in ``KINDS``."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    raw = text.encode("utf-8", "surrogatepass")
    # a quick look whether there is any run long enough; the patterns then give exact places
    if b"x" * 16 in raw.translate(_HEX_AS_X):
        found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if m.end() - m.start() >= 16]
    if b"x" * SHORTEST in raw.translate(_RUN_AS_X):
        base = list(found)
        model = model or default_model()
        for m in RUN.finditer(text):
            for start, end in _left(m.start(), m.end(), base):
                run = REPEATED.sub(r"\1", text[start:end])
                # digits and signs alone are dates and numbers, or hex
                if len(run) >= SHORTEST and re.search("[A-Za-z]", run) and model.score(run) > margin * max(1.0, FULL / len(run)):
                    found.append((start, end, "markov"))
    found.sort(key=lambda s: (s[0], KINDS.index(s[2])))
    return found


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def redacted(text: str, found: list[tuple[int, int, str]], mark: str = "<secret>") -> str:
    """The text with every span, overlapping ones as one, replaced by ``mark``."""
    out, at = [], 0
    whole: list[list[int]] = []
    for a, b, _ in sorted(found):
        if whole and a < whole[-1][1]:
            whole[-1][1] = max(whole[-1][1], b)
        else:
            whole.append([a, b])
    for a, b in whole:
        out += [text[at:a], mark]
        at = b
    return "".join([*out, text[at:]])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", samples: list[tuple[str, int]] | None = None, margin: float = MARGIN) -> DataFrame:
    """Spans of every row: ``(doc_id, n_assign, n_access, n_hex, n_markov, base_sha256, spans, redacted)``.

    Row by row: null and empty texts have no spans, repeated rows repeat, an empty table gives no rows. ``redacted``
    is null where the text has no span, so that the usual row carries nothing twice.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    model = Markov(samples) if samples is not None else default_model()  # a table of 68 x 67 numbers, the same for all tasks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[list] = [[] for _ in range(7)]
            for t in b.column(1):
                text = t.as_py() or ""
                found = spans(text, model, margin)
                kinds = [k for *_, k in found]
                for k in range(4):
                    rows[k].append(kinds.count(KINDS[k]))
                rows[4].append(hashlib.sha256(joined([s for s in found if s[2] != "markov"]).encode()).hexdigest())
                rows[5].append(joined(found))
                rows[6].append(redacted(text, found) if found else None)
            types = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x, t) for x, t in zip(rows, types))], ["doc_id", "n_assign", "n_access", "n_hex", "n_markov", "base_sha256", "spans", "redacted"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        lean(run), f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_markov long, base_sha256 string, spans string, redacted string"
    )


def redact(docs: DataFrame, text_col: str = "text", margin: float = MARGIN) -> DataFrame:
    """``docs`` with every secret replaced by ``<secret>``; all rows and columns stay, and ``n_chars``, where there is one, follows the text.

    Null texts stay null, empty ones empty; repeated rows are changed alike; an empty table stays empty; texts are read whole, however long.
    """
    small_batches(docs.sparkSession)
    columns = docs.columns
    text_at = columns.index(text_col)
    length_at = columns.index("n_chars") if dict(docs.dtypes).get("n_chars") in ("bigint", "int") else None
    model = default_model()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(text_at).to_pylist()
            arrays, changed = list(b.columns), {}
            for i, t in enumerate(texts):
                if found := spans(t, model, margin):
                    changed[i] = redacted(t, found)
            if changed:
                arrays[text_at] = pa.array([changed.get(i, t) for i, t in enumerate(texts)], b.schema.field(text_at).type)
                if length_at is not None:
                    lengths = b.column(length_at).to_pylist()
                    arrays[length_at] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(lengths)], b.schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(arrays, schema=b.schema)

    return docs.mapInArrow(lean(run), docs.schema)
