"""Language ID by cross-parsing entropy.

For every language a suffix automaton holds labelled text. A document is parsed greedily into the longest phrases that
occur in that text; the language that needs the fewest phrases, normalised by the lengths of both texts, wins.

Texts are the UTF-8 bytes of their lower-cased letters, so every letter of every alphabet is itself, and there are few different bytes. The
automata are dense tables over the bytes of the labelled text in which a missing transition already is the restart of the next phrase,
so a step is one table lookup, taken for all languages and thousands of documents at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import lean, small_batches

#: Stands for all that isn't a letter; letters' bytes are never 0 or 1.
BLANK, SEPARATOR = 0, 1
#: Bytes of labelled text that a language's automaton holds at most: the documented bound of the fitted sample.
TRAIN_BYTES = 32_768
#: Long texts are parsed in pieces of so many bytes at once, which are fitted together afterwards.
PIECE = 2048
#: Bytes times languages that are parsed at a time; of longer texts the state is carried on.
AT_ONCE = 1 << 23
UNKNOWN = "und"


@cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)


def letters_of(text: str) -> tuple[np.ndarray, bool]:
    """UTF-8 bytes of the lower-cased letters, every run of other characters as one blank; whether there is any letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    letter = _is_letter()[points]
    points = np.where(letter, points, BLANK).astype("<u4")
    keep = letter | np.r_[True, letter[:-1]] if len(letter) else letter
    flat = points[keep].tobytes().decode("utf-32-le").encode()
    return np.frombuffer(flat, np.uint8), bool(letter.any())


def automaton(letters: np.ndarray, width: int) -> np.ndarray:
    """Transition table of the suffix automaton of ``letters``, which are below ``width``, an even number.

    Entry ``state * width + letter`` is ``next state * width + started``: where there is no transition the next state is the root's, and
    started is 1 there and for all steps from the root, since those begin a phrase.
    """
    edges: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for c in letters.tolist():
        now = len(edges)
        edges.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in edges[p]:
            edges[p][c] = now
            p = link[p]
        if p >= 0:
            q = edges[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(edges)
                edges.append(dict(edges[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and edges[p].get(c) == q:
                    edges[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    root = np.full(width, 1, dtype=np.int64)
    for c, to in edges[0].items():
        if c != SEPARATOR:
            root[c] = to * width + 1
    table = np.tile(root, len(edges))
    for state, own in enumerate(edges[1:], 1):
        for c, to in own.items():
            if c != SEPARATOR:
                table[state * width + c] = to * width
    return table


class Model:
    """Automata of all languages in one table."""

    def __init__(self, samples: dict[str, list[str]], train_bytes: int = TRAIN_BYTES) -> None:
        self.langs = sorted(samples)
        held, sizes = [], []
        for lang in self.langs:
            parts, used = [np.zeros(0, np.uint8)], 0
            for text in samples[lang]:
                got, _ = letters_of(text)
                if used and used + len(got) > train_bytes:
                    continue
                got = got[:train_bytes]
                parts += [got, np.array([SEPARATOR], dtype=np.uint8)]
                used += len(got)
            held.append(np.concatenate(parts))
            sizes.append(max(2, used))
        # bytes of no labelled text are one column of the tables, without transitions
        seen = np.setdiff1d(np.concatenate([*held, np.zeros(0, np.uint8)]), [BLANK, SEPARATOR])
        self.width = len(seen) + 3 + (len(seen) + 3) % 2
        self.column = np.full(256, len(seen) + 2, dtype=np.int64)
        self.column[[BLANK, SEPARATOR, *seen.tolist()]] = np.arange(len(seen) + 2)
        tables, roots, at = [], [], 0
        for letters in held:
            table = automaton(self.column[letters], self.width)
            roots.append(at)
            tables.append(table + at)
            at += len(table)
        kind = np.int32 if at < 1 << 31 else np.int64
        self.table = np.concatenate([t.astype(kind) for t in tables]) if tables else np.zeros(0, kind)
        self.roots = np.array(roots, dtype=np.int64)
        self.bits = np.log2(np.array(sizes, dtype=np.float64))

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases of each text under each language, ``(texts, languages)``, whole texts in one parse each."""
        out = np.zeros((len(texts), len(self.langs)), dtype=np.int64)
        most = max(1, AT_ONCE // max(1, len(self.langs)) // PIECE) * PIECE
        group: list[int] = []
        size = 0
        for i, text in enumerate(texts):
            if group and size + len(text) > most:
                self._whole(texts, group, most, out)
                group, size = [], 0
            group.append(i)
            size += len(text)
        self._whole(texts, group, most, out)
        return out

    def _whole(self, texts: list[np.ndarray], group: list[int], most: int, out: np.ndarray) -> None:
        state = np.repeat(self.roots[None], len(texts), axis=0)
        at = 0
        while group := [i for i in group if len(texts[i]) > at]:
            parts = [self.column[texts[i][at : at + most]] for i in group]
            counts, state[group] = self._parse(parts, state[group])
            out[group] += counts
            at += most

    def _parse(self, parts: list[np.ndarray], state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases begun in each part and the state behind it, from the states before.

        Pieces behind a part's first are parsed as if a phrase began there. A parse depends on nothing but where its phrase began, so
        where a parse that enters from the piece before begins a phrase at the same place, both are one from there.
        """
        flat = np.concatenate(parts)
        sizes = np.array([len(p) for p in parts])
        pieces = -(-sizes // PIECE)
        part = np.repeat(np.arange(len(parts)), pieces)
        first = np.r_[0, np.cumsum(pieces)[:-1]]
        number = np.arange(len(part)) - first[part]
        begin = (np.cumsum(sizes) - sizes)[part] + number * PIECE
        length = np.minimum(PIECE, sizes[part] - number * PIECE)
        counts = np.zeros((len(part), len(self.langs)), dtype=np.int64)
        ends = np.zeros_like(counts)
        behind = np.flatnonzero(number)
        self._run(flat, begin, length, np.flatnonzero(number == 0), state[part], counts, ends, None)
        if len(behind):
            started = np.zeros((len(self.langs), len(flat) + 1), dtype=np.int8)
            self._run(flat, begin, length, behind, np.repeat(self.roots[None], len(part), axis=0), counts, ends, started)
            upto = np.cumsum(started, axis=1, dtype=np.int32)
            own = ends.copy()
            while len(behind):
                before, entered = ends[behind], ends[behind - 1]
                ends[behind] = own[behind]
                self._enter(flat, begin, length, behind, entered, counts, ends, started, upto)
                # where no place was shared the state behind the piece is another, and the next piece is entered anew
                other = behind[(ends[behind] != before).any(axis=1)] + 1
                other = other[other < len(part)]
                behind = other[number[other] > 0]
        total = np.zeros((len(parts), len(self.langs)), dtype=np.int64)
        np.add.at(total, part, counts)
        return total, ends[first + pieces - 1]

    def _run(self, flat, begin, length, which, state, counts, ends, started) -> None:  # noqa: ANN001
        """Parse the pieces ``which`` from their states; ``started`` gets the places where phrases begin."""
        which = which[np.argsort(-length[which], kind="stable")]
        table = self.table
        for at in range(0, len(which), 1024):
            some = which[at : at + 1024]
            lengths = length[some]
            active = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right")
            places = begin[some]
            now = np.ascontiguousarray(state[some].T)
            breaks = np.zeros(now.shape, dtype=np.int64)
            for t, n in enumerate(active.tolist()):
                got = table[now[:, :n] + flat[places[:n] + t]]
                new = got & 1
                breaks[:, :n] += new
                now[:, :n] = got - new
                if started is not None:
                    started[:, places[:n] + t] = new
            counts[some], ends[some] = breaks.T, now.T

    def _enter(self, flat, begin, length, which, state, counts, ends, started, upto) -> None:  # noqa: ANN001
        """Parse the pieces ``which`` from the states before them, up to the first place where their own parse begins a phrase too."""
        langs = len(self.langs)
        piece, lang = np.repeat(which, langs), np.tile(np.arange(langs), len(which))
        now, n, t = state.reshape(-1).copy(), np.zeros(len(piece), np.int64), 0
        while len(piece):
            place = begin[piece] + t
            got = self.table[now + flat[place]].astype(np.int64)
            new = got & 1
            now = got - new
            met = (new == 1) & (started[lang, place] == 1)
            rest = upto[lang, begin[piece] + length[piece] - 1] - np.where(place > 0, upto[lang, place - 1], 0)
            n += np.where(met, rest, new)
            t += 1
            done = ~met & (length[piece] == t)
            ends[piece[done], lang[done]] = now[done]
            over = met | done
            counts[piece[over], lang[over]] = n[over]
            piece, lang, now, n = piece[~over], lang[~over], now[~over], n[~over]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and confidence of each text; ties go to the language that sorts first."""
        got = [letters_of(t) if t else (np.zeros(0, np.uint8), False) for t in texts]
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [k for k, (_, letters) in enumerate(got) if letters]
        langs, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        if known:
            parses = self.phrases([got[k][0] for k in known])
            lengths = np.array([len(got[k][0]) for k in known], dtype=np.float64)
            rate = parses * self.bits / lengths[:, None]
            best = rate.argmin(axis=1)
            for row, k in enumerate(known):
                low = rate[row, best[row]]
                rest = np.delete(rate[row], best[row])
                langs[k] = self.langs[best[row]]
                scores[k] = float(1 - low / rest.min()) if len(rest) else 1.0
        return langs, scores


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, train_bytes: int = TRAIN_BYTES) -> Model:
    """Fit on a bounded hash sample of the different labelled texts that aren't held out.

    The driver gets, for each language, about twice ``train_bytes`` characters of whole documents (20 documents at least);
    all different texts of a language have the same chance. Null and empty texts and labels don't take part.
    """
    known = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out())
    known = known.select("lang", "text", F.xxhash64(F.lit(11), "text").alias("draw"))
    each = known.groupBy("lang", "draw").agg(F.min(F.length("text")).alias("chars"))
    totals = each.groupBy("lang").agg(F.sum("chars").alias("chars"), F.count("*").alias("rows")).collect()
    if not totals:
        return Model({}, train_bytes)
    share = F.lit(0.0)
    for r in totals:
        share = F.when(F.col("lang") == r.lang, min(1.0, max(2 * train_bytes / r.chars, 20 / r["rows"]))).otherwise(share)
    u = F.shiftrightunsigned("draw", 11).cast("double") / float(1 << 53)
    # substring only bounds what a single huge document sends to the driver; the model cuts there anyway
    drawn = known.where(u < share).select("lang", "draw", F.substring("text", 1, 2 * train_bytes).alias("text"))
    rows = drawn.groupBy("lang", "draw").agg(F.min("text").alias("text")).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.draw)):
        samples.setdefault(r.lang, []).append(r.text)
    return Model(samples, train_bytes)


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` of every row from its whole text alone.

    Null texts and texts without letters are ``und`` with score 0. The score is one less the winner's share of the runner-up's phrase rate.
    Without any labelled text all rows are ``und``. Repeated rows repeat; an empty table gives no rows; a null id isn't held out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    model = model or fit(docs)
    sent = spark.sparkContext.broadcast(model)  # at most train_bytes * 2 states for each language, 4 bytes for each different byte of the sample
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = sent.value.predict(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"]
            )

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(lean(run), f"doc_id {kind}, held_out boolean, lang_pred string, score double")
