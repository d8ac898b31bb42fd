"""Span scoring of triples: tokens of candidate and gold attributes are aligned, and labelled spans are scored by four schemes.

The schemes follow the public SemEval-2013 definitions. Work within an entry is small and irregular, so it runs in Python,
one entry a row; sums and averages over entries are one aggregate.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TAGS = ("SUB", "PRED", "OBJ")
SCHEMES = ("ent_type", "partial", "strict", "exact")
Span = tuple[str, int, int]
#: By scheme and tag. Scores are shared between equal pairs and mustn't be changed.
Scores = dict[tuple[str, str], list[int]]


_TOKEN = re.compile(r"\w+(?:[-'.]\w+)*|[^\w\s]+")


@lru_cache(maxsize=1 << 16)
def _both_tokens(text: str) -> tuple[tuple[str, ...], tuple[str, ...]]:
    found = _TOKEN.findall(text.lower())
    # a token is of word characters from its first on, or of none
    kept = tuple([t for t in found if len(t) > 1 or t[0].isalnum() or t[0] == "_"])
    return kept, tuple([t for t in kept if t[0].isalnum() or t[0] == "_"])


def tokens(text: str, strict: bool) -> tuple[str, ...]:
    """Lower-cased words; tokens of punctuation go, of one character only if not ``strict``."""
    return _both_tokens(text)[strict]


#: What two token lists share: where it begins in the said list, where in the gold list, and how many tokens it has.
Run = tuple[int, int, int]


class _Substrings:
    """Suffix automaton of a token list: each state stands for substrings that end at the same places, and knows the first of these."""

    def __init__(self, words: list[object]) -> None:
        self.steps: list[dict[object, int]] = [{}]
        self.shorter, self.size, self.end = [-1], [0], [-1]
        last = 0
        for at, word in enumerate(words):
            last = self._append(last, word, at)

    def _state(self, size: int, end: int, steps: dict[object, int], shorter: int) -> int:
        self.steps.append(steps)
        self.size.append(size)
        self.end.append(end)
        self.shorter.append(shorter)
        return len(self.steps) - 1

    def _append(self, last: int, word: object, at: int) -> int:
        new = self._state(self.size[last] + 1, at, {}, 0)
        p = last
        while p >= 0 and word not in self.steps[p]:
            self.steps[p][word] = new
            p = self.shorter[p]
        if p >= 0:
            q = self.steps[p][word]
            if self.size[q] != self.size[p] + 1:
                copy = self._state(self.size[p] + 1, self.end[q], dict(self.steps[q]), self.shorter[q])
                while p >= 0 and self.steps[p].get(word) == q:
                    self.steps[p][word] = copy
                    p = self.shorter[p]
                self.shorter[q] = copy
                q = copy
            self.shorter[new] = q
        return new

    def longest(self, words: list[object]) -> Run | None:
        """The longest run of ``words`` that occurs, of equally long ones the first, and its first place."""
        state = length = 0
        top: Run | None = None
        for at, word in enumerate(words):
            while state and word not in self.steps[state]:
                state = self.shorter[state]
                length = self.size[state]
            state = self.steps[state].get(word, 0)
            length = length + 1 if state else 0
            if length and (top is None or length > top[2]):
                top = (at - length + 1, self.end[state] - length + 1, length)
        return top


@lru_cache(maxsize=1 << 16)
def shared_runs(gold: tuple[str, ...], said: tuple[str, ...]) -> tuple[Run, ...]:
    """A greedy cover of both lists by common runs, longest first, in the order in which they are found.

    Of runs of one length the first in ``said`` counts, at its first place in ``gold``; tokens that are covered take no part in later runs.
    """
    out: list[Run] = []
    left: list[object] = list(gold)
    right: list[object] = list(said)
    if set(gold).isdisjoint(said):
        return ()
    while run := _Substrings(left).longest(right):
        out.append(run)
        s, g, n = run
        # what is covered equals nothing any more, not even itself on the other side
        left[g : g + n] = [("gold", g + k) for k in range(n)]
        right[s : s + n] = [("said", s + k) for k in range(n)]
    return tuple(out)


def attribute_spans(gold: tuple[str, ...], said: tuple[str, ...], gold_tag: str, said_tag: str, base: int) -> tuple[bool, list[Span], list[Span], int]:
    """Whether anything matches, spans of both sides from ``base``, and how many places they take.

    Places are the gold tokens', widened by said tokens that lead up to a run at gold's very start or follow one at its very end; each other stretch of said tokens between runs
    comes behind them. Said spans are the runs, in gold's order, and those stretches.
    """
    runs = shared_runs(gold, said)
    if not runs:
        whole = [(gold_tag, base, base + len(gold) - 1)] if gold else []
        other = [(said_tag, base + len(gold), base + len(gold) + len(said) - 1)] if said else []
        return False, whole, other, len(gold) + len(said)
    in_said = sorted(runs)
    head, tail = in_said[0], in_said[-1]
    lead = head[0] if head[1] == 0 else 0
    rest = len(said) - (tail[0] + tail[2])
    trail = rest if tail[1] + tail[2] == len(gold) else 0
    start = base + lead
    spans = []
    for run in sorted(runs, key=lambda r: r[1]):
        first, last = start + run[1], start + run[1] + run[2] - 1
        spans.append((said_tag, first - lead * (run is head), last + trail * (run is tail)))
    # stretches of said tokens before, between and behind the runs that no run has drawn to itself
    edges = [0, *(x for s, _, n in in_said for x in (s, s + n)), len(said)]
    gaps = [b - a for a, b in zip(edges[::2], edges[1::2])]
    gaps[0] -= lead
    gaps[-1] -= trail
    at = start + len(gold) + trail
    for gap in gaps:
        if gap:
            spans.append((said_tag, at, at + gap - 1))
            at += gap
    return True, [(gold_tag, start, start + len(gold) - 1)], spans, at - base


def triple_spans(gold: tuple[str, str, str], said: tuple[str, str, str]) -> tuple[list[Span], list[Span]]:
    """Spans of a gold and a said triple; where two attributes match nothing, they are tried against each other: S-O, S-P, P-O."""
    return _token_spans([tokens(x, True) for x in gold], [tokens(x, False) for x in said])


def _token_spans(g: Sequence[tuple], s: Sequence[tuple]) -> tuple[list[Span], list[Span]]:
    """``triple_spans`` of attributes as lists of tokens, or of anything that is equal where tokens are."""
    pairing = [0, 1, 2]
    shared = lambda x, y: not set(g[x]).isdisjoint(s[y])
    found = [shared(i, i) for i in range(3)]
    for a, b in ((0, 2), (0, 1), (1, 2)):
        if not found[a] and not found[b] and (shared(a, b) or shared(b, a)):
            pairing[a], pairing[b] = b, a
            break
    left: list[Span] = []
    right: list[Span] = []
    base = 0
    for i in range(3):
        _, x, y, size = attribute_spans(g[i], s[pairing[i]], TAGS[i], TAGS[pairing[i]], base)
        left += x
        right += y
        base += size
    return left, right


def semeval(gold: list[Span], said: list[Span]) -> Scores:
    """Correct, incorrect, partial, missed and spurious counts by scheme and tag (``all`` included)."""
    return _semeval(tuple(gold), tuple(said))


@lru_cache(maxsize=1 << 16)
def _semeval(gold: tuple[Span, ...], said: tuple[Span, ...]) -> Scores:
    out = {(k, t): [0] * 5 for k in SCHEMES for t in ("all", *TAGS)}

    def add(tag: str, *what: int) -> None:
        for k, w in zip(SCHEMES, what):
            out[k, "all"][w] += 1
            out[k, tag][w] += 1

    used: set[Span] = set()
    for p in said:
        if p in gold:
            used.add(p)
            add(p[0], 0, 0, 0, 0)
            continue
        same = next((t for t in gold if t[1:] == p[1:]), None)
        over = same or next((t for t in gold if t[1] <= p[2] and p[1] <= t[2]), None)
        if over is None:
            add(p[0], 4, 4, 4, 4)
            continue
        used.add(over)
        add(over[0], 0 if over[0] == p[0] else 1, 0 if same else 2, 1, 0 if same else 1)
    for t in gold:
        if t not in used:
            add(t[0], 3, 3, 3, 3)
    return out


def rates(counts: list[int], scheme: str) -> tuple[int, int, float, float, float]:
    """Possible, actual, precision, recall and F1."""
    cor, inc, par, mis, spu = counts
    possible, actual = cor + inc + par + mis, cor + inc + par + spu
    right = cor + (0.5 * par if scheme in ("partial", "ent_type") else 0)
    p, r = (right / actual if actual else 0.0), (right / possible if possible else 0.0)
    return possible, actual, p, r, (2 * p * r / (p + r) if p + r else 0.0)


def assignment(value: list[list[float]]) -> list[int]:
    """The permutation with the largest sum; of equal ones the first in lexicographic order.

    Shortest augmenting paths give an optimum and potentials; the optima are the perfect matchings of the pairs that the potentials leave tight. From row to row the
    first tight column is taken with which the rows below can still be matched.
    """
    n = len(value)
    u, v, owner = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, way, done = [float("inf")] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        while True:
            done[j0] = True
            row, delta, j1 = owner[j0], float("inf"), 0
            for j in range(1, n + 1):
                if not done[j]:
                    cost = -value[row - 1][j - 1] - u[row] - v[j]
                    if cost < low[j]:
                        low[j], way[j] = cost, j0
                    if low[j] < delta:
                        delta, j1 = low[j], j
            for j in range(n + 1):
                if done[j]:
                    u[owner[j]] += delta
                    v[j] -= delta
                else:
                    low[j] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            owner[j0], j0 = owner[way[j0]], way[j0]
    tight = [[j for j in range(n) if -value[i][j] - u[i + 1] - v[j + 1] < 1e-9] for i in range(n)]
    row_of = [owner[j + 1] - 1 for j in range(n)]
    column_of = [0] * n
    for j, i in enumerate(row_of):
        column_of[i] = j

    def moved(i: int, fixed: int, tried: set[int]) -> bool:
        """Find row ``i`` another column, moving rows below ``fixed`` along."""
        for j in tight[i]:
            if j not in tried and row_of[j] > fixed:
                tried.add(j)
                if row_of[j] == n or moved(row_of[j], fixed, tried):
                    row_of[j], column_of[i] = i, j
                    return True
        return False

    for i in range(n):
        for j in tight[i]:
            if j == column_of[i]:
                break
            if row_of[j] < i:
                continue
            # row i takes column j; its own becomes free for the row that had j
            other, free, before = row_of[j], column_of[i], (row_of[:], column_of[:])
            row_of[j], column_of[i], row_of[free] = i, j, n
            if moved(other, i, {j}):
                break
            row_of[:], column_of[:] = before
    return column_of


#: An entry's gold and said triples with a number for each token, by first occurrence.
Pattern = tuple[tuple, tuple]


def pattern(gold: Iterable[tuple[str, str, str]], said: Iterable[tuple[str, str, str]]) -> Pattern:
    """What scores depend on: which tokens of an entry are equal, not what they are."""
    names: dict[str, int] = {}
    number = names.setdefault
    return tuple([tuple([tuple([tuple([number(w, len(names)) for w in _both_tokens(x)[strict]]) for x in t]) for t in side]) for side, strict in ((gold, 1), (said, 0))])


@lru_cache(maxsize=1 << 14)
def pattern_scores(entry: Pattern) -> tuple[Scores, ...]:
    """Scores of an entry's triples under the best pairing; the shorter side is padded by empty triples."""
    gold, said = entry
    n = max(len(gold), len(said))
    none = (((), (), ()),)
    g, s = gold + none * (n - len(gold)), said + none * (n - len(said))
    table = [[semeval(*_token_spans(x, y)) for x in g] for y in s]
    seen: dict[int, float] = {}
    for row in table:
        for t in row:
            if id(t) not in seen:
                seen[id(t)] = sum(rates(t[k, "all"], k)[4] for k in SCHEMES) / len(SCHEMES)
    value = [[seen[id(t)] for t in row] for row in table]
    return tuple(table[i][j] for i, j in enumerate(assignment(value)))


def score_entry(gold: list[tuple[str, str, str]], said: list[tuple[str, str, str]]) -> list[Scores]:
    """``pattern_scores`` of an entry's texts."""
    return list(pattern_scores(pattern(gold, said)))


ENTRY = "entry_id long, scheme string, tag string, correct long, incorrect long, partial long, missed long, spurious long, possible long, actual long, precision double, recall double, f1 double"


def entry_scores(entries: DataFrame) -> DataFrame:
    """Long rows of scores, one for each pair of triples, scheme and tag; ``entries`` is (entry_id, gold, said), arrays of three strings."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            rows = []
            for e, gold, said in zip(df["entry_id"], df["gold"], df["said"]):
                as_list = lambda x: [tuple(t) for t in x] if x is not None else []
                for scores in score_entry(as_list(gold), as_list(said)):
                    rows += [(e, k, t, *c, *rates(c, k)) for (k, t), c in scores.items()]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in ENTRY.split(", ")])

    return entries.select("entry_id", "gold", "said").mapInPandas(run, ENTRY)


def system_scores(scores: DataFrame) -> DataFrame:
    """Counts summed and rates averaged by scheme and tag."""
    sums = [F.sum(c).alias(c) for c in ("correct", "incorrect", "partial", "missed", "spurious", "possible", "actual")]
    return scores.groupBy("scheme", "tag").agg(*sums, *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])


def _rows(column: pa.Array) -> list[list[tuple[str, ...]]]:
    """Lists of triples; null is an empty one."""
    flat = column.flatten()
    words = flat.flatten().to_pylist()
    ends = np.cumsum(pc.list_value_length(flat).to_numpy(zero_copy_only=False)).astype(int).tolist()
    triples = [tuple(words[a:b]) for a, b in zip([0, *ends], ends)]
    ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)).astype(int).tolist()
    return [triples[a:b] for a, b in zip([0, *ends], ends)]


def _summed(times: Counter[Pattern], parts: tuple[str, ...]) -> pa.RecordBatch:
    """Sums over entries by scheme and tag, each pattern as often as it came."""
    sums: dict[tuple[str, str], list[float]] = {}
    for entry, often in times.items():
        for scores in pattern_scores(entry):
            for (k, t), c in scores.items():
                own = sums.setdefault((k, t), [0.0] * len(parts))
                for i, v in enumerate((*c, *rates(c, k), 1)):
                    own[i] += often * v
    columns = [[k for k, _ in sums], [t for _, t in sums]], list(map(list, zip(*sums.values()))) or [[]] * len(parts)
    arrays = [pa.array(c, pa.string()) for c in columns[0]] + [pa.array(c, pa.float64()) for c in columns[1]]
    return pa.RecordBatch.from_arrays(arrays, ["scheme", "tag", *parts])


#: Patterns that a task counts before it sums their scores.
HELD = 1 << 14


def system_scores_of(entries: DataFrame) -> DataFrame:
    """``system_scores`` of ``entry_scores`` with sums made in each task: entries are counted by pattern, and each pattern is scored once."""
    counts = ("correct", "incorrect", "partial", "missed", "spurious", "possible", "actual")
    parts = (*counts, "precision", "recall", "f1", "rows")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times: Counter[Pattern] = Counter()
        for b in batches:
            times.update(map(pattern, _rows(b.column(0)), _rows(b.column(1))))
            if len(times) > HELD:
                yield _summed(times, parts)
                times.clear()
        if times:
            yield _summed(times, parts)

    each = entries.select("gold", "said").mapInArrow(run, "scheme string, tag string, " + ", ".join(f"{c} double" for c in parts))
    sums = each.groupBy("scheme", "tag").agg(*[F.sum(c).alias(c) for c in parts])
    return sums.select("scheme", "tag", *[F.col(c).cast("long").alias(c) for c in counts], *[(F.col(c) / F.col("rows")).alias(c) for c in ("precision", "recall", "f1")])
