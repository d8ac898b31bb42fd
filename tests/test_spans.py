"""Span alignment against plain searches."""

import itertools
import random

from kgspark.operators import spans as S


def cover(gold, said):
    """Common runs, longest first, by trying all places."""
    out, g, s = [], list(gold), list(said)
    for n in range(min(len(g), len(s)), 0, -1):
        again = True
        while again:
            again = False
            for a, b in itertools.product(range(len(s) - n + 1), range(len(g) - n + 1)):
                if None not in s[a : a + n] and s[a : a + n] == g[b : b + n]:
                    out.append((a, b, n))
                    s[a : a + n] = g[b : b + n] = [None] * n
                    again = True
                    break
    return tuple(out)


def test_runs_like_trying_all_places():
    draw = random.Random(1)
    for _ in range(4000):
        letters = "abcd"[: draw.randint(1, 4)]
        gold, said = (tuple(draw.choice(letters) for _ in range(draw.randint(0, 9))) for _ in range(2))
        assert S.shared_runs(gold, said) == cover(gold, said)


def test_spans_of_runs_and_stretches():
    words = lambda t: tuple(t.split())
    # "x" leads up to gold's start, "z" follows its end, "y" lies between
    got = S.attribute_spans(words("a b c d"), words("x a b y c d z"), "SUB", "OBJ", 10)
    assert got == (True, [("SUB", 11, 14)], [("OBJ", 10, 12), ("OBJ", 13, 15), ("OBJ", 16, 16)], 7)
    # nothing is drawn to runs inside gold
    got = S.attribute_spans(words("a b c"), words("x b y"), "SUB", "SUB", 0)
    assert got == (True, [("SUB", 0, 2)], [("SUB", 1, 1), ("SUB", 3, 3), ("SUB", 4, 4)], 5)
    assert S.attribute_spans((), words("a"), "SUB", "OBJ", 3) == (False, [], [("OBJ", 3, 3)], 1)
    # each stretch is a span, however the runs are ordered
    got = S.attribute_spans(words("a b"), words("b x a"), "SUB", "SUB", 0)
    assert got == (True, [("SUB", 0, 1)], [("SUB", 0, 0), ("SUB", 1, 1), ("SUB", 2, 2)], 3)


def test_long_lists_take_little_time():
    gold = tuple(str(i % 97) for i in range(3000))
    assert sum(n for _, _, n in S.shared_runs(gold, gold[1500:] + gold[:1500])) == 3000


def test_first_of_the_best_pairings():
    draw = random.Random(2)
    for _ in range(400):
        n = draw.randint(1, 7)
        table = [[draw.choice([0, 0.25, 0.5, 1]) for _ in range(n)] for _ in range(n)]
        value = lambda p: sum(table[i][j] for i, j in enumerate(p))  # noqa: B023, E731
        best = max(map(value, itertools.permutations(range(n))))
        assert S.assignment(table) == list(next(p for p in itertools.permutations(range(n)) if abs(value(p) - best) < 1e-9))


def test_large_pairings_split_into_small_ones():
    """Blocks that have nothing to do with each other are paired as they are alone."""
    draw = random.Random(3)
    for _ in range(10):
        blocks = [[[draw.choice([0.25, 0.5, 1]) for _ in range(6)] for _ in range(6)] for _ in range(5)]
        table = [[-9.0] * 30 for _ in range(30)]
        want = []
        for k, block in enumerate(blocks):
            for i in range(6):
                table[6 * k + i][6 * k : 6 * k + 6] = block[i]
            want += [6 * k + j for j in S.assignment(block)]
        assert S.assignment(table) == want


def test_entries_of_one_pattern_are_scored_once(monkeypatch):
    """Scores depend on which tokens are equal only, so other words in the same places cost no other scoring."""
    draw = random.Random(4)
    words = ["a", "b c", "d, e", "f-g", "...", ""]
    triples = lambda of: [tuple(draw.choice(of) for _ in range(3)) for _ in range(draw.randint(0, 3))]
    calls = []
    monkeypatch.setattr(S, "assignment", lambda v, f=S.assignment: calls.append(1) or f(v))
    S.pattern_scores.cache_clear()
    other = str.maketrans("abcdefg", "qrstuvw")
    for _ in range(60):
        gold, said = triples(words), triples(words)
        moved = [[tuple(x.translate(other) for x in t) for t in side] for side in (gold, said)]
        before = S.score_entry(gold, said)
        n = len(calls)
        assert S.score_entry(*moved) == before and len(calls) == n
        assert [S.triple_spans(g, s) for g, s in zip(gold, said)] == [S.triple_spans(g, s) for g, s in zip(*moved)]
