"""Model interfaces and deterministic stand-ins.

A real model plugs in as an object with one method. It is sent to workers by pickling, makes its heavy state on first
use, and gets whole Arrow batches, so prompts are generated in batches.
"""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.parsers import literal


class Completer(Protocol):
    def complete(self, prompts: list[str], max_tokens: int, n: int) -> list[list[str]]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class PairScorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


class RuleCompleter:
    """Completions by rule: what a prompt's last ``Text:`` line, choices or candidates suggest."""

    def complete(self, prompts: list[str], max_tokens: int = 1024, n: int = 1) -> list[list[str]]:
        return [[self._one(p)] * n for p in prompts]

    @staticmethod
    def _one(prompt: str) -> str:
        # what isn't there isn't looked for by patterns: prompts hold whole texts
        if prompt.startswith("A. ") or "\nA. " in prompt:
            letters = re.findall(r"^([A-Z])\. ", prompt, re.M)
            return letters[hash_number(prompt) % len(letters)]
        if "Triples to define: " in prompt and (m := re.search(r"Triples to define: (.*)", prompt)):
            return "\n".join(f"- {r}: {r} relates a subject to an object" for r in dict.fromkeys(re.findall(r"'([^']*)'", m[1])[1::3]))
        if "Entities to describe: [" in prompt and (m := re.search(r"Entities to describe: \[(.*)\]", prompt)):
            names = re.findall(r"'([^']*)'", m[1])
            return "[" + ", ".join('{"entity":"%s","definition":"%s as named in the text","type":"thing"}' % (x, x) for x in names) + "]"
        if m := re.search(r"Text: (.*)", prompt):
            words = [w for w in re.findall(r"[^\W\d_]+", m[1]) if len(w) > 1][:9]
            if prompt.rstrip().endswith("Entities:"):
                return str(words[::2])
            return str([words[i : i + 3] for i in range(0, len(words) - 2, 3)])
        return ""


class SameInitial:
    """A verifier that names the alphabetically first choice with the initial of the definition's last word, and the last letter if there is none."""

    def complete(self, prompts: list[str], max_tokens: int = 5, n: int = 1) -> list[list[str]]:
        return [[self._one(p)] * n for p in prompts]

    @staticmethod
    def _one(prompt: str) -> str:
        question = prompt.rpartition("\nDefinition: ")[2].split("\n")
        initial = question[0].split()[-1:] and question[0].split()[-1][0]
        choices = [(line[3:], line[0]) for line in question if line[1:3] == ". "]
        fitting = [c for c in choices[:-1] if initial and c[0].startswith(initial)]
        return min(fitting)[1] if fitting else choices[-1][1]


class EchoCompleter(RuleCompleter):
    """``RuleCompleter`` that takes hints at their word: extraction adds a triple of the first and last known entity and the first known relation, lists are merged, definitions end in their relation."""

    @staticmethod
    def _one(prompt: str) -> str:
        if "Triples to define: " in prompt and (m := re.search(r"Triples to define: (.*)", prompt)):
            return "\n".join(f"- {r}: what is meant by {r}" for r in dict.fromkeys(re.findall(r"'([^']*)'", m[1])[1::3]))
        if "List " in prompt and (lists := re.findall(r"^List [12]: (\[.*\])$", prompt, re.M)):
            return str(list(dict.fromkeys(x for one in lists for x in literal(one))))
        said = RuleCompleter._one(f"\n{prompt}".replace("\nA. ", "\nA.")[1:])  # it is never asked for a choice: that is a line of the text
        known = [re.search(rf"^Known {kind}: (.*)$", prompt, re.M) for kind in ("entities", "relations")] if prompt.endswith("Triples:") else [None]
        if all(m and m[1] not in ("", "None") for m in known):
            entities, relations = (sorted(m[1].split(", ")) for m in known)
            return str([*literal(said), [entities[0], relations[0], entities[-1]]])
        return said


class HashEmbedder:
    """Signed feature hashing of character trigrams, at length 1."""

    def __init__(self, size: int = 64) -> None:
        self.size = size

    def embed(self, texts: list[str]) -> np.ndarray:
        """Texts go in pieces of some ``PIECE`` characters, in which each different trigram is hashed once."""
        out = np.zeros((len(texts), self.size), dtype=np.float32)
        padded, first, held = [], 0, 0
        for i, t in enumerate(texts):
            padded.append(f"  {t.lower()} ")
            held += len(padded[-1])
            if held >= PIECE or i + 1 == len(texts):
                out[first : i + 1] = self._sums(padded)
                padded, first, held = [], i + 1, 0
        for row in out:
            norm = np.linalg.norm(row)
            row /= norm or 1
        return out

    def _sums(self, padded: list[str]) -> np.ndarray:
        sizes = np.array([len(t) for t in padded])
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        known = np.flatnonzero(np.bincount(points))
        letters = np.zeros(int(known[-1]) + 1, dtype=np.int64)
        letters[known] = np.arange(len(known))
        at, n = letters[points], len(known)
        codes = (at[:-2] * n + at[1:-1]) * n + at[2:]
        starts = np.ones(len(points), dtype=bool)
        ends = np.cumsum(sizes)
        starts[ends - 1] = starts[ends - 2] = False
        codes, row = codes[starts[:-2]], np.repeat(np.arange(len(padded)), sizes - 2)
        if n**3 <= 4 * PIECE:
            kinds = np.flatnonzero(np.bincount(codes))
            place = np.zeros(int(kinds[-1]) + 1, dtype=np.int64)
            place[kinds] = np.arange(len(kinds))
            place = place[codes]
        else:
            kinds, place = np.unique(codes, return_inverse=True)
        names = (chr(known[c // n // n]) + chr(known[c // n % n]) + chr(known[c % n]) for c in kinds)
        hashes = [_trigram_hash(name) for name in names]
        slot = np.array([h % self.size for h in hashes])[place]
        sign = np.array([1.0 if h & (1 << 40) else -1.0 for h in hashes])[place]
        return np.bincount(row * self.size + slot, sign, len(padded) * self.size).reshape(len(padded), self.size)


class JaccardScorer:
    """Shared words over all words of two texts."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for a, b in pairs:
            x, y = set(a.lower().split()), set(b.lower().split())
            out.append(len(x & y) / len(x | y) if x | y else 0.0)
        return out


class Retrying:
    """A remote completer with a bounded number of attempts."""

    def __init__(self, call: Callable[[list[str], int, int], list[list[str]]], attempts: int = 5, wait: float = 5.0) -> None:
        self.call, self.attempts, self.wait = call, attempts, wait

    def complete(self, prompts: list[str], max_tokens: int = 512, n: int = 1) -> list[list[str]]:
        for attempt in range(self.attempts):
            try:
                return self.call(prompts, max_tokens, n)
            except OSError:
                if attempt + 1 == self.attempts:
                    raise
                time.sleep(self.wait)
        raise AssertionError


def is_remote(name: str) -> bool:
    """Models that are called over the network, by name."""
    return "gpt" in name


def hash_number(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


#: Characters that are embedded together, about.
PIECE = 1 << 20

#: Hashes of trigrams that were met, in each worker.
_trigram_hash = lru_cache(1 << 18)(hash_number)


def complete(model: Completer, prompt: Column, max_tokens: int = 1024, prefix: str = "") -> Column:
    """The completion of every prompt, greedy, behind ``prefix``; null prompts stay null.

    By batches rather than by an iterator of them, so that Spark runs a parser of the answer in the same worker.
    """

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series) -> pd.Series:
        known = s.notna()
        out = pd.Series([None] * len(s), dtype=object)
        out[known.to_numpy()] = [prefix + c[0] for c in model.complete(s[known].tolist(), max_tokens, 1)]
        return out

    return run(prompt)


def complete_samples(model: Completer, prompt: Column, n: int, max_tokens: int = 1024) -> Column:
    """``n`` completions of every prompt."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(model.complete(s.fillna("").tolist(), max_tokens, n))

    return run(prompt)


def embed(model: Embedder, text: Column, prefix: str = "") -> Column:
    """Embeddings at length 1."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.asarray(model.embed([prefix + t for t in s.fillna("")]), dtype=np.float64).reshape(len(s), -1)
            norm = np.linalg.norm(x, axis=1, keepdims=True)
            yield pd.Series(list((x / np.where(norm > 0, norm, 1))))

    return run(text)


def last_token_pool(states: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """The hidden state of each row's last token; ``states`` is (rows, tokens, size), ``mask`` 1 for tokens, padded on either side."""
    if mask[:, -1].all():
        return states[:, -1]
    return states[np.arange(len(states)), mask.sum(axis=1) - 1]


def pooled(states: Column, tokens: Column, size: int) -> Column:
    """Embeddings at length 1 from token states laid end to end, ``size`` numbers a token, of which the first ``tokens`` count."""

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for flat, count in batches:
            x = np.stack(flat.to_numpy()).astype(np.float64).reshape(len(flat), -1, size) if len(flat) else np.zeros((0, 1, size))
            last = last_token_pool(x, (np.arange(x.shape[1]) < count.to_numpy()[:, None]).astype(int))
            norm = np.linalg.norm(last, axis=1, keepdims=True)
            yield pd.Series(list((last / np.where(norm > 0, norm, 1))))

    return run(states, tokens)


def score_pairs(model: PairScorer, a: Column, b: Column) -> Column:
    @F.pandas_udf(T.DoubleType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, y in batches:
            yield pd.Series(model.score(list(zip(x.fillna(""), y.fillna("")))), dtype="float64")

    return run(a, b)
