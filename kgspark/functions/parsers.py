"""Lenient parsers of model completions.

Flat shapes have column expressions; nested Python literals go through an Arrow UDF, as no SQL function reads them.
"""

from __future__ import annotations

import ast
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kgspark.functions.text import strip


def bracket_spans(text: str) -> list[str]:
    """Every balanced ``[...]``, in the order in which they close; unmatched brackets are skipped."""
    opened: list[int] = []
    out = []
    for i, c in enumerate(text):
        if c == "[":
            opened.append(i)
        elif c == "]" and opened:
            out.append(text[opened.pop() : i + 1])
    return out


_PLAIN = r"\[(?:'[^'\\\n\r\0\[\]]*'(?:, '[^'\\\n\r\0\[\]]*')*)?\]"
_PLAIN_LIST, _PLAIN_LISTS = re.compile(_PLAIN), re.compile(rf"\[{_PLAIN}(?:, {_PLAIN})*\]")


def plain_list(text: str) -> list[str] | None:
    """A literal list of plain single-quoted strings, which are most of what models say; None for anything else, which may be a literal too."""
    return text[2:-2].split("', '") if len(text) > 2 and _PLAIN_LIST.fullmatch(text) else None


def literal(text: str):
    """``ast.literal_eval``, spared where the text is a plain list."""
    plain = plain_list(text)
    return ast.literal_eval(text) if plain is None else plain


def triples_of(text: str | None) -> list[list[str]]:
    """All triples of a completion.

    A list of three strings counts unless one is empty or ``_``. Where elements are of different kinds, list elements are
    joined by ", " and strings stay. What isn't a literal is skipped.
    """
    out = []
    for span in bracket_spans(text or ""):
        if _PLAIN_LISTS.fullmatch(span):
            continue  # its lists came before it
        try:
            value = literal(span)
        except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
            continue
        if not isinstance(value, list):
            continue
        if len(value) == 3 and all(isinstance(x, str) for x in value):
            if all(x not in ("", "_") for x in value):
                out.append(value)
        elif len({type(x) for x in value}) > 1:
            flat = [", ".join(map(str, x)) if isinstance(x, list) else x for x in value]
            if all(isinstance(x, str) for x in flat):
                out.append(flat)
    return out


def literal_triples(text: str | None) -> list[list[str]] | None:
    """A line that as a whole is a literal list of triples of strings; None for anything else."""
    try:
        value = ast.literal_eval((text or "").strip())
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return None
    fine = isinstance(value, list) and all(isinstance(t, list | tuple) and len(t) == 3 and all(isinstance(x, str) for x in t) for t in value)
    return [list(t) for t in value] if fine else None


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def strict_triples(texts: pd.Series) -> pd.Series:
    return texts.map(literal_triples)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def parse_triples(texts: pd.Series) -> pd.Series:
    return texts.map(triples_of)


def entities_of(text: str | None) -> list[str]:
    """The list from the first ``[`` to the first ``]`` behind it; empty if that is no list of strings."""
    text = text or ""
    a = text.find("[")
    b = text.find("]")
    if a < 0 or b < a:
        return []
    try:
        value = literal(text[a : b + 1])
    except (ValueError, SyntaxError, MemoryError, RecursionError, TypeError):
        return []
    return [str(x) for x in value]


@F.pandas_udf(T.ArrayType(T.StringType()))
def parse_entities(texts: pd.Series) -> pd.Series:
    return texts.map(entities_of)


_ITEM = r"'([^'\\\[\]]*)'"


def parse_triples_flat(text: Column) -> Column:
    """Triples of lists of three single-quoted strings without escapes or nesting, as structs."""
    spans = F.regexp_extract_all(text, F.lit(rf"(\[\s*{_ITEM}\s*,\s*{_ITEM}\s*,\s*{_ITEM}\s*\])"), F.lit(1))
    parts = F.transform(spans, lambda s: F.regexp_extract_all(s, F.lit(_ITEM), F.lit(1)))
    good = F.filter(parts, lambda p: F.forall(p, lambda x: (x != "") & (x != "_")))
    return F.transform(good, lambda p: F.struct(p[0].alias("subj"), p[1].alias("rel"), p[2].alias("obj")))


def parse_entities_flat(text: Column) -> Column:
    """Single-quoted strings between the first ``[`` and the first ``]``."""
    return F.regexp_extract_all(F.regexp_extract(text, r"^[^\[\]]*(\[[^\]]*\])", 1), F.lit(_ITEM), F.lit(1))


def parse_definitions(text: Column) -> Column:
    """``relation: definition`` lines as a map; a leading dash goes, ``Answer`` isn't a relation, the last of equal keys wins."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.instr(x, ":") > 0)
    pairs = F.transform(
        lines,
        lambda x: F.struct(
            strip(F.regexp_replace(strip(F.substring_index(x, ":", 1)), "^-", "")).alias("k"),
            strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("v"),
        ),
    )
    named = F.filter(pairs, lambda p: p.k != "Answer")
    # the last of equal keys: entries that no later one repeats
    keys = F.transform(named, lambda p: p.k)
    last = F.filter(named, lambda p, i: ~F.array_contains(F.slice(keys, i + 2, F.size(keys)), p.k))
    return F.map_from_entries(last)


def json_objects(text: Column) -> Column:
    """The objects of a completion's JSON array, from its first ``[`` to its last ``]``, as an array of variants; others are dropped."""
    body = F.replace(F.regexp_extract(text, r"(?s)(\[.*\])", 1), F.lit("\\_"), F.lit("_"))
    items = F.try_variant_get(F.try_parse_json(body), "$", "array<variant>")
    return F.filter(F.coalesce(items, F.array().cast("array<variant>")), lambda v: F.schema_of_variant(v).startswith("OBJECT"))


def parse_mentions(text: Column, wanted: Column) -> Column:
    """``(entity, definition, type, stub)`` for every wanted entity, in the order of ``wanted``.

    Only wanted entities count, the last of equal ones wins, missing fields are empty, and an entity that the completion leaves out becomes a stub.
    """
    get = lambda v, k: F.coalesce(F.try_variant_get(v, f"$.{k}", "string"), F.lit(""))
    said = F.transform(json_objects(text), lambda v: F.struct(get(v, "entity").alias("e"), get(v, "definition").alias("d"), get(v, "type").alias("t")))
    # arrays of one element bind what is parsed to a variable, so that it is parsed once and not for each use
    last = lambda said, e: F.array(F.try_element_at(F.filter(said, lambda s: s.e == e), F.lit(-1)))
    one = lambda e: lambda x: F.struct(
        e.alias("entity"), F.coalesce(x.d, F.lit("")).alias("definition"), F.coalesce(x.t, F.lit("")).alias("type"), x.isNull().alias("stub")
    )
    bound = F.array(F.struct(said.alias("said"), wanted.alias("wanted")))
    return F.flatten(F.transform(bound, lambda b: F.flatten(F.transform(b.wanted, lambda e: F.transform(last(b.said, e), one(e))))))


def parse_generated(text: Column, required: list[str]) -> Column:
    """Objects with all ``required`` keys, keyed by the stripped first of them; the first of equal keys wins."""
    get = lambda v, k: F.try_variant_get(v, f"$.{k}", "string")
    full = F.filter(json_objects(text), lambda v: F.forall(F.array(*[get(v, k) for k in required]), lambda x: x.isNotNull()))
    rows = F.transform(full, lambda v: F.struct(strip(get(v, required[0])).alias(required[0]), *[get(v, k).alias(k) for k in required[1:]]))
    # arrays of one element bind what is parsed to a variable, so that it isn't parsed again for each object
    first = lambda b: F.filter(b.rows, lambda r, i: ~F.array_contains(F.slice(b["keys"], F.lit(1), i), r[required[0]]))
    keyed = lambda b: F.struct(b.rows.alias("rows"), F.transform(b.rows, lambda r: r[required[0]]).alias("keys"))
    return F.flatten(F.transform(F.transform(F.array(F.struct(rows.alias("rows"))), keyed), first))


def first_definition(samples: Column, key: str = "definition") -> Column:
    """``key`` of the first sample whose ``{...}`` is JSON that holds it as a string."""
    body = lambda s: F.try_parse_json(F.regexp_extract(s, r"(?s)(\{.*\})", 1))
    text = F.transform(samples, lambda s: F.when(F.schema_of_variant(F.try_variant_get(body(s), f"$.{key}", "variant")) == "STRING", F.try_variant_get(body(s), f"$.{key}", "string")))
    return F.try_element_at(F.filter(text, lambda t: t.isNotNull()), F.lit(1))


def answered_id(text: Column, candidates: Column) -> Column:
    """The candidate at a ``{"ID": k}`` answer's 0-based k; null for anything else."""
    k = F.try_variant_get(F.try_parse_json(text), "$.ID", "int")
    return F.when(k >= 0, F.try_element_at(candidates, k + 1))
