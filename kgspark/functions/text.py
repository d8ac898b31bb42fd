"""Text functions as column expressions: terms, descriptions, prompts, answers, chat templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The prefixes put before queries, not documents, when they are embedded.
STS_PREFIX = "Instruct: Retrieve semantically similar text.\nQuery: "
RETRIEVAL_PREFIX = ""
NONE_TEXT = "None of the above."


def strip(x: Column) -> Column:
    return F.trim(x, F.lit(" \t\n\v\f\r"))


def normalise_term(x: Column, compat: bool = False) -> Column:
    """``<iri>`` without its brackets; of a literal, the text without quotes and without an English language tag.

    ``compat`` removes every ``@en`` wherever it stands, also in ``@en-gb``; else only a tag at the end that is exactly English goes.
    """
    t = strip(x)
    iri = t.startswith("<") & t.rlike(r"^<(.*?)>")
    literal = F.replace(t, F.lit("@en"), F.lit("")) if compat else F.regexp_replace(t, r'(?<=")@en$', "")
    return F.when(iri, F.substring(t, F.lit(2), F.greatest(F.length(t) - 2, F.lit(0)))).otherwise(F.replace(literal, F.lit('"'), F.lit("")))


def split_tag(x: Column) -> Column:
    """``(text, tag)`` at the last ``@``; tag empty if there is none."""
    tag = F.substring_index(x, "@", -1)
    has = F.instr(x, "@") > 0
    return F.struct(
        F.when(has, F.left(x, F.length(x) - F.length(tag) - 1)).otherwise(x).alias("text"), F.when(has, tag).otherwise(F.lit("")).alias("tag")
    )


def full_description(label: Column, definition: Column, types: Column, most: int = 3) -> Column:
    """``label (t1, t2, t3): definition`` with at most three non-empty types, ``label: definition`` without any."""
    kept = F.slice(F.filter(F.coalesce(types, F.array().cast("array<string>")), lambda t: t.isNotNull() & (t != "")), 1, most)
    return F.when(F.size(kept) > 0, F.concat(label, F.lit(" ("), F.array_join(kept, ", "), F.lit("): "), definition)).otherwise(F.concat(label, F.lit(": "), definition))


def pair_text(name: Column, description: Column, types: Column) -> Column:
    """``name (types): description`` for pair scorers: all types, parentheses also when there is none."""
    return F.concat(name, F.lit(" ("), F.array_join(F.coalesce(types, F.array().cast("array<string>")), ", "), F.lit("): "), description)


def relation_text(rel: Column, definition: Column) -> Column:
    return F.concat_ws(": ", rel, definition)


def as_query(x: Column, prefix: str = STS_PREFIX) -> Column:
    return F.concat(F.lit(prefix), x)


def fill(template: str, **values: Column) -> Column:
    """``template`` with each ``{name}`` replaced; a null value renders as ``None``. Values aren't scanned for names again."""
    parts: list[Column] = []
    rest = template
    while rest:
        found = min(((rest.find("{%s}" % n), n) for n in values if "{%s}" % n in rest), default=None)
        if found is None:
            parts.append(F.lit(rest))
            break
        at, name = found
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("None")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def quoted(x: Column) -> Column:
    """A string as a Python literal: single quotes, or double ones if it holds single and no double ones."""
    body = F.replace(F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")), F.lit("\t"), F.lit("\\t"))
    double = (F.instr(x, "'") > 0) & (F.instr(x, '"') == 0)
    return F.when(double, F.concat(F.lit('"'), body, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'")))


def list_text(xs: Column) -> Column:
    """An array of strings as a Python list."""
    return F.concat(F.lit("["), F.array_join(F.transform(xs, quoted), ", "), F.lit("]"))


def triples_text(triples: Column) -> Column:
    """An array of (subj, rel, obj) structs as a Python list of lists."""
    return F.concat(F.lit("["), F.array_join(F.transform(triples, lambda t: list_text(F.array(t.subj, t.rel, t.obj))), ", "), F.lit("]"))


def set_text(xs: Column) -> Column:
    """Distinct strings as a Python set, in first-seen order."""
    each = F.array_distinct(xs)
    return F.when(F.size(each) == 0, F.lit("set()")).otherwise(F.concat(F.lit("{"), F.array_join(F.transform(each, quoted), ", "), F.lit("}")))


def lettered_choices(options: Column, most: int = 25) -> Column:
    """``A. '...'`` lines and a last letter for none; more than ``most`` options are refused. Behind Z come the characters that follow it, which reach to 190 options."""
    letter = lambda i: F.char(F.lit(65) + i)
    lines = F.transform(options, lambda o, i: F.concat(letter(i), F.lit(". "), o))
    all_ = F.concat(lines, F.array(F.concat(letter(F.size(options)), F.lit(f". {NONE_TEXT}"))))
    return F.when(F.size(options) > most, F.raise_error(F.lit("more choices than letters")).cast("string")).otherwise(F.array_join(all_, "\n"))


def numbered_candidates(options: Column) -> Column:
    """``1. ...`` lines and a last number for none."""
    lines = F.transform(options, lambda o, i: F.concat((i + 1).cast("string"), F.lit(". "), o))
    return F.array_join(F.concat(lines, F.array(F.concat((F.size(options) + 1).cast("string"), F.lit(". None")))), "\n")


def chosen_letter(answer: Column, size: Column) -> Column:
    """0-based choice of an answer's first character; null for none, for other characters and for an empty answer."""
    at = F.ascii(F.substring(answer, 1, 1)) - 65
    return F.when((F.length(answer) > 0) & (at >= 0) & (at < size), at)


def chosen_number(answer: Column, size: Column, compat: bool = False) -> Column:
    """0-based choice of a numbered answer; null for none.

    By default the first whole integer counts. ``compat`` looks from the highest number down for digits anywhere in the answer, so that
    11 of 10 is taken as 1.
    """
    if compat:
        tried = F.filter(F.reverse(F.sequence(F.lit(1), F.greatest(size, F.lit(1)))), lambda k: (k <= size) & F.contains(answer, k.cast("string")))
        return F.try_element_at(tried, F.lit(1)) - 1
    n = F.regexp_extract(answer, r"(\d{1,9})", 1)
    value = F.when(n != "", n.cast("int"))
    return F.when((value >= 1) & (value <= size), value - 1)


def truncated(x: Column, words: Column | int) -> Column:
    """The first ``words`` space-separated tokens."""
    n = F.lit(words) if isinstance(words, int) else words
    return F.array_join(F.slice(F.split(x, " "), F.lit(1), n), " ")


def shrunk(x: Column, fixed_words: Column, budget: int, start: int = 256, step: int = 32) -> Column:
    """The largest of the lengths start, start - step, ... 0 at which the text and ``fixed_words`` fit the budget; null if none does."""
    size = F.size(F.split(x, " "))
    fits = F.filter(F.sequence(F.lit(start), F.lit(0), F.lit(-step)), lambda n: F.least(n, size) + fixed_words <= budget)
    return F.try_element_at(fits, F.lit(1))


def webnlg(x: Column, last: bool = False) -> Column:
    """Evaluation form of a term: camelCase split, underscores as spaces, white space even, lower case; of a last element, no trailing parenthesis."""
    t = F.regexp_replace(x, r"([a-z])([A-Z])", "$1 $2")
    t = F.lower(F.regexp_replace(F.replace(t, F.lit("_"), F.lit(" ")), r"\s+", " "))
    if last:
        t = F.regexp_replace(t, r"\s*\([^()]*\)$", "")
    return F.trim(F.translate(t, "áàâäãåçéèêëíìîïñóòôöõúùûüýÿß", "aaaaaaceeeeiiiinooooouuuuyys"))


def chat(messages: Column, answer_prefix: str = "") -> Column:
    """Role-tagged messages as one prompt that ends where the answer begins."""
    lines = F.transform(messages, lambda m: F.concat(F.lit("<|"), m.role, F.lit("|>\n"), m["content"], F.lit("\n")))
    return F.concat(F.array_join(lines, ""), F.lit("<|assistant|>\n" + answer_prefix))


def union_ordered(first: Column, then: Column) -> Column:
    """Both lists without repeats, ``first`` leading."""
    return F.array_distinct(F.concat(first, then))


def hints_in_front(hints: Column, retrieved: Column) -> Column:
    """Hints that weren't retrieved, then everything retrieved."""
    return F.concat(F.array_except(hints, retrieved), retrieved)


def merged_entities(answer: Column, first: Column, second: Column) -> Column:
    """The model's merged list; without one the first list, and without that the second."""
    return F.when(F.size(answer) > 0, answer).when(F.size(first) > 0, first).otherwise(second)
