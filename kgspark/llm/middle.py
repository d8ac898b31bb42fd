"""Fill-in-the-middle texts by built-in functions alone.

A text becomes an array of code points, two of its places are drawn from a digest of its id, and the three parts are put in another order with sentinels in front
of each. Parts are slices of the array; restoring splits the output at the sentinels.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kgspark.llm.common import unused

#: The sentinels in front of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = "<[PSM]>"


def draws(id_col: Column) -> list[Column]:
    """Four unsigned numbers of 32 bits from the SHA-256 of ``1:`` and the decimal id; null ids count as empty."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(id_col.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def arranged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", plain_percent: int = 10, suffix_first_percent: int = 20) -> DataFrame:
    """All columns of ``docs`` and ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output``: every whole text rearranged.

    Forms: ``plain`` (the text itself: empty texts, texts with a sentinel's string, and ``plain_percent`` of the rest), ``spm`` (suffix, prefix, middle) and ``psm`` (prefix, suffix, middle).
    Places are code points from 0 to n, both drawn alike, and null where plain. Null texts count as empty, repeated ids are cut alike, an
    empty table stays empty; columns of the five names are replaced. Row by row, nothing is shuffled.
    """
    own = ("n", "form", "prefix_chars", "middle_chars", "output")
    rows = docs.drop(*own)
    text, units, h, a, b = (unused(x, [*rows.columns, *own]) for x in ("__text", "__units", "__h", "__a", "__b"))
    rows = rows.withColumn(text, F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    rows = rows.withColumn(units, F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))).withColumn(h, F.array(*draws(F.col(f"`{id_col}`"))))
    rows = rows.withColumn("n", F.size(units).cast("long"))
    places = [F.col(h)[k] % (F.col("n") + 1) for k in (0, 1)]
    rows = rows.withColumns({a: F.least(*places), b: F.greatest(*places)})
    plain = (F.col("n") == 0) | F.col(text).contains(PREFIX) | F.col(text).contains(SUFFIX) | F.col(text).contains(MIDDLE) | (F.col(h)[2] % 100 >= 100 - plain_percent)
    rows = rows.withColumn("form", F.when(plain, "plain").when(F.col(h)[3] % 100 < suffix_first_percent, "spm").otherwise("psm"))
    part = lambda start, length: F.array_join(F.slice(units, (start + 1).cast("int"), length.cast("int")), "")
    prefix, middle, suffix = part(F.lit(0), F.col(a)), part(F.col(a), F.col(b) - F.col(a)), part(F.col(b), F.col("n") - F.col(b))
    front = F.when(F.col("form") == "psm", F.array_join(F.array(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle), ""))
    output = front.when(F.col("form") == "spm", F.array_join(F.array(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle), "")).otherwise(F.col(text))
    moved = F.col("form") != "plain"
    return rows.withColumns({"prefix_chars": F.when(moved, F.col(a)), "middle_chars": F.when(moved, F.col(b) - F.col(a)), "output": output}).drop(text, units, h, a, b)


def restored(output: Column, form: Column) -> Column:
    """The text that ``arranged`` started from: what follows each sentinel, put back in order; null where either is null."""
    parts = F.split(output, SENTINEL)
    order = F.when(form == "psm", F.array(parts[1], parts[3], parts[2])).when(form == "spm", F.array(parts[2], parts[3], parts[1]))
    return F.when(form == "plain", output).otherwise(F.array_join(order, ""))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)`` of every row; see ``arranged`` for odd rows."""
    made = arranged(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256")
    )
