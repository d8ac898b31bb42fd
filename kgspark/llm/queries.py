"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kgspark.llm import bpe, embeddings, htmltext, langid, media, middle, mixing, pieces, quality, ranking, secrets, simhash, tokens
from kgspark.llm.common import table

VOCABULARY = "byte_bpe_50k.json"
PIECE_MODEL = "piece_bpe_32k.model"


def vocabulary(name: str = VOCABULARY) -> str:
    """A public vocabulary's place, the same on every machine of the cluster; the byte-level one unless another is named."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).drop("redacted")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"), vocabulary()).select("doc_id", "n_tokens")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_columns(table(spark, sf_dir, "documents")).drop("shard", "offset", "length")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary())


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op11_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.sale_line_places(table(spark, sf_dir, "sale_lines"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return middle.digests(table(spark, sf_dir, "documents"))


def op13_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(table(spark, sf_dir, "documents"), vocabulary(PIECE_MODEL))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (
        op1_secret_scans, op2_token_counts, op3_quality_classifier, op4_language_id, op5_simhash,
        op6_media_columns, op7_mixing, op8_bpe, op9_embedding_dedup, op10_html_extraction,
        op11_ranking, op12_fill_in_middle, op13_sentencepiece,
    )
    return {f.__name__: f for f in own}


#: Brute force over all pairs of rows, and reachability by recursion.
OP9 = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
  SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), reach AS (
  SELECT vec_id AS id, vec_id AS seen FROM embeddings
  UNION
  SELECT r.id, l.dst FROM reach r JOIN link l ON l.src = r.seen
), least AS (SELECT id, min(seen) AS component_id FROM reach GROUP BY id),
degree AS (SELECT src, count(*) AS n FROM link GROUP BY src)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.id = e.vec_id LEFT JOIN degree d ON d.src = e.vec_id
"""


#: CRC-32 bit by bit over the digits of a number, then windows over whole groups.
OP11 = """
WITH digits AS (
  SELECT DISTINCT sale_id, list_transform(string_split(sale_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS d FROM sale_lines WHERE sale_id IS NOT NULL
), sums AS (
  SELECT sale_id, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, d), lambda crc, b:
    list_reduce(list_prepend(xor(crc, b), list_transform(range(8), lambda i: 0::BIGINT)), lambda x, i: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384::BIGINT) ELSE x // 2 END))) AS crc
  FROM digits
), lines AS (
  SELECT coalesce(s.crc % 5 = 0, false) AS pooled, l.sale_id, l.line_no::BIGINT AS line_no, l.quantity::BIGINT AS quantity,
    floor(100 * l.discount + 0.5)::BIGINT AS percent, floor(100 * l.amount + 0.5)::BIGINT AS amount_cents, floor(l.quantity / 10)::BIGINT AS tens,
    CASE WHEN pooled THEN -1 ELSE l.vendor_id END AS vendor_id, CASE WHEN pooled THEN -1 ELSE coalesce(l.item_id % 2, -1) END AS part,
    CASE WHEN pooled THEN -1 ELSE coalesce(100 * year(l.shipped_at) + month(l.shipped_at), -1) END AS month
  FROM sale_lines l LEFT JOIN sums s ON s.sale_id = l.sale_id
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month
      ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos,
    dense_rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST) AS place,
    count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied
  FROM lines
)
SELECT vendor_id::BIGINT AS vendor_id, part::BIGINT AS part, month::BIGINT AS month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM ranked WHERE place <= 5
"""

#: Cuts by substrings of code points; the restored text is put together from the output's own parts.
OP12 = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), d AS (
  SELECT *, ('0x' || substr(h, 1, 8))::BIGINT % (n + 1) AS x, ('0x' || substr(h, 9, 8))::BIGINT % (n + 1) AS y,
    CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
         WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM t
), p AS (
  SELECT *, least(x, y) AS a, greatest(x, y) AS b, substr(text, 1, least(x, y)) AS prefix, substr(text, least(x, y) + 1, greatest(x, y) - least(x, y)) AS middle, substr(text, greatest(x, y) + 1) AS suffix FROM d
), o AS (
  SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END AS output FROM p
), r AS (
  SELECT *, CASE form WHEN 'plain' THEN output
    WHEN 'psm' THEN substr(output, 4, strpos(output, '<S>') - 4) || substr(output, strpos(output, '<M>') + 3) || substr(output, strpos(output, '<S>') + 3, strpos(output, '<M>') - strpos(output, '<S>') - 3)
    ELSE substr(output, strpos(output, '<P>') + 3, strpos(output, '<M>') - strpos(output, '<P>') - 3) || substr(output, strpos(output, '<M>') + 3) || substr(output, 4, strpos(output, '<P>') - 4) END AS restored
  FROM o
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256, sha256(restored) AS restored_sha256 FROM r
"""


def oracle_sql() -> dict[str, str]:
    return {"op9_embedding_dedup": OP9, "op11_ranking": OP11, "op12_fill_in_middle": OP12}
