"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltgrain.llm.store import table

MODEL, BYTE_LEVEL = "piece_bpe_32k.model", "byte_bpe_50k.json"


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from voltgrain.llm.sentencepiece_codec import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(MODEL), ids=False)


def op4_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltgrain.llm.line_quality import clean_documents

    return clean_documents(table(spark, sf_dir, "documents"), cleaned=False)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltgrain.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).drop("source", "copies")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltgrain.llm.sharding import interleave

    return interleave(table(spark, sf_dir, "documents")).drop("source")


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltgrain.llm.simhash_pivots import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_factorisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltgrain.llm.factorisation import fit, score

    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def op1_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltgrain.llm.katz import score_documents

    return score_documents(table(spark, sf_dir, "documents"), order=3)


def op2_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltgrain.llm.metric_join import near_duplicates

    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op5_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltgrain.llm.html_style_tree import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltgrain.llm.warc_dictionary import archive

    return archive(table(spark, sf_dir, "pages")).drop("url")


def op11_fim_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltgrain.llm.fim_index import fill_in_middle, restored

    out = fill_in_middle(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256")
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest, F.sha2(restored(F.col("output"), F.col("form")).cast("binary"), 256).alias("restored_sha256"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from voltgrain.llm.token_alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(MODEL), groups=False)[0].drop("groups")


def op13_sanitise(spark: SparkSession, sf_dir: str) -> DataFrame:
    from voltgrain.llm.sanitise import sanitise

    return sanitise(table(spark, sf_dir, "documents"), sanitised=False).drop("sanitised")


#: The cuts, the forms and the digests in SQL; the text is put together from the parts that the sentinels delimit.
OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h FROM documents),
e AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, substring(t, 1, a) AS pre, substring(t, a + 1, b - a) AS mid, substring(t, b + 1) AS suf FROM f),
o AS (SELECT *, CASE form WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid WHEN 'spm' THEN '<S>' || suf || '<P>' || pre || '<M>' || mid ELSE t END AS output FROM g)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(output) AS output_sha256,
  sha256(CASE form
    WHEN 'psm' THEN substring(split_part(output, '<S>', 1), 4) || split_part(output, '<M>', 2) || split_part(split_part(output, '<S>', 2), '<M>', 1)
    WHEN 'spm' THEN split_part(split_part(output, '<P>', 2), '<M>', 1) || split_part(output, '<M>', 2) || substring(split_part(output, '<P>', 1), 4)
    ELSE output END) AS restored_sha256
FROM o
"""

QUERIES = {f.__name__: f for f in (op1_katz, op2_metric_join, op3_sentencepiece, op4_line_quality, op5_style_tree, op6_warc, op7_mixing, op8_sharding, op9_simhash, op10_factorisation, op11_fim_index, op12_alignment, op13_sanitise)}
ORACLES: dict[str, str] = {"op11_fim_index": OP11_SQL}
