"""The operators of this subpackage bound to the provided tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprints, licenses, materialise, mixing, near_duplicates, packing, quality, sharding, topk, toxicity
from ._shared import table

Query = Callable[[SparkSession, str], DataFrame]


def vocabulary() -> str:
    """The vocabulary file of the public byte-level BPE that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posterior quality of every document, by its text, path (language) and host (source)."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_histogram_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    placed = sharding.histogram_shard(table(spark, sf_dir, "documents"), 8, keep=["doc_id"])
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences in every whole document."""
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.withColumn("spans", F.to_json("spans"))


def op4_lz_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase fingerprints of every whole document and of its edited text."""
    return fingerprints.fingerprint(table(spark, sf_dir, "documents"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every vector whose id is divisible by 20."""
    vectors = table(spark, sf_dir, "embeddings")
    return topk.exact_topk(vectors, F.col("vec_id") % 20 == 0, 20)


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates and the number of links of every document."""
    return near_duplicates.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every document."""
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary())


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that the mix takes of every document."""
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token sequence of all documents with its place in the training shards."""
    return materialise.materialise(table(spark, sf_dir, "documents"), vocabulary())


QUERIES: dict[str, Query] = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_histogram_shards": op2_histogram_shards,
    "op3_license_scan": op3_license_scan,
    "op4_lz_fingerprints": op4_lz_fingerprints,
    "op5_exact_topk": op5_exact_topk,
    "op6_ngram_jaccard_join": op6_ngram_jaccard_join,
    "op7_toxicity": op7_toxicity,
    "op8_pack_sequences": op8_pack_sequences,
    "op9_mix_sources": op9_mix_sources,
    "op10_training_order": op10_training_order,
}

ORACLE_SQL: dict[str, str] = {
    "op5_exact_topk": """
        WITH v AS (SELECT row_number() OVER () AS place, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
        scored AS (SELECT q.place, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.place <> c.place WHERE q.vec_id % 20 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY place ORDER BY score DESC, vec_id) AS rank FROM scored)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20""",
    "op9_mix_sources": r"""
        WITH docs AS (
            SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
                   -ln((('0x' || substr(md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null:' || coalesce(md5(text), ''))), 1, 12))::BIGINT::DOUBLE + 0.5::DOUBLE) / 281474976710656::DOUBLE) /
                   coalesce(greatest(0.1::DOUBLE, 1::DOUBLE - 4::DOUBLE * (length(text) - length(translate(text, '*%&$#|!{}<>=_~^\', ''))) / nullif(length(text), 0)), 1::DOUBLE) AS key
            FROM documents),
        per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM docs GROUP BY source),
        numbered AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS pos FROM per),
        weighed AS (SELECT *, pos % 3 + 1 AS weight, 3 * source_size AS most FROM numbered),
        levels AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
                   / (sum(weight) OVER (ORDER BY most::DOUBLE / weight, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS own FROM weighed),
        level AS (SELECT arg_min(own, (most::DOUBLE / weight, pos)) AS level FROM levels WHERE own * weight <= most),
        targets AS (SELECT source, source_size, least(most::DOUBLE, coalesce(weight * level, 0)) AS target FROM levels, level),
        placed AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs,
                   coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
                   FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
        SELECT doc_id, size, source_size, target,
               CAST(epochs * size + greatest(0, least(size, round(target)::BIGINT - epochs * source_size - start)) AS BIGINT) AS taken FROM placed""",
}
