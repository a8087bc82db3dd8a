"""Registered queries of the corpus operators, over whole tables with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesmill.llm import bpe, exact_dedup, lattice_lm, licence, packing, permutation_index, simhash, token_files, toxicity, warc
from seriesmill.llm.common import shared_path, table


def op1_licence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families named by the paragraphs of every text."""
    docs = table(spark, sf_dir, "documents")
    found = licence.scan(docs, licence.train(docs))
    names = F.array_sort(F.array_distinct("findings.family"))
    sure = F.array_sort(F.array_distinct(F.filter("findings", lambda x: x.confirmed).family))
    return found.select("doc_id", "n_paragraphs", F.size("findings").cast("long").alias("n_findings"), F.concat_ws(",", names).alias("families"), F.concat_ws(",", sure).alias("confirmed_families"), F.array_min("findings.probability").alias("least_probability"))


def op2_lattice_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text probabilities under the subword lattice and the add-one word model."""
    return lattice_lm.score(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of ``documents`` at 4 or fewer differing bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4, width=4)
    return found.select("doc_id", simhash.hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact copies in ``documents``: half of the rows, by hash of the id, are the snapshot, the rest the batch."""
    docs = table(spark, sf_dir, "documents")
    found = exact_dedup.exact_dedup(docs, F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected severity of every text."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded with the byte-level vocabulary and decoded again."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    ids = F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256)
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every twentieth id."""
    return permutation_index.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document in bins of 8,192 bytes, no two of a source or a duplicate cluster in one."""
    return packing.pack(table(spark, sf_dir, "documents"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, written to ORC in document order and read back."""
    path = shared_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), path, end_id=2)
    return token_files.with_crc32(token_files.read_tokens(spark, path))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to WARC archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_licence": op1_licence,
    "op2_lattice_lm": op2_lattice_lm,
    "op3_simhash": op3_simhash,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_bpe": op6_bpe,
    "op7_permutation_index": op7_permutation_index,
    "op8_packing": op8_packing,
    "op9_token_files": op9_token_files,
    "op10_warc": op10_warc,
}

SQL = {
    "op4_exact_dedup": """
        WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS text_sha256, coalesce(text, '') AS body FROM documents),
             g AS (SELECT body, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY body)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256
        FROM d JOIN g USING (body)
    """,
    "op10_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
             g AS (SELECT body, min(page_id) AS first FROM p WHERE octet_length(body) >= 100 GROUP BY body)
        SELECT p.page_id, octet_length(p.body)::BIGINT AS payload_bytes, sha256(p.body) AS payload_digest,
               CASE WHEN g.first IS DISTINCT FROM p.page_id AND g.body IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN g.first IS DISTINCT FROM p.page_id THEN g.first END AS refers_to
        FROM p LEFT JOIN g USING (body)
    """,
}
