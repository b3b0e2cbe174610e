"""The dealt operators as registered queries over the given tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.llm import findings, flatfile, langid, lexical, licenses, packing, passes, sentencepieces, sharding, simhash, spelling, topk, warc
from sluicework.llm.common import table
from sluicework.session import cut_lineage, scratch_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def vocabulary(name: str) -> str:
    """A file of the public tokenizers: below ``SLUICEWORK_TOKENIZERS``, or where their package is installed."""
    if folder := os.environ.get("SLUICEWORK_TOKENIZERS"):
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_length_buckets", sql=packing.oracle())
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's sequences with their bucket, batch and slot; a token is a word or the end sign."""
    docs = table(spark, folder, "documents").select("doc_id", packing.word_tokens().alias("n_tokens"))
    return packing.pack(docs, "n_tokens")


@query("op2_sentencepiece")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Every document encoded with its end id and decoded again, with a checksum of the source spans."""
    return sentencepieces.digests(table(spark, folder, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op3_language_id")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's language, by a network trained on labelled documents that are not held out."""
    docs = table(spark, folder, "documents")
    return langid.identify(docs, langid.train(docs)).select(F.col("id").alias("doc_id"), langid.in_held_out("id").alias("held_out"), "lang_pred", "score")


@query("op4_simhash_near_dedup")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's fingerprint and the smallest document reachable over links of two bits or fewer."""
    prints = cut_lineage(simhash.fingerprints(table(spark, folder, "documents")))
    return simhash.near_duplicates(prints).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@query("op5_flat_token_files")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place, size and checksum, read back from the flat files."""
    target = scratch_path(spark, "flat")
    dtype = flatfile.write(table(spark, folder, "documents"), vocabulary("word_bpe_49k.json"), 2, target)
    return flatfile.read(spark, target, dtype)


@query("op6_projection_passes")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector's number of links at a cosine of 0.9 and its component."""
    return passes.near_duplicates(table(spark, folder, "embeddings"))


@query("op7_exact_top_k", sql=topk.ORACLE)
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best rows for every hundredth vector."""
    return topk.search(table(spark, folder, "embeddings"))


@query("op8_secret_scan")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's secrets: what the patterns find, and what the network adds."""
    docs = table(spark, folder, "documents")
    found = findings.scan(docs, findings.train(docs))

    def listed(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def of(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "model")
    return found.select(
        F.col("id").alias("doc_id"), of("assign"), of("access"), of("hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


@query("op9_histogram_shards", sql="""WITH t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS step),
h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
y AS (SELECT doc_id, list_transform(range(len(h) // 2), lambda i: (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) * 16 + instr('0123456789ABCDEF', h[2 * i + 2]) - 1) AS bytes FROM h),
d AS (SELECT doc_id, CAST(len(bytes) + 8 AS BIGINT) AS size, CAST(xor(list_reduce(list_prepend(4294967295, bytes), lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32 FROM y, t),
b AS (SELECT *, sum(size) OVER (ORDER BY doc_id) - size AS before, sum(size) OVER () AS total FROM d),
s AS (SELECT doc_id, size, text_crc32, CAST(24 * before // total AS INTEGER) AS shard FROM b)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s""")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's place in 24 shards of near-equal bytes."""
    docs = sharding.map_sizes(table(spark, folder, "documents"))
    docs = docs.select("doc_id", "size", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32"))
    return sharding.shard_by_bytes(docs, 24).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query("op10_license_scan", sql=licenses.oracle())
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's licence notices."""
    return licenses.scan(table(spark, folder, "documents"))


@query("op11_spelling_variants", sql=spelling.ORACLE)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Every repeated word's near words, the form it varies and the root its forms lead to."""
    return spelling.variants(spelling.words(table(spark, folder, "documents")))


@query("op12_lexical_search", sql=lexical.ORACLE)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """Every benchmark item's ten best documents by integer impacts."""
    return lexical.search(table(spark, folder, "benchmark"), table(spark, folder, "documents"))


@query("op13_warc_archives", sql=warc.ORACLE)
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Every page's record, read back from the archives by way of their index."""
    target = scratch_path(spark, "warc")
    warc.write(table(spark, folder, "pages"), target)
    return warc.read(spark, target, warc.index(spark, target)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
