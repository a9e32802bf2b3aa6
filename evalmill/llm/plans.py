"""Registered queries of the operators in this folder, each over its whole table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalmill.llm import oracles
from evalmill.llm.bpe import round_trip
from evalmill.llm.licenses import scan_licenses
from evalmill.llm.neardup import near_duplicates
from evalmill.llm.packing import pack_documents
from evalmill.llm.pages import extract_pages
from evalmill.llm.periods import periodic_runs
from evalmill.llm.quality import quality_rules
from evalmill.llm.scoring import score_documents
from evalmill.llm.secrets import scan_secrets, written
from evalmill.llm.sharding import shard_documents
from evalmill.llm.suffixes import drop_repeats
from evalmill.llm.texts import words_of
from evalmill.llm.topk import top_k
from evalmill.llm.whitening import whiten

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = oracles.ORACLES


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query
def op1_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of all documents under the hidden Markov model and under unigrams."""
    return score_documents(table(spark, sf_dir, "documents"))


@query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded texts of all documents, as digests."""
    out = round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op3_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 2048 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op4_bayes_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query
def op5_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards; law bytes, equal texts together."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    return shard_documents(docs, 16).select(
        "doc_id",
        F.col("_size").alias("size"),
        "text_crc32",
        F.lit("bytes").alias("law"),
        F.col("_shard").cast("int").alias("shard"),
        F.col("_slot").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op6_license_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licenses of every document with their best Dice coefficient."""
    hits = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return hits.select(
        "doc_id",
        F.size("license_hits").cast("bigint").alias("n_licenses"),
        F.array_join(F.transform("license_hits", lambda h: h["license"]), ",").alias("licenses"),
        F.round(F.array_max(F.transform("license_hits", lambda h: h["dice"])), 6).alias("best_dice"),
    )


@query
def op7_entropy_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secret spans of every document."""
    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")
    count = lambda kind: F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter(spans, lambda s: s["kind"].isin("assign", "access", "hex"))
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(base).cast("binary"), 256).alias("base_sha256"), written(spans).alias("spans")
    )


@query
def op8_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 rows with the highest integer inner product for every query row."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 20 == 0), 20)


@query
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    judged = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_features=False)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query
def op10_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; texts with crc32(doc_id) % 10 = 0 become their words, repeated from a place on."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(ws):
        n = F.size(ws).cast("bigint")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        return F.transform(ws, lambda w, i: F.when(i < a, w).otherwise(ws[(a + (i - a) % p).cast("int")]))

    # the words are bound as a lambda variable; as a column in a lambda's body they would be split again for every word
    words = F.transform(F.array(words_of(F.col("text"))), repeated)[0]
    return docs.select("doc_id", F.when(h % 10 == 0, F.array_join(words, " ")).otherwise(F.col("text")).alias("text"))


@query
def op11_sync_set_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of repeated words in every document and its text without the repeats, as digests."""
    found = periodic_runs(with_repeats(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    listed = F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("")
    return found.withColumn("best", best).select(
        F.col("row.doc_id").alias("doc_id"),
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


@query
def op12_cover_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the bytes under 400-byte strings that stand elsewhere too, as digests."""
    out = drop_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op13_jacobi_davidson_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's share in the eight components of largest variance, scaled to unit variance."""
    out = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 8)
    pairs = out.select("vec_id", "n", "deviation", F.posexplode(F.arrays_zip("whitened", "explained")).alias("place", "pair"), "identity_error")
    return pairs.select("vec_id", (F.col("place") + 1).cast("int").alias("component"), "n", "deviation", "pair.whitened", "pair.explained", "identity_error")
