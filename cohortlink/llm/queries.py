"""The registered queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ctw, langid, licenses, toxicity, wrappers
from .bpe import decode, encode, n_tokens
from .codes import compress
from .common import remainder, stored, table
from .exact import mark_copies, text_sha256
from .merkle import compare_with_next
from .minhash import near_components
from .search import search
from .mixture import mix
from .simhash import hexadecimal, mark_near_copies


VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    ids = docs.select("doc_id", encode(spark, VOCABULARY)(F.col("text")).alias("ids"))
    both = ids.withColumn("decoded", decode(spark, VOCABULARY)(F.col("ids")))
    return both.select("doc_id", n_tokens(F.col("ids")).alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def simhash_near(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return mark_near_copies(docs).select("doc_id", hexadecimal(F.col("print")).alias("fingerprint"), "component_id")


def toxic_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 5) == 0
    labels = table(spark, folder, "labels").where(~held_out)
    scored = toxicity.predict(docs, toxicity.learn(docs, labels))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = langid.learn(docs.where(~held_out))
    scored = langid.predict(docs.drop("lang"), model)
    return scored.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def page_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    texts = wrappers.extract(pages, stored(wrappers.infer(pages)))
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def language_model(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    held_out = remainder(F.col("doc_id"), 10) == 0
    model = ctw.learn(docs.where(~held_out).select("text"))
    return ctw.score(docs, model).select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes",
        ctw.bits_per_byte(F.col("score"), F.col("n_bytes")).alias("bits_per_byte"))


def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return compare_with_next(docs).select(
        "doc_id", "n_chars", F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"), "fingerprint",
        "edited_fingerprint", "near_edited", "near_next")


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    # The best match: of equal coverage, the longest, then the last by name.
    best = F.expr("array_max(transform(matches, m -> struct(m.coverage, m.end - m.begin AS letters, m.license)))")
    return licenses.find(docs).select("doc_id", F.size("matches").cast("long").alias("n_matches"), best["license"].alias("license"),
                                      best["coverage"].alias("coverage"), "matches")


def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", text_sha256(F.col("text")).alias("text_sha256"))
    return mark_copies(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def source_mix(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def minhash_near(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return near_components(docs)


def lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return search(docs, table(spark, folder, "benchmark").select("item_id", "text"))


def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    return compress(table(spark, folder, "embeddings").select("vec_id", "embedding", "label"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": bpe_round_trip,
    "op2_simhash_near": simhash_near,
    "op3_toxicity": toxic_documents,
    "op4_page_text": page_text,
    "op5_language_model": language_model,
    "op6_fingerprints": fingerprints,
    "op7_license_scan": license_scan,
    "op8_exact_dedup": exact_dedup,
    "op9_language": language,
    "op10_source_mix": source_mix,
    "op11_minhash_near": minhash_near,
    "op12_lexical_search": lexical_search,
    "op13_vector_codes": vector_codes,
}
