"""Registered queries of this subpackage: thin callers of the operators, with the columns their contracts fix."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import caps, decontaminate, gnat, hosts, language, manifest, minhash, packing, pii, polytope, repeats, toxicity, wavelet
from .blocks import usable
from .common import importable, shared_folder, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Callers choose their own secret; the registered query needs one that does not change.
PSEUDONYM_KEY = "registered query"


def query(name: str, sql: str | None = None):
    def keep(run):
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Place of a public tokenizer's file; the package lies beside the libraries on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_minhash_dedup")
def op1(spark, sf_dir):
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_best_fit_packing")
def op2(spark, sf_dir):
    return packing.packed(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), special=True)


@query("op3_wavelet_tokens")
def op3(spark, sf_dir):
    folder = f"{shared_folder(spark)}/wavelet-{uuid.uuid4().hex}"
    made = written(wavelet.write(table(spark, sf_dir, "documents"), folder, vocabulary("word_bpe_49k.json"), special=True), "shards")
    return wavelet.documents(spark, folder, made)


@query("op5_noisy_channel_toxicity")
def op5(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scorer = toxicity.learn(table(spark, sf_dir, "labels").where(~held), docs)
    told = toxicity.score(docs.withColumn("held_out", F.coalesce(held, F.lit(False))), scorer)
    return told.select("doc_id", "held_out", "score", "predicted")


@query("op6_feistel_pii")
def op6(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, key=PSEUDONYM_KEY, count="n_found")


@query("op7_consensus_html")
def op7(spark, sf_dir):
    return hosts.extract(table(spark, sf_dir, "pages"))


@query("op8_winnowing_decontamination", decontaminate.SQL)
def op8(spark, sf_dir):
    return decontaminate.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("items", "key")


@query("op4_anchor_substring_dedup", repeats.SQL)
def op4(spark, sf_dir):
    return repeats.without_repeats(table(spark, sf_dir, "documents"), keep_text=False)


@query("op9_spherical_caps", caps.SQL)
def op9(spark, sf_dir):
    return caps.links(table(spark, sf_dir, "embeddings"))


@query("op10_output_code_language")
def op10(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    codes = language.learn(docs.where(~held))
    told = language.identify(docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out")), codes)
    return told.select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


@query("op11_gnat_hard_negatives", gnat.SQL)
def op11(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    e = F.col("embedding").cast("array<double>")
    rows = rows.where(usable(e)).select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"),
        F.transform(e, lambda x: F.floor(x * 256)).alias("vector"))
    return gnat.hard_negatives(rows, rows.where("vec_id % 100 = 0").select("vec_id"))


@query("op12_merkle_manifest", manifest.SQL)
def op12(spark, sf_dir):
    third = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return manifest.manifest(table(spark, sf_dir, "documents"), found={"text": F.when(third, lower).otherwise(F.col("text"))})


@query("op13_cross_polytope_search")
def op13(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return polytope.nearest(rows, rows.where("vec_id % 50 = 0"))
