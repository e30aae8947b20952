"""One query an operator, over its whole table, and the SQL of those that DuckDB can express."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm.fill_middle import fill_middle, fill_middle_inverted
from noctua.llm.fingerprints import fingerprints, likeness
from noctua.llm.license_scan import scan_licenses
from noctua.llm.mixing import mix_sizes
from noctua.llm.near_dedup import near_duplicates
from noctua.llm.oracle import ORACLE
from noctua.llm.packing import pack_documents
from noctua.llm.pii import PATTERNS, find_personal_data
from noctua.llm.repeats import repeated_bytes
from noctua.llm.resampling import resample
from noctua.llm.shared import documents, passing, shared_dir
from noctua.llm.token_files import read_token_digests, write_token_files
from noctua.llm.tokens import tokenizer_file
from noctua.llm.toxicity import in_training, score_toxicity, train
from noctua.llm.topk import quantised, top_k
from noctua.llm.url_filter import judge_urls


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sizes(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir)).drop("kept")


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprints(documents(spark, sf_dir))
    near = [likeness(F.col("fingerprint"), F.col(f"{k}_fingerprint")).alias(f"near_{k}") for k in ("edited", "next")]
    return found.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", *near)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge_urls(pages).select("page_id", "host", "path", "rule", "verdict")


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), words=3, percent=85)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/noctua/token-files-{uuid.uuid4().hex}"
    write_token_files(documents(spark, sf_dir), path, tokenizer_file(), end_id=1)
    passing(spark, path)
    return read_token_digests(spark, path)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"), with_text=False)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*PATTERNS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, PATTERNS), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir), tokenizer_file(), capacity=2048, end_id=0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.filter(in_training(F.col("doc_id"))))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    held_out = F.coalesce(~in_training(F.col("doc_id")), F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op10_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return top_k(vectors, vectors.filter(F.col("vec_id") % 50 == 0), 5)


def op11_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle_inverted(fill_middle(documents(spark, sf_dir).select("doc_id", "text")).drop("text"))
    digests = [F.sha2(c, 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", F.col("units").alias("n"), "form", "prefix_chars", "middle_chars", *digests)


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(documents(spark, sf_dir), benchmark).select("doc_id", "n_features", "weight", "score", "rank")


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_bytes(documents(spark, sf_dir), length=200, keep_first=False)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


OPERATORS = [op1_mixing, op2_license_scan, op3_fingerprints, op4_url_filter, op5_near_dedup, op6_token_files, op7_pii, op8_packing, op9_toxicity, op10_topk_search, op11_fill_middle, op12_resampling, op13_repeats]
QUERIES = {f.__name__: f for f in OPERATORS}
__all__ = ["ORACLE", "QUERIES"]
