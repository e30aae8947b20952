"""From documents to packed training sequences: five stages, each one operator over all that the one before it kept.

toxicity drops the documents it predicts toxic; near duplicates keep one document of each group (five-word shingles,
similarity 0.8); personal data is replaced in the texts (n_chars follows); the mix repeats or leaves out whole
documents towards the sources' target weights; packing returns a row a piece of at most 2048 tokens. The first four
return the columns of documents, whatever their names.

Null and empty texts are clean and linked with nothing: they go through to the mix, where they have no words and are
taken as often as their source's plan says, and give a piece with the end id alone. Rows with a null doc_id are kept by
the first three stages. Of rows that share a doc_id near_dedup keeps one. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from noctua.llm.mixing import mix
from noctua.llm.near_dedup import near_duplicates
from noctua.llm.packing import pack_documents
from noctua.llm.pii import find_personal_data
from noctua.llm.shared import free_name, quoted, stored, tucked, untucked
from noctua.llm.tokens import tokenizer_file
from noctua.llm.toxicity import in_training, score_toxicity, train


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(in_training(F.col("doc_id")))
    score = F.col(free_name(docs, "toxicity"))
    return score_toxicity(docs, train(docs, labels)).filter(score < 0.7).select(*map(quoted, docs.columns))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = near_duplicates(docs, words=5, percent=80).filter("kept and doc_id is not null").select("doc_id").distinct()
    rows = tucked(docs, ["doc_id"])
    once = rows.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return untucked(once.unionByName(rows.filter("doc_id is null")), docs, ["doc_id"])


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    clean = F.col(free_name(docs, "sanitised"))
    new = {"text": clean} | ({"n_chars": F.length(clean).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return find_personal_data(docs).select(*[new[c].alias(c) if c in new else F.col(quoted(c)) for c in docs.columns])


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_file(), capacity=2048, end_id=0)


STAGES = [("toxicity", without_toxic), ("near_dedup", without_near_duplicates), ("pii", without_personal_data), ("mixing", mixed), ("packing", packed)]
#: No stage but the mix can be said in SQL: the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
