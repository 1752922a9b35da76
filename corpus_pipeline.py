"""Corpus pipeline: documents to token shards in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept;
all but the last return the columns of documents.  run writes every stage's rows as a table of
the shared folder and reads them again for the next one.

In every stage null texts count as empty, rows may repeat, and columns of docs besides doc_id
and text pass through whatever their names: they travel as one struct that no operator looks
into.  An empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.llm import decontaminate, deobfuscate, mixing, queries, shingles, token_shards
from tessera.llm.shared import new_path

#: Token shares of the mix; as many tokens as leave the clean domain what it has.
MIX = {"clean": 0.95, "low": 0.05}


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, text, doc): what operators read, and the whole row as a struct."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("doc"))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that score 0.3 or more; if nothing usable is labelled, all score less and stay."""
    fitted = queries.fitted_toxicity(spark, sf_dir, docs)
    return deobfuscate.toxicity_scores(packed(docs), *fitted, out="score").where("score < 0.3").select("doc.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one text, that with the smallest doc_id, of every group linked at five-word similarity 0.8.

    Texts decide, not ids: texts under one id that nothing links all stay, equal rows of one id
    and text count as one.  Rows without an id stay.
    """
    return shingles.without_near_copies(packed(docs)).select("doc.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item within its edit budget; without items all stay."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats each document by its copies: once at least if it is clean, so often that the mix is met in expectation if not.

    If nothing is labelled every document stays once.
    """
    labels = queries.labels(spark, sf_dir).where("doc_id is not null and quality is not null")
    chosen = labels.groupBy("doc_id").agg(F.max(F.expr("case when quality = 0 then 'low' else 'clean' end")).alias("domain"))
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(queries.LABELLED_ROWS)
    model = mixing.fit_domains(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id"))
    mixed = mixing.mixed(packed(docs), model, MIX, total_of="clean", carry=["doc"], whole="clean")
    return mixed.where("copies > 0").select("doc", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy")).select("doc.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the token shards and returns, read back from them, doc_id, start, n_tokens and ids_crc32."""
    read = token_shards.tokenized(docs, queries.tokenizer_path("word_bpe_49k.json"), end_id=2)
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mix),
    ("token_output", token_output),
]

#: The classifiers, the restoring decoder and the tokenizer have no SQL; tests/llm/test_pipeline.py checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
