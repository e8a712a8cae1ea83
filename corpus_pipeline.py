"""From documents to token ids in five stages, each written as Parquet and reread as the next one's documents.

1. quality: documents that the classifier scores under 0.5 go.
2. near_duplicates: of each group of rows linked by a Jaccard similarity of at least 0.8 on word 5-grams, the one of least
   id stays (of several rows of that id, one). Rows of one id with different texts are judged apart; rows without an id stay.
3. decontamination: documents that hold a benchmark item go.
4. secrets: secrets in texts are replaced by ``[SECRET:<kind>]``, and n_chars follows the text.
5. bpe: the texts as token ids.

Odd input, stage by stage. Null or empty texts: scored like any other, no copies of one another, hold no item and no
secret, and have no ids. Null ids: judged like others, but never as copies. Very long texts are read whole everywhere. Ties:
a score of exactly 0.5 stays; of copies of one least id one row stays. Repeated rows are scored alike, and one of them stays.
Empty tables give empty tables; without labels every score is 0.5, and without items every document stays. Other columns are
kept through the first four stages, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, common, decontaminate, exchange, ngram_join, quality, queries, secrets
from cohortlens.storage import erase, ship, stored, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.fitted(docs, queries.table(spark, sf_dir, "labels"))
    score = common.free_name(docs, "score")
    return quality.scored(docs, model, name=score).where(F.col(score) >= 0.5).drop(score)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    rows = written(ngram_join.linked_rows(docs, words=5, percent=80), "rows")
    several = rows.groupBy("component").agg(F.min(F.struct("dk", "rk")).alias("first"), F.max(F.struct("dk", "rk")).alias("last")).where("first <> last")
    copies = rows.join(several, "component").where("dk <> first.dk or rk <> first.rk").select("dk", "rk").distinct()
    repeated = rows.groupBy("dk", "rk").count().where("count > 1").select("dk", "rk")
    names = exchange.row_name(docs, "doc_id", "text")
    given = docs.select(F.struct("*").alias("doc"), *(c.alias(k) for k, c in names.items()))
    single = given.join(copies.unionByName(repeated).distinct(), ["dk", "rk"], "left_anti")
    again = given.join(repeated, ["dk", "rk"], "left_semi").join(copies, ["dk", "rk"], "left_anti").dropDuplicates(["dk", "rk"])
    return single.unionByName(again).select("doc.*")


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, queries.table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    out = secrets.redacted(docs, secrets.trained())
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return bpe.encode_documents(docs, queries.vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_each),
    ("decontamination", keep_uncontaminated),
    ("secrets", redact_secrets),
    ("bpe", encode),
]

#: A trained classifier and a forest have no SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = queries.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        before = path
        docs, path = stored(stage(spark, docs, sf_dir), name)
        if before:
            erase(spark, before)
    return docs
