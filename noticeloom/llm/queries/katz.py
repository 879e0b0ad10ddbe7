from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import fold, table
from ..katz import score, train


def op5_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 7) != 2))
    scored = score(docs, model)
    model.drop()
    return scored.select("doc_id", (fold("doc_id", 7) == 2).alias("held_out"), "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")


QUERIES = {"op5_katz": op5_katz}
SQL: dict[str, str] = {}
