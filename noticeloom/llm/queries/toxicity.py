from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import fold, table
from ..toxicity import score_toxicity, train

#: Documents with at least this score count as toxic.
LEAST = 0.7


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), F.col("text_score").alias("score"), (F.col("text_score") >= LEAST).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
SQL: dict[str, str] = {}
