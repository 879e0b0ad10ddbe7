from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..common import fold, table
from ..quality import score_quality, train

#: Documents with a score below this are rejected.
LEAST = 0.3


def op1_nbsvm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_quality(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), F.col("text_score").alias("score"), (F.col("text_score") >= LEAST).cast("int").alias("predicted"))


QUERIES = {"op1_nbsvm_quality": op1_nbsvm_quality}
SQL: dict[str, str] = {}
