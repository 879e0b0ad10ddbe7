from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..jaccard_forest import jaccard_join


def op8_jaccard_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("digest")


QUERIES = {"op8_jaccard_forest": op8_jaccard_forest}
SQL: dict[str, str] = {}
