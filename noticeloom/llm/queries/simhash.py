from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..simhash import near_duplicates


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op12_simhash": op12_simhash}
SQL: dict[str, str] = {}  # XXH64 isn't in SQL
