from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..secrets import scan_secrets, span_digest


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(scan_secrets(table(spark, sf_dir, "documents")), ("assign", "access", "hex"))


QUERIES = {"op3_secrets": op3_secrets}
SQL: dict[str, str] = {}
