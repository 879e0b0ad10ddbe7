from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..pii import BASE, find_personal_data
from ..secrets import span_digest


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return span_digest(find_personal_data(table(spark, sf_dir, "documents")), BASE)


QUERIES = {"op2_pii": op2_pii}
SQL: dict[str, str] = {}
