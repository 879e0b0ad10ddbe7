import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..byte_bpe import round_trip
from ..common import table

VOCABULARY = "byte_bpe_50k.tiktoken"


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


QUERIES = {"op7_byte_bpe": op7_byte_bpe}
SQL: dict[str, str] = {}
