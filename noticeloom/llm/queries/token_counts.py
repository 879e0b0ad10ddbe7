import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ..common import table
from ..token_counts import count_tokens


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    # this tokenizer cuts at white space and drops it: no token spans two words
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), by_word=True)


QUERIES = {"op4_token_counts": op4_token_counts}
SQL: dict[str, str] = {}
