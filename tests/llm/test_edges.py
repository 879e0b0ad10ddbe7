"""Every operator and stage on nulls, empty and very long texts, ties, repeated rows, empty tables and
clashing columns."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from noticeloom.llm import byte_bpe, decontaminate, exact_dedup, jaccard_forest, katz, pii, quality, secrets, token_counts, toxicity

SCHEMA = "doc_id long, text string, lang string, digest string, _id string, _own int, row int, item int, word string"
BPE, WORDS = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("word_bpe_49k.json")


def _word(r):
    return "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))


R = random.Random(5)
LONG = " ".join(_word(R) for _ in range(30_000))
SAME = " ".join(_word(R) for _ in range(40))
ROWS = [
    (1, None, None), (2, "", "x"), (3, SAME, None), (4, SAME, "y"), (4, SAME, "y"), (None, SAME, None), (5, LONG, "z"), (6, LONG + " more", "z"), (7, "a", None),
    (8, "0" * 5000 + " " + "@" * 3000 + "a" * 4000, None), (9, " \n\t ", None), (10, "\U0001f600 ünï \u0000 <|endoftext|>", None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, g, "d", "i", 1, 2, 3, "w") for i, t, g in ROWS], SCHEMA)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def _labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def _bench(spark, rows=()):
    return spark.createDataFrame(list(rows), "item_id long, text string, word string")


def _operators(spark, d):
    labels, bench = _labels(spark, [(3, 1, 0), (6, 0, 1), (None, 1, 1), (8, None, None)]), _bench(spark, [(1, SAME, "w"), (2, None, None), (3, "", None), (None, "ünï", None), (4, SAME, None)])
    return {
        "quality": lambda: quality.score_quality(d, quality.train(d, labels)), "pii": lambda: pii.find_personal_data(d), "secrets": lambda: secrets.scan_secrets(d),
        "tokens": lambda: token_counts.count_tokens(d, WORDS, by_word=True), "katz": lambda: katz.score(d, katz.train(d)), "exact": lambda: exact_dedup.deduplicate(d),
        "bpe": lambda: byte_bpe.round_trip(d, BPE, public_tokenizers.PATTERN), "join": lambda: jaccard_forest.jaccard_join(d), "decontaminate": lambda: decontaminate.contamination(d, bench),
        "toxicity": lambda: toxicity.score_toxicity(d, toxicity.train(d, labels)),
    }


NAMES = ["quality", "pii", "secrets", "tokens", "katz", "exact", "bpe", "join", "decontaminate", "toxicity"]


@pytest.mark.parametrize("name", NAMES)
def test_one_row_for_each_document(spark, docs, none, name):
    got = sorted(("" if r["doc_id"] is None else str(r["doc_id"])) for r in _operators(spark, docs)[name]().collect())
    assert got == sorted("" if i is None else str(i) for i, _, _ in ROWS)
    assert _operators(spark, none)[name]().count() == 0


def test_no_local_folder_on_a_cluster():
    from types import SimpleNamespace

    from noticeloom.llm import common

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: default), sparkContext=SimpleNamespace(master="spark://head:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(session)


def test_long_batches_are_cut_by_bytes():
    import pyarrow as pa

    from noticeloom.llm import common

    batch = pa.RecordBatch.from_pydict({"text": ["x" * 1_000_000] * 20 + [None, ""]})
    parts = list(common.slices(batch))
    assert len(parts) > 3 and sum(p.num_rows for p in parts) == 22 and list(common.slices(batch.slice(0, 0))) == []


def test_joins_with_a_hot_key(spark):
    from noticeloom.llm.common import join_skewed

    rows = spark.range(3000).selectExpr("id", "if(id % 3 = 0, -1, id) AS k")
    out = join_skewed(rows, rows.groupBy("k").count(), "k", "count")
    assert out.count() == 3000 and out.where("k = -1").agg({"count": "max"}).first()[0] == 1000


def test_locators_name_file_and_row(spark, data):
    rows = exact_dedup.deduplicate(spark.read.parquet(f"{data}/documents.parquet")).select("locator").collect()
    assert len({r["locator"] for r in rows}) == len(rows) and all(".parquet#" in r["locator"] for r in rows)


def test_token_counts_of_a_tokenizer_that_keeps_blanks(spark, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(WORDS)
    got = {(r["doc_id"], r["n_bytes"]): r["n_tokens"] for r in token_counts.count_tokens(docs, WORDS).collect()}
    assert got == {(i, len((t or "").encode())): len(tokenizer.encode(t or "", add_special_tokens=False).ids) for i, t, _ in ROWS}
    assert token_counts.tokenizer_version(WORDS, True) != token_counts.tokenizer_version(WORDS, False)


def test_exact_ties(docs):
    rows = exact_dedup.deduplicate(docs).collect()
    same = [r for r in rows if r["group_size"] == 4]
    assert len(same) == 4 and {r["keep_id"] for r in same} == {4} and sum(r["kept"] for r in same) == 1
    empty = [r for r in rows if r["doc_id"] in (1, 2)]
    assert {r["keep_id"] for r in empty} == {2} and [r["kept"] for r in sorted(empty, key=lambda r: r["doc_id"])] == [False, True]


def test_exact_with_a_weak_digest(docs):
    weak = lambda text: F.substring(F.sha2(text.cast("binary"), 256), 1, 1)
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text_sha256"], r["kept"])
    plain = [r.asDict() for r in exact_dedup.deduplicate(docs).drop("locator").collect()]
    clashing = [r.asDict() for r in exact_dedup.deduplicate(docs, weak).drop("locator").collect()]
    assert sorted(plain, key=key) == sorted(clashing, key=key)


def test_exact_stream_goes_on_from_its_state(spark, tmp_path):
    folder = f"file://{tmp_path}/work"
    kind = "row long, doc_id long, digest string, text_sha256 string, locator string"
    make = lambda ids: spark.createDataFrame([(i, i, f"d{i % 3}", "", "") for i in ids], kind).write.mode("append").parquet(f"{folder}/feed")
    make(range(4))
    first = exact_dedup.stream_state(spark, f"{folder}/feed", spark.read.parquet(f"{folder}/feed").schema, folder)
    assert {(r["digest"], r["last_id"], r["group_size"]) for r in first.collect()} == {("d0", 3, 2), ("d1", 1, 1), ("d2", 2, 1)}
    make(range(4, 8))
    again = exact_dedup.stream_state(spark, f"{folder}/feed", spark.read.parquet(f"{folder}/feed").schema, folder)
    assert {(r["digest"], r["last_id"], r["group_size"]) for r in again.collect()} == {("d0", 6, 3), ("d1", 7, 3), ("d2", 5, 2)}


def test_stages_keep_columns_and_clean_rows(spark, docs, none):
    bench = _bench(spark, [(1, "b c d", None)])
    model = quality.fit([], [])
    for stage in (exact_dedup.keep_one, jaccard_forest.keep_one, lambda d: decontaminate.remove_contaminated(d, bench), lambda d: quality.keep_good(d, model, 0.3)):
        out = stage(docs)
        assert out.columns == docs.columns and {7, 10} <= {r["doc_id"] for r in out.collect()}
        assert stage(none).count() == 0
    kept = [r["doc_id"] for r in exact_dedup.keep_one(docs).collect()]
    assert sorted(kept) == [2, 4, 5, 6, 7, 8, 9, 10]
    assert sorted(r["doc_id"] or 0 for r in jaccard_forest.keep_one(docs).collect()) == [1, 2, 3, 5, 7, 8, 9, 10]


def test_token_cache_encodes_only_misses(spark, docs, tmp_path):
    cache = f"file://{tmp_path}/cache"
    first = token_counts.count_tokens(docs, WORDS, cache, by_word=True).collect()
    stored = spark.read.parquet(cache).count()
    assert stored == len({" ".join((t or "").split(" ")) for _, t, _ in ROWS})
    more = docs.unionByName(docs.limit(1).withColumn("text", F.lit("something else")))
    again = token_counts.count_tokens(more, WORDS, cache, by_word=True).collect()
    assert spark.read.parquet(cache).count() == stored + 1
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_tokens"])
    assert sorted(map(tuple, first), key=str) == sorted([tuple(r) for r in again if r["n_bytes"] != 14], key=str) and key


def test_secret_scan_takes_linear_time():
    """Long runs, slugs and words with a digit: none takes over a second."""
    import re
    import time

    r = random.Random(2)
    texts = ["a" * 10_000 + "1", "ab" * 5_000 + "7", "ab" + "-c1" * 8_000 + "=", "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(20_000)), "Abc" * 10_000 + "9",
             "ABCab" * 4_000 + "9", "EXAMPLE" * 20_000 + "1", "0123456789" * 5_000, "a_" * 50_000 + "1", "ACDEFGHIKLMNPQRSTVWY" * 1_000 + "7", "password=" * 5_000]
    for text in texts:
        began = time.perf_counter()
        secrets.all_spans(text)
        assert time.perf_counter() - began < 1, text[:40]
    # the possessive rule clears what the plain one does
    plain = re.compile(r"([A-Z]?[a-z]{2,}|[A-Z]{3,}|[_/+=-])*$")
    for _ in range(20_000):
        text = "".join(r.choice("abABC_1") for _ in range(r.randint(0, 10)))
        assert bool(plain.match(text)) == bool(secrets.ALLOW[1].match(text))


def test_runs_hide_no_key():
    """A run is cut out, and what else a candidate holds is scanned."""
    keys = ["Q7rT9xK2vB8nM4Zw3K", "9dk27fpq01zmx84hvt6wbn3s"]
    for key in keys:
        for text in (key, "0123456789abcdef" + key, "abcdefghijklmnop/" + key, key + "+0123456789", "http-" + key):
            assert [s[2] for s in secrets.all_spans(f"see {text} there")[1]], text
    for text in ("abcdefghijklmnopqrstuvwxyz0123456789", "0123456789abcdefghijklmnop"):
        assert secrets.entropy_kind(text) is None
