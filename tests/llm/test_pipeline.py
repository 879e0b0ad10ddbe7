"""The whole pipeline against brute force on a small fixture."""

import hashlib
import random
import re

import public_tokenizers
import pytest

import corpus_pipeline
from noticeloom.llm import byte_bpe, quality
from noticeloom.llm.queries.quality import LEAST


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefghij", k=r.randint(2, 7)))
    passage = [word() for _ in range(20)]
    texts = [" ".join(word() for _ in range(r.randint(60, 120))) + "." for _ in range(40)]
    texts += [texts[0]] * 3 + [texts[1]] * 2  # exact copies
    texts += [re.sub(r"^(\S+ ){2}", "other words ", texts[k]) for k in (1, 2, 3)] + [texts[2] + " end"]  # near copies
    texts += [" ".join(passage[:15]) + " " + " ".join(word() for _ in range(n)) for n in (20, 60, 400)]  # over and under a twentieth
    texts += ["!!! ### $$$ " * 30 + str(k) for k in range(20)] + ["", None]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    where = f"file://{tmp_path_factory.mktemp('pipeline')}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame([(1, " ".join(passage)), (2, None)], "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    spark.createDataFrame([(i, int(not (t or "!").startswith("!")), 0) for i, t, *_ in rows if t], "doc_id long, quality int, toxic int").write.parquet(f"{where}/labels.parquet")
    return where


def _shingles(text):
    w = re.findall(r"\w+", (text or "").lower())
    return {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()


def test_pipeline_by_brute_force(spark, folder):
    import tiktoken

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    rows = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    good = {i: t for i, t in rows.items() if model.probability(quality.featurise(t, quality.Codes())) >= LEAST}
    assert 40 < len(good) < len(rows)
    once = {t: i for i, t in sorted(good.items())}  # of equal texts the largest id stays
    kept = {i: t for t, i in once.items()}
    root = {i: i for i in kept}

    def find(i):
        return i if root[i] == i else find(root[i])

    sets = {i: _shingles(t) for i, t in kept.items()}
    for a in sorted(kept):
        for b in sorted(kept):
            both = len(sets[a] & sets[b])
            if a < b and both and 5 * both >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    kept = {i: t for i, t in kept.items() if find(i) == i}
    item = re.findall(r"[a-z0-9]+", spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first()["text"])
    windows = {tuple(item[j:j + 13]) for j in range(len(item) - 12)}
    clean = {}
    for i, t in kept.items():
        w = re.findall(r"[a-z0-9]+", t.lower())
        hit = {p for j in range(len(w) - 12) if tuple(w[j:j + 13]) in windows for p in range(j, j + 13)}
        if not (hit and 20 * len(hit) >= len(w)):
            clean[i] = t
    assert len(good) > len(once) > len(kept) > len(clean)
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = {i: hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in own.encode_ordinary(t))).hexdigest() for i, t in clean.items()}
    got = corpus_pipeline.run(spark, folder)
    assert {r["doc_id"]: r["ids_sha256"] for r in got.collect()} == want


def test_stages_return_the_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name
