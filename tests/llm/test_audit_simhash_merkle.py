"""The filter audit, SimHash with covering masks, and the Merkle manifest, against plain Python; odd rows by their values."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
import xxhash
from pyspark.sql import functions as F

from noticeloom.llm import filter_audit, merkle, simhash
from noticeloom.llm.queries import simhash as simhash_query

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, tree string, word int, digest int"
R = random.Random(8)
LONG = " ".join("".join(R.choice("abcdefgh") for _ in range(R.randint(2, 6))) for _ in range(250_000))
ROWS = [
    (1, None, None, None, None), (2, "", "", "", 0), (3, " \n\t ", "de", "s", 4), (4, "one\ntwo", "de", "s", 7), (4, "one\ntwo", "de", "s", 7), (5, "one\ntwo", "de", None, 7),
    (None, "one\ntwo", "de", "s", 7), (6, LONG, "en", "s", len(LONG)), (7, LONG + " more", "en", "t", 1), (8, "ÄÖ HELLO é & Co", "en", "\U0001f600", 3), (9, "Hello\nthere\n", "en", "ü", 3),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "f", "t", 1, 2) for r in ROWS], SCHEMA)


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def _audit(rows, labels):
    """By running every order over the rows."""
    first = {}
    for i, text, *_ in rows:
        if i is not None:
            first[text or ""] = min(first.get(text or "", i), i)
    docs = []
    for i, text, lang, *_ in rows:
        t = text or ""
        w = _words(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and first[t] < i}
        docs.append((lang or "", fails, *labels.get(i, (0, 0))))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        for order in map("".join, itertools.permutations("ABCDE")):
            left = [d for d in docs if d[0] == part]
            for k, f in enumerate(order, 1):
                gone = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                own = [d for d in docs if d[0] == part and d[1][f]]
                out[part, order, k] = [len(left), len(gone), len(own) - len(gone), sum(sum(d[1].values()) == 1 for d in own), sum(d[2] == 1 for d in gone), sum(d[3] == 1 for d in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _audited(docs, labels):
    found = filter_audit.audit(filter_audit.with_labels(filter_audit.failure_flags(docs), labels))
    names = "kept removed redundant unique_fails good_lost toxic_lost shapley".split()
    rows = found.collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in names) for r in rows}
    assert len(got) == len(rows) and all(r["filter"] == r["filter_order"][r["step"] - 1] for r in rows)
    return got


def test_audit_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, None), (5, 1, 1), (7, None, 1), (99, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = _audited(docs, labels)
    assert got == _audit(ROWS, {4: (1, 0), 5: (1, 1), 7: (0, 1)})
    assert {p for p, _, _ in got} == {"", "de", "en"} and len(got) == 3 * 600
    assert _audited(docs.limit(0), labels) == {} and len(_audited(docs, labels.limit(0))) == 3 * 600


def test_audit_of_the_tables(spark, data):
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    assert _audited(docs, labels) == _audit(rows, {r["doc_id"]: (r["quality"], r["toxic"]) for r in labels.collect()})


def _fingerprint(text):
    words = _words("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def _reached(prints, radius):
    """The least index that each fingerprint reaches, by search."""
    out = {}
    for i in range(len(prints)):
        if i not in out:
            todo = [i]
            while todo:
                j = todo.pop()
                if j not in out:
                    out[j] = i
                    todo += [k for k in range(len(prints)) if k not in out and (prints[j] ^ prints[k]).bit_count() <= radius]
    return out


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_masks_cover_the_radius(radius):
    found = simhash.masks(radius)
    assert len(found) == 2 ** (radius + 1) - 1
    for bits in itertools.combinations(range(64), radius):
        assert any(all(not m >> b & 1 for b in bits) for m in found)


def test_fingerprints_match_spark_and_python(spark, docs, monkeypatch):
    want = {(i, t): f"{_fingerprint(t or ''):016x}" for i, t, *_ in ROWS}
    got = {(r["doc_id"], r["text"]): f"{r['fp'] & (2**64 - 1):016x}" for r in simhash.fingerprints(docs).join(docs.select("doc_id", "text"), "doc_id").collect()}
    assert got == {k: v for k, v in want.items() if k[0] is not None}
    monkeypatch.setattr(simhash, "BLOCK", 50)  # shingles across blocks
    for text in (LONG[:3000], "a\x0bb\x1cc  d " * 30, "x" * 400, "one two", "AÄ b c"):
        assert simhash.fingerprint(text) & (2**64 - 1) == _fingerprint(text)
    assert spark.sql("SELECT xxhash64('a b c')").first()[0] & (2**64 - 1) == _fingerprint("A b\nc")


def test_near_duplicates_of_odd_rows(docs):
    got = sorted((str(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    prints = [_fingerprint(t or "") for _, t, *_ in ROWS]
    roots = _reached(prints, 2)
    least = {}
    for k, (i, *_) in enumerate(ROWS):
        if i is not None:
            least[roots[k]] = min(least.get(roots[k], i), i)
    assert got == sorted((str(i), f"{prints[k]:016x}", least[roots[k]]) for k, (i, *_) in enumerate(ROWS))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("radius,paired", [(2, 64), (2, 1), (1, 64), (1, 1), (2, 5)])
def test_links_connect_all_within_the_radius(spark, radius, paired):
    r = random.Random(radius * 100 + paired)
    prints = {r.getrandbits(64) for _ in range(60)}
    for start in list(prints)[:6]:  # chains and dense clusters
        for _ in range(25):
            for b in r.sample(range(64), r.randint(1, 3)):
                start ^= 1 << b
            prints.add(start)
    dense = r.getrandbits(64)
    prints |= {dense ^ 1 << a ^ 1 << b for a in range(8) for b in range(8)}
    prints = sorted(prints)
    signed = lambda p: p - 2**64 if p >> 63 else p
    rows = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long"), radius, paired).collect()
    assert all(1 <= ((a ^ b) & (2**64 - 1)).bit_count() <= radius for a, b in rows)
    place = {signed(p): k for k, p in enumerate(prints)}
    heads = list(range(len(prints)))

    def head(k):
        while heads[k] != k:
            k = heads[k]
        return k

    for a, b in rows:
        x, y = sorted((head(place[a]), head(place[b])))
        heads[y] = x
    assert {k: head(k) for k in range(len(prints))} == _reached(prints, radius)


def test_near_duplicates_of_the_tables(spark, data):
    got = {r["doc_id"]: r for r in simhash_query.op12_simhash(spark, data).collect()}
    rows = sorted((r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect())
    prints = [_fingerprint(t) for _, t in rows]
    roots = _reached(prints, 2)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[k]:016x}", rows[roots[k]][0]) for k, (i, _) in enumerate(rows)}


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _tree(leaves):
    """(root, the run and place of each leaf at each level)."""
    paths, now, at = [[] for _ in leaves], leaves, list(range(len(leaves)))
    while len(now) > 1:
        for k, path in enumerate(paths):
            path.append((now[at[k] // 3 * 3:at[k] // 3 * 3 + 3], at[k] % 3))
            at[k] //= 3
        now = [_h(*now[i:i + 3]) for i in range(0, len(now), 3)]
    return now[0], paths


def _manifest(rows):
    leaf = lambda i, t, g, s, n: _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, s, g, n, t)))
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        own = sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = own, *_tree([leaf(*r) for r in own])
    root, tops = _tree([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, tops):
        own, subroot, paths = trees[s]
        for r, path in zip(own, paths):
            even = zlib.crc32(str(r[0] if r[0] is not None else "").encode()) % 2 == 0
            now = leaf(r[0], r[1].replace("\n", "") if even and r[1] is not None else r[1], *r[2:])
            siblings = ""
            for run, place in path + top:
                siblings += "".join(run[:place] + run[place + 1:])
                now = _h(*run[:place], now, *run[place + 1:])
            out.append((str(r[0]), leaf(*r), subroot, root, _h(siblings), now, now == root))
    return sorted(out)


def _verified(docs):
    return sorted((str(r["doc_id"]), r["leaf"], r["subroot"], r["root"], r["proof_sha256"], r["folded_root"], r["verified"]) for r in merkle.verify(docs).collect())


def test_manifest_of_odd_rows(docs):
    assert _verified(docs) == _manifest(ROWS)
    assert merkle.verify(docs.limit(0)).count() == 0
    one = docs.where("doc_id = 9")
    assert _verified(one) == _manifest([r for r in ROWS if r[0] == 9])


@pytest.mark.parametrize("size", [1, 2, 3, 4, 9, 10, 28])
def test_manifest_of_one_source(spark, size):
    rows = [(i, f"text\n{i}", "en", "s", i) for i in range(size)]
    got = _verified(spark.createDataFrame([(*r, "f", "t", 1, 2) for r in rows], SCHEMA))
    assert got == _manifest(rows) and all(r[6] == (zlib.crc32(r[0].encode()) % 2 == 1) for r in got)


def test_manifest_of_many_sources(spark):
    r = random.Random(3)
    rows = [(i, "a\nb" if i % 3 else None, None, r.choice([None, "", *"äbcDE", "f" * 40, "src10", "src9"]), i) for i in range(150)]
    assert _verified(spark.createDataFrame([(*x, "f", "t", 1, 2) for x in rows], SCHEMA).repartition(7)) == _manifest(rows)


def test_a_source_is_numbered_over_many_tasks(spark):
    nodes = spark.range(5000).select(F.when(F.col("id") % 10 < 7, "a").otherwise("b").alias("tree"), (F.col("id") * 7919 % 5003).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = merkle.numbered(nodes, ["v"]).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for tree in "ab":
        own = sorted((r["v"], r["index"], r["n"]) for r in rows if r["tree"] == tree)
        assert [(i, n) for _, i, n in own] == [(i, len(own)) for i in range(len(own))]
