"""Importance resampling, suffix-array dedup and whitening against brute force; and the odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import DOC, ODD, clashing, prose, table
from weftline.llm import importance_resample, suffix_dedup, whiten

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOC)


# --- 11 ------------------------------------------------------------------------------------------------------------


def brute_features(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    runs = [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) % 10000 for r in runs]


def brute_resample(rows, target, percent=5, least=20):
    found = [(d, *brute_features(t)) for d, t in rows]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in brute_features(x)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000))))
    out = []
    for d, n, f in found:
        h = int(hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = {id(r): i + 1 for i, r in enumerate(able[: percent * len(able) // 100])}
    return Counter((*r[:4], drawn.get(id(r))) for r in out)


def rows_of(df):
    return Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect())


def test_resample_equals_brute_force_on_the_table(spark):
    docs, target = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = importance_resample.resample(docs, target)
    want = brute_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()])
    assert rows_of(got) == want
    assert dict(got.dtypes)["rank"] == "bigint"


def test_resample_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(importance_resample, "CHUNK_BYTES", 500)
    texts = [*ODD, "İ ß x1-y2 ZZ" * 9, "a" * 5000, prose(3000, 3), *[prose(25, i) for i in range(40)], prose(25, 1)]
    docs = clashing(table(spark, texts)).withColumn("doc_id", F.when(F.col("doc_id") != 12, F.col("doc_id"))).withColumn("bucket", F.lit("x")).withColumn("weight", F.lit(7))
    target = [None, prose(50, 2), "one two three"]
    got = importance_resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), percent=30)
    assert rows_of(got) == brute_resample([(r.doc_id, r.text) for r in docs.collect()], target, 30)


def test_resample_empty_tables(spark, none):
    target = spark.createDataFrame([], "text string")
    assert importance_resample.resample(none, target).collect() == []
    docs = table(spark, ["one two three four"] * 30)
    assert rows_of(importance_resample.resample(docs, target, 50, 3)) == brute_resample([(i, "one two three four") for i in range(30)], [], 50, 3)


# --- 12 ------------------------------------------------------------------------------------------------------------


def brute_repeats(texts, length=200):
    data = [(t or "").encode() for t in texts]
    count = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int64)
        for i in range(len(d) - length + 1):
            if count[d[i : i + length]] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        gone = np.cumsum(gone)[: len(d)] > 0
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(d) else 0
        kept = bytes(np.frombuffer(d, np.uint8)[~gone])
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def got_repeats(docs, **more):
    return [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.deduplicated(docs, **more).orderBy("doc_id").collect()]


def test_suffix_array_and_common_prefixes():
    r = random.Random(5)
    for data, depth in [(bytes(r.choice(b"ab") for _ in range(700)), 200), (b"abc" * 300, 200), (b"x" * 500, 200), (bytes(range(256)) * 3, 200), (b"q", 200), (bytes(r.choice(b"ab") for _ in range(90)), 13)]:
        d = np.frombuffer(data, np.uint8)
        order, rank = suffix_dedup.suffix_array(d, depth)
        padded = data + bytes(depth)
        key = lambda i: padded[i : i + depth]  # noqa: E731,B023
        assert [key(i) for i in order] == sorted(key(i) for i in range(len(data)))
        assert all((rank[i] == rank[j]) == (key(i) == key(j)) for i in range(0, len(data), 7) for j in range(0, len(data), 11))
        lanes = np.array(sorted({0, *r.sample(range(len(data)), min(5, len(data)))}))
        common = suffix_dedup.common_prefixes(d, order, rank, lanes, depth)
        for p in range(1, len(data)):
            a, b = data[order[p] :][:depth], data[order[p - 1] :][:depth]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert common[p] == n


def passages(seed=1):
    r = random.Random(seed)
    shared, copy, near = prose(60, 100), prose(150, 101), prose(300, 102).split(" ")
    texts = [*ODD, copy, copy, "é" * 150, "é" * 130 + "x", "a" * 900, "ab" * 333, "ab" * 101, shared * 3, prose(4000, 9) + shared]
    texts += [prose(r.randint(0, 40), i) + shared + prose(r.randint(0, 40), 50 + i) for i in range(25)]
    for i in range(25):
        words = list(near)
        for _ in range(4):
            words[r.randrange(len(words))] = f"w{i}"
        texts.append(" ".join(words))
    return texts


@pytest.mark.parametrize("limit", [4096, 3])
def test_repeats_equal_brute_force(spark, monkeypatch, limit):
    monkeypatch.setattr(suffix_dedup, "SAMPLE", 1)
    monkeypatch.setattr(suffix_dedup, "TOGETHER", 60)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    texts = passages()
    assert got_repeats(clashing(table(spark, texts)).repartition(5, "doc_id").withColumn("t", F.lit(1)).withColumn("lo", F.lit(1)), group_limit=limit) == brute_repeats(texts)


def test_repeats_of_parts_that_are_hashed_apart(monkeypatch):
    data = prose(900, 4).encode()
    whole = suffix_dedup.anchors(data, np.array([0, 1500]), np.array([1500, len(data)]))
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 333)
    assert all((a == b).all() for a, b in zip(whole, suffix_dedup.anchors(data, np.array([0, 1500]), np.array([1500, len(data)]))))


def test_repeats_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert got_repeats(docs) == brute_repeats([r.text for r in docs.orderBy("doc_id").collect()])


def test_repeats_empty_and_null_ids(spark, none):
    assert suffix_dedup.deduplicated(none).collect() == []
    twice = spark.createDataFrame([(None, "z" * 250), (None, "z" * 250), (3, None)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed) for r in suffix_dedup.deduplicated(twice).collect()) == [(0, 0), (250, 250), (250, 250)]


# --- 13 ------------------------------------------------------------------------------------------------------------


def check_whitened(rows, vectors, components=32):
    """Against numpy's eigendecomposition."""
    ids, x = list(vectors), np.array([[math.floor(64 * float(np.float64(c))) + 1000000 for c in v] for v in vectors.values()])
    n = len(x)
    centred = x - x.sum(0) / n
    cov = centred.T @ centred / n
    e = np.sort(np.linalg.eigvalsh(cov))[::-1]
    k = min(components, x.shape[1], int((e > 1e-9 * e[0]).sum()))
    assert len(rows) == n * k
    by = {(r.vec_id, r.component): r for r in rows}
    assert {r.n for r in rows} == {n} and {c for _, c in by} == set(range(1, k + 1))
    w = np.array([[by[i, c].whitened for c in range(1, k + 1)] for i in ids])
    cov_w = (w - w.mean(0)).T @ (w - w.mean(0)) / n
    error = np.abs(cov_w - np.eye(k)).max()
    assert error < 1e-8 and abs({r.identity_error for r in rows}.pop() - error) < 1e-8
    for j, i in enumerate(ids):
        assert by[i, 1].deviation == sum((n * int(a) - int(s)) ** 2 for a, s in zip(x[j], x.sum(0)))
    shares = np.array([by[ids[0], c].explained for c in range(1, k + 1)])
    assert np.allclose(shares, e[:k] / e.sum(), rtol=1e-9)
    back = np.linalg.lstsq(centred, w * np.sqrt(e[:k]), rcond=1e-9)[0]  # the directions that were used
    assert np.abs(cov @ back - back * e[:k]).max() < 1e-8 * e[0]


def test_whitened_table(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet")
    check_whitened(whiten.whiten(t).collect(), {r.vec_id: r.embedding for r in t.collect()})


@pytest.mark.parametrize("block", [1, 3, 16])
def test_lanczos_converges_before_the_space_is_full(spark, block):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((400, 90)) * np.r_[[60, 50, 40, 30, 20], np.full(85, 0.5)] @ np.linalg.qr(rng.standard_normal((90, 90)))[0]
    x = whiten.integer_vectors(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>"))
    of = whiten.fit(x, 4, block)
    z = np.floor(64 * m)
    e, v = np.linalg.eigh(np.cov(z.T, bias=True))
    assert np.allclose(of.values, e[::-1][:4], rtol=1e-12) and np.allclose(np.abs((of.vectors * v[:, ::-1][:, :4]).sum(0)), 1, atol=1e-10)
    assert of.passes * block < 90


def test_whitening_restarts_on_breakdown(spark):
    # two clusters of equal vectors and a third: rank 2, so most directions vanish
    rows = [(i, [[1.0, 2.0, 3.0, 4.0], [5.0, 5.0, 5.0, 5.0], [0.0, 9.0, 1.0, 0.5]][i % 3]) for i in range(30)]
    got = whiten.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    check_whitened(got, dict(rows))


def test_whitening_odd_rows(spark):
    rng = np.random.default_rng(1)
    good = {i: rng.standard_normal(5).tolist() for i in range(40)}
    good[7] = good[8]
    bad = [(100, None), (101, [1.0, None, 2.0, 3.0, 4.0]), (102, [float("nan")] * 5), (103, [float("inf"), 1.0, 1.0, 1.0, 1.0]), (104, []), (105, [1.0, 2.0])]
    df = spark.createDataFrame([*good.items(), *bad], "vec_id long, embedding array<double>").withColumn("x", F.lit(1)).withColumn("w", F.lit(2)).withColumn("n", F.lit(3))
    check_whitened(whiten.whiten(df).collect(), good)
    assert whiten.whiten(df.limit(0)).collect() == []
    assert whiten.whiten(spark.createDataFrame([(1, [1.0, 2.0])] * 5, "vec_id long, embedding array<double>")).collect() == []
