import numpy as np

from shelfspark.llm import neighbours as nb

SCHEMA = "chunk_id long, embedding array<float>, same string, id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v], "", 0) for i, v in rows], SCHEMA)


def clustered(rng, clusters, size, spread):
    centres = rng.standard_normal((clusters, 64))
    return np.concatenate([c + spread * rng.standard_normal((size, 64)) for c in centres])


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([clustered(rng, 120, 5, 0.25), clustered(rng, 3, 120, 0.2), rng.standard_normal((1500, 64))]).astype(np.float32)
    x *= rng.uniform(0.1, 9, (len(x), 1)).astype(np.float32)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -1)
    true = set()
    for i, row in enumerate(s):
        true |= {(i, int(j)) for j in np.argsort(-row)[:10] if row[j] >= 0.9}
    got = {(r.id, r.other) for r in nb.neighbours(frame(spark, list(enumerate(x)))).collect()}
    assert len(got & true) >= 0.9 * len(true) and len(true) > 2000
    assert all(s[a, b] >= 0.9 - 1e-6 for a, b in got)


def test_large_class_of_equal_vectors_is_not_searched(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal(64)
    rows = [(i, v * (1 + i % 3)) for i in range(400)] + [(1000 + i, y) for i, y in enumerate(rng.standard_normal((200, 64)))] + [(5000, v + 0.01)]
    got = nb.neighbours(frame(spark, rows), least=100)
    per = {r.id: r.n for r in got.groupBy("id").count().withColumnRenamed("count", "n").collect()}
    assert all(per[i] == 10 for i in range(400)) and per[5000] == 10
    far = {r.other for r in got.filter("id = 399").collect()}
    assert far == set(range(10))
    assert nb.similar_pairs(got).filter("chunk_a >= chunk_b").count() == 0


def test_unusable_rows_copies_and_small_tables(spark):
    one = np.ones(64)
    nan = one.copy()
    nan[3] = np.nan
    inf = one.copy()
    inf[3] = np.inf
    rows = [(1, one), (1, one), (2, one * 3), (3, None), (4, one * 0), (5, one[:63]), (6, nan), (7, []), (8, inf), (9, -one)]
    df = frame(spark, rows)
    hole = spark.createDataFrame([(10, [None] + [1.0] * 63, "", 0)], SCHEMA)
    assert [tuple(r) for r in nb.similar_pairs(nb.neighbours(df.unionByName(hole))).collect()] == [(1, 2)]
    assert nb.neighbours(df.filter("chunk_id = 1")).count() == 0 and nb.neighbours(df.limit(0)).count() == 0


def test_pigeonhole(spark):
    rng = np.random.default_rng(9)
    bits = rng.integers(0, 2, (2, 512)).astype(np.uint8)
    bits[1] = bits[0]
    flips = rng.choice(12 * 16, 11, replace=False)
    bits[1, flips] ^= 1
    keys, _, _ = nb.substrings(bits, 16, 12)
    assert (keys[0] == keys[1]).any()
    p = nb.plan(10**9, 64, 0.9, np.zeros((0, 64)))
    assert p.bits <= 32 and p.tables < 256 and len(p.rotations) * 64 >= p.bits * p.tables + nb.FILTER_BITS


def true_pairs(x, k, cosine):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return {(i, int(j)) for i, row in enumerate(s) for j in np.argsort(-row)[:k] if row[j] >= cosine}


def dense_rows(rng, size, others, near=0.95):
    """A cluster at cosine `near` to its centre, and other rows."""
    centre = rng.standard_normal(64)
    centre /= np.linalg.norm(centre)
    noise = rng.standard_normal((size, 64))
    noise -= np.outer(noise @ centre, centre)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    return np.concatenate([near * centre + np.sqrt(1 - near**2) * noise, rng.standard_normal((others, 64))]).astype(np.float32)


def test_hot_buckets_are_not_split(spark, monkeypatch):
    monkeypatch.setattr(nb, "WINDOW", 2000)  # so that a bucket is compared whole
    real = nb.substrings

    def differing(*args):
        """Every other row differs in the first of the further bits."""
        keys, rest, more = real(*args)
        return keys, rest ^ (np.arange(len(rest), dtype=np.uint64) % np.uint64(2) << np.uint64(63)), more

    monkeypatch.setattr(nb, "substrings", differing)
    x = dense_rows(np.random.default_rng(12), 800, 1600, 0.98)
    true = true_pairs(x, 10, 0.9)
    got = {(r.id, r.other) for r in nb.neighbours(frame(spark, list(enumerate(x)))).collect()}
    assert len(got & true) >= 0.97 * len(true) and len(true) >= 8000


def test_recall_in_one_dense_cluster_of_a_third_of_the_rows(spark):
    x = dense_rows(np.random.default_rng(10), 2500, 5000)
    true = true_pairs(x, 10, 0.9)
    got = {(r.id, r.other) for r in nb.neighbours(frame(spark, list(enumerate(x)))).collect()}
    assert len(got & true) >= 0.9 * len(true) and len(true) >= 25_000


def test_every_vector_has_its_k_most_similar(spark):
    rng = np.random.default_rng(11)
    x = rng.standard_normal((1500, 64)).astype(np.float32)
    got = {(r.id, r.other) for r in nb.exact_neighbours(frame(spark, [*enumerate(x), (0, x[0]), (9999, None)])).collect()}
    assert got == true_pairs(x.astype(np.float64), 10, -1) and len(got) == 15_000
    blocks = nb.blocked(nb.unit_vectors(frame(spark, list(enumerate(x))), "chunk_id", "embedding", 64).selectExpr("0L as grp", "id", "v"), 10, -2.0, 64, 400)
    assert {(r.id, r.other) for r in nb._best(blocks, 10).collect()} == got
