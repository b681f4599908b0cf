"""Vector codes and centroid clusters against plain rounds, and their bounds against full scans."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirekit.llm import op11_codes, op12_clusters
from quirekit.llm.vectors import limit

SCHEMA = "vec_id long, embedding array<float>, label int"


def whole(v):
    return [math.floor(256 * float(np.float32(x))) for x in v]


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b))


def fine(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def rounds_of(x, c, n):
    """Plain Lloyd: nearest by distance, then index; means floored; empty ones stay."""
    for r in range(n + 1):
        near = [min(range(len(c)), key=lambda j: (gap(v, c[j]), j)) for v in x]
        if r < n:
            own = [[v for v, k in zip(x, near) if k == j] for j in range(len(c))]
            c = [[sum(z) // len(m) for z in zip(*m)] if m else c[j] for j, m in enumerate(own)]
    return near, c


def plain_codes(rows, dims, parts=16, entries=64, rounds=2):
    kept = sorted(((i, whole(v), s) for i, v, s in rows if fine(v) and len(v) == dims), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w, books, codes, errors = dims // parts, [], [""] * len(kept), [0] * len(kept)
    for p in range(parts):
        x = [v[p * w : p * w + w] for _, v, _ in kept]
        near, book = rounds_of(x, x[:entries], rounds)
        books += book
        for k, j in enumerate(near):
            codes[k] += f"{j:02x}"
            errors[k] += gap(x[k], book[j])
    total = {}
    for (_, _, s), e in zip(kept, errors):
        total[s] = total.get(s, 0) + e
    sha = hashlib.sha256(",".join(str(z) for e in books for z in e).encode()).hexdigest()
    return sorted(repr((i, c, e, total[s], sha)) for (i, _, s), c, e in zip(kept, codes, errors))


def plain_clusters(rows, k=40, rounds=5):
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1])
    kept = sorted(((i, whole(v)) for i, v, _ in rows if fine(v) and len(v) == 64), key=key)
    near, c = rounds_of([v for _, v in kept], [v for _, v in kept[:k]], rounds)
    far = [gap(v, c[j]) for (_, v), j in zip(kept, near)]
    of = {j: sum(f for f, n in zip(far, near) if n == j) for j in set(near)}
    return sorted(repr((i, j, f, of[j], sum(far), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())) for (i, _), j, f in zip(kept, near, far))


def odd_rows(n=150, seed=3):
    """Coarse grids, so that ties are common; nulls, NaN, infinities, other lengths, repeats, a large component."""
    r = np.random.default_rng(seed)
    rows = [(i * 3 - 40, [float(v) for v in r.integers(-2, 3, 64) / 256], int(r.integers(0, 3)) if i % 5 else None) for i in range(n)]
    rows += rows[7:12] + [(rows[3][0], rows[9][1], 1), (None, rows[5][1], 2), (None, rows[6][1], None)]
    rows += [(1001, None, 1), (1002, [], 1), (1003, [0.5] * 63, 1), (1004, [0.5] * 63 + [None], 1), (1005, [float("nan")] * 64, 1), (1006, [float("-inf")] + [0.0] * 63, 1)]
    return rows + [(1007, [300.25, -300.125] * 32, 1)]


def shown(df, *columns):
    return sorted(repr(tuple(r)) for r in df.select(*columns).collect())


CODES = ("vec_id", "code", "error", "label_error", "codebooks_sha256")
CLUSTERS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


@pytest.fixture()
def embeddings(spark, saved):
    def build(rows):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        for name in ("x", "entry", "upper", "lower", "cluster", "distance", "error", "code", "n", "s", "of"):
            df = df.withColumn(name, F.lit("clash"))
        return saved(embeddings=df.withColumn("m", F.create_map(F.lit("a"), F.lit(1))))

    return build


def test_codes_equal_plain_rounds(spark, embeddings):
    rows = odd_rows()
    assert shown(op11_codes.op11_codes(spark, embeddings(rows)), *CODES) == plain_codes(rows, 64)


def test_clusters_equal_plain_rounds(spark, embeddings):
    rows = odd_rows(seed=4)
    assert shown(op12_clusters.op12_clusters(spark, embeddings(rows)), *CLUSTERS) == plain_clusters(rows)


def test_few_and_equal_vectors(spark, embeddings):
    rows = [(i, [0.25] * 64, 1) for i in range(6)] + [(9, [0.5] * 64, None)]
    path = embeddings(rows)
    assert shown(op11_codes.op11_codes(spark, path), *CODES) == plain_codes(rows, 64)
    assert shown(op12_clusters.op12_clusters(spark, path), *CLUSTERS) == plain_clusters(rows)


def test_empty_tables(spark, embeddings):
    path = embeddings([(1, None, None)])
    assert op11_codes.op11_codes(spark, path).count() == 0
    assert op12_clusters.op12_clusters(spark, path).count() == 0


def test_other_sizes(spark):
    r = np.random.default_rng(8)
    rows = [(i, [float(v) for v in r.normal(0, 0.2, 12)], 0) for i in range(60)]
    found, books = op11_codes.coded(spark.createDataFrame(rows, SCHEMA), parts=4, entries=8, rounds=3)
    assert books.shape == (4, 8, 3)
    want = plain_codes(rows, 12, 4, 8, 3)
    assert sorted((r["vec_id"], r["code"], r["error"]) for r in found.collect()) == sorted(eval(x)[:3] for x in want)
    with pytest.raises(ValueError):
        op11_codes.coded(spark.createDataFrame(rows, SCHEMA), entries=300)


def test_huge_components_are_held(spark):
    rows = [(1, [3e38] + [0.0] * 63, 0), (2, [-3e38] + [0.0] * 63, 0), (3, [0.0] * 64, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    found, books = op11_codes.coded(df, entries=2)
    assert abs(books).max() == limit(64) and found.count() == 3
    found, centroids = op12_clusters.clustered(df, k=2)
    assert abs(centroids).max() == limit(64) and found.count() == 3


@pytest.mark.parametrize("spread", [2, 30, 100_000])
def test_bounds_hold_and_prune(spread):
    """After each move of the entries the bounds still enclose all distances, and the nearest entry is that of a full scan."""
    r = np.random.default_rng(spread)
    centres = r.integers(-spread, spread + 1, (8, 4)) * 4
    x = centres[r.integers(0, 8, 900)] + r.integers(-1, 2, (900, 4))
    book = x[:64].copy()
    entry, upper, lower = op11_codes.first_bounds(x, book)
    near, high, low = op12_clusters.scanned(x, book)
    measured = scanned = 0
    for _ in range(6):
        now = book + r.integers(-1, 2, book.shape)
        moved = np.nextafter(np.sqrt(((now - book) ** 2).sum(1)), np.inf)
        book = now
        kept = np.nextafter(upper.astype(np.float32), np.float32(np.inf)).astype(float)
        entry, upper, lower, n = op11_codes.next_bounds(x, book, moved, entry, kept, op11_codes.unpacked(op11_codes.packed(lower)))
        near, high, low, m = op12_clusters.rescanned(x, book, moved, near, high, low)
        measured, scanned = measured + n, scanned + m
        d = ((x[:, None] - book[None]) ** 2).sum(2)
        at = np.arange(len(x))
        assert (entry == d.argmin(1)).all() and (near == d.argmin(1)).all()
        assert (upper >= np.sqrt(d[at, entry])).all() and (high >= np.sqrt(d[at, near])).all()
        lower[at, entry] = 0
        assert (lower <= np.sqrt(d)).all()
        d[at, near] = 1 << 60
        assert (low[low <= high] <= np.sqrt(d.min(1))[low <= high]).all()
    assert measured < 6 * x.shape[0] * 64
    if spread == 100_000:
        assert measured < 6 * x.shape[0] * 64 / 2


def test_packed_bounds_round_down():
    x = np.r_[0.0, 0.5, 0.999, 1.0, np.nextafter(2.0, 0), 2.0, 3.7, 1e4, 2.0**31, np.random.default_rng(1).uniform(0, 1e6, 500)]
    y = op11_codes.unpacked(op11_codes.packed(x))
    assert (y <= x).all() and (y >= np.where(x < 1, 0, x / 1.126)).all()
