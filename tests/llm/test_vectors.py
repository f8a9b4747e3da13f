"""Operators 12 and 13 against plain Lloyd rounds over Python integers."""

import hashlib
import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from foliospark.llm import codes, queries
from foliospark.llm.centroids import cluster_vectors, nearest, with_totals
from foliospark.llm.codes import compress_vectors, rescan, violated, with_digests

SCHEMA = "vec_id long, embedding array<float>, label int, cluster string, code string"


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def integers(v, factor):
    return [math.floor(factor * float(x)) for x in v]


def gap(a, b):
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def lloyd(points, table, rounds):
    """The table after so many rounds, and each point's (distance, index); points and entries are lists of ints."""
    pick = lambda p: min((gap(p, c), k) for k, c in enumerate(table))
    for _ in range(rounds):
        own = [pick(p)[1] for p in points]
        means = []
        for k, c in enumerate(table):
            mine = [p for p, o in zip(points, own, strict=True) if o == k]
            means.append([sum(x) // len(mine) for x in zip(*mine, strict=True)] if mine else c)
        table = means
    return table, [pick(p) for p in points]


def vectors(seed, n, dim, spread=1.0):
    """Clustered vectors with equal ones, a hot one, negative numbers, nulls, missing and repeated ids and other lengths."""
    rng = np.random.default_rng(seed)
    centers = rng.normal(0, spread, (7, dim))
    rows = [(int(i), (centers[rng.integers(7)] + rng.normal(0, spread / 4, dim)).astype(np.float32).tolist(), int(rng.integers(3))) for i in rng.permutation(n)]
    hot = rows[0][1]
    rows += [(n + k, hot, None) for k in range(n // 3)]
    rows += [(n * 3, None, 1), (n * 3 + 1, [None] * dim, 1), (n * 3 + 2, [float("nan")] * dim, 1), (n * 3 + 3, [float("-inf")] + hot[1:], 2), (5, hot[::-1], 1), (None, hot[::-1], None), (n * 3 + 5, [], 0)]
    return rows


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(parts)


@pytest.mark.parametrize(("seed", "n", "spread"), [(1, 60, 1.0), (2, 150, 0.05), (3, 40, 1e6)])
def test_centroids(spark, seed, n, spread):
    rows = [*vectors(seed, n, 8, spread), (7, [1.0] * 9, 1)]
    found, centroids, inertia = cluster_vectors(frame(spark, rows), clusters=5, dim=8)
    kept = [(i, integers(v, 64)) for i, v, _ in rows if usable(v) and len(v) == 8]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    table, best = lloyd([v for _, v in kept], [v for _, v in order[:5]], 3)
    assert centroids.tolist() == table
    total = {k: sum(d for d, j in best if j == k) for k in range(5)}
    want = [(i, k, d, total[k], sum(total.values()), hashlib.sha256(",".join(map(str, table[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, best, strict=True)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in with_totals(found, centroids, inertia).collect())


@pytest.mark.parametrize(("seed", "n", "spread", "entries"), [(4, 90, 1.0, 16), (5, 200, 0.01, 32), (6, 40, 1e5, 8), (7, 12, 1.0, 256)])
def test_codes(spark, monkeypatch, seed, n, spread, entries):
    monkeypatch.setattr(codes, "BLOCK", 37)
    rows = vectors(seed, n, 12, spread)
    found, books = compress_vectors(frame(spark, rows), entries=entries)
    kept = sorted(((i, integers(v, 1024), label) for i, v, label in rows if usable(v) and len(v) == 12), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    own = []
    for p in range(4):
        points = [v[3 * p : 3 * p + 3] for _, v, _ in kept]
        table, best = lloyd(points, points[:entries], 4)
        assert books[p].tolist() == table
        own.append(best)
    digest = hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
    error = [sum(o[r][0] for o in own) for r in range(len(kept))]
    by_label = {label: sum(e for e, k in zip(error, kept, strict=True) if k[2] == label) for _, _, label in kept}
    want = [(k[0], "".join(f"{o[r][1]:02x}" for o in own), error[r], by_label[k[2]], digest) for r, k in enumerate(kept)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in with_digests(found, books).collect())


def test_no_vectors(spark):
    rows = [(1, None, 1), (2, [None, 1.0, 2.0, 3.0], 1)]
    for kept in ([], rows):
        assert with_digests(*compress_vectors(frame(spark, kept))).collect() == []
        found = with_totals(*cluster_vectors(frame(spark, kept)))
        assert found.collect() == [] and found.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_numbers_beyond_doubles_are_exact():
    points = np.array([[1 << 40, -(1 << 40)], [(1 << 40) + 1, -(1 << 40)]], np.int64)
    entries = np.array([[1 << 40, -(1 << 40) + 1], [(1 << 40) + 2, -(1 << 40)]], np.int64)
    assert rescan(points, entries)[0].tolist() == [0, 1]
    assert nearest(points, entries)[0].tolist() == [0, 1] and nearest(points, entries)[1].tolist() == [1, 1]


def test_ties_go_to_the_lower_index():
    points = np.array([[0, 0], [2, 0], [1, 0]], np.int64)
    entries = np.array([[1, 1], [1, -1], [1, 1]], np.int64)
    assert rescan(points, entries)[0].tolist() == [0, 0, 0] and nearest(points, entries)[0].tolist() == [0, 0, 0]


def test_heaps_give_exactly_the_violated_keys():
    rng = np.random.default_rng(9)
    for _ in range(20):
        own, keys, drifted = rng.integers(0, 6, 300), rng.integers(0, 50, 300).astype(float), rng.integers(0, 50, 6).astype(float)
        assert violated(own, keys, drifted).tolist() == np.flatnonzero(keys <= drifted[own]).tolist()


def test_heaps_spare_most_parts(monkeypatch):
    """Settled clusters: after the first round only few parts are compared with all entries again."""
    rng = np.random.default_rng(11)
    centers = rng.integers(-4000, 4000, (16, 8))
    points = (centers[rng.integers(0, 16, 4000)] + rng.integers(-40, 40, (4000, 8))).astype(np.int64)
    books, drifted = (centers[None, :, 4:] + 0), np.zeros((1, 16))
    best, near, second = rescan(points[:, 4:], books[0])
    keys = second - near
    for _ in range(3):
        counts = np.bincount(best, minlength=16)[None]
        sums = np.stack([points[best == k, 4:].astype(object).sum(axis=0) if (best == k).any() else np.zeros(4, object) for k in range(16)])[None]
        books, drifted = codes.moved_books(books, counts, sums, drifted)
        due = violated(best, keys, drifted[0])
        assert len(due) < 400
        now = rescan(points[:, 4:], books[0])[0]
        assert np.array_equal(np.delete(now, due), np.delete(best, due))
        best = now


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no driver tables")
@pytest.mark.parametrize("name", ["op12_vector_codes", "op13_centroid_clustering"])
def test_registered(spark, name):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    want = con.execute(queries.ORACLE[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(str, want.fetchall()))


def test_registered_with_hard_rows(spark, tmp_path):
    """The SQL and the queries agree on rows that are left out, negative numbers, and null labels."""
    rng = np.random.default_rng(13)
    rows = [(i, rng.normal(0, 1, 64).astype(np.float32).tolist(), None if i % 5 == 0 else i % 3) for i in range(40)]
    rows += [(50, None, 1), (51, [None, *rows[0][1][1:]], 1), (52, [float("nan"), *rows[0][1][1:]], 1), (53, [float("inf"), *rows[0][1][1:]], 1)]
    pd.DataFrame(rows, columns=["vec_id", "embedding", "label"]).astype({"label": "Int32"}).to_parquet(tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    for name in ("op12_vector_codes", "op13_centroid_clustering"):
        want = con.execute(queries.ORACLE[name])
        names = [c[0] for c in want.description]
        got = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert len(got) == 40 and sorted(str(tuple(r[c] for c in names)) for r in got) == sorted(map(str, want.fetchall()))
