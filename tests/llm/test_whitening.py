import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lexicarta.llm import queries, whitening


def plain(rows):
    """Everything by numpy on whole arrays: ``{(row, component): values}``."""
    usable = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in usable], dtype=np.int64)
    fit = np.unique(x, axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(-values)[:16]
    return usable, x, n, sums, covariance, values[order], vectors[:, order]


@pytest.mark.parametrize("d", [1, 2, 3, 7, 64])
def test_eigenvectors(d):
    rng = np.random.default_rng(d)
    a = rng.standard_normal((3 * d, d)) * np.exp(-np.arange(d) / 3)
    m = a.T @ a
    values, vectors = whitening.leading_eigenvectors(m, min(16, d))
    expected = np.sort(np.linalg.eigvalsh(m))[::-1][: len(values)]
    assert np.allclose(values, expected, rtol=1e-9, atol=1e-13 * expected[0])
    assert np.allclose(vectors.T @ vectors, np.eye(len(values)), atol=1e-13)
    assert np.max(np.abs(m @ vectors - vectors * values)) < 1e-12 * expected[0]


@pytest.mark.parametrize("values", [[5, 5, 5, 1, 1, 0, 0], [1] * 9, [3, 3 * (1 + 1e-13), 2, 2 + 1e-9, 1], [0] * 4, [7, 0, 0]])
def test_clusters_of_equal_eigenvalues(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(4).standard_normal((d, d)))
    for m in (q @ np.diag(values) @ q.T, np.diag(np.array(values, dtype=float))):
        m = (m + m.T) / 2
        found, vectors = whitening.leading_eigenvectors(m, d)
        assert np.allclose(found, np.sort(values)[::-1], atol=1e-12 * max(1, max(values)))
        assert np.allclose(vectors.T @ vectors, np.eye(d), atol=1e-12)
        assert np.allclose(m @ vectors, vectors * found, atol=1e-11 * max(1, max(values)))


def test_sturm_counts():
    diagonal, off = np.array([2.0, 1.0, 3.0, 0.0]), np.array([1.0, 0.0, 0.5])
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    at = np.linspace(-3, 5, 37)
    assert list(whitening.sturm_counts(diagonal, off, at)) == [int((values < a).sum()) for a in at]


def test_same_as_whole_arrays(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    usable, x, n, sums, covariance, values, vectors = plain(rows)
    found = queries.op11_whitening(spark, folder).collect()
    assert len(found) == 16 * len(usable)
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert {r["n"] for r in found} == {n}
    (error,) = {r["identity_error"] for r in found}
    assert error < 1e-9
    white = ((x - sums / n) @ vectors) / np.sqrt(values)
    own = np.array([[by[i, c + 1]["whitened"] for c in range(16)] for i, _ in usable])
    signs = np.sign((white * own).sum(axis=0))
    assert np.allclose(own, white * signs, atol=1e-8)
    apart = n * x.astype(object) - sums.astype(object)
    for (i, _), row in zip(usable, (apart * apart).sum(axis=1), strict=True):
        assert {by[i, c]["deviation"] for c in range(1, 17)} == {row}
    for c in range(16):
        assert math.isclose(by[usable[0][0], c + 1]["explained"], values[c] / np.trace(covariance), rel_tol=1e-9)


def test_exact_columns_in_sql(spark, folder):
    sql = f"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(64 * CAST(c AS DOUBLE)) AS BIGINT) + 1000000) AS x
                   FROM '{folder}/embeddings.parquet'),
             f AS (SELECT DISTINCT x FROM v),
             s AS (SELECT i, sum(x) AS s, count(*) AS n FROM (SELECT unnest(x) AS x, unnest(range(64)) AS i FROM f) GROUP BY i)
        SELECT vec_id, any_value(n), sum((n * x - s) * (n * x - s))
        FROM (SELECT vec_id, unnest(x) AS x, unnest(range(64)) AS i FROM v) JOIN s USING (i) GROUP BY vec_id"""
    expected = sorted(tuple(int(v) for v in r) for r in duckdb.sql(sql).fetchall())
    found = queries.op11_whitening(spark, folder).where("component = 1").select("vec_id", "n", "deviation")
    assert sorted(tuple(r) for r in found.collect()) == expected


SCHEMA = "vec_id bigint, embedding array<float>, label int, x string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 7) for i, v in rows], SCHEMA)


def test_awkward_rows(spark):
    rows = [
        (1, [0.0, 1.0, 2.0]), (1, [0.0, 1.0, 2.0]), (None, [0.5, -1.0, 2.25]), (3, None), (4, []), (5, [1.0, None, 2.0]),
        (6, [1.0, float("nan"), 2.0]), (7, [float("inf"), 0.0, 0.0]), (8, [-0.01, 3.0, 1.0]), (9, [4.0, 4.0, -4.0]),
    ]
    usable, x, n, sums, _, values, vectors = plain(rows)
    found = whitening.whitened(frame(spark, rows)).collect()
    assert n == 4 and len(found) == 5 * 3
    assert sorted(str(r["vec_id"]) for r in found if r["component"] == 1) == ["1", "1", "8", "9", "None"]
    white = np.abs(((x - sums / n) @ vectors) / np.sqrt(values))
    own = {r["vec_id"]: abs(r["whitened"]) for r in found if r["component"] == 3}
    assert all(math.isclose(own[i], white[at][2], rel_tol=1e-7) for at, (i, _) in enumerate(usable))


def test_no_variance(spark):
    found = whitening.whitened(frame(spark, [(1, [2.0, 3.0]), (2, [2.0, 3.0])])).collect()
    assert len(found) == 4
    for r in found:
        assert (r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) == (1, 0, None, None, None)
    line = whitening.whitened(frame(spark, [(i, [float(i), 2.0 * i]) for i in range(6)])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    assert max(r["identity_error"] for r in line) < 1e-9


def test_no_rows_and_several_lengths(spark):
    assert whitening.whitened(frame(spark, [])).collect() == []
    assert whitening.whitened(frame(spark, [(1, None)])).collect() == []
    with pytest.raises(Exception, match="several lengths"):
        whitening.whitened(frame(spark, [(1, [1.0]), (2, [1.0, 2.0])])).collect()


def test_large_numbers_stay_exact():
    x = np.array([[10**9, -5], [3, 4]])
    found = whitening.deviations(x, 10**9, (7, -9)).to_pylist()
    assert [int(v) for v in found] == [(10**18 - 7) ** 2 + (-5 * 10**9 + 9) ** 2, (3 * 10**9 - 7) ** 2 + (4 * 10**9 + 9) ** 2]


def test_a_hot_vector_is_sent_once_per_task(spark):
    rows = frame(spark, [(i, [1.0, 2.0] if i % 3 else [float(i), 0.0]) for i in range(300)])
    plan = rows.select(whitening.integers(F.col("embedding")).alias("x")).distinct()
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert text.count("HashAggregate") == 2
