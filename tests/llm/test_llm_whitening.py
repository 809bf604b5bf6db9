import numpy as np
import pytest

from sensorlab.llm.whitening import leading_components, negative_pivots, whiten


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")


def brute(rows, count=32):
    """By the definition, with numpy's own eigenvectors; signs are free."""
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for _, v, _ in rows])
    n, s = len(x), x.sum(axis=0)
    y = x - s / n
    v = y.T @ y / n
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:count], axes[:, ::-1][:, :count]
    return ((n * x - s) ** 2).sum(axis=1), np.abs(y @ axes / np.sqrt(values)), values / np.trace(v)


def table_of(df):
    rows = df.toPandas().sort_values(["vec_id", "component"])
    return rows, rows["component"].max()


def test_agrees_with_eigenvectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(rng.standard_normal((300, 40)) * np.linspace(1, 9, 40))]
    got, k = table_of(whiten(vectors(spark, rows)))
    deviation, whitened, explained = brute(rows)
    assert k == 32 and len(got) == 300 * 32 and set(got["n"]) == {300}
    assert got["deviation"].to_numpy().reshape(300, 32)[:, 5].tolist() == deviation.tolist()
    assert np.allclose(np.abs(got["whitened"].to_numpy().reshape(300, 32)), whitened, atol=1e-8)
    assert np.allclose(got["explained"].to_numpy()[:32], explained, rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].max() < 1e-9
    signed = got["whitened"].to_numpy().reshape(300, 32)
    assert np.allclose(signed.T @ signed / 300, np.eye(32), atol=1e-9)  # one sign for all rows


@pytest.mark.parametrize("d", [1, 2, 7, 60])
@pytest.mark.parametrize("shape", ["full", "equal", "low rank", "crowded", "steep"])
def test_components(d, shape):
    rng = np.random.default_rng(d)
    q, _ = np.linalg.qr(rng.standard_normal((d, d)))
    values = {
        "full": rng.random(d) + 0.1,
        "equal": np.full(d, 3.0),
        "low rank": np.where(np.arange(d) < max(1, d // 3), 1.0 + np.arange(d), 0.0),
        "crowded": 1 + 1e-10 * rng.random(d) * (np.arange(d) % 2),
        "steep": 10.0 ** -(np.arange(d) / 6),
    }[shape]
    v = q * values @ q.T
    v = (v + v.T) / 2
    e, x = leading_components(v)
    want = np.sort(np.linalg.eigvalsh(v))[::-1]
    want = want[want > 1e-11 * want.sum()][:32]
    assert len(e) == len(want)
    assert np.allclose(e, want, rtol=1e-9, atol=1e-13 * want[0])
    assert np.abs(v @ x - x * e).max() < 1e-12 * want[0]
    assert np.abs(x.T @ x - np.eye(len(e))).max() < 1e-12


def test_inertia_with_zero_diagonal():
    assert negative_pivots(np.array([[0.0, 1.0], [1.0, 0.0]])) == 1
    assert negative_pivots(np.zeros((3, 3))) == 0
    rng = np.random.default_rng(0)
    for _ in range(50):
        a = rng.integers(-2, 3, (9, 9)).astype(float)
        a += a.T + 0.3 * np.eye(9)
        assert negative_pivots(a) == (np.linalg.eigvalsh(a) < 0).sum()


def test_dropped_rows_and_dimensions(spark, clashing):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], 0), (1, [3.0, 2.5], 0), (None, [0.0, 5.0], 1), (2, None, 1), (3, [], 1), (4, [nan, 1.0], 0)]
    rows += [(5, [1.0, None], 0), (6, [inf, 0.0], 0), (7, [1.0], None), (8, [4.0], None), (9, [1.0, 2.0, 3.0], 2)]
    got = clashing(whiten(clashing(vectors(spark, rows)))).toPandas()
    assert sorted(got["vec_id"].dropna().astype(int)) == [1, 1, 1, 1, 7, 8]  # the three-dimensional list has one vector
    assert got["vec_id"].isna().sum() == 2
    two = got[got["vec_id"].isna() | (got["vec_id"] == 1)]
    assert set(two["n"]) == {3} and got["identity_error"].max() < 1e-9


def test_empty_and_equal_vectors(spark):
    assert whiten(vectors(spark, [])).count() == 0
    assert whiten(vectors(spark, [(i, [0.5, 0.25], 0) for i in range(9)])).count() == 0


def test_large_values_are_exact(spark):
    rows = [(0, [1e9, 0.0], 0), (1, [-1e9, 1.0], 0), (2, [5.0, 2.0], 0), (3, [1e300, 0.0], 0)]
    got = whiten(vectors(spark, rows[:3], "double")).toPandas().set_index(["vec_id", "component"])
    x = [[int(64 * c) + 1_000_000 for c in v] for _, v, _ in rows[:3]]
    sums = [sum(c) for c in zip(*x, strict=True)]
    want = [sum((3 * c - s) ** 2 for c, s in zip(v, sums, strict=True)) for v in x]
    for i, w in enumerate(want):
        value = got.loc[(i, 1), "deviation"]
        assert (np.isnan(value) if w >= 2**63 else int(value) == w)
    # Beside a saturated entry, the other dimension is below the noise: one component.
    assert whiten(vectors(spark, rows, "double")).filter("vec_id = 2").count() == 1


def test_order_of_rows_does_not_matter(spark):
    rng = np.random.default_rng(5)
    rows = [(i, v.tolist(), 0) for i, v in enumerate(rng.standard_normal((50, 5)))]
    a, b = (table_of(whiten(vectors(spark, r)))[0]["whitened"].to_numpy() for r in (rows, rows[::-1]))
    assert np.allclose(a, b, atol=1e-9)
