import numpy as np

from tests.llm import brute
from tillroll.llm import neardup


def test_hadamard_keeps_lengths():
    x = np.random.default_rng(0).standard_normal((5, 16))
    y = neardup.rotate(x, 0, 0)
    assert np.allclose(np.linalg.norm(x, axis=1), np.linalg.norm(y, axis=1))
    assert np.allclose(neardup.hadamard(neardup.hadamard(x)), x)


def test_links_and_components_equal_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((400, 48))
    x = np.concatenate([base, base * 0.9 + 0.42 * rng.standard_normal((400, 48)),
                        base[:1] + 0.05 * rng.standard_normal((80, 48)), base[:30] * 3.0])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    part = brute.components(range(len(x)), [(int(a), int(b)) for a, b in np.argwhere(near) if a < b])
    for dense in (neardup.DENSE, 16):  # also with buckets cut into blocks
        monkeypatch.setattr(neardup, "DENSE", dense)
        got = {r["vec_id"]: r for r in neardup.find(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
        assert sum(r["n_links"] for r in got.values()) >= 0.99 * near.sum()
        assert all(r["n_links"] <= near[i].sum() for i, r in got.items())
        assert sum(got[i]["component_id"] == part[i] for i in got) >= 0.99 * len(got)


def test_unusable_and_equal_vectors(spark):
    one = [1.0, 0.0, 0.5]
    rows = [(1, one), (2, one), (2, one), (3, [2.0, 0.0, 1.0]), (4, None), (5, []), (6, [0.0, -0.0, 0.0]),
            (7, [1.0, None, 2.0]), (8, [float("inf"), 0.0, 0.0]), (9, [float("nan")] * 3), (None, one),
            (10, [1.0, 0.0]), (11, [1e300, 0.0, 5e299])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "'x' as label", "1 as class")
    got = sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup.find(df).collect()), key=repr)
    want = [(1, 4, 1, True), (2, 4, 1, False), (2, 4, 1, False), (3, 4, 1, False), (11, 4, 1, False)]
    want += [(i, 0, i, True) for i in (4, 5, 6, 7, 8, 9, 10)] + [(None, 0, None, False)]
    assert got == sorted(want, key=repr)
    assert neardup.find(df.limit(0)).count() == 0
