"""Near duplicates of embeddings against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from embertrace.llm.vector_links import codes_of, learn_rotation, unit_rows, vector_links

SCHEMA = "vec_id bigint, embedding array<float>, label int, key string, code int, gid string, vector string"


def plain_links(rows: list[tuple]) -> list[tuple]:
    """(vec_id, n_links, component_id) of every row."""
    n = len(rows)
    good = [i for i, (v, e, label) in enumerate(rows) if v is not None and label is not None and e and None not in e
            and np.isfinite(e).all() and np.any(np.array(e) != 0)]
    component, links = list(range(n)), [0] * n

    def root(i):
        while component[i] != i:
            component[i] = component[component[i]]
            i = component[i]
        return i

    for x, i in enumerate(good):
        for j in good[x + 1:]:
            if rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = (np.array(rows[k][1], float) for k in (i, j))
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.98:
                    links[i] += 1
                    links[j] += 1
                    component[root(i)] = root(j)
    smallest: dict[int, int] = {}
    for i in range(n):
        if rows[i][0] is not None:
            smallest[root(i)] = min(smallest.get(root(i), rows[i][0]), rows[i][0])
    return [(rows[i][0], links[i], smallest.get(root(i))) for i in range(n)]


def result(df) -> list[tuple]:
    rows = df.collect()
    assert all(r.kept == (r.vec_id == r.component_id) for r in rows)
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=str)


def clustered(rng, groups: int, members: int, dims: int, noise: float) -> list[np.ndarray]:
    out = []
    for _ in range(groups):
        centre = rng.standard_normal(dims)
        out += [centre + noise * rng.standard_normal(dims) for _ in range(members)]
    return out


def test_rotation_keeps_neighbours_near():
    rng = np.random.default_rng(0)
    base = unit_rows(rng.standard_normal((2000, 64)))
    near = unit_rows(base + 0.01 * rng.standard_normal(base.shape))
    model = learn_rotation(base)
    apart = np.bitwise_count(codes_of(base, model) ^ codes_of(near, model))
    assert apart.mean() < 4 and np.allclose(model[1].T @ model[1], np.eye(64), atol=1e-9)


@pytest.mark.parametrize("block_rows", [256, 4])
def test_clusters_equal_brute_force(spark, block_rows):
    rng = np.random.default_rng(1)
    vectors = clustered(rng, 30, 4, 64, 0.06) + clustered(rng, 2, 60, 64, 0.05) + list(rng.standard_normal((300, 64)))
    rows = [(1000 - i, [float(np.float32(x)) for x in v], int(i % 3 == 0), "a", 1, "b", "c") for i, v in enumerate(vectors)]
    rows += [(2000 + i, rows[5][1], rows[5][2], "", 0, "", "") for i in range(20)]
    found = result(vector_links(spark.createDataFrame(rows, SCHEMA).repartition(5), block_rows=block_rows))
    plain = sorted(plain_links([r[:3] for r in rows]), key=str)
    total = sum(n for _, n, _ in plain)
    assert sum(n for _, n, _ in found) >= 0.99 * total and all(f[1] <= p[1] for f, p in zip(found, plain))
    assert found == plain


def test_awkward_rows(spark):
    rng = np.random.default_rng(2)
    one = [float(x) for x in rng.standard_normal(8)]
    rows = [(1, one, 0), (2, one, 0), (2, one, 0), (3, [2 * x for x in one], 0), (4, one, 1), (5, one, None), (None, one, 0),
            (6, None, 0), (7, [], 0), (8, [0.0] * 8, 0), (9, [0.0] * 8, 0), (10, [None, *one[1:]], 0), (11, [float("nan")] * 8, 0),
            (12, [float("inf"), *one[1:]], 0), (13, one[:7], 0), (14, [1e-30 * x for x in one], 0), (15, [1e30 * x for x in one], 0),
            (-4, [-x for x in one], 0), (None, None, None), (16, one + one * 9, 0), (17, one + one * 9, 0)]
    df = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    cast = [(v, e and [None if x is None else float(np.float32(x)) for x in e], label) for v, e, label in rows]
    assert result(vector_links(df)) == sorted(plain_links(cast), key=str)


def test_empty_table(spark):
    assert vector_links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table_equals_brute_force(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding, r.label) for r in table.collect()]
    assert result(vector_links(table)) == sorted(plain_links(rows), key=str)
