"""Near-duplicate vectors and whitening against brute force."""

import numpy as np
import pytest
from oracle import SF

from plume.llm import bidiagonal, near_vectors, queries, whitening

SCHEMA = "vec_id long, label int, embedding array<double>, n int, class string, root string, x int, of int"


def table(spark, rows):
    return spark.createDataFrame([(i, l, None if e is None else [None if c is None else float(c) for c in e], 7, "c", "r", 1, 2) for i, l, e in rows], SCHEMA)


def awkward():
    r = np.random.default_rng(5)
    base = r.standard_normal(6).tolist()
    rows = [(k, k % 3, r.standard_normal(6).tolist()) for k in range(40)]
    rows += [(100, 1, base), (101, 1, base), (101, 1, base), (None, 1, base), (102, 2, base), (103, None, base), (104, 1, [2 * c for c in base])]
    rows += [(110, 1, None), (111, 1, []), (112, 1, [0.0] * 6), (113, 1, [1.0, None, 1, 1, 1, 1]), (114, 1, [float("nan")] + base[1:]), (115, 1, [float("inf")] + base[1:])]
    rows += [(120, 1, base[:4]), (121, 1, base[:4]), (122, 1, [1e200 * c for c in base]), (123, 1, [1e-200 * c for c in base]), (124, 1, [-0.0, 1.0, 0, 0, 0, 0]), (125, 1, [0.0, 1.0, 0, 0, 0, 0])]
    return rows


def brute_links(rows, threshold=0.98):
    """vec_id, n_links, component_id of each row, by all pairs and a flood over them."""
    good = [l is not None and bool(e) and all(c is not None and np.isfinite(c) for c in e) and any(e) for _, l, e in rows]
    units = [np.array(e) / max(map(abs, e)) if g else None for (_, _, e), g in zip(rows, good)]
    near = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][1] == rows[j][1] and len(units[i]) == len(units[j]):
                if units[i] @ units[j] / np.sqrt((units[i] @ units[i]) * (units[j] @ units[j])) >= threshold:
                    near[i].append(j)
                    near[j].append(i)
    root = [None] * len(rows)
    for i in range(len(rows)):
        if root[i] is None:
            todo, reached = [i], {i}
            while todo:
                new = [k for k in near[todo.pop()] if k not in reached]
                reached.update(new)
                todo.extend(new)
            ids = [rows[k][0] for k in reached if rows[k][0] is not None]
            for k in reached:
                root[k] = (min(ids) if ids else None,)
    return sorted((str(i), len(n), str(c), i == c) for (i, _, _), n, (c,) in zip(rows, near, root))


def links_of(frame):
    return sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in frame.collect())


def test_near_vectors_of_awkward_rows(spark):
    rows = awkward()
    got = near_vectors.near_vectors(table(spark, rows))
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert links_of(got) == brute_links(rows)
    assert near_vectors.near_vectors(table(spark, [])).count() == 0
    assert links_of(near_vectors.near_vectors(table(spark, rows[47:53]))) == brute_links(rows[47:53])


def crowd(seed, n=900, d=24):
    """Groups of near copies, a chain, exact copies and loose vectors, most of one label."""
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, d))
    centre = x[0] / np.linalg.norm(x[0])
    x[: n // 3] = centre + 0.022 * r.standard_normal((n // 3, d))  # cosines around the threshold
    for k in range(60):  # a chain whose ends are far apart
        t = k / 12
        x[n // 3 + k] = np.cos(t) * x[n - 1] + np.sin(t) * x[n - 2]
    x[5 * n // 9 : 5 * n // 9 + 20] = x[5 * n // 9]
    x = x.astype(np.float32).astype(float)
    return [(int(i), 0 if i % 5 else 1, v.tolist()) for i, v in zip(r.permutation(n), x)]


@pytest.mark.parametrize("numbers", [near_vectors.BLOCK_NUMBERS, 24 * 60])
def test_near_vectors_in_one_block_and_in_many(spark, numbers):
    rows = crowd(3)
    assert links_of(near_vectors.near_vectors(table(spark, rows), numbers=numbers)) == brute_links(rows)


def test_slabs_of_ties(spark):
    """All vectors share their leading coordinate, so that quantiles can't part them."""
    r = np.random.default_rng(8)
    rows = [(k, 0, [5.0, *(r.choice([-1.0, 1.0], 8) * 0.5).tolist()]) for k in range(400)]
    assert links_of(near_vectors.near_vectors(table(spark, rows), numbers=9 * 40)) == brute_links(rows)


def test_tiles_stop_and_skip_without_loss(monkeypatch):
    monkeypatch.setattr(near_vectors, "TILE", 16)
    rows = crowd(4, 300)
    x = np.array([e for _, _, e in rows])
    u = near_vectors.units(x)
    rotation = np.linalg.eigh(u.T @ u)[1][:, ::-1]
    linked, root = near_vectors.Tiled(x, rotation, 0.98).compared(np.ones(300, np.int64), np.arange(300), None)
    near = (u @ u.T >= 0.98) & ~np.eye(300, dtype=bool)
    assert (linked == near.sum(1)).all()
    assert all(root[i] == root[j] for i, j in zip(*np.nonzero(near)))


def test_near_vectors_of_the_given_table(spark):
    rows = [(r.vec_id, r.label, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert links_of(queries.op11_near_vectors(spark, SF)) == brute_links(rows)


def brute_whitening(rows, d):
    """x, n, S, eigenvalues and unit eigenvectors of the fit list, from NumPy."""
    kept = [(i, e) for i, _, e in rows if e is not None and len(e) == d and all(c is not None and np.isfinite(c) for c in e)]
    x = np.array([[int(np.floor(64 * c)) + 1000000 for c in e] for _, e in kept])
    fit = np.unique(x, axis=0)
    centred = fit - fit.sum(0) / len(fit)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(fit))
    return [i for i, _ in kept], x, fit, values[::-1], vectors[:, ::-1]


def assert_whitened(got, rows, d):
    ids, x, fit, e, v = brute_whitening(rows, d)
    k = min(d, 16, len(fit) - 1)
    n, total = len(fit), fit.sum(0)
    assert len(got) == len(ids) * k
    assert {r.n for r in got} == {n}
    assert all(r.identity_error <= 1e-10 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.component, []).append(r)
    for c in range(1, k + 1):
        part = by[c]
        want = (x - total / n) @ v[:, c - 1] / np.sqrt(e[c - 1])
        assert part[0].explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
        deviation = ((n * x - total) ** 2).sum(1)
        right = sorted(zip(map(str, ids), deviation.tolist(), want))
        found = sorted((str(r.vec_id), r.deviation, r.whitened) for r in part)
        assert [f[:2] for f in found] == [w[:2] for w in right]
        f, w = np.array([r[2] for r in found]), np.array([r[2] for r in right])
        if len(set(ids)) == len(ids):
            assert min(np.abs(f - w).max(), np.abs(f + w).max()) < 1e-8


def test_whitening_of_the_given_table(spark):
    rows = [(r.vec_id, r.label, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    assert_whitened(queries.op13_whitening(spark, SF).collect(), rows, len(rows[0][2]))


def test_whitening_of_awkward_rows(spark):
    rows = [r for r in awkward() if r[0] not in (122,)]
    got = whitening.whiten(table(spark, rows)).collect()
    assert_whitened(got, rows, 6)
    assert {r.vec_id for r in got} >= {112, None} and not {r.vec_id for r in got} & {110, 111, 113, 114, 115, 120, 121}
    huge = whitening.whiten(table(spark, [(1, 1, [1e300, 0.0]), (2, 1, [0.0, 1.0]), (3, 1, [1.0, 0.0])])).collect()
    assert {r.vec_id for r in huge} == {1, 2, 3} and {r.deviation for r in huge} == {None}
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [(1, 1, [1.0, 2.0]), (2, 1, [1.0, 2.0])])).count() == 0


def test_whitening_with_few_rows_and_many_parts(spark):
    r = np.random.default_rng(9)
    few = [(k, 0, r.standard_normal(30).tolist()) for k in range(9)]
    assert_whitened(whitening.whiten(table(spark, few)).collect(), few, 30)
    many = [(k, 0, (r.standard_normal(5) * [9, 5, 3, 2, 1]).tolist()) for k in range(2000)]
    assert_whitened(whitening.whiten(table(spark, many).repartition(40)).collect(), many, 5)


def matrices():
    g = np.random.default_rng(1)
    turn = np.linalg.qr(g.standard_normal((64, 64)))[0]
    other = np.linalg.qr(g.standard_normal((64, 64)))[0]
    steps = np.repeat([5.0, 3, 1, 0.5], 16)
    yield from (g.standard_normal((64, 64)), np.eye(64), np.diag([3.0, 3, 2, 2, 1]), np.array([[2.0]]), np.array([[1.0, 2], [0, 3]]))
    yield g.standard_normal((64, 64)) * np.logspace(0, -12, 64)
    yield np.vstack([g.standard_normal((10, 64)), np.zeros((54, 64))])
    for noise in (0, 1e-12, 1e-9, 1e-5):
        yield (other * (steps * (1 + noise * g.standard_normal(64)))) @ turn.T
    yield np.diag(np.abs(np.arange(-10.0, 11)) + 1) + np.diag(np.ones(20), 1)


@pytest.mark.parametrize("r", list(matrices()))
def test_bidiagonal_solver(r):
    values, leading, v = bidiagonal.leading_directions(r, 16)
    right = np.linalg.svd(r, compute_uv=False)
    assert np.abs(values - right).max() < 1e-13 * right[0]
    assert np.abs(v.T @ v - np.eye(v.shape[1])).max() < 1e-12
    assert np.abs(r.T @ (r @ v) - v * leading**2).max() < 1e-13 * right[0] ** 2


def test_dqds_is_accurate_for_tiny_values():
    """Relative accuracy: the product of the values is that of the diagonal, over 60 orders of magnitude."""
    d = np.logspace(0, -60, 40)
    assert np.log(bidiagonal.dqds(d, d[:-1] * 0.7)).sum() == pytest.approx(np.log(d).sum(), abs=1e-10)
    assert bidiagonal.dqds(np.zeros(3), np.zeros(2)).tolist() == [0, 0, 0]
