import numpy as np

from fieldframe.llm import embedding


def make(seed=0, dims=64):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(400, dims))
    near = [base[rng.integers(0, 60)] / 8 * 8 + rng.normal(size=dims) * rng.choice((0, 0.05, 0.2, 0.35)) for _ in range(300)]
    x = np.vstack((base, near)).astype(np.float32)
    return x, rng.integers(0, 3, len(x))


def brute(x, label, threshold=0.93):
    d = x.astype(float)
    u = d / np.linalg.norm(d, axis=1)[:, None]
    return (u @ u.T >= threshold) & (label[:, None] == label[None]) & ~np.eye(len(x), dtype=bool)


def reach(links):
    group = np.arange(len(links))
    while True:
        new = np.array([min([group[k], *group[np.flatnonzero(links[k])]]) for k in range(len(links))])
        if (new == group).all():
            return group
        group = new


def test_links_against_brute_force(spark):
    x, label = make()
    links = brute(x, label)
    df = spark.createDataFrame([(k, v.tolist(), int(c), "x") for k, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int, key string")
    for tile in (8, 256):
        got = {r.vec_id: r for r in embedding.near_duplicates(df, tile=tile).collect()}
        assert len(got) == len(x)
        n = np.array([got[k].n_links for k in range(len(x))])
        want = links.sum(1)
        assert (n <= want).all()
        assert n.sum() >= 0.97 * want.sum()
        if (n == want).all():
            group = reach(links)
            assert [got[k].component_id for k in range(len(x))] == group.tolist()
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())


def test_codes_rule_out_no_link():
    x, _ = make(3)
    u = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    linked = u @ u.T >= 0.93
    small, scale, rounding = embedding.shortened(u)
    for lists in (1, 16, 512):
        index = embedding.Index(u, lists, 0.93)
        home, _, codes, error = index.encode(u)
        for at in np.unique(home):
            k = np.flatnonzero(home == at)
            assert not (linked[:, k] & ~index.candidates(small * scale[:, None], rounding, at, codes[k], error[k])).any()


def test_levels_agree_with_their_sums():
    x, _ = make(4)
    u = x / np.linalg.norm(x.astype(float), axis=1)[:, None]
    index = embedding.Index(u, 600, 0.93)
    assert len(index.shape) == 2 and index.lists == len(index.halves) >= 600
    centers = index.center(np.arange(index.lists))
    assert np.allclose((centers**2).sum(1) / 2, index.halves, atol=1e-4)
    home, visits, _, _ = index.encode(u)
    far = ((u[:, None] - centers[None]) ** 2).sum(2)
    assert np.allclose(far[np.arange(len(u)), home], far.min(1), atol=1e-4)
    for h, v in zip(home, visits, strict=True):
        assert h not in v and all((h < k) == ((h + k) % 2 == 0) for k in v)


def test_recall_at_three_sizes(spark):
    """Links planted from just above the threshold upwards, over tables of one list and of many."""
    for n in (300, 2_000, 6_000):
        rng = np.random.default_rng(n)
        base = rng.normal(size=(n, 64))
        base /= np.linalg.norm(base, axis=1)[:, None]
        side = rng.normal(size=(n // 2, 64))
        side /= np.linalg.norm(side, axis=1)[:, None]
        x = np.vstack((base, base[: n // 2] + side * rng.uniform(0.05, 0.39, n // 2)[:, None]))
        links = brute(x, np.zeros(len(x), int))
        df = spark.createDataFrame([(k, v.tolist(), 1) for k, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
        got = {r.vec_id: r.n_links for r in embedding.near_duplicates(df, tile=256).collect()}
        found, want = np.array([got[k] for k in range(len(x))]), links.sum(1)
        assert (found <= want).all()
        assert found.sum() >= 0.95 * want.sum() > 0


def test_rare_lengths_and_extreme_numbers(spark):
    rows = [(k, [float(k), 1.0], 1) for k in range(50)]
    rows += [(100, [1e200, 2e200, 3e200], 1), (101, [1e-200, 2e-200, 3e-200], 1), (102, [1.0, 2.0, 3.1], 1), (103, [3.0, -2.0, 1.0], 1), (104, [5e-324, 0.0, 0.0, 0.0], 1), (105, [1.0, 0.0, 0.0, 0.0], 1)]
    got = {r.vec_id: r for r in embedding.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert [(got[k].n_links, got[k].component_id) for k in range(100, 106)] == [(2, 100), (2, 100), (2, 100), (0, 103), (1, 104), (1, 104)]


def test_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int"
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, 0.0], 2), (5, [1.0, 0.0], None), (6, None, 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1)]
    rows += [(9, [inf, 1.0], 1), (10, [1.0, None], 1), (11, [], 1), (12, [1.0], 1), (14, [2.0], 1), (None, [1.0, 0.0], 1), (13, [0.0, 1.0], 1), (2, [1.0, 0.0], 1)]
    got = embedding.near_duplicates(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    assert {(r.vec_id, r.n_links, r.component_id) for r in got} == {(1, 3, 1), (2, 3, 1), (3, 3, 1), (12, 1, 12), (14, 1, 12), *((k, 0, k) for k in (4, 5, 6, 7, 8, 9, 10, 11, 13)), (None, 0, None)}
    assert embedding.near_duplicates(spark.createDataFrame([], schema)).count() == 0
