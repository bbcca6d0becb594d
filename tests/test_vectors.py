import numpy as np

from tessera.operators import vectors as V


def test_core_distances_and_clusters(spark):
    rng = np.random.default_rng(1)
    x = np.vstack([rng.normal(c, 0.1, (30, 4)) for c in ((0,) * 4, (3,) * 4, (0, 3, 0, 3))] + [rng.uniform(-9, 12, (8, 4))])
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    got = {r.vec_id: r.core for r in V.core_distances(df, 2, block=16).collect()}
    assert np.allclose([got[i] for i in range(len(x))], np.sort(d, 1)[:, 1])
    labels = {r.vec_id: r.label for r in V.hdbscan(df).collect()}
    for k in range(3):
        part = {labels[i] for i in range(30 * k, 30 * k + 30)} - {-1}
        assert len(part) == 1
    assert len({labels[0], labels[30], labels[60]}) == 3


def clusters_by_definition(x, k, size):
    """Density clusters straight from the matrix of mutual reachability, level by level; -1 is noise."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d + np.diag(np.full(n, np.inf)), 1)[:, k - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None])

    def parts(members, below):
        left, out = set(members), []
        while left:
            todo, got = [left.pop()], []
            while todo:
                a = todo.pop()
                got.append(a)
                near = [b for b in left if reach[a, b] < below]
                left -= set(near)
                todo += near
            out.append(got)
        return out

    def falls_apart(members):
        inside = reach[np.ix_(members, members)]
        for level in sorted(set(inside[~np.eye(len(members), dtype=bool)]), reverse=True):
            if len(split := parts(members, level)) > 1:
                return level, split

    def best(members, birth, root=False):
        everyone, mass, now = members, 0.0, members
        while True:
            level, split = falls_apart(now)
            large = [p for p in split if len(p) >= size]
            rise = 1 / max(level, V.LEAST) - birth
            if len(large) == 1:
                mass += (len(now) - len(large[0])) * rise
                now = large[0]
                continue
            mass += len(now) * rise
            below = [best(p, 1 / max(level, V.LEAST)) for p in large]
            if root or below and sum(m for m, _ in below) > mass:
                return sum(m for m, _ in below), [g for _, gs in below for g in gs]
            return mass, [everyone]

    out = np.full(n, -1)
    for number, members in enumerate(sorted(best(list(range(n)), 0.0, True)[1], key=min)):
        out[members] = number
    return out


def test_clusters_equal_their_definition_for_any_blocks(spark):
    rng = np.random.default_rng(4)
    clouds = np.vstack([rng.normal(c, s, (m, 3)) for c, s, m in ((0, 0.1, 25), (2, 0.3, 30), (2.9, 0.1, 12), (6, 0.05, 18))] + [rng.uniform(-3, 9, (20, 3))])
    grid = np.vstack([rng.integers(0, 4, (60, 2)), rng.integers(9, 12, (30, 2)), np.full((25, 2), 30)]).astype(float)  # ties and copies
    for x in (clouds, grid, np.vstack([clouds, np.repeat(clouds[:2] + 0.123456789, 9, 0)]) * 1000.1):
        wanted = clusters_by_definition(x, 2, 5)
        df = spark.createDataFrame([(7 * i, [float(a) for a in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        for block in (20, 2048):
            got = {r.vec_id: r.label for r in V.hdbscan(df, block=block).collect()}
            assert [got[7 * i] for i in range(len(x))] == wanted.tolist()


def test_more_vectors_than_one_task_was_given(spark, monkeypatch):
    monkeypatch.setattr(V, "MOST_CLUSTERED", 100, raising=False)
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, [float(i % 3 * 9 + a) for a in rng.normal(0, 0.1, 4)]) for i in range(150)], "vec_id long, embedding array<double>")
    assert len({r.label for r in V.hdbscan(df).collect()} - {-1}) >= 3
    assert [tuple(r) for r in V.hdbscan(df.limit(3)).collect()] and V.hdbscan(df.limit(0)).count() == 0
