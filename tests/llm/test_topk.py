import numpy as np

from tessera.llm import topk as K


def brute(rows, k=20):
    ok = [(i, np.floor(64 * np.array(v, float)).astype(int)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dim = max((len(v) for _, v in ok), default=0)
    ok = [(i, np.r_[v, np.zeros(dim - len(v), int)]) for i, v in ok]
    out = {}
    for q, x in ok:
        if q % 20 == 0:
            out[q] = sorted(((-int(x @ y), i) for i, y in ok if i != q))[:k]
    return out


def run(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    v = K.scaled_vectors(df)
    out = {}
    for r in K.top_k(v.where("id % 20 = 0"), v).collect():
        out.setdefault(r.query_id, {})[r["rank"]] = (-r.score, r.vec_id)
    assert all(sorted(x) == list(range(1, len(x) + 1)) for x in out.values())
    return {q: [x[i] for i in sorted(x)] for q, x in out.items()}


def test_equals_brute_force_with_ties_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK_ROWS", 64)
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 1, (5, 8))
    rows = [(i, [float(x) for x in (centres[i % 5] + rng.normal(0, 0.05, 8))]) for i in range(600)]
    rows += [(1000 + i, [0.5] * 8) for i in range(300)]
    rows += [(2000, None), (2020, [1.0, None]), (2040, [float("nan")] * 8), (2060, [float("inf")] * 8), (2080, []), (2100, [1.0, 2.0]), (None, [1.0])]
    assert run(spark, rows) == brute(rows)


def test_few_and_no_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == {}


def test_candidates_are_skipped():
    """On clustered vectors the bound stops queries before all candidates are scored."""
    rng = np.random.default_rng(5)
    x = np.floor(64 * np.vstack([rng.normal(c, 0.02, (300, 8)) for c in rng.normal(0, 3, (8, 8))]))
    pivots = x[::150]
    far = np.sqrt(((x[:, None] - pivots[None]) ** 2).sum(2)).astype(np.float32)

    def block(at):
        out = K._Block.__new__(K._Block)
        out.ids, out.vectors, out.norms, out.pivots, out.wide = at, x[at], (x[at] ** 2).sum(1), far[at], False
        return out

    q, c = block(np.arange(0, 2400, 100)), block(np.arange(2400))
    scored = []
    whole = np.matmul
    K.np.matmul = lambda a, b: (scored.append(a.shape[0] * a.shape[1]), whole(a, b))[1]
    try:
        scores, ids = K.search_block(q, c, 5, None)
    finally:
        K.np.matmul = whole
    assert sum(scored) < 0.8 * 24 * 2400
    for i, me in enumerate(q.ids):
        want = sorted((-(x[me] @ x[j]), j) for j in range(2400) if j != me)[:5]
        assert [(-s, j) for s, j in zip(scores[i], ids[i])] == want


def test_repeated_query_ids(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(0, 1, 4)]) for i in range(100)]
    twice = [*rows, rows[0], rows[20], (40, [0.25] * 4), (7, [1.0] * 4)]
    got = run(spark, twice)
    kept = sorted(twice, key=lambda r: (r[0], [int(np.floor(64 * np.float32(x))) for x in r[1]]))
    seen, queries = set(), {}
    for i, v in kept:
        if i % 20 == 0 and i not in seen:
            seen.add(i)
            queries[i] = np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)
    for q, x in queries.items():
        want = sorted((-int(x @ np.floor(64 * np.array(v, np.float32).astype(float)).astype(int)), i) for i, v in twice if i != q)[:20]
        assert got[q] == want


def test_large_components(spark):
    rows = [(i, [float(i * 20_000.0), 1.0, -3.5]) for i in range(60)] + [(1000, [3e38, 1.0, 1.0]), (1001, [1e10, -1e10, 0.0])]
    got = run(spark, rows)
    exact = {i: [max(-(1 << 63), min((1 << 63) - 1, int(np.floor(64 * float(np.float32(x)))))) for x in v] for i, v in rows}
    cut = lambda x: max(1 - (1 << 63), min((1 << 63) - 1, x))
    for q in exact:
        if q % 20 == 0:
            want = sorted((-cut(sum(a * b for a, b in zip(exact[q], exact[j]))), j) for j in exact if j != q)[:20]
            assert got[q] == want
