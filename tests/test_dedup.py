import random

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tessera.operators import dedup
from tessera.operators.components import components_and_rounds


def find_groups(n, edges):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[root(a)] = root(b)
    low = {}
    for i in range(n):
        low[root(i)] = min(low.get(root(i), i), i)
    return {i: low[root(i)] for i in range(n)}


def test_band_join_equals_brute_force(spark):
    rng = random.Random(4)
    hashes = [rng.getrandbits(64) for _ in range(60)]
    for h in list(hashes):
        for _ in range(3):
            x = h
            for _ in range(rng.randrange(0, 12)):
                x ^= 1 << rng.randrange(64)
            hashes.append(x)
    hashes = sorted(set(hashes))
    df = spark.createDataFrame([(f"{h:016x}",) for h in hashes], "id string").select("id", *dedup.halves("id"))
    for threshold, slices in ((8, None), (8, 3), (8, 9), (0, None), (5, None)):
        got = {(int(r.a, 16), int(r.b, 16), r.distance) for r in dedup.hamming_pairs(df, threshold, slices).collect()}
        want = {(a, b, (a ^ b).bit_count()) for i, a in enumerate(hashes) for b in hashes[i + 1 :] if (a ^ b).bit_count() <= threshold}
        assert got == want and (want or not threshold)
    assert (dedup.n_slices(8, 1000), dedup.n_slices(8, 2_000_000), dedup.n_slices(0, 5)) == (5, 3, 1)


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 14), st.integers(0, 14)).filter(lambda e: e[0] != e[1]), min_size=1, max_size=14))
def test_components_equal_union_find(spark, edges):
    got = {r.node: r.label for r in dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = find_groups(15, edges)
    assert got == {k: v for k, v in want.items() if k in got} and set(got) == {x for e in edges for x in e}


def test_rounds_of_long_chains(spark):
    n = 2000
    random_order = list(range(n))
    random.Random(1).shuffle(random_order)
    sawtooth = [i // 2 if i % 2 == 0 else n - 1 - i // 2 for i in range(n)]
    for order in (list(range(n)), random_order, sawtooth):
        out, rounds = components_and_rounds(spark.createDataFrame(list(zip(order, order[1:])), "a long, b long"))
        assert rounds <= 14
        assert out.where("label <> 0").isEmpty() and out.count() == n


def test_links_to_oneself_and_none(spark):
    assert dedup.components(spark.createDataFrame([(3, 3)], "a long, b long")).isEmpty()
    assert {(r.node, r.label) for r in dedup.components(spark.createDataFrame([(3, 3), (5, 4), (4, 5)], "a long, b long")).collect()} == {(5, 4), (4, 4)}


def test_winner_order(spark):
    rows = [("a", 500, 500, 100, False, 1.0, "g"), ("b", 1000, 1000, 50, False, None, "g"), ("c", 500, 500, 200, False, 9.0, "g"), ("d", 2000, 2000, 9, True, 1.0, "g"), ("e", 8, 8, 5, False, None, "h"), ("f", 8, 8, 5, False, 0.0, "h")]
    df = spark.createDataFrame(rows, "path string, width int, height int, file_size long, upscale boolean, blur double, grp string")
    won = lambda prefer: {r.grp: r.path for r in dedup.winners(df, prefer).where("winner").collect()}
    assert won(False) == {"g": "b", "h": "e"}
    assert won(True)["g"] == "d"
