from collections import Counter, defaultdict

from conftest import documents

from pyspark.sql import functions as F
from tessera.llm import mixing as M
from tessera.llm import sharding as S


def check_shards(rows, order, n):
    rows = sorted(rows, key=lambda r: (r.shard, r.slot))
    assert [order(r) for r in rows] == sorted(order(r) for r in rows)
    total, largest = sum(r.size for r in rows), max(r.size for r in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(s == list(range(len(s))) for s in slots.values())
    assert set(sizes) <= set(range(n)) and all(abs(sizes[k] - total / n) <= largest for k in range(n))


def test_shards_are_contiguous_and_equal(spark, rng):
    rows = [(i, rng.randrange(8, 500), "x") for i in range(2000)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, size long, pid string")
    check_shards(S.assign_shards(df, "size", ["doc_id"]).collect(), lambda r: r.doc_id, 24)


def test_one_key_holds_a_third(spark, rng):
    rows = [(5 if i % 3 == 0 else i, 10) for i in range(3000)] + [(None, 10)] * 5
    out = S.assign_shards(spark.createDataFrame(rows, "doc_id long, size long"), "size", ["doc_id"]).collect()
    assert len(out) == len(rows)
    check_shards(out, lambda r: -1 if r.doc_id is None else r.doc_id, 24)


def test_shard_query_on_odd_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert S.op8_prefix_sum_shards(spark, f"{tmp_path}/a").count() == 0
    documents(spark, [None, "", "é", "é"]).write.parquet(f"{tmp_path}/b/documents.parquet")
    got = {r.doc_id: (r.size, r.text_crc32) for r in S.op8_prefix_sum_shards(spark, f"{tmp_path}/b").collect()}
    import zlib

    assert got == {0: (8, 0), 1: (8, 0), 2: (10, zlib.crc32("é".encode())), 3: (10, zlib.crc32("é".encode()))}


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left = dict.fromkeys(order, 0.0), 1.5 * sum(sizes.values())
    open_ = set(order)
    while left > 1e-9 and open_:
        w = sum(weight[s] for s in open_)
        share, left = left, 0.0
        for s in list(open_):
            target[s] += share * weight[s] / w
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def mixed(spark, rng, limit=None):
    names = ["a", "b", None, "é", "z", "B"]
    rows = [(i, "a" if i % 3 == 0 else rng.choice(names), rng.randrange(0, 60)) for i in range(4000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("target", F.lit("clash"))
    return rows, M.mix(df, "source", "size", ["doc_id"]).collect()


def test_mix_reaches_targets_and_repeats(spark, rng, monkeypatch):
    state = rng.getstate()
    rows, out = mixed(spark, rng)
    sizes, taken = Counter(), Counter()
    for _, s, n in rows:
        sizes[s] += n
    for r in out:
        taken[r.source] += r.copies * r.size
        assert r.target == "clash" and 0 <= r.copies <= 2 and r.source_size == sizes[r.source]
    want = brute_targets(sizes)
    for s in sizes:
        assert abs(want[s] - next(r._target for r in out if r.source == s)) < 1e-6
        assert abs(taken[s] - want[s]) <= 60
    monkeypatch.setattr(M, "MAX_BROADCAST_SOURCES", 0)  # the way beyond the bound gives the same mix
    rng.setstate(state)
    again = mixed(spark, rng)[1]
    assert {(r.doc_id, r.copies) for r in again} == {(r.doc_id, r.copies) for r in out}


def test_mix_of_odd_tables(spark, tmp_path):
    documents(spark, []).write.parquet(f"{tmp_path}/a/documents.parquet")
    assert M.op10_weighted_mix(spark, f"{tmp_path}/a").count() == 0
    documents(spark, [None, "", " "]).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert all((r.size, r.taken, r.target) == (0, 0, 0.0) for r in M.op10_weighted_mix(spark, f"{tmp_path}/b").collect())


def test_rows_without_or_with_one_id_are_split(spark):
    for key in (None, 7):
        df = spark.createDataFrame([(key, "s", 20)] * 300 + [(i, "t", 20) for i in range(200)], "doc_id long, source string, size long")
        out = [r for r in M.mix(df, "source", "size", ["doc_id"]).collect() if r.source == "s"]
        assert abs(sum(r.copies * r.size for r in out) - out[0].target) <= 10


def test_no_row_exceeds_the_cap(spark):
    rows = [(i, "a", 10) for i in range(50)] + [(1000 + i, "b", 0 if i % 2 else 1) for i in range(2000)]
    out = M.mix(spark.createDataFrame(rows, "doc_id long, source string, size long"), "source", "size", ["doc_id"], weights=(1, 1000)).collect()
    assert max(r.copies for r in out) <= 2


CLASHES = ["src", "epochs", "threshold", "source_size", "target", "copies", "hash", "tie", "row", "row_key", "prefix", "rest", "shard", "slot", "pid", "salt", "start", "first", "before", "rank", "total", "bytes", "rows", "key_0"]


def test_clashing_columns_stay(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], 5 + i % 3) for i in range(60)], "doc_id long, source string, size long")
    plain = {r.doc_id: r.copies for r in M.mix(df, "source", "size", ["doc_id"]).collect()}
    wide = df.select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in CLASHES])
    mixed = M.mix(wide, "source", "size", ["doc_id"])
    assert mixed.columns == [*wide.columns, *M.added_names(wide)]
    placed = S.assign_shards(wide, "size", ["doc_id"], 4)
    assert placed.columns == [*wide.columns, "_shard", "_slot"]
    for out in (mixed, placed):
        assert all(r[c] == f"{c}{r.doc_id}" for r in out.collect() for c in CLASHES)
    assert {r.doc_id: r._copies for r in mixed.collect()} == plain
