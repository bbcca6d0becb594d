import pytest
from conftest import documents, edit_distance, groups_of, mangled
from pyspark.sql import functions as F

from tessera.llm import line_duplicates as L


@pytest.mark.parametrize("edits", [1, 2])
def test_distance_expression(spark, rng, edits):
    rows = []
    for _ in range(1500):
        a = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 24)))
        b = "".join(mangled(rng, a, rng.randrange(0, 4), "abé"))
        if len(b) >= 5:
            a, b = (a, b) if len(a) >= len(b) else (b, a)
            rows.append((a, b, edit_distance(a, b) <= edits))
    df = spark.createDataFrame(rows, "a string, b string, want boolean")
    assert df.where(F.expr(L.distance_within("a", "b", edits)) != F.col("want")).count() == 0


@pytest.mark.parametrize("edits, hot_key", [(1, 50), (1, 3), (1, 0), (2, 50)])
def test_join_equals_brute_force(spark, rng, edits, hot_key):
    lines = set()
    for _ in range(8):
        base = [rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 80))]
        lines |= {"".join(mangled(rng, base, rng.choice((0, 1, 1, 1, 2, 3)), "abc ")) for _ in range(30)}
    lines = sorted(x for x in lines if len(x) >= 20)
    links = [(i, j) for i in range(len(lines)) for j in range(i) if abs(len(lines[i]) - len(lines[j])) <= edits and edit_distance(lines[i], lines[j]) <= edits]
    degree = dict.fromkeys(range(len(lines)), 0)
    for a, b in links:
        degree[a] += 1
        degree[b] += 1
    rows = L.line_classes(documents(spark, lines), edits=edits, hot_key=hot_key).collect()
    assert {r.doc_id: r.n_links for r in rows} == degree
    want = groups_of(range(len(lines)), links)
    for r in rows:
        assert (r.class_doc, r.class_line) == (want[r.doc_id], 0)
        assert r.duplicate == (want[r.doc_id] != r.doc_id)


def test_texts_without_duplicates(spark):
    line, near = "the quick brown fox jumps over", "the quick brown fox jumps ower"
    texts = [f"{line}\nshort\n{line}", f"own words of the second text\n{near}", near, None, "", "short\nshort", "x" * 200_000]
    got = {r.doc_id: r for r in L.without_duplicate_lines(documents(spark, texts)).collect()}
    assert {k: r.text for k, r in got.items()} == {0: f"{line}\nshort", 1: "own words of the second text", 3: None, 4: "", 5: "short\nshort", 6: "x" * 200_000}
    assert L.without_duplicate_lines(documents(spark, [])).count() == 0
    assert L.line_classes(documents(spark, [])).count() == 0


def test_long_hot_lines(spark, rng):
    """Lines of thousands of characters under one hot segment, each one edit from the first."""
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    places = rng.sample(range(1600, 3000), 60)
    lines = [base, *(base[:p] + "X" + base[p + (i % 2) :] for i, p in enumerate(places))]
    rows = L.line_classes(documents(spark, lines), hot_key=5).collect()
    links = {(i, j) for i in range(len(lines)) for j in range(i) if edit_distance_one(lines[i], lines[j])}
    degree = [sum(i in x for x in links) for i in range(len(lines))]
    assert {r.doc_id: r.n_links for r in rows} == dict(enumerate(degree)) and degree[0] == 60
    assert {r.class_doc for r in rows} == {0}


def edit_distance_one(a, b):
    if len(a) < len(b):
        a, b = b, a
    p = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(b))
    return len(a) - len(b) <= 1 and a[p + 1 :] == (b[p + 1 :] if len(a) == len(b) else b[p:])


def test_short_lines_by_equality(spark):
    rows = L.line_classes(documents(spark, ["ab\nab\nac", "ab"])).collect()
    assert sorted((r.doc_id, r.line_no, r.class_doc, r.class_line, r.n_links, r.duplicate) for r in rows) == [(0, 0, 0, 0, 0, False), (0, 1, 0, 0, 0, True), (0, 2, 0, 2, 0, False), (1, 0, 0, 0, 0, True)]


def test_null_and_repeated_ids(spark):
    line = "a line of more than twenty characters"
    rows = [(None, line), (None, f"short\n{line}"), (None, "short\nits own line of twenty characters"), (3, "repeated row of twenty characters"), (3, "repeated row of twenty characters"), (7, line), (7, "own text of id seven, twice there")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit("x"))
    got = sorted((str(r.doc_id), r.text) for r in L.without_duplicate_lines(df).collect())
    assert got == [("3", rows[3][1]), ("7", rows[6][1]), ("None", line), ("None", "short"), ("None", rows[2][1])]


def test_clashing_columns_stay(spark):
    df = documents(spark, ["a line of more than twenty characters", "a line of more than twenty characters\nnew"])
    names = ["_cut", "_doc", "_left", "cut", "left_text", "row", "row_key", "lines", "line", "line_no", "node", "first", "class_id"]
    wide = df.select("*", *[F.concat(F.lit(c), "doc_id").alias(c) for c in names])
    out = L.without_duplicate_lines(wide)
    assert out.columns == wide.columns
    rows = out.collect()
    assert [r.text for r in sorted(rows)] == ["a line of more than twenty characters", "new"]
    assert all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
