import numpy as np
from conftest import documents, edit_distance, groups_of, mangled

from tessera.llm import near_duplicates as N


def test_banded_distance(rng):
    for _ in range(4000):
        a = [rng.randrange(4) for _ in range(rng.randrange(0, 14))]
        b = mangled(rng, a, rng.randrange(0, 6), [0, 1, 2, 3])
        most, true = rng.randrange(0, 8), edit_distance(a, b)
        assert N.banded_distance(a, b, most) == min(true, most + 1)


def test_word_hashes_and_occurrences():
    h = N.WordHashes()
    assert len(h("a b\ta  b\n")) == 4 and h("a b")[0] == h("zz a")[1] != h("A c")[1]
    assert h("A")[0] == h("a")[0]
    words = h("a b a b a b a b")
    assert len(set(N.k_mers(words, 2).tolist())) == 7 and len(N.k_mers(words[:1])) == 1
    x = N.k_mers(h(" ".join(f"w{i}" for i in range(60))))
    assert (N.order_min_hash(x) != N.order_min_hash(x[::-1])).mean() > 0.9  # order matters


def test_classes_equal_brute_force(spark, rng):
    vocabulary = [f"w{i}" for i in range(300)]
    texts = []
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 120))]
        for _ in range(rng.randrange(1, 5)):
            texts.append(" ".join(mangled(rng, base, rng.randrange(0, max(1, len(base) // 20)), vocabulary)))
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))  # a common passage is no near-duplicate
    texts += [" ".join(rng.choice(vocabulary) for _ in range(90)) + " " + shared for _ in range(30)]
    texts += ["same text here"] * 40 + ["three words only", "Three words  only", None, None, "", " \n"]
    words = [(t or "").lower().split() for t in texts]
    links = []
    for i in range(len(texts)):
        for j in range(i):
            a, b = words[i], words[j]
            if a and b and abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)):
                if edit_distance(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9):
                    links.append((i, j))
    got = {r.doc_id: r.class_id for r in N.near_duplicate_classes(documents(spark, texts)).collect()}
    assert got == groups_of(range(len(texts)), links)


def test_large_group_of_near_copies(spark, rng):
    base = [f"w{rng.randrange(400)}" for _ in range(80)]
    texts = [" ".join(mangled(rng, base, 3, ["x", "y", "z"])) for _ in range(400)]
    got = {r.class_id for r in N.near_duplicate_classes(documents(spark, texts)).collect()}
    assert got == {0}


def test_pairs_near_the_bound_share_a_sketch():
    random = np.random.default_rng(3)
    for changed, least in ((40, 0.98), (30, 0.995)):  # of 200 words: similarity 0.80 and 0.85
        met = 0
        for _ in range(400):
            a = random.integers(0, 1 << 62, 200).astype(np.uint64)
            b = a.copy()
            b[random.choice(200, changed, replace=False)] = random.integers(0, 1 << 62, changed).astype(np.uint64)
            met += bool((N.order_min_hash(N.k_mers(a)) == N.order_min_hash(N.k_mers(b))).any())
        assert met / 400 >= least


def test_hub_and_its_copies(spark, rng):
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(1000):
        copy = list(base)
        for at in rng.sample(range(200), 30):  # 0.85 to the hub, about 0.72 to each other
            copy[at] = f"x{i}y{at}"
        texts.append(" ".join(copy))
    held = {r.doc_id: set(enumerate(r.sketch)) for r in N.sketch_table(documents(spark, texts)).collect()}
    met = {i for i in held if i == 0 or held[i] & held[0]}
    got = {r.doc_id: r.class_id for r in N.near_duplicate_classes(documents(spark, texts)).collect()}
    assert {got[i] for i in met} == {0} and len(met) > 800


def test_odd_tables(spark):
    assert N.near_duplicate_classes(documents(spark, [])).count() == 0
    long = "word " * 60_000
    df = documents(spark, [long, long + "end"]).union(documents(spark, [long])).withColumnRenamed("lang", "class_id")
    assert [r.class_id for r in N.near_duplicate_classes(df).collect()] == [0, 0, 0]
    lone = spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "d e f")], "doc_id long, text string")
    assert sorted(str(r.class_id) for r in N.near_duplicate_classes(lone).collect()) == ["4", "4", "None"]


def test_similarity_bound():
    a = np.arange(100)
    b = a.copy()
    b[:20] += 1000
    assert N.similar(a, b)
    b[20] += 1000
    assert not N.similar(a, b)


def test_joined_groups_keep_all_pairs_and_compare_no_more(spark, rng):
    groups = {k: set(rng.sample(range(40), 25)) for k in range(8)} | {k: {100 + k, 101 + k} for k in range(8, 20)} | {k: {1, 2, 3} for k in range(20, 24)}
    rows = [(k, n, n % 7, n * 31) for k, nodes in groups.items() for n in nodes]
    with N.Scratch(spark) as s:
        got = N._joined(s, spark.createDataFrame(rows, "key long, node long, label long, mark long"), 0).collect()
    joined = {}
    for r in got:
        joined.setdefault(r.key, set()).add(r.node)
        assert (r.label, r.mark) == (r.node % 7, r.node * 31)
    assert len(got) == sum(map(len, joined.values())) and all(any(g <= j for j in joined.values()) for g in groups.values())
    assert sum(len(j) ** 2 for j in joined.values()) <= sum(len(g) ** 2 for g in groups.values())
    assert sum(j == {1, 2, 3} for j in joined.values()) <= 1 and len(joined) <= 21


def test_texts_with_one_passage_meet_in_few_groups(spark, rng, monkeypatch):
    vocabulary = [f"w{i}" for i in range(5000)]
    shared = " ".join(rng.choice(vocabulary) for _ in range(60))
    texts = [" ".join(rng.choice(vocabulary) for _ in range(40)) + " " + shared for _ in range(150)]
    sent, cells = [], N._cells

    def counted(groups, block_nodes):
        out = cells(groups, block_nodes)
        sent.append(out.count())
        return out

    monkeypatch.setattr(N, "_cells", counted)
    got = {r.doc_id: r.class_id for r in N.near_duplicate_classes(documents(spark, texts)).collect()}
    assert got == {i: i for i in range(150)}
    assert sum(sent) < 3 * len(texts), sent
