import random

import pytest
from conftest import documents
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, tmp_path):
    rng = random.Random(2)
    plain = [a + b for a in ("mo", "ta", "ri", "sel", "pon", "ka") for b in ("ler", "ver", "nad", "ick", "th", "lo")]
    text = lambda n: " ".join(rng.choice(plain) for _ in range(n))
    texts = [text(40) for _ in range(400)]
    for i in range(0, 200, 5):
        texts[i] += " blockhead"
    shared = text(60)
    texts += [f"{text(30)}\n{shared}\n{text(30)}" for _ in range(10)]
    near = text(50)
    texts += [near, near + " more", near]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 200 and i % 5 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    ids = {name: {r.doc_id for r in rows} for name, rows in kept.items()}
    assert ids["toxicity"] == {i for i in range(len(texts)) if not (i < 200 and i % 5 == 0)}
    after = {r.doc_id: r for r in kept["line_dedup"]}
    assert ids["line_dedup"] == ids["toxicity"] - {len(texts) - 1}  # an exact copy has no line of its own
    assert shared in after[400].text and not any(shared in after[i].text for i in range(401, 410))
    assert all(r.n_chars == len(r.text) for r in after.values())
    assert ids["near_dedup"] == ids["line_dedup"] - {len(texts) - 2}
    copies = {}
    for r in kept["mixing"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert set(copies.values()) <= {1, 2} and set(copies) <= ids["near_dedup"]
    assert sorted(r.doc_id for r in kept["packing"] if r.piece == 0) == sorted(r.doc_id for r in kept["mixing"])


def test_odd_rows(spark, tmp_path):
    rng = random.Random(5)
    words = [a + b for a in ("mo", "ta", "ri", "sel", "pon", "ka") for b in ("ler", "ver", "nad", "ick", "th", "lo")]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    one, own, other, twice = (text(40) for _ in range(4))
    rows = [(1, one), (7, one), (7, own), (None, one), (None, other), (5, twice), (5, twice), (8, None), (9, "")]
    docs = spark.createDataFrame([(i, t, "en", None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["target", "source_size", "copies", "mix_size", "row_key", "class_id", "score", "key", "row", "toxicity"]
    docs = docs.select("*", *[F.lit(c).alias(c) for c in clash])
    spark.createDataFrame([(1, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    (tmp_path / "x").mkdir()
    stages = dict(corpus_pipeline.STAGES)
    kept = lambda df: sorted(((str(r.doc_id), r.text) for r in df.collect()), key=lambda x: (x[0], x[1] or ""))
    assert kept(stages["toxicity"](spark, docs, str(tmp_path))) == sorted(((str(i), t) for i, t in rows), key=lambda x: (x[0], x[1] or ""))
    lines = stages["line_dedup"](spark, docs, str(tmp_path))
    assert kept(lines) == sorted([("None", one), ("7", own), ("None", other), ("5", twice), ("8", None), ("9", "")], key=lambda x: (x[0], x[1] or ""))
    near = stages["near_dedup"](spark, docs, str(tmp_path))
    assert kept(near) == sorted([("1", one), ("7", own), ("None", other), ("5", twice), ("8", None), ("9", "")], key=lambda x: (x[0], x[1] or ""))
    mixed = stages["mixing"](spark, docs, str(tmp_path))
    for out in (lines, near, mixed):
        assert out.columns == docs.columns
        assert all(r[c] == c for r in out.collect() for c in clash)
    assert abs(sum(len(r.text.split()) for r in mixed.collect() if r.text) - 420) <= 20  # 150 % of 280 words, off by half a document at most
    pieces = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert len(pieces) == len(rows)
    none = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0
