import itertools
import re

import pytest
from conftest import documents

from tessera.llm import toxicity as X

BAD = ["grumbler", "blockhead"]


@pytest.fixture(scope="module")
def model(spark):
    import random

    rng = random.Random(1)
    plain = [a + b for a in ("mo", "ta", "ri", "sel", "pon") for b in ("ler", "ver", "nad", "ick", "th")]
    texts = []
    for i in range(900):
        words = [rng.choice(plain) for _ in range(25)]
        if i % 6 == 0:
            words.insert(rng.randrange(25), BAD[i // 6 % 2])
        texts.append(" ".join(words))
    df = documents(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(700)] + [(3, None)], "doc_id long, toxic int")
    return texts, X.fit(df, labels)


def scores(spark, model, texts):
    return {r.doc_id: r.score for r in X.score(documents(spark, texts), model).collect()}


def test_held_out_accuracy(spark, model):
    texts, fitted = model
    got = scores(spark, fitted, texts)
    assert all((got[i] >= X.THRESHOLD) == (i % 6 == 0) for i in range(700, 900))


def test_obfuscated_words_are_restored(spark, model):
    _, fitted = model
    restore = X.Restorer(fitted["trigrams"])
    assert restore("moler gr00umbler").split()[0] == "moler"
    for hidden in ("grumbl3r", "grumbleeeer", "g r u m b l e r", "bl0ckhe@d", "b.l.o.c.k.h.e.a.d"):
        word = "grumbler" if hidden[0] == "g" else "blockhead"
        assert word in restore(f"moler {hidden} tath").split(), hidden
    got = scores(spark, fitted, ["moler tath grumbl3r", "moler b l o c k h e a d tath", "moler tath", "", None])
    assert got[0] >= 0.7 and got[1] >= 0.7 and max(got[2], got[3], got[4]) < 0.3


def test_combined_obfuscations_are_restored(model):
    restore = X.Restorer(model[1]["trigrams"])
    for hidden in ("g r u m b 1 e r", "g  r  u  m  b  l  e  r", "b.l.0.c.k.h.e.a.d", "ggrruummbblleerr", "b l 0 c k h e @ d", "bb ll oo cc kk hh ee aa dd"):
        word = "grumbler" if hidden[0] == "g" else "blockhead"
        assert word in X.WORD.findall(restore(f"moler, {hidden}, tath")), hidden


def test_decoding_equals_all_paths(model, rng):
    """Of all paths through a span's lattice, Viterbi finds the likeliest."""
    trigrams = model[1]["trigrams"]

    def path_score(chosen):
        a = b = 0
        total = 0.0
        for text, cost in chosen:
            total += cost
            for c in "" if text == " " and b == 0 else text:
                z = 0 if c == " " else X._symbol(c)
                total += float(trigrams[a, b, z])
                a, b = b, z
        return total

    for _ in range(300):
        spelled = rng.random() < 0.5
        span = "".join(rng.choice("gru3mb1le@0 .") * rng.choice((1, 1, 2, 3)) for _ in range(rng.randrange(1, 7)))
        runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", span)]
        paths = list(itertools.product(*[X._options(c, n, spelled) for c, n in [*runs, ("\n", 1)]]))
        best = max(map(path_score, paths))
        texts = set()
        for p in paths:
            if path_score(p) >= best - 1e-5:
                text = ""
                for t, _ in p:
                    text += "" if t == " " and (not text or text.endswith(" ")) else t
                texts.add(text)
        assert X.restore(span, trigrams, spelled) in texts


def test_long_tokens_are_restored(model):
    restore = X.Restorer(model[1]["trigrams"])
    for token in ("grumb" + "l" * 70 + "er", ",".join(["grumbl3r"] * 20), "_".join(["grumbl3r"] * 20), "\u00a0".join(["grumbl3r"] * 20), "/".join(["moler"] * 20 + ["grumbl3r"])):
        assert "grumbler" in X.WORD.findall(restore(token)), token


def test_clean_text_is_left_as_it_is(model):
    restore = X.Restorer(model[1]["trigrams"])
    for text in ("moler tath, 1999 and 12:30!", "a b", "https://x.example/a1b2c3" * 6, ""):
        assert restore(text) == text


def test_odd_tables(spark):
    docs = documents(spark, ["a b", None])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in X.score(docs, X.fit(docs, none)).collect()} == {0.0}
    clash = docs.withColumnRenamed("source", "score")
    assert X.score(clash, X.fit(docs, none)).columns.count("score") == 1
    assert X.score(documents(spark, []), X.fit(documents(spark, []), none)).count() == 0
