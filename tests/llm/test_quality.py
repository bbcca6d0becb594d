import re

from conftest import documents  # noqa: I001

from tessera.llm import quality as Q

WORD = re.compile("[^\\x20\\x09-\\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    seen, hit = {}, set()
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(5)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in lines
            lines.add(line)
    n, repeated = len(words), len(hit)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, repeated, n < 10 or 100 * repeated > 20 * n


def test_counts_equal_brute_force(spark, rng):
    texts = [None, "", " \n\t", "a", "a b c d e a b c d e", "x y z\x0bq", "🙂 # é" * 4, "w " * 3000]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", "the ", " ", "\n", "\t", "#", "cd ", "<x> ", "é "]) for _ in range(rng.randrange(0, 120))))
    rows = Q.judge(documents(spark, texts).withColumnRenamed("lang", "_words"), keep=["doc_id"]).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(texts[r.doc_id]), texts[r.doc_id]
        assert not (r.base_failed and r.kept)


def test_verdicts(spark):
    clean = "the cat sat on the mat and it was happy with all that it had seen there in the sun"
    junk = "## ** $$ %% && || << >> @@ ## ** $$ x1 y2 z3 k4"
    got = {r.doc_id: r.kept for r in Q.judge(documents(spark, [clean, junk, clean + "\n" + clean]), keep=["doc_id"]).collect()}
    assert got == {0: True, 1: False, 2: False}


def test_empty_table(spark):
    assert Q.judge(documents(spark, []), keep=["doc_id"]).count() == 0
