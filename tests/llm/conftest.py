import random

import pytest


@pytest.fixture
def rng():
    return random.Random(7)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def mangled(rng, items, edits, alphabet):
    out = list(items)
    for _ in range(edits):
        at, kind = rng.randrange(len(out) + 1), rng.random()
        if kind < 0.33 or not out:
            out.insert(at, rng.choice(alphabet))
        elif kind < 0.66:
            out.pop(at % len(out))
        else:
            out[at % len(out)] = rng.choice(alphabet)
    return out


def groups_of(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    low = {}
    for i in ids:
        low[root(i)] = min(low.get(root(i), i), i)
    return {i: low[root(i)] for i in ids}


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, source=None):
    rows = [(i, t, "en", (source or (lambda i: f"s{i % 3}"))(i), len(t) if t is not None else None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCUMENTS)
