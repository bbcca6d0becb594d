"""Toxicity by a noisy-channel deobfuscator and a classifier of restored words.

1. A character trigram model is counted over all texts (letters of any case; all else is a boundary).
2. Spans that an obfuscator may have made - digits or signs among letters, letters twice or more in a row,
   letters or signs spelled one by one, or all of these - become lattices: a sign may stand for a letter or a boundary, a run for one
   or two letters, a separator for nothing or a boundary.  Viterbi decoding picks the likeliest restoration
   under the character model and the channel's costs.  Everywhere else the lattice has one path.
3. Words and word beginnings of restored texts whose excess in toxic training rows is significant (G test
   against the number of features seen) get log odds; a logistic curve over the strongest feature and their
   number gives the score.

Labels are only read for training rows.  Training takes a sample of at most about ``MAX_TRAINING_ROWS``
labelled rows, by a hash of the id; all counts of the character model cover all rows.

Defined results for odd input: null and empty texts get the score of a text without any feature; equal
texts get equal scores; null ids are never training rows and count as not held out; where labels repeat a
row, toxic wins; without any toxic or clean training row every score is the training rate (0 without rows);
an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, written

THRESHOLD = 0.7
MAX_TRAINING_ROWS = 40_000
#: Log odds that a feature needs besides its significance.
MIN_ODDS = 2.5
PREFIXES = (4, 5)
#: Letters the character model knows: a-z, then those from U+00DF to U+00FF; other letters share the last symbol.
N_SYMBOLS = 61
#: Characters counted at once.
BLOCK = 1 << 20

#: The letters a digit or sign stands for in leetspeak.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "l", "+": "t", "€": "e", "£": "l"}
SEPARATORS = " .-_*"
#: Costs of the channel (log probabilities).
SUBSTITUTE, BOUNDARY, COLLAPSE, COLLAPSE_PAIR, DOUBLE, KEEP_PAIR, SKIP, KEEP_SEPARATOR = -1.0, -12.0, -0.7, -4.0, -1.2, -0.1, -0.5, -1.5
WORD = re.compile(r"[^\W\d_]+")
#: Tokens up to this many characters are decoded as a whole, longer ones by their runs of letters and signs.
LONG_TOKEN = 64
_SIGNS = re.escape("".join(LEET))
PIECE = re.compile(rf"(?:[^\W\d_]|[{_SIGNS}])+")
#: Boundaries at a token's ends change nothing in its decoding, so they are left out of what is remembered.
EDGES = ".,;:?\"'()[]{}<>-_*/"
ADDRESS = re.compile(r"[a-z]+://")
_INNER, _OUTER, _GAP = rf"(?:[^\W\d_]|[{_SIGNS}])", r"[^\W_]|[@$€£]", f"[{re.escape(SEPARATORS)}]+"
#: Three or more units (a letter or sign, or a run of it) with separators between; the first and last are no punctuation.
SPELLED = re.compile(rf"(?<![^\W_])(?={_OUTER})({_INNER})\1*+(?:{_GAP}({_INNER})\2*+)+{_GAP}({_OUTER})\3*+(?![^\W_])")


def _symbol_table() -> np.ndarray:
    out = np.zeros(0x250, np.uint8)
    for code in range(0x250):
        c = chr(code).lower()
        if c.isalpha() and len(c) == 1:
            if "a" <= c <= "z":
                out[code] = ord(c) - 96
            elif 0xDF <= ord(c) <= 0xFF:
                out[code] = 27 + ord(c) - 0xDF
            else:
                out[code] = N_SYMBOLS - 1
    return out


SYMBOLS = _symbol_table()
_LEET = np.zeros(0x20AD, bool)
_LEET[[ord(c) for c in LEET]] = True


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")


def symbols(codes: np.ndarray) -> np.ndarray:
    """Symbol of each code point; letters beyond the table (other scripts) are rare and count as boundaries."""
    return SYMBOLS[np.where(codes < len(SYMBOLS), codes, 0)]


@lru_cache(1 << 16)
def _symbol(char: str) -> int:
    return int(symbols(code_points(char))[0])


def char_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``code, n``: how often three symbols follow each other in all texts; each task sums its own first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(N_SYMBOLS**3, np.int64)

        def add(texts: list[str]) -> None:
            s = symbols(code_points("  ".join(["", *texts, ""]))).astype(np.int32)
            total[:] += np.bincount((s[:-2] * N_SYMBOLS + s[1:-1]) * N_SYMBOLS + s[2:], minlength=len(total))

        for batch in batches:
            held, size = [], 0
            for value in batch.column(0):
                if t := value.as_py():
                    held.append(t)
                    size += len(t)
                    if size >= BLOCK:
                        add(held)
                        held, size = [], 0
            if held:
                add(held)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["code", "n"])

    parts = df.select(F.col(f"`{text}`").cast("string")).mapInArrow(run, "code int, n long")
    return parts.groupBy("code").agg(F.sum("n").alias("n"))


def trigram_model(counts: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of c after a and b, smoothed by shorter contexts; at most ``N_SYMBOLS``^3 counts are collected."""
    n = np.zeros(N_SYMBOLS**3)
    for code, k in counts.collect():
        n[code] = k
    n = n.reshape(N_SYMBOLS, N_SYMBOLS, N_SYMBOLS)
    two, one = n.sum(0), n.sum((0, 1))
    p1 = (one + 1) / (one.sum() + N_SYMBOLS)
    p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
    p3 = (n + 5 * p2) / (n.sum(2, keepdims=True) + 5)
    return np.log(p3).astype(np.float32)


def _options(char: str, run: int, spelled: bool) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with the channel's cost."""
    if char.isalpha():
        if run == 1:
            return [(char, 0.0)]
        return [(char * 2, KEEP_PAIR if run == 2 else DOUBLE), (char, COLLAPSE_PAIR if run == 2 else COLLAPSE)]
    if char in LEET:
        return [*[(c * k, SUBSTITUTE * k) for c in LEET[char] for k in {1, min(run, 2)}], (" ", BOUNDARY)]
    if spelled and char in SEPARATORS:
        return [("", SKIP), (" ", KEEP_SEPARATOR)]
    return [(" ", 0.0)]


def restore(span: str, model: np.ndarray, spelled: bool) -> str:
    """The likeliest text behind a span: Viterbi over its lattice, states are the last two symbols."""
    runs = [(m[0][0], len(m[0])) for m in re.finditer(r"(.)\1*", span, re.DOTALL)]
    code = {" ": 0}
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    for char, run in [*runs, ("\n", 1)]:
        options = _options(char, run, spelled)
        for text, _ in options:
            for c in text:
                if c not in code:
                    code[c] = _symbol(c)
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in states.items():
            for text, cost in options:
                x, y, s = a, b, score + cost
                if text == " " and y == 0:
                    text = ""
                for c in text:
                    z = code[c]
                    s += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in after or s > after[x, y][0]:
                    after[x, y] = (s, (path, text))
        states = after
    path, out = max(states.values(), key=lambda v: v[0])[1], []
    while path is not None:
        path, text = path
        out.append(text)
    return "".join(reversed(out))


def suspicious_spans(text: str) -> list[tuple[int, int, bool]]:
    """(start, end, spelled) of spans that may be obfuscated, in order, apart; ``text`` is in lower case."""
    codes = code_points(text)
    n = len(codes)
    if n < 3:
        return []
    sym = symbols(codes)
    letter = np.concatenate([[False], sym > 0, [False] * 5])
    cp = np.concatenate([[0], codes, [0] * 5])
    here = slice(1, n + 1)
    double = letter[here] & (cp[1 : n + 1] == cp[2 : n + 2])
    leet = _LEET[np.minimum(cp, len(_LEET) - 1)]
    mixed = leet[here] & ((letter[0:n] & (letter[2 : n + 2] | leet[2 : n + 2])) | letter[2 : n + 2])
    spans = []
    if double.any() or mixed.any():
        space = np.concatenate([[-1], np.flatnonzero((codes == 32) | ((codes >= 9) & (codes <= 13))), [n]])
        at = np.flatnonzero(double | mixed)
        tokens = np.unique(np.searchsorted(space, at, "right"))
        for start, end in zip((space[tokens - 1] + 1).tolist(), space[tokens].tolist()):
            if end - start <= LONG_TOKEN:
                token = text[start:end]
                core = token.lstrip(EDGES)
                start += len(token) - len(core)
                spans.append((start, start + len(core.rstrip(EDGES)), False))
            else:
                spans += _windows(text, start, end, double | mixed)
    own = [(m.start(), m.end(), True) for m in SPELLED.finditer(text) if any(c.isalpha() for c in m[0])]
    if not own:
        return spans
    out: list[tuple[int, int, bool]] = []
    for start, end, spelled in sorted(spans + own):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]), spelled or out[-1][2])
        else:
            out.append((start, end, spelled))
    return out


def _windows(text: str, start: int, end: int, suspicious: np.ndarray) -> list[tuple[int, int, bool]]:
    """The runs of letters and signs of a long token that hold a suspicious place; an address to its end stays as it is."""
    address = ADDRESS.search(text, start, end)
    stop = address.start() if address else end
    return [(m.start(), m.end(), False) for m in PIECE.finditer(text, start, stop) if suspicious[m.start() : m.end()].any()]


class Restorer:
    """Restores texts under one character model; remembers spans it has decoded."""

    def __init__(self, model: np.ndarray, remembered: int = 300_000):
        self.model, self.remembered, self.known = model, remembered, {}

    def __call__(self, text: str) -> str:
        """The text in lower case with every suspicious span decoded."""
        text = text.lower()
        spans = suspicious_spans(text)
        if not spans:
            return text
        out, last = [], 0
        for start, end, spelled in spans:
            key = (text[start:end], spelled)
            if end - start > 4 * LONG_TOKEN:
                out += [text[last:start], restore(*key[:1], self.model, spelled)]
                last = end
                continue
            if key not in self.known:
                if len(self.known) >= self.remembered:
                    self.known.clear()
                self.known[key] = restore(*key[:1], self.model, spelled)
            out += [text[last:start], self.known[key]]
            last = end
        return "".join([*out, text[last:]])


def features(restored: str) -> set[str]:
    """Words, and the beginnings of longer words (marked by a hyphen)."""
    words = set(WORD.findall(restored))
    return words.union(*[{w[:k] + "-" for w in words if len(w) > k} for k in PREFIXES])


def _feature_counts(rows: DataFrame, model) -> DataFrame:
    """``feature, toxic, n`` over training rows (text, toxic); each task sums its own first, a bounded number at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, counts = Restorer(model.value), (Counter(), Counter())

        def flush() -> Iterator[pa.RecordBatch]:
            for toxic, c in enumerate(counts):
                if c:
                    yield pa.RecordBatch.from_arrays([pa.array(c.keys(), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(c.values(), pa.int64())], ["feature", "toxic", "n"])
                    c.clear()

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                counts[toxic].update(features(restorer(text.as_py() or "")))
                if len(counts[0]) + len(counts[1]) > 300_000:
                    yield from flush()
        yield from flush()

    return rows.select("text", "toxic").mapInArrow(run, "feature string, toxic int, n long")


def _x_log(x: F.Column, y: F.Column) -> F.Column:
    return F.when(x > 0, x * F.log(x / y)).otherwise(0.0)


def learn_features(counts: DataFrame, n_clean: int, n_toxic: int) -> dict[str, float]:
    """Log odds of all features that are significant; they come from the sample of training rows alone, which bounds their number."""
    by = written(counts.groupBy("feature").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("c")).where("t > 0"), "features")
    n_features = max(by.count(), 1)
    rate = n_toxic / (n_toxic + n_clean)
    t, c, n = F.col("t").cast("double"), F.col("c").cast("double"), F.col("t") + F.col("c")
    g = 2 * (_x_log(t, n * rate) + _x_log(c, n * (1 - rate)))
    odds = F.log((t + 0.5) / (n_toxic + 1.0)) - F.log((c + 0.5) / (n_clean + 1.0))
    kept = by.select("feature", odds.alias("odds"), g.alias("g")).where((F.col("odds") > MIN_ODDS) & (F.col("g") > 2 * math.log(n_features) + 6))
    return {r[0]: r[1] for r in kept.collect()}


def _evidence(found: set[str], odds: dict[str, float]) -> tuple[float, float]:
    hits = [odds[f] for f in found if f in odds]
    return (max(hits), math.log1p(len(hits))) if hits else (0.0, 0.0)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(df: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text", max_rows: int = MAX_TRAINING_ROWS):
    """The model as a dict: ``trigrams``, ``odds``, ``weights``.  ``labels``: doc, toxic; all its rows may be used."""
    spark = df.sparkSession
    trigrams = trigram_model(char_counts(df, text))
    shared = spark.sparkContext.broadcast(trigrams)
    labels = labels.where("toxic IN (0, 1)").groupBy(F.col(f"`{doc}`").alias("_doc")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, max_rows / max(labels.count(), 1))
    chosen = labels.where(F.pmod(F.xxhash64("_doc"), F.lit(1 << 20)) < F.lit(round(share * (1 << 20))))
    # At most about max_rows slim rows, so they can be broadcast and the texts stay where they are.
    rows = df.select(F.col(f"`{doc}`").alias("_doc"), F.col(f"`{text}`").cast("string").alias("text")).join(F.broadcast(chosen), "_doc").select("text", "toxic").groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies teach once
    rows = written(rows, "toxicity-training")
    sizes = {r[0]: r[1] for r in rows.groupBy("toxic").count().collect()}
    n_clean, n_toxic = sizes.get(0, 0), sizes.get(1, 0)
    if not n_clean or not n_toxic:
        rate = n_toxic / max(1, n_toxic + n_clean)
        return {"trigrams": trigrams, "odds": {}, "weights": None, "rate": rate}
    odds = learn_features(_feature_counts(rows, shared), n_clean, n_toxic)
    shared_odds = spark.sparkContext.broadcast(odds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        for batch in batches:
            got = [_evidence(features(restorer(v.as_py() or "")), shared_odds.value) for v in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column(1)], ["top", "many", "toxic"])

    seen = rows.mapInArrow(run, "top double, many double, toxic int").groupBy("top", "many", "toxic").count().collect()  # at most the sample
    x = np.array([[r[0], r[1]] for r in seen for _ in range(r[3])])
    y = np.array([float(r[2]) for r in seen for _ in range(r[3])])
    return {"trigrams": trigrams, "odds": odds, "weights": _logistic(x, y), "rate": n_toxic / (n_toxic + n_clean)}


def score(df: DataFrame, model: dict, text: str = "text", column: str = "score") -> DataFrame:
    """Adds the score of every whole text as ``column``; all other columns stay."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[f for f in df.schema.fields if f.name.lower() != column.lower()], T.StructField(column, T.DoubleType())])
    names = [f.name for f in schema.fields[:-1]]
    at = names.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        restorer, odds, w = Restorer(m["trigrams"]), m["odds"], m["weights"]
        for batch in batches:
            out = []
            for v in batch.column(at):
                if w is None:
                    out.append(m["rate"])
                    continue
                top, many = _evidence(features(restorer(v.as_py() or "")), odds)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, w[0] * top + w[1] * many + w[2])))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], schema.names)

    return df.select(*[F.col(f"`{n}`") for n in names]).mapInArrow(run, schema)


def held_out(doc: str = "doc_id") -> F.Column:
    """Rows whose labels are never read."""
    return F.coalesce(F.crc32(F.col(f"`{doc}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_tables(df: DataFrame, labels: DataFrame) -> dict:
    return fit(df, labels.select("doc_id", "toxic").where("doc_id IS NOT NULL").where(~held_out()))


def op1_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(docs, fit_on_tables(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
