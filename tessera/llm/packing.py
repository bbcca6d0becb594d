"""Packing token sequences: bounded-space online best-fit.

Texts become token ids in Arrow batches; pieces (slim rows) are dealt over tasks by hash and packed there.
A packer holds at most ``OPEN_BINS`` open bins.  A bitset (one integer) marks the free spaces that some open
bin has; the lowest set bit at or above a piece's length is the best fit.  Where none fits, a bin opens, and
if that is one too many, the fullest closes for good.

Defined results for odd input: a null text is an empty one (its ids are the closing id alone); empty texts
give one piece of one token; very long texts are cut into pieces of the full length, only the last may be
shorter; equal rows are packed as often as they occur; an empty table gives an empty table.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, unused, with_row_key

MAX_TOKENS = 2048
END_ID = 0
OPEN_BINS = 1024
#: Pieces that one packing task takes, about; each task leaves at most its open bins part full.
PIECES_PER_TASK = 50_000
#: Words whose ids a worker remembers; beyond, it forgets all and starts again.
REMEMBERED_WORDS = 1_000_000


#: Texts of these characters only, without what follows, are cut at every change between letters and other signs.
_BEYOND_LATIN = re.compile("[^\t-\r\x20-\x7e\xa0-ɏ]|[İ']|<\\|")
_RUNS = re.compile(r"[^\W\d_]+|(?:[^\w\s]|_)+|\d")


class WordEncoder:
    """Token ids of texts as little-endian unsigned 32-bit integers.

    For tokenizers that lower case, drop white space and never join over it or over a change from letters to
    other signs (apart from apostrophes and special tokens): a text's ids are those of its parts in order,
    and the ids of parts seen before are remembered.  Texts with other than Latin letters, apostrophes or
    special tokens are cut at spaces only.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.remembered, self.known = Tokenizer.from_file(path), remembered, {"": b""}

    def __call__(self, text: str) -> bytes:
        if _BEYOND_LATIN.search(text):
            parts = text.replace("\n", " ").split(" ")
        else:
            parts = _RUNS.findall(text.lower())
        known = self.known
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        if len(known) > self.remembered:
            known.clear()
            known[""] = b""
        new = [p for p in dict.fromkeys(parts) if p not in known]
        self._learn(new)
        return b"".join([known[p] for p in parts])

    def _learn(self, new: list[str]) -> None:
        """All new parts in one call; a token belongs to the part in which it starts, by the tokenizer's offsets."""
        joined = " ".join(new)
        got = self.tokenizer.encode(joined, add_special_tokens=False)
        ids = array("I", got.ids).tobytes()
        first, n, at = 0, len(got.ids), 0
        spans, shared = got.offsets, False
        for part in new:
            end = at + len(part)
            last = first
            while last < n and spans[last][0] < end:
                shared |= spans[last][1] > end or spans[last][0] < at
                last += 1
            self.known[part] = ids[4 * first : 4 * last]
            first, at = last, end + 1
        if shared or first < n:  # a token that spans parts tells nothing about either: each part on its own
            for part, one in zip(new, self.tokenizer.encode_batch(new, add_special_tokens=False)):
                self.known[part] = array("I", one.ids).tobytes()


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder a worker process: later tasks go on with the words that earlier ones have met."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


class BoundedBestFit:
    """Places lengths one after another; holds at most ``most_open`` bins."""

    def __init__(self, capacity: int = MAX_TOKENS, most_open: int = OPEN_BINS):
        self.capacity, self.most_open = capacity, most_open
        self.free_set = 0  # bit f: some open bin has f free places
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = self.n_bins = 0

    def _take(self, free: int) -> int:
        stack = self.bins[free]
        number = stack.pop()
        if not stack:
            self.free_set &= ~(1 << free)
        self.n_open -= 1
        return number

    def place(self, length: int) -> tuple[int, int]:
        """The bin's number and the place in it."""
        fitting = self.free_set >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            number = self._take(free)
        else:
            if self.n_open >= self.most_open:  # the fullest closes
                self._take((self.free_set & -self.free_set).bit_length() - 1)
            free, number = self.capacity, self.n_bins
            self.n_bins += 1
        if rest := free - length:
            self.bins[rest].append(number)
            self.free_set |= 1 << rest
            self.n_open += 1
        return number, self.capacity - free


def cut_into_pieces(df: DataFrame, doc: str, text: str, tokenizer: str, max_tokens: int = MAX_TOKENS, with_ids: bool = True) -> DataFrame:
    """``doc, piece, start, length, ids_crc32`` and, if asked for, ``ids`` (array of int) of every text."""
    fields = [df.schema[doc], T.StructField("piece", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32")]]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []
    end = array("I", [END_ID]).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows, pieces, starts, lengths, crcs, ids = [], [], [], [], [], []
            for row, value in enumerate(batch.column(1)):
                data = encode(value.as_py() or "") + end
                for k, at in enumerate(range(0, len(data), 4 * max_tokens)):
                    part = data[at : at + 4 * max_tokens]
                    rows.append(row)
                    pieces.append(k)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    crcs.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(array("i", part))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return df.select(F.col(f"`{doc}`"), F.col(f"`{text}`").cast("string")).mapInArrow(run, T.StructType(fields))


def pack(pieces: DataFrame, length: str = "length", capacity: int = MAX_TOKENS, most_open: int = OPEN_BINS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to rows with a ``length`` of 1 to ``capacity``.

    Rows are dealt by a row key, so ids that repeat or are null spread like any others.
    """
    names = pieces.columns
    (key,) = unused(pieces, "row_key")
    pieces = with_row_key(pieces, key, "pieces")
    n_tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))
    schema = T.StructType([*[pieces.schema[n] for n in names], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])
    at = names.index(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, first = BoundedBestFit(capacity, most_open), TaskContext.get().partitionId() << 32
        for batch in batches:
            placed = [packer.place(n) for n in batch.column(at).to_pylist()]
            numbers = pa.array([first + n for n, _ in placed], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], numbers, pa.array([o for _, o in placed], pa.int64())], schema.names)

    dealt = pieces.repartition(n_tasks, key)
    return dealt.sortWithinPartitions(F.xxhash64(key), key).mapInArrow(run, schema)


def pack_documents(df: DataFrame, doc: str = "doc_id", text: str = "text", tokenizer: str | None = None, max_tokens: int = MAX_TOKENS, with_ids: bool = True) -> DataFrame:
    """All texts as pieces in sequences of at most ``max_tokens``."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    pieces = cut_into_pieces(df, doc, text, tokenizer, max_tokens, with_ids)
    return pack(pieces, "length", max_tokens)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pack_documents(docs, with_ids=False).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
