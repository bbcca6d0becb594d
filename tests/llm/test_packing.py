import zlib

import numpy as np
import pytest
from conftest import documents

from tessera.llm import packing as P

public_tokenizers = pytest.importorskip("public_tokenizers")


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), P.WordEncoder(path, remembered=50)
    texts = ["it's a_b ._x... 12²3 don't", "Émile ÀÉ!!?? x²y ½ ____ --_--", "a\x1cb\x85c\xa0d", "<|endoftext|> hi", "ß ſ ŀ ñ ñ İs ΑΣ", "tab\tnew\x0bx", "ª º µ ¼", "", " \n ", "漢字 and Latin", "the quick brown fox " * 40]
    for text in texts * 2:
        assert np.frombuffer(own(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_one_encoder_over_many_texts(rng):
    """What an encoder remembers from one text must not change another's ids."""
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    whole, own = Tokenizer.from_file(path), P.WordEncoder(path)
    bits = ["don't", "know", "I", "i", "\t", "\x0c", "\u00a0", "\u3000", "中1", "中", "it's", "'s", "x²", "é", "e\u0301", "\u0301", "ſ", "İ", "<|endoftext|>", "_", "--", "a_b", "7", "'", "ß", "\x85", "", "WORD", "😀", "नमस्ते", "ﬁ", "\u200b"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", "\n", "\t", "  "]) for _ in range(rng.randrange(1, 8))) for _ in range(50_000)]
    got = [np.frombuffer(own(t), "<u4").tolist() for t in ["\t don't", "中1 \u3000", *texts, "I don't know", "中1"]]
    want = [e.ids for e in whole.encode_batch(["\t don't", "中1 \u3000", *texts, "I don't know", "中1"], add_special_tokens=False)]
    assert got == want


class NaiveBestFit:
    """Scans all open bins for the least free space that holds a length."""

    def __init__(self, capacity, most_open):
        self.capacity, self.most_open, self.open, self.n = capacity, most_open, {}, 0

    def place(self, length):
        fits = [f for f in self.open.values() if f >= length]
        if fits:
            free = min(fits)
            # Of equally full bins the one that came to that space last is taken.
            number = [b for b, f in self.open.items() if f == free][-1]
        else:
            if len(self.open) >= self.most_open:
                fullest = min(self.open.values())
                del self.open[[b for b, f in self.open.items() if f == fullest][-1]]
            free, number, self.n = self.capacity, self.n, self.n + 1
        self.open.pop(number, None)
        if free > length:
            self.open[number] = free - length
        return number, self.capacity - free


def test_packer_equals_a_naive_one(rng):
    for capacity, most_open in ((50, 3), (200, 16), (2048, 1024)):
        packer, naive = P.BoundedBestFit(capacity, most_open), NaiveBestFit(capacity, most_open)
        for _ in range(4000):
            n = rng.randrange(1, capacity + 1)
            assert packer.place(n) == naive.place(n)


def test_bounded_best_fit(rng):
    packer, bins = P.BoundedBestFit(100, most_open=4), {}
    for _ in range(3000):
        n = rng.randrange(1, 101)
        number, offset = packer.place(n)
        assert bins.get(number, 0) == offset and offset + n <= 100
        bins[number] = offset + n
        assert packer.n_open <= 4
    packer = P.BoundedBestFit(10, 2)
    assert [packer.place(n)[0] for n in (6, 7, 3, 8, 4)] == [0, 1, 1, 2, 0]
    packer = P.BoundedBestFit(10, 1)
    assert [packer.place(n)[0] for n in (6, 7, 3, 8, 4)] == [0, 1, 1, 2, 3]  # the fullest closed


def test_pieces_and_places(spark):
    from tokenizers import Tokenizer

    texts = [None, "", "a b c", "word " * 5000, "word " * 2047, "word " * 2048] + [f"doc {i} " * (i % 90) for i in range(300)]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = P.pack_documents(documents(spark, texts)).collect()
    by, used = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for doc, text in enumerate(texts):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        parts = sorted(by[doc], key=lambda r: r.piece)
        assert [i for r in parts for i in r.ids] == want and [r.piece for r in parts] == list(range(len(parts)))
        assert all(r.length == 2048 for r in parts[:-1]) and [r.start for r in parts] == [2048 * k for k in range(len(parts))]
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    tokens = sum(r.length for r in rows)
    assert len(used) <= tokens / 2048 + 3
    assert P.pack_documents(documents(spark, [])).count() == 0
