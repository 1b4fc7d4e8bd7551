"""Token output and token counts against the libraries, byte for byte."""

import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from foliant.llm import _blocks, _segments, token_counts, token_output

from ._rows import prose, table, texts

BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_ids_round_trip(spark):
    library = Tokenizer.from_file(BPE)
    got = sorted(token_output.write_and_read(table(spark), BPE).collect(), key=lambda r: r.start)
    ids = [(r[0], library.encode(r[1] or "", add_special_tokens=False).ids + [2]) for r in texts()]
    packed = lambda x: zlib.crc32(np.array(x, "<u4").tobytes())
    assert Counter((g.doc_id, g.n_tokens, g.ids_crc32) for g in got) == Counter((d, len(x), packed(x)) for d, x in ids)
    assert [g.start for g in got] == np.cumsum([0, *(g.n_tokens for g in got[:-1])]).tolist()
    keys = [-1 if g.doc_id is None else g.doc_id for g in got]
    assert keys == sorted(keys)


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_huffman(n):
    rng = np.random.default_rng(n)
    counts = np.zeros(n + 9, np.int64)
    counts[4 : 4 + n] = rng.zipf(1.3, n).clip(max=10**9)
    limit = max(16, n.bit_length() + 1)
    lengths = token_output.code_lengths(counts, limit)
    assert lengths.max() <= limit and sum(2.0 ** -int(x) for x in lengths[lengths > 0]) <= 1
    code = token_output.Code(lengths, limit)
    for size in (0, 1, 1023, 1024, 1025, 5000):
        ids = rng.integers(4, 4 + n, size)
        shard = token_output.pack_shard(code, np.array([7, -3]), np.array([False, True]), np.array([size, 0]), ids)
        doc, null, per, back = token_output.unpack_shard(shard)
        assert doc.tolist() == [7, -3] and null.tolist() == [0, 1] and per.tolist() == [size, 0] and (back == ids).all()


def test_length_limit_is_optimal():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34])
    free, tight = token_output.code_lengths(counts, 16), token_output.code_lengths(counts, 4)
    heap, cost = sorted(counts.tolist()), 0
    while len(heap) > 1:
        both = heap.pop(0) + heap.pop(0)
        cost += both
        heap = sorted([*heap, both])
    assert (counts * free).sum() == cost
    assert tight.max() == 4 and sum(2.0 ** -int(x) for x in tight) == 1


def test_counts(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    got = token_counts.prefix_counts(table(spark), PIECES).collect()
    assert Counter((g.doc_id, g.n_bytes, g.n_tokens) for g in got) == Counter((r[0], len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in texts())


def test_every_prefix(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    text = prose(40, 8) + "  two\n\n spaces " + "ab-cd" * 90
    (row,) = token_counts.prefix_counts(spark.createDataFrame([(1, text)], "doc_id long, text string"), PIECES).collect()
    want = [len(library.encode(text[:j])) for j in range(len(text) + 1)]
    cut = text.index("ab-cd")
    assert [token_counts.count_at(row.steps, j) for j in range(cut)] == want[:cut] and token_counts.count_at(row.steps, len(text)) == want[-1]
    assert token_counts.longest_within(row.steps, 20) == max(j for j in range(cut) if want[j] <= 20)


def test_every_prefix_of_marks_and_long_runs(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    rng = random.Random(3)
    texts = [" ▁▁mark " + prose(10, 4) + "▁ end▁", "head " + "".join(rng.choice("abetinsor") for _ in range(400)), "".join(rng.choice("aeß中Ωst\U0001f600") for _ in range(300)), " " * 300 + "x", "-=" * 200]
    long = ["b" * 100_000, "▁ " + "x " * 40_000]
    rows = token_counts.prefix_counts(spark.createDataFrame(list(enumerate(texts + long)), "doc_id long, text string"), PIECES).collect()
    for r in rows:
        text = (texts + long)[r.doc_id]
        assert r.n_tokens == len(library.encode(text)) == token_counts.count_at(r.steps, len(text))
        at = range(len(text) + 1) if r.doc_id < len(texts) else (1, 300, 70_001)
        want = [len(library.encode(text[:j])) for j in at]
        assert [token_counts.count_at(r.steps, j) for j in at] == want
        if r.doc_id < len(texts):
            assert token_counts.longest_within(r.steps, 9) == max(j for j in at if want[j] <= 9)
    assert max(r.n_tokens for r in rows) > 32767


def test_empty_tables(spark):
    assert token_output.write_and_read(table(spark, []), BPE).count() == 0
    assert token_counts.prefix_counts(table(spark, []), PIECES).count() == 0


def _complementary(n: int = 1024) -> tuple[str, str]:
    """Two words of the same length whose polynomial hashes modulo 2**64 are equal for every odd base."""
    marks = [k.bit_count() & 1 for k in range(n)]
    return "".join("ab"[m] for m in marks), "".join("ba"[m] for m in marks)


def test_words_that_weak_hashes_confuse(spark):
    one, two = _complementary()
    for at in (0, 1, 40_000):
        buf = np.frombuffer((" " * at + one + " " + two).encode(), np.uint8)
        start = np.array([at, at + 1025])
        h = _blocks.span_hash(_blocks.prefix_sums(buf), start, start + 1024)
        assert h[0] != h[1]
        again = _blocks.span_hash(_blocks.prefix_sums(buf[at:]), start - at, start - at + 1024)
        assert (h == again).all()
    rows = [(1, one), (2, two), (3, f"x {one} y"), (4, f"x {two} y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    library, pieces = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    crc = lambda t: zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 2], "<u4").tobytes())
    assert {(r.doc_id, r.ids_crc32) for r in token_output.write_and_read(docs, BPE).collect()} == {(d, crc(t)) for d, t in rows}
    assert {(r.doc_id, r.n_tokens) for r in token_counts.prefix_counts(docs, PIECES).collect()} == {(d, len(pieces.encode(t))) for d, t in rows}


def test_segments_with_equal_hashes():
    table_ = _segments.SegmentTable(np.uint32)
    buf = np.frombuffer(b"one two six one", np.uint8)
    start, end = np.array([0, 4, 8, 12]), np.array([3, 7, 11, 15])
    same = np.full(4, 5, np.uint64)
    for _ in range(2):
        at, size = table_.lookup(buf, start, end, same, lambda texts_: [[ord(c) for c in t] for t in texts_])
        assert bytes(table_.gather(at, size).astype(np.uint8)) == b"onetwosixone"
