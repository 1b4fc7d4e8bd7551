"""Token ids as compact binary: canonical length-limited Huffman coding.

Global counts of the ids give code lengths by package-merge, none above a
limit; the canonical code needs only these lengths.  Documents are dealt by
range of doc_id and written in ascending order.  A *shard* holds the ids of
whole documents in one bit string; every ``BLOCK`` ids a checkpoint says at
which bit the next block starts, so blocks decode independently of each other,
by table: all blocks of a shard take a step at a time, each looking up its
next ``limit`` bits.

Layout of a shard (little-endian): ``FHUF``, u8 version, u8 limit, u16 0,
u32 symbols, u32 documents, u64 ids, u32 blocks, u32 bytes of the deflated
length table; that table (one u8 a symbol); documents as i64 doc_id, u8 null
flag and u32 number of ids; blocks as u64 bit offset; the bits, first bit
highest.  Shards are the rows of a Parquet folder: Spark's committer makes
each task's output appear whole or not at all in any store.

Rules for unusual rows: a null or empty text has only the end id.  Rows that
share a doc_id follow each other, ordered by their ids, so that the result is
the same in every run.  A null doc_id comes first.  Columns besides doc_id and
text are ignored.  No rows give no shards and no rows.
"""

from __future__ import annotations

import json
import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._blocks import chunks, lean, prefix_sums, span_hash
from ._segments import SegmentTable
from ._tables import drop_path, load, new_path

END_ID, BLOCK, SHARD = 2, 1024, 1 << 19
#: Bytes of text that are encoded at a time, and pre-tokens whose ids a worker keeps.
CHUNK, KNOWN = 1 << 19, 50_000
HEAD = struct.Struct("<4sBBHIIQII")
U64 = np.uint64
#: The pattern of byte-level pre-tokenizers (a fixed value of the file format).
PRETOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


def byte_symbols() -> dict[int, str]:
    """The printable stand-ins that byte-level vocabularies use: printable Latin-1 as itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in shown}
    table.update({b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in table)})
    return table


class Encoder:
    """A tokenizer file with the table of the segments that it has met."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.by_segment = spec["model"]["type"] == "BPE" and not spec.get("normalizer") and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not spec["model"].get("dropout")
        self.special = [t["content"].encode() for t in spec.get("added_tokens") or []]
        self.symbols = str.maketrans({chr(b): c for b, c in byte_symbols().items()})
        self.space = byte_symbols()[32]
        self.model = self.tokenizer.model
        self.table = SegmentTable(np.uint32)
        self.known: dict[str, list[int]] = {}

    def whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def segments(self, texts: list[str]) -> list[list[int]]:
        known, table, tokenise = self.known, self.symbols, self.model.tokenize
        if len(known) > KNOWN:
            known.clear()
        out = []
        for text in texts:
            # a space and letters are one pre-token, and the space has a stand-in of its own
            if text[:1] == " " and text[1:].isalpha():
                out.append([t.id for t in tokenise(self.space + text[1:] if text.isascii() else text.encode().decode("latin-1").translate(table))])
                continue
            run: list[int] = []
            for p in PRETOKEN.findall(text):
                got = known.get(p)
                if got is None:
                    got = known[p] = [t.id for t in tokenise(p.encode().decode("latin-1").translate(table))]
                run += got
            out.append(run)
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _cuts(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Starts of segments: text starts, and single spaces between two characters that are surely no white space."""
    pad = np.zeros(len(buf) + 8, np.uint8)
    pad[4:-4] = buf
    here = [pad[4 + k : 4 + k + len(buf)] for k in range(-3, 2)]
    p3, p2, p1, _, after = here
    tail = (p1 & 0xC0) == 0x80
    before = ((p1 > 0x20) & (p1 < 0x7F)) | (tail & (p2 >= 0xC3) & (p2 <= 0xDF)) | (tail & ((p2 & 0xC0) == 0x80) & ((p3 == 0xE0) | ((p3 >= 0xE4) & (p3 <= 0xEF))))
    follows = ((after > 0x20) & (after < 0x7F)) | ((after >= 0xC3) & (after <= 0xE0)) | ((after >= 0xE4) & (after <= 0xF4))
    cut = (buf == 32) & before & follows
    ends = np.unique(off[1:-1])
    cut[ends[(ends > 0) & (ends < len(buf))] - 1] = False
    starts = off[:-1][np.diff(off) > 0]
    cut[starts] = True
    return np.flatnonzero(cut)


def encode_texts(model: Encoder, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, and the number of each text."""
    n = len(off) - 1
    counts, data = np.zeros(n, np.int64), None
    if not model.by_segment or any(s in (data := data or buf.tobytes()) for s in model.special):
        data = data or buf.tobytes()
        odd = [i for i in range(n) if not model.by_segment or any(s in data[off[i] : off[i + 1]] for s in model.special)]
    else:
        odd = []
    flat = np.zeros(0, np.uint32)
    if model.by_segment and len(buf):
        start = _cuts(buf, off)
        end = np.r_[start[1:], len(buf)]
        at, size = model.table.lookup(buf, start, end, span_hash(prefix_sums(buf), start, end), model.segments)
        flat = model.table.gather(at, size)
        full = np.diff(off) > 0
        counts[full] = np.add.reduceat(size, np.searchsorted(start, off[:-1][full]))
    if odd:
        edges = np.r_[0, np.cumsum(counts)]
        runs = [flat[edges[i] : edges[i + 1]] for i in range(n)]
        for i in odd:
            runs[i] = np.array(model.whole(data[off[i] : off[i + 1]].decode()), np.uint32)
        counts, flat = np.array([len(r) for r in runs], np.int64), np.concatenate(runs)
    return flat, counts


def _encoded(path: str, end_id: int | None, width: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = encoder(path)
        for rows, buf, off in chunks(batches, max_bytes=CHUNK):
            flat, counts = encode_texts(model, buf, off)
            edges = np.r_[0, np.cumsum(counts)]
            if end_id is not None:
                flat = np.insert(flat, edges[1:], end_id)
                edges = edges + np.arange(len(edges))
            flat = flat.astype(width)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([flat[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary())], ["doc_id", "ids"])

    return lean(run)


def code_lengths(counts: np.ndarray, limit: int) -> np.ndarray:
    """Lengths of an optimal code none of which is above ``limit``; 0 where the count is 0 (package-merge)."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n <= 1:
        out[used] = 1
        return out
    if n > 1 << limit:
        raise ValueError(f"{n} symbols don't fit codes of {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    row, marks = leaves, [np.ones(n, bool)]
    for _ in range(limit - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(1)
        row = np.concatenate([leaves, pairs])
        sort = np.argsort(row, kind="stable")
        row = row[sort]
        marks.append(sort < n)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for mark in reversed(marks):
        single = int(mark[:take].sum())
        lengths[:single] += 1
        take = 2 * (take - single)
    out[order] = lengths
    return out


class Code:
    """The canonical code of a length table."""

    def __init__(self, lengths: np.ndarray, limit: int) -> None:
        self.lengths, self.limit = lengths, limit
        used = np.flatnonzero(lengths)
        order = used[np.argsort(lengths[used], kind="stable")]
        span = 1 << (limit - lengths[order].astype(np.int64))
        self.left = np.zeros(len(lengths), U64)  # codes, shifted to the top of ``limit`` bits
        self.left[order] = (np.cumsum(span) - span).astype(U64)
        self.table = np.zeros(1 << limit, np.uint32)
        self.table[: span.sum()] = np.repeat(order, span)
        self.packed = zlib.compress(lengths.tobytes(), 6)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """The bits, and the bit at which each block starts."""
        size = self.lengths[ids].astype(np.int64)
        at = np.cumsum(size) - size
        total = int(size.sum())
        words = np.zeros(total // 32 + 2, U64)
        value = self.left[ids] << (U64(64 - self.limit) - (at & 31).astype(U64))
        word = at >> 5
        if len(ids):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            words[word[first]] |= np.bitwise_or.reduceat(value >> U64(32), first)
            words[word[first] + 1] |= np.bitwise_or.reduceat(value & U64(0xFFFFFFFF), first)
        return words.astype(">u4").tobytes()[: (total + 7) // 8], at[::BLOCK].astype(np.uint64)

    def decode(self, data: bytes, blocks: np.ndarray, n: int) -> np.ndarray:
        words = np.frombuffer(data + bytes(12 - len(data) % 4), ">u4").astype(U64)
        pairs = (words[:-1] << U64(32)) | words[1:]
        out = np.zeros((len(blocks), BLOCK), np.uint32)
        at, down = blocks.astype(np.int64), 64 - self.limit
        last = n - (len(blocks) - 1) * BLOCK if len(blocks) else 0
        lengths, table = self.lengths.astype(np.int64), self.table
        for step in range(min(BLOCK, n)):
            live = at if step < last else at[:-1]
            got = table[(pairs[live >> 5] << (live & 31).astype(U64)) >> U64(down)]
            out[: len(live), step] = got
            live += lengths[got]
        return out.ravel()[:n]


def pack_shard(code: Code, doc: np.ndarray, null: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> bytes:
    bits, blocks = code.encode(ids)
    head = HEAD.pack(b"FHUF", 1, code.limit, 0, len(code.lengths), len(doc), len(ids), len(blocks), len(code.packed))
    return b"".join([head, code.packed, doc.astype("<i8").tobytes(), null.astype("u1").tobytes(), counts.astype("<u4").tobytes(), blocks.astype("<u8").tobytes(), bits])


@lru_cache(maxsize=4)
def _code(packed: bytes, limit: int) -> Code:
    return Code(np.frombuffer(zlib.decompress(packed), np.uint8), limit)


def unpack_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, null flags, counts and all ids of a shard."""
    magic, version, limit, _, symbols, docs, n, blocks, packed = HEAD.unpack_from(data)
    if magic != b"FHUF" or version != 1:
        raise ValueError("no shard of this format")
    at, parts = HEAD.size, []
    for size, kind in ((packed, None), (8 * docs, "<i8"), (docs, "u1"), (4 * docs, "<u4"), (8 * blocks, "<u8")):
        parts.append(data[at : at + size] if kind is None else np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    code = _code(parts[0], limit)
    if len(code.lengths) != symbols:
        raise ValueError("damaged length table")
    return parts[1], parts[2], parts[3], code.decode(data[at:], parts[4], n)


def _tally(width: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for rows in range(0, b.num_rows, 512):
                found = np.bincount(np.frombuffer(b"".join(b.column(0).slice(rows, 512).to_pylist()), width))
                if len(found) > len(total):
                    found[: len(total)] += total
                    total = found
                else:
                    total[: len(found)] += found
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    return lean(run)


def _shards(lengths: bytes, limit: int, width: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, seq = _code(lengths, limit), TaskContext.get().partitionId(), 0
        doc: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal seq, size
            counts = np.array([len(x) for x in held], np.int64)
            null = np.array([d is None for d in doc])
            payload = pack_shard(code, np.array([d or 0 for d in doc], np.int64), null, counts, np.concatenate(held))
            out = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "docs": pa.array([len(doc)], pa.int64()), "n": pa.array([int(counts.sum())], pa.int64()), "payload": pa.array([payload], pa.large_binary()).cast(pa.binary())})
            seq, size = seq + 1, 0
            doc.clear()
            held.clear()
            return out

        for b in batches:
            for d, x in zip(b.column(0).to_pylist(), b.column(1)):
                doc.append(d)
                held.append(np.frombuffer(x.as_py(), width))
                size += len(held[-1])
                if size >= SHARD:
                    yield flush()
        if held:
            yield flush()

    return lean(run)


def write_ids(docs: DataFrame, tokenizer: str, path: str, end_id: int | None = END_ID) -> None:
    """Encode all texts of docs and write their ids as shards to the Parquet folder ``path``."""
    spark = docs.sparkSession
    from tokenizers import Tokenizer

    vocabulary = Tokenizer.from_file(tokenizer).get_vocab_size(with_added_tokens=True)
    width = "<u2" if max(vocabulary, end_id or 0) < 1 << 16 else "<u4"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    between = new_path(spark, "ids")
    rows.mapInArrow(_encoded(tokenizer, end_id, width), "doc_id long, ids binary").write.option("compression", "zstd").parquet(between)
    ids = spark.read.schema("doc_id long, ids binary").parquet(between)
    tally = ids.select("ids").mapInArrow(_tally(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(max(vocabulary, (end_id or 0) + 1), np.int64)
    for row in tally.collect():  # at most one row for each id of the vocabulary
        counts[row.id] = row.n
    limit = max(16, int(np.count_nonzero(counts)).bit_length() + 1)
    packed = zlib.compress(code_lengths(counts, limit).tobytes(), 6)
    dealt = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    shards = dealt.mapInArrow(_shards(packed, limit, width), "part int, seq int, docs long, n long, payload binary")
    shards.write.option("compression", "none").parquet(path)
    drop_path(spark, between)


def _read(digest: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for base, payload in zip(b.column(0).to_pylist(), b.column(1)):
                doc, null, counts, ids = unpack_shard(payload.as_py())
                edges = np.r_[0, np.cumsum(counts, dtype=np.int64)]
                words = ids.astype("<u4", copy=False)
                cut = [words[i:j] for i, j in zip(edges[:-1], edges[1:])]
                last = pa.array([zlib.crc32(x) for x in cut], pa.int64()) if digest else pa.array([x.tobytes() for x in cut], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(doc, mask=null.astype(bool)), pa.array(base + edges[:-1]), pa.array(counts.astype(np.int64)), last], ["doc_id", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    return lean(run)


def read_ids(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """doc_id, start (ids before the document), n_tokens and ids (little-endian 32-bit) of every document in the shards of ``path``.

    With ``digest``, ids_crc32 (unsigned crc32 of the ids) stands in the place of ids.
    """
    kind = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary")
    shards = spark.read.schema("part int, seq int, docs long, n long, payload binary").parquet(path)
    sizes = shards.groupBy("part").agg(F.sum("n").alias("n")).collect()  # one row for each partition that was written
    base, starts = 0, []
    for row in sorted(sizes):
        starts.append((row.part, base))
        base += row.n
    if not starts:
        return spark.createDataFrame([], kind)
    before = F.sum("n").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    index = shards.select("part", "seq", F.coalesce(before, F.lit(0)).alias("within"))
    index = index.join(spark.createDataFrame(starts, "part int, base long"), "part").select("part", "seq", (F.col("base") + F.col("within")).alias("start"))
    return shards.join(index, ["part", "seq"]).select("start", "payload").mapInArrow(_read(digest), kind)


def write_and_read(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the ids of docs and read the files back: doc_id, start, n_tokens, ids_crc32."""
    path = new_path(docs.sparkSession, "shards")
    write_ids(docs, tokenizer, path)
    return read_ids(docs.sparkSession, path, digest=True)


def op4_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return write_and_read(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
