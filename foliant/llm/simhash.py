"""SimHash near-duplicates, candidates by pigeonring filtering.

A fingerprint of 64 bits is cut into five consecutive segments on a ring.  If
two fingerprints differ in at most four bits, some start on the ring has a
chain whose first l segments together differ in at most ``l * 4 / 5`` bits for
every l.  So the first segment is equal, the first two differ in one bit at
most, and the first three in two: of the halves of the second and the third
segment, both of the second are equal, or one of either.  The first segment with
such two halves is the join key (about 26 bits, 25 keys a fingerprint); the
cumulative budgets then prune the pairs of a key before the full Hamming check,
in keys of every size.

Only *distinct* fingerprints are paired, and a key hands out links, never all
its pairs: copies of a text, however many, are one fingerprint.  A pair that the
chain of one start doesn't pass is met under another one.

Rules for unusual rows: a null text counts as empty, and a text without words
has fingerprint zero and links like any other; one with fewer than four words
has its whole sequence as the only shingle.  Rows that share a doc_id each
return a row.  A null doc_id gets its component like any other and never names
one unless the whole component has none.  Columns besides doc_id and text are
ignored.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import chunks, lean
from ._components import components
from ._tables import fresh, load, settle

WORDS, MAX_DIFFERENT, SEED = 4, 4, 42
#: (shift, width) of the five segments, from the low end.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
U64 = np.uint64
#: Above these bits, a key says its start and its halves.
START_BITS = 32
_SET_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _majority(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of n texts from the hashes of their shingles."""
    total = np.bincount(owner, minlength=n)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    out = np.zeros(n, U64)
    for k in range(8):
        table = np.bincount(owner * 256 + octets[:, k], minlength=n * 256).reshape(n, 256)
        bits = 2 * (table @ _SET_BITS) > total[:, None]
        out |= np.packbits(bits, axis=1, bitorder="little")[:, 0].astype(U64) << U64(8 * k)
    return out


def fingerprint_arrays(buf: np.ndarray, off: np.ndarray, words: int = WORDS) -> np.ndarray:
    data, digest = buf.tobytes().lower(), xxhash.xxh64_intdigest
    found: list[int] = []
    per_doc = np.zeros(len(off) - 1, np.int64)
    for i in range(len(off) - 1):
        parts = data[off[i] : off[i + 1]].split()
        if not parts:
            continue
        line, ends, at = b" ".join(parts), [], -1
        for p in parts:
            at += len(p) + 1
            ends.append(at)
        starts = [0, *(e + 1 for e in ends[:-1])]
        ends = ends[words - 1 :] or [len(line)]
        found += [digest(line[a:b], SEED) for a, b in zip(starts, ends)]
        per_doc[i] = len(ends)
    owner = np.repeat(np.arange(len(per_doc)), per_doc)
    return _majority(np.array(found, U64), owner, len(per_doc))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, buf, off in chunks(batches):
        fp = fingerprint_arrays(buf, off).view(np.int64)
        yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(2), pa.array(fp)], ["doc_id", "text_hash", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash (to tell rows of one doc_id apart) and fp (the 64 bits as a signed long) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(lean(_fingerprints), "doc_id long, text_hash long, fp long")


def _segment(x: np.ndarray, i: int) -> np.ndarray:
    shift, width = SEGMENTS[i % len(SEGMENTS)]
    return (x >> U64(shift)) & U64((1 << width) - 1)


#: Which halves (0 and 1 of the second segment, 2 and 3 of the third) make a key with the first segment.
HALVES = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3))


def ring_keys(fp: np.ndarray) -> np.ndarray:
    """(25, n): for each start on the ring, its segment with two halves of the next ones."""
    out = []
    for i in range(len(SEGMENTS)):
        parts = []
        for step in (1, 2):
            x, low = _segment(fp, i + step), SEGMENTS[(i + step) % len(SEGMENTS)][1] // 2
            parts += [x & U64((1 << low) - 1), x >> U64(low)]
        for k, (a, b) in enumerate(HALVES):
            tag = U64(i * len(HALVES) + k) << U64(START_BITS)
            out.append(tag | (_segment(fp, i) << U64(14)) | (parts[a] << U64(7)) | parts[b])
    return np.stack(out)


def chain_holds(different: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Whether the cumulative differences from each pair's start stay in their budgets."""
    n, per = len(SEGMENTS), np.stack([np.bitwise_count(_segment(different, i)) for i in range(len(SEGMENTS))]).astype(np.int16)
    column, total, good = np.arange(len(different)), np.zeros(len(different), np.int16), np.ones(len(different), bool)
    for step in range(n):
        total += per[(start + step) % n, column]
        good &= total <= (step + 1) * MAX_DIFFERENT // n
    return good


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        keys = ring_keys(fp.view(U64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.tile(fp, len(keys)))], ["key", "fp"])


def _start(key: np.ndarray) -> np.ndarray:
    return (key >> U64(START_BITS)).astype(np.int64) // len(HALVES)


def linked(different: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Places of the pairs whose chain holds and that differ in few enough bits."""
    at = np.flatnonzero(chain_holds(different, start))
    return at[np.bitwise_count(different[at]) <= MAX_DIFFERENT]


def _links_of_large(fp: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is linked in one large key: a breadth-first search over what is not yet reached."""
    left, a, b = fp, [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = linked(left ^ x, np.full(len(left), start))
            if len(near):
                reached = left[near]
                a.append(np.full(len(reached), x))
                b.append(reached)
                queue += list(reached)
                left = np.delete(left, near)
    none = np.zeros(0, U64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def key_links(key: np.ndarray, fp: np.ndarray, small: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Links among rows sorted by key. Keys of few rows go together, pair distance by pair distance."""
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[first, len(key)])
    out_a, out_b = [], []
    for at, n in zip(first[sizes > small], sizes[sizes > small]):
        a, b = _links_of_large(fp[at : at + n], int(_start(key[at : at + 1])[0]))
        out_a.append(a)
        out_b.append(b)
    keep = np.repeat(sizes <= small, sizes)
    key, fp = key[keep], fp[keep]
    for shift in range(1, small):
        same = np.flatnonzero(key[shift:] == key[:-shift])
        if not len(same):
            break
        a, b = fp[same], fp[same + shift]
        good = linked(a ^ b, _start(key[same]))
        out_a.append(a[good])
        out_b.append(b[good])
    none = np.zeros(0, U64)
    return (np.concatenate(out_a), np.concatenate(out_b)) if out_a else (none, none)


def _links(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key; a key that may go on in the next batch waits for it."""

    def found(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = key_links(key, fp)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    wait_k: list[np.ndarray] = []
    wait_f: list[np.ndarray] = []
    for b in frames:
        key, fp = (b.column(i).to_numpy(zero_copy_only=False).astype(np.int64).view(U64) for i in (0, 1))
        if not len(key):
            continue
        cut = int(np.searchsorted(key, key[-1], "left"))
        if wait_k and (cut or wait_k[0][0] != key[0]):
            split = int(np.searchsorted(key, wait_k[0][0], "right"))
            yield found(np.concatenate([*wait_k, key[:split]]), np.concatenate([*wait_f, fp[:split]]))
            wait_k, wait_f = [], []
            if cut > split:
                yield found(key[split:cut], fp[split:cut])
        elif cut:
            yield found(key[:cut], fp[:cut])
        wait_k.append(key[cut:])
        wait_f.append(fp[cut:])
    if wait_k:
        yield found(np.concatenate(wait_k), np.concatenate(wait_f))


def near_links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints (column fp) at most four bits apart."""
    keyed = distinct.select("fp").mapInArrow(lean(_keys), "key long, fp long")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(lean(_links), "a long, b long")


def _classes(prints: DataFrame) -> DataFrame:
    """fp, root and component_id of every distinct fingerprint."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = components(near_links(first), "a", "b")
    classed = first.join(roots, first.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    names = classed.groupBy("root").agg(F.min("first").alias("component_id"))
    return settle(classed.join(names, "root").select("fp", "root", "component_id"), "classes")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable) of every row."""
    prints = settle(fingerprints(docs), "fingerprints")
    return prints.join(_classes(prints), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, one of each class: that with the smallest doc_id (null last), then the smallest text hash.

    Rows with the same doc_id and text count as one; rows that share only the
    doc_id are judged apart.
    """
    prints = settle(fingerprints(docs), "fingerprints")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")
    kept = prints.join(_classes(prints), "fp").groupBy("root").agg(F.min(rank).alias("k"))
    rid, rhash, own = fresh(docs, "_doc", "_hash", "_own")
    ids = kept.select(F.col("k.doc_id").alias(rid), F.col("k.text_hash").alias(rhash))
    rows = docs.withColumn(own, F.xxhash64("text"))
    rows = rows.join(ids, rows["doc_id"].cast("long").eqNullSafe(F.col(rid)) & (F.col(own) == F.col(rhash)), "left_semi")
    return rows.dropDuplicates(["doc_id", own]).drop(own)


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(load(spark, sf_dir, "documents"))
