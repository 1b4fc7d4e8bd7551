"""Line dedup: fuzzy copies of lines by MinHash.

Lines (between line breaks, white space at both ends dropped) are first
brought down to distinct ones.  A distinct line is the set of its 7-character
shingles (a shorter line: itself).  64 min-hashes make 16 bands of 4: lines
with a Jaccard similarity of 0.8 share a band in all but 2 of 10,000 cases,
unrelated ones hardly ever.  Lines that share a band are candidates; each pair
is verified by the exact Jaccard similarity of the whole sets, as sorted 64-bit
shingle hashes.  Verified links go to the distributed union-find, and of each
component only the first line (smallest doc_id, then smallest place) stays.

Bands travel packed: numpy arrays dealt by hash, one key a band and distinct
line of a task, so a line that a third of all documents hold arrives once from
each task.  A band with up to ``PAIRS`` distinct lines hands out its pairs.  In
a larger one the lines meet in one breadth-first search that compares the
lines at hand with those not yet reached, so that near copies cost one
comparison each, and no pair of it is skipped that could add a link.

Rules for unusual rows: a null or empty text has one blank line.  Blank lines
always stay and are never compared.  A null doc_id comes after all others.
Rows with the same doc_id and text count as one and return the same result;
rows that share only the doc_id are compared with each other.  Columns besides
doc_id and text are ignored.  No rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import SPACE, U64, chunks, lean, mix, prefix_sums, ragged, span_hash
from ._components import components
from ._tables import buckets_for, fresh, load, settle

SHINGLE, BANDS, WIDTH, LEAST = 7, 16, 4, 0.8
PAIRS = 16
FLUSH = 1 << 16
#: Bits of the filter of candidate lines (32 MB at every size) and its probes.
FILTER_BITS, PROBES = 1 << 28, 4
_A = mix(np.arange(1, BANDS * WIDTH + 1, dtype=U64)).astype(np.uint32) | np.uint32(1)
#: Shingles that are hashed at a time, so that they stay in the processor's cache.
_STEP = 1 << 15


def line_spans(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end, text and place of every line that is not blank, without white space at its ends."""
    n = len(off) - 1
    breaks = np.flatnonzero(buf == 10)
    start = np.sort(np.r_[off[:-1], breaks + 1], kind="stable")
    end = np.sort(np.r_[breaks, off[1:]], kind="stable")
    owner = np.repeat(np.arange(n), np.bincount(np.searchsorted(off, breaks, "right") - 1, minlength=n) + 1)
    place = np.arange(len(owner)) - np.searchsorted(owner, owner)
    solid = np.flatnonzero(~SPACE[buf])
    if not len(solid):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    i, j = np.searchsorted(solid, start), np.searchsorted(solid, end) - 1
    good = i <= j
    return solid[i[good]], solid[j[good]] + 1, owner[good], place[good]


def _rolled(x: np.ndarray) -> np.ndarray:
    """Hash of every SHINGLE (7) consecutive code points: of pairs, of fours, of two fours that share one."""
    out = np.empty(max(0, len(x) - SHINGLE + 1), U64)
    for i in range(0, len(out), _STEP):
        h = x[i : i + _STEP + SHINGLE - 1].astype(U64)
        h = h[:-1] * U64(0x9E3779B97F4A7C15) + h[1:]
        h = h[:-2] * U64(0xC2B2AE3D27D4EB4F) + h[2:]
        out[i : i + _STEP] = mix(h[:-3] * U64(0x165667B19E3779F9) + h[3:])
    return out


def shingle_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each line, one line after the other, and their numbers."""
    lead = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    a, b = lead[start], lead[end]
    count = np.maximum(1, b - a - SHINGLE + 1)
    roll = _rolled(points)
    whole = b - a >= SHINGLE
    if whole.all():
        return roll[ragged(a, count)], count
    at = ragged(np.where(whole, a, 0), count)
    flat = roll[np.minimum(at, max(0, len(roll) - 1))] if len(roll) else np.zeros(len(at), U64)
    short = np.flatnonzero(~whole)
    flat[(np.cumsum(count) - count)[short]] = span_hash(prefix_sums(buf), start[short], end[short])
    return flat, count


def signatures(flat: np.ndarray, count: np.ndarray) -> np.ndarray:
    """(BANDS, lines) keys: a hash of the WIDTH min-hashes of each band."""
    x = (flat >> U64(32)).astype(np.uint32)
    at = np.cumsum(count) - count
    out = np.zeros((BANDS, len(count)), U64)
    step = 0
    lines = len(count)
    room = np.empty(max(_STEP, int(count.max(initial=0))), np.uint32)
    while step < lines:
        stop = max(step + 1, int(np.searchsorted(at, at[step] + _STEP, "right")) - 1)
        part = x[at[step] : at[stop] if stop < lines else len(x)]
        if len(part) > len(room):
            room = np.empty(len(part), np.uint32)
        now = room[: len(part)]
        first = at[step:stop] - at[step]
        for k in range(BANDS * WIDTH):
            np.multiply(part, _A[k], out=now)
            out[k // WIDTH, step:stop] = out[k // WIDTH, step:stop] * U64(0xD6E8FEB86659FD93) + np.minimum.reduceat(now, first)
        step = stop
    return mix(out ^ (np.arange(BANDS, dtype=U64)[:, None] << U64(56)))


class Seen:
    """The hashes that a task has met lately: a bounded number, so one may pass for new again, which does no harm."""

    def __init__(self) -> None:
        self.have = np.zeros(0, U64)

    def new(self, h: np.ndarray) -> np.ndarray:
        """Which of the sorted, different hashes are new; they are not from now on."""
        at = np.searchsorted(self.have, h)
        new = np.ones(len(h), bool)
        inside = at < len(self.have)
        new[inside] = self.have[at[inside]] != h[inside]
        self.have = np.insert(self.have, at[new], h[new]) if len(self.have) < 1 << 20 else h[new]
        return new


def _band_blobs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        lines: list[np.ndarray] = []
        seen = Seen()

        def flush() -> pa.RecordBatch:
            key, line = np.concatenate(keys, axis=1).ravel(), np.tile(np.concatenate(lines), BANDS)
            keys.clear()
            lines.clear()
            order = np.argsort(key)
            key, line = key[order], line[order]
            edges = np.searchsorted(((key >> U64(32)) * U64(buckets)) >> U64(32), np.arange(buckets + 1))
            cut = [(k, i, j) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
            return pa.RecordBatch.from_arrays([pa.array([k for k, _, _ in cut], pa.int32()), pa.array([key[i:j].tobytes() for _, i, j in cut], pa.binary()), pa.array([line[i:j].tobytes() for _, i, j in cut], pa.binary())], ["bucket", "key", "line"])

        size = 0
        for _, buf, off in chunks(batches):
            start, end, _, _ = line_spans(buf, off)
            h, first = np.unique(span_hash(prefix_sums(buf), start, end), return_index=True)
            new = seen.new(h)
            h, first = h[new], first[new]
            if not len(h):
                continue
            keys.append(signatures(*shingle_hashes(buf, start[first], end[first])))
            lines.append(h)
            size += len(h)
            if size >= FLUSH:
                yield flush()
                size = 0
        if lines:
            yield flush()

    return lean(run)


def _band_groups(blobs: pd.DataFrame) -> pd.DataFrame:
    """Candidates: pairs of the bands with few lines (a, b), and members of the others (a, null, key)."""
    key = np.concatenate([np.frombuffer(x, U64) for x in blobs.key])
    line = np.concatenate([np.frombuffer(x, U64) for x in blobs.line])
    order = np.lexsort((line, key))
    key, line = key[order], line[order]
    keep = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1])]
    key, line = key[keep], line[keep]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    size = np.diff(np.r_[first, len(key)])
    large = np.repeat(size > PAIRS, size)
    a, b = [], []
    k, x = key[~large], line[~large]
    for shift in range(1, PAIRS):
        same = np.flatnonzero(k[shift:] == k[:-shift])
        if not len(same):
            break
        a.append(x[same])
        b.append(x[same + shift])
    none = np.zeros(0, U64)
    pair = np.unique(np.stack([np.concatenate([none, *a]), np.concatenate([none, *b])], 1), axis=0)
    n, m = len(pair), int(large.sum())
    b = pd.arrays.IntegerArray(np.r_[pair[:, 1], np.zeros(m, U64)].view(np.int64), np.arange(n + m) >= n)
    return pd.DataFrame({"a": np.r_[pair[:, 0], line[large]].view(np.int64), "b": b, "key": np.r_[np.zeros(n, U64), key[large]].view(np.int64)})


def _probes(h: np.ndarray, bits: int) -> list[np.ndarray]:
    x = mix(h.view(U64))
    low, step = x & U64(0xFFFFFFFF), x >> U64(32) | U64(1)
    return [((low + U64(k) * step) % U64(bits)).astype(np.int64) for k in range(PROBES)]


def _filter_of(lines: DataFrame, buckets: int) -> np.ndarray:
    """A Bloom filter of the column ``line``, in parts by bucket; FILTER_BITS in all at every size."""
    bits = FILTER_BITS // buckets // 8 * 8

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        marks = np.zeros(bits, bool)
        for p in _probes(rows.line.to_numpy(np.int64), bits):
            marks[p] = True
        return pd.DataFrame({"bucket": rows.bucket[:1], "part": [np.packbits(marks).tobytes()]})

    dealt = lines.select(F.pmod("line", F.lit(buckets)).cast("int").alias("bucket"), "line").distinct()
    out = np.zeros((buckets, bits // 8), np.uint8)
    for row in dealt.groupBy("bucket").applyInPandas(part, "bucket int, part binary").toLocalIterator():
        out[row.bucket] = np.frombuffer(row.part, np.uint8)
    return out


def _some_bytes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, good: np.ndarray) -> pa.Array:
    """The spans under good as a binary column, null elsewhere."""
    size = np.where(good, end - start, 0)
    data = buf[ragged(start, size)]
    off = np.r_[0, np.cumsum(size)].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(good), [pa.py_buffer(np.packbits(good, bitorder="little").tobytes()), pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])


def _places(shared):
    """A row for each line that is not blank, and one without a line for each text: its place is the number of lines.

    A line that the filter of candidates lets through comes with its words, once in a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        bits = table.shape[1] * 8
        seen = Seen()
        for rows, buf, off in chunks(batches):
            start, end, doc, place = line_spans(buf, off)
            h = span_hash(prefix_sums(buf), start, end)
            one, first = np.unique(h, return_index=True)
            bucket, good = np.mod(one.view(np.int64), len(table)), np.ones(len(one), bool)
            for p in _probes(one.view(np.int64), bits):
                good &= (table[bucket, p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
            n = len(off) - 1
            shown = np.zeros(len(h) + n, bool)
            shown[first[good][seen.new(one[good])]] = True
            words = _some_bytes(buf, np.r_[start, np.zeros(n, np.int64)], np.r_[end, np.zeros(n, np.int64)], shown)
            breaks = np.searchsorted(off, np.flatnonzero(buf == 10), "right") - 1
            d = pa.array(np.r_[doc, np.arange(n)])
            places = np.r_[place, np.bincount(breaks, minlength=n) + 1].astype(np.int32)
            line = pa.array(np.r_[h.view(np.int64), np.zeros(n, np.int64)], mask=np.r_[np.zeros(len(h), bool), np.ones(n, bool)])
            yield pa.RecordBatch.from_arrays([rows.column(0).take(d), rows.column(2).take(d), pa.array(places), line, words], ["doc_id", "text_hash", "place", "line", "words"])

    return lean(run)


def shingle_sets(texts: list[bytes]) -> list[np.ndarray]:
    """The shingles of each text as a sorted array of different hashes."""
    if not texts:
        return []
    buf = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    flat, count = shingle_hashes(buf, np.r_[0, end[:-1]], end)
    out = []
    for part in np.split(flat, np.cumsum(count)[:-1]):
        part = np.sort(part)
        out.append(part[np.r_[True, part[1:] != part[:-1]]])
    return out


def enough(both: np.ndarray | int, a: np.ndarray | int, b: np.ndarray | int) -> np.ndarray | bool:
    """Whether sets of a and b elements, ``both`` of them shared, have a similarity of LEAST, in whole numbers."""
    return 5 * both >= 4 * (a + b - both)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether the Jaccard similarity of two sorted sets is LEAST at least."""
    n, m = len(a), len(b)
    if not enough(min(n, m), n, m):
        return False
    x = np.sort(np.concatenate([a, b]))
    return bool(enough(int((x[1:] == x[:-1]).sum()), n, m))


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by the first line of the pair; its set is kept, as are those met lately."""
    kept: dict[int, np.ndarray] = {}
    for b in batches:
        for i in range(0, b.num_rows, 512):
            rows = b.slice(i, 512)
            a, c = rows.column(0).to_pylist(), rows.column(1).to_pylist()
            new: dict[int, bytes] = {}
            for names, texts in ((a, rows.column(2)), (c, rows.column(3))):
                for name, text in zip(names, texts):
                    if name not in kept and name not in new:
                        new[name] = text.as_buffer().to_pybytes()
            kept.update(zip(new, shingle_sets(list(new.values()))))
            good = [similar(kept[x], kept[y]) for x, y in zip(a, c)]
            while len(kept) > 1024:
                del kept[next(iter(kept))]
            yield rows.select(["a", "b"]).filter(pa.array(good, pa.bool_()))


def search(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (numbers of sets) that connect what is linked among the lines of one band.

    Two sets with a similarity of LEAST share one of the rarest shingles of
    either: as many as may be missing and one more (prefix filter).  So a line
    is compared only with those not yet reached that share one of its rarest.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    edge = np.r_[0, np.cumsum(size)]
    owner = np.repeat(np.arange(n), size)
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if n else np.zeros(0, np.int64)
    often = np.bincount(codes)
    rare = np.lexsort((codes, often[codes], owner))
    place = np.arange(len(codes)) - edge[owner]
    head = rare[place < (size - -(-4 * size // 5) + 1)[owner]]
    held, holder = codes[head], owner[head]
    post = np.argsort(held, kind="stable")
    post_of, post_at = holder[post], np.searchsorted(held[post], np.arange(len(often) + 1))
    head_at = np.searchsorted(holder, np.arange(n + 1))
    left, mark, links = np.ones(n, bool), np.zeros(len(often), bool), []
    for root in range(n):
        if not left[root]:
            continue
        left[root] = False
        queue = [root]
        while queue:
            i = queue.pop()
            mine = held[head_at[i] : head_at[i + 1]]
            near = post_of[ragged(post_at[mine], post_at[mine + 1] - post_at[mine])]
            near = np.unique(near[left[near]])
            near = near[enough(np.minimum(size[near], size[i]), size[near], size[i])]
            if not len(near):
                continue
            mark[codes[edge[i] : edge[i + 1]]] = True
            both = np.add.reduceat(mark[codes[ragged(edge[near], size[near])]].astype(np.int64), np.cumsum(size[near]) - size[near])
            mark[codes[edge[i] : edge[i + 1]]] = False
            found = near[enough(both, size[near], size[i])]
            left[found] = False
            links += [(i, j) for j in found.tolist()]
            queue += found.tolist()
    return links


def _searched(group: pd.DataFrame) -> pd.DataFrame:
    names = group.line.to_numpy(np.int64)
    links = np.array(search(shingle_sets(group.words.tolist())), np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": names[links[:, 0]], "b": names[links[:, 1]]})


def line_links(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(places: doc_id, text_hash, place, line, words of every line, see _places()), and (a, b): hashes of
    distinct lines that are similar, enough of them to connect each component."""
    spark = rows.sparkSession
    buckets = buckets_for(rows)
    blobs = rows.select("doc_id", "text").mapInArrow(_band_blobs(buckets), "bucket int, key binary, line binary")
    found = settle(blobs.groupBy("bucket").applyInPandas(_band_groups, "a long, b long, key long"), "candidates")
    pairs = found.where("b is not null").select("a", "b").distinct()
    members = found.where("b is null").select(F.col("a").alias("line"), "key")
    all_lines = found.select(F.col("a").alias("line")).unionByName(found.where("b is not null").select(F.col("b").alias("line")))
    shared = spark.sparkContext.broadcast(_filter_of(all_lines, buckets))
    places = settle(rows.mapInArrow(_places(shared), "doc_id long, text_hash long, place int, line long, words binary"), "places")
    texts = settle(places.where("words is not null").select("line", "words").dropDuplicates(["line"]), "lines")
    first = texts.select(F.col("line").alias("a"), F.col("words").alias("x"))
    second = texts.select(F.col("line").alias("b"), F.col("words").alias("y"))
    verified = pairs.join(first, "a").join(second, "b").select("a", "b", "x", "y").mapInArrow(lean(_verified), "a long, b long")
    searched = members.join(texts, "line").groupBy("key").applyInPandas(_searched, "a long, b long")
    return places, verified.unionByName(searched)


def duplicate_lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_lines and removed (places of the lines that go, from 0, in order) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found, links = line_links(rows)
    lines = found.where("line is not null").drop("words")
    spot = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place", "text_hash")
    first = lines.groupBy("line").agg(F.min(spot).alias("spot"), F.count("*").alias("n"))
    roots = settle(components(links, "a", "b"), "roots")
    # lines that come once and have no link stay; repeated rows have equal spots
    classed = first.join(roots, first.line == roots.node, "left").where("n > 1 or root is not null").select("line", "spot", F.coalesce("root", "line").alias("root"))
    least = classed.groupBy("root").agg(F.min("spot").alias("keep"))
    kept = classed.join(least, "root").select("line", "keep")
    late = lines.join(kept, "line").where(~spot.eqNullSafe(F.col("keep")))
    gone = late.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_set("place")).alias("removed"))
    gone = gone.select(F.col("doc_id").alias("d"), F.col("text_hash").alias("t"), "removed")
    each = found.where("line is null").select("doc_id", "text_hash", F.col("place").cast("long").alias("n_lines"))
    each = each.join(gone, each.doc_id.eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("t")), "left")
    return each.select("doc_id", "text_hash", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def remove_lines(docs: DataFrame) -> DataFrame:
    """The rows of docs, their texts without the lines that go."""
    rid, rhash, own, gone = fresh(docs, "_doc", "_hash", "_own", "_gone")
    found = duplicate_lines(docs).select(F.col("doc_id").alias(rid), F.col("text_hash").alias(rhash), F.col("removed").alias(gone)).where(F.size(gone) > 0).distinct()
    rows = docs.withColumn(own, F.xxhash64("text"))
    joined = rows.join(found, F.col("doc_id").cast("long").eqNullSafe(F.col(rid)) & (F.col(own) == F.col(rhash)), "left")
    stay = F.filter(F.split("text", "\n", -1), lambda _, i: ~F.array_contains(F.col(gone), i))
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    return joined.select(*[(text if c == "text" else F.col(c)).alias(c) for c in docs.columns])


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = duplicate_lines(load(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"))
