"""Benchmark decontamination by the q-gram lemma.

Texts are compared as characters: lower case, white space runs as one space.
An item of m characters may stand in a text with up to ``e = RATE * m`` edits.
By the q-gram lemma such a region shares at least ``m - q + 1 - q * e`` of the
item's q-grams with it, all on diagonals (place in text minus place in item)
that lie within e of each other.  So the q-grams of a text that the items
have are counted by item in bands of 2(e + 1) diagonals that overlap by half;
bands that reach the bound are retained and verified by banded alignment,
which finds the least number of edits of the whole item against any stretch
of the region.  q is 8, and less for an item whose bound would else be under
one, so that every item has the same rate.

Shared q-grams are met ``HITS`` at a time, and only the counts of bands are
kept between, so a text and an item that both repeat one q-gram a thousand
times take time, not memory.  Where such hits are cut, a q-gram may count
twice; a band more is verified then, and none is lost.

The items are the query set: they go to the tasks in blocks of bounded size,
one pass over the texts a block.  Texts are never shuffled.

Rules for unusual rows: null or empty texts match nothing; null or blank items
are no items.  An item of less than ten characters is found as it stands.  Items
with the same item_id are items of their own and report this id.  Rows that
share a doc_id each report their matches.  A null doc_id is reported as null.
Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import U64, chunks, lean, ragged
from ._tables import fresh, load

Q, RATE = 8, 0.1
#: Characters of items that one pass takes to the tasks.
BLOCK_CHARS = 1 << 22
TABLE_BITS = 22
#: Shared q-grams at a time.
HITS = 1 << 19
#: The lower-case form of the letters that have one of one character.
LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x600)], np.uint32)
BLANK = np.zeros(0x3001, bool)
BLANK[[c for c in range(0x3001) if chr(c).isspace()]] = True


def _fold(points: np.ndarray) -> np.ndarray:
    low = points < len(LOWER)
    return np.where(low, LOWER[np.where(low, points, 0)], points)


def normal(text: str) -> np.ndarray:
    """Code points of a text in the form that is compared."""
    return _fold(np.frombuffer(" ".join(text.split()).encode("utf-32-le"), np.uint32))


def normal_texts(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts in the form that is compared, their offsets, and each one's place in its text."""
    lead = (buf & 0xC0) != 0x80
    points = np.frombuffer(buf.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.r_[0, np.cumsum(lead)][off]
    blank = (points < len(BLANK)) & BLANK[np.minimum(points, len(BLANK) - 1)]
    first = np.zeros(len(points) + 1, bool)
    first[at] = True
    drop = blank.copy()
    drop[1:] &= blank[:-1]
    drop &= ~first[:-1]
    keep = np.flatnonzero(~drop)
    x = _fold(points[keep])
    x[blank[keep]] = 32
    edges = np.searchsorted(keep, at)
    return x, edges, keep


def grams(x: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of every q characters."""
    if len(x) < q:
        return np.zeros(0, U64)
    have, h = 1, x.astype(U64)
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        k = min(have, q - have)  # two windows, which may overlap, make a longer one
        if k:
            h = h[:-k] * U64(base) + h[k:]
        have += k
    return h ^ (h >> U64(29))


def gram_size(m: int, rate: float) -> int:
    """The q-gram size for an item of m characters: Q, or the largest with a bound of one shared q-gram at least."""
    return max(1, min(Q, m // (int(np.floor(m * rate)) + 1)))


def band_edits(item: np.ndarray, text: np.ndarray, shift: int, width: int, most: int) -> tuple[int, int]:
    """Least edits of the whole item against a stretch of text on diagonals shift .. shift + width - 1, and its end.

    The stretch may begin and end anywhere; ``most + 1`` if there is none within ``most``.
    """
    exact = text[max(0, shift) : shift + width + len(item)].tobytes()
    at = exact.find(item.tobytes())
    if at >= 0 and at % 4 == 0:
        return 0, max(0, shift) + at // 4 + len(item)
    span = np.arange(width)
    far = most + 1
    pad = np.full(len(item) + 2 * width + 2, 0xFFFFFFFF, np.uint32)
    low = shift - 1
    a, b = max(0, low), min(len(text), low + len(pad))
    if b > a:
        pad[a - low : b - low] = text[a:b]
    # cell d of row i: i characters of the item against text that ends at shift + d + i
    row = np.where((shift + span >= 0) & (shift + span <= len(text)), 0, far).astype(np.int32)
    for i, c in enumerate(item):
        new = row + (pad[i + 1 : i + 1 + width] != c)
        new[:-1] = np.minimum(new[:-1], row[1:] + 1)
        row = (np.minimum.accumulate(new - span) + span).astype(np.int32)
        if row.min() >= far:
            return far, 0
    d = int(row.argmin())
    return int(row[d]), min(len(text), max(0, shift + d + len(item)))


class Items:
    """The items of a block that have one q-gram size, indexed by q-gram."""

    def __init__(self, rows: list[tuple[int, np.ndarray]], rate: float, q: int = Q) -> None:
        self.q = q
        self.ids = [r[0] for r in rows]
        self.points = [r[1] for r in rows]
        self.size = np.array([len(p) for p in self.points], np.int64)
        self.edits = np.floor(self.size * rate).astype(np.int64)
        self.need = np.maximum(1, self.size - q + 1 - q * self.edits)
        all_grams = [grams(p, q) for p in self.points]
        gram = np.concatenate(all_grams) if all_grams else np.zeros(0, U64)
        item = np.repeat(np.arange(len(rows)), [len(g) for g in all_grams])
        place = np.concatenate([np.arange(len(g)) for g in all_grams]) if all_grams else np.zeros(0, np.int64)
        order = np.argsort(gram, kind="stable")
        self.gram, self.item, self.place = gram[order], item[order], place[order]
        self.keys, self.first = np.unique(self.gram, return_index=True)
        self.count = np.diff(np.r_[self.first, len(self.gram)])
        self.seen = np.zeros(1 << TABLE_BITS, bool)
        self.seen[self._slot(self.keys)] = True

    @classmethod
    def by_size(cls, rows: list[tuple[int, str]], rate: float) -> list["Items"]:
        """All items of a block, those of each q-gram size together."""
        groups: dict[int, list[tuple[int, np.ndarray]]] = {}
        for item_id, text in rows:
            points = normal(text)
            if len(points):
                groups.setdefault(gram_size(len(points), rate), []).append((item_id, points))
        return [cls(some, rate, q) for q, some in sorted(groups.items())]

    @staticmethod
    def _slot(g: np.ndarray) -> np.ndarray:
        return (g & U64((1 << TABLE_BITS) - 1)).astype(np.int64)

    def regions(self, x: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int]]:
        """(text, item, band) of every band with enough shared q-grams."""
        g = grams(x, self.q)
        at = np.flatnonzero(self.seen[self._slot(g)])
        if not len(at) or not len(self.keys):
            return []
        k = np.minimum(np.searchsorted(self.keys, g[at]), len(self.keys) - 1)
        good = self.keys[k] == g[at]
        text = np.searchsorted(edges, at, "right") - 1
        good &= at + self.q <= edges[np.minimum(text + 1, len(edges) - 1)]
        at, k, text = at[good], k[good], text[good]
        # a q-gram of many items meets each: the hits of a text are the work of the filter
        size = self.count[k]
        edge = np.r_[0, np.cumsum(size)]
        begin = 0
        kept = [np.zeros((4, 0), np.int64)]  # text, item, band, count: of the texts that a step may have cut
        found: list[np.ndarray] = []
        while begin < len(k):
            stop = max(begin + 1, int(np.searchsorted(edge, edge[begin] + HITS, "right")) - 1)
            s = slice(begin, stop)
            hit = ragged(self.first[k[s]], size[s])
            t, p, i, q = np.repeat(text[s], size[s]), np.repeat(at[s] - edges[text[s]], size[s]), self.item[hit], self.place[hit]
            band = (p - q + self.size[i]) // (self.edits[i] + 1)  # a band holds two of these: 2 * width diagonals
            now = self._counts(np.r_[t, t], np.r_[i, i], np.r_[band, band - 1], np.r_[q, q])
            both = self._summed(np.concatenate([*kept, now], axis=1))
            over = both[0] < (text[stop] if stop < len(k) else len(edges))
            found.append(both[:3, over & (both[3] >= self.need[both[1]])])
            kept = [both[:, ~over]]
            begin = stop
        return sorted(zip(*np.concatenate(found, axis=1).tolist())) if found else []

    @staticmethod
    def _counts(t: np.ndarray, i: np.ndarray, band: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Number of *different* q-grams of the item that each band meets."""
        order = np.lexsort((q, band, i, t))
        t, i, band, q = t[order], i[order], band[order], q[order]
        new = np.r_[True, (t[1:] != t[:-1]) | (i[1:] != i[:-1]) | (band[1:] != band[:-1])]
        other = new | np.r_[True, q[1:] != q[:-1]]
        first = np.flatnonzero(new)
        return np.stack([t[first], i[first], band[first], np.add.reduceat(other.astype(np.int64), first)])

    @staticmethod
    def _summed(rows: np.ndarray) -> np.ndarray:
        if not rows.shape[1]:
            return rows
        rows = rows[:, np.lexsort(rows[2::-1])]
        first = np.flatnonzero(np.r_[True, (rows[:3, 1:] != rows[:3, :-1]).any(0)])
        return np.concatenate([rows[:3, first], np.add.reduceat(rows[3], first)[None]])

    def matches(self, x: np.ndarray, edges: np.ndarray) -> list[tuple[int, int, int, int, int]]:
        """(text, item, edits, start, end) of the best verified region of each text and item, in places of x."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for t, i, band in self.regions(x, edges):
            if best.get((t, i), (1,))[0] == 0:
                continue
            body, width = x[edges[t] : edges[t + 1]], int(self.edits[i]) + 1
            most = int(self.edits[i])
            edits, end = band_edits(self.points[i], body, band * width - int(self.size[i]), 2 * width, most)
            if edits <= most:
                back, length = band_edits(self.points[i][::-1], body[:end][::-1], -width, 2 * width, most)
                start = end - length if back <= most else max(0, end - int(self.size[i]))
                best[t, i] = min(best.get((t, i), (most + 1, 0, 0)), (edits, start, end))
        return [(t, i, *v) for (t, i), v in sorted(best.items())]


def _matcher(shared, rate: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups = Items.by_size(shared.value, rate)
        for rows, buf, off in chunks(batches):
            x, edges, place = normal_texts(buf, off)
            lead = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)][off]
            for items in groups:
                found = items.matches(x, edges)
                if not found:
                    continue
                t = np.array([f[0] for f in found])
                start = [int(place[edges[a] + s] - lead[a]) for a, _, _, s, _ in found]
                end = [int(place[edges[a] + e - 1] - lead[a]) + 1 for a, _, _, _, e in found]
                cols = [rows.column(0).take(pa.array(t)), rows.column(2).take(pa.array(t)), pa.array([items.ids[f[1]] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32()), pa.array(start, pa.int64()), pa.array(end, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "text_hash", "item_id", "edits", "start", "end"])

    return lean(run)


def _blocks(items: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """Items in blocks of at most BLOCK_CHARS (or one item), fetched one after the other."""
    block, size = [], 0
    rows = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.length(F.trim("text")) > 0)
    for row in rows.orderBy("item_id", "text").toLocalIterator():
        if block and size + len(row.text) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row.item_id, row.text))
        size += len(row.text)
    if block:
        yield block


def contaminated(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, text_hash, item_id, edits, start and end (code points of the text) of each text and item that it holds."""
    spark = docs.sparkSession
    schema = "doc_id long, text_hash long, item_id long, edits int, start long, end long"
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash"))
    found = spark.createDataFrame([], schema)
    for k, block in enumerate(_blocks(items)):
        part = rows.mapInArrow(_matcher(spark.sparkContext.broadcast(block), rate), schema)
        found = part if k == 0 else found.unionByName(part)
    return found


def clean(docs: DataFrame, items: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of docs that hold no item."""
    rid, rhash, own = fresh(docs, "_doc", "_hash", "_own")
    bad = contaminated(docs, items, rate).select(F.col("doc_id").alias(rid), F.col("text_hash").alias(rhash)).distinct()
    rows = docs.withColumn(own, F.xxhash64("text"))
    return rows.join(bad, F.col("doc_id").cast("long").eqNullSafe(F.col(rid)) & (F.col(own) == F.col(rhash)), "left_anti").drop(own)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")).drop("text_hash")
