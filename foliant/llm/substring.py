"""Substring dedup: passages that an earlier document holds word for word.

Seed: of the 5-word hashes in every window of 13 words the smallest is its
anchor (winnowing), so equal windows have equal anchors and about one place in
five is one.  Documents are joined on anchors; those of two documents or more
go into a Bloom filter of fixed size.  Extend: round each anchor that the
filter lets through, the match is grown both ways to every 13-word context
that has this anchor; a context is keyed by a 96-bit hash of its words, so a
passage in n documents costs n rows, not n * n pairs.  Keep: contexts that
also start in a document with a smaller doc_id are laid over each other, and
what they cover are the maximal repeats over the length threshold, whose words
go.

Both joins travel packed: a task sorts what it has read, keeps one row of each
hash (that of the smallest doc_id, the other documents being settled on the
spot) and sends numpy arrays dealt by hash.  So a passage in a third of all
documents arrives once from each task.  The filter's false hits cost traffic
only; results do not depend on them.

Rules for unusual rows: words are ``[^\x20\x09-\x0D]+``; a null or empty text
has none and returns zeros and the hash of nothing.  Windows inside one
document, or among rows of one doc_id, remove nothing from each other.  A null
doc_id counts as larger than all others.  Repeated rows each return a row.
Columns besides doc_id and text are ignored.  No rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._blocks import chunks, ids, lean, mix, prefix_sums, ragged, rolled, sliding_min, span_hash, word_spans
from ._tables import buckets_for, load, settle

WINDOW, SEED_WORDS = 13, 5
#: Bits of the whole anchor filter (32 MB) and probes for an anchor: fixed at every size.
FILTER_BITS, PROBES = 1 << 28, 4
#: Anchors, or windows, that a task gathers before it sends them.
FLUSH = 1 << 20
LAST = (1 << 63) - 1
U64 = np.uint64


def anchors_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every window inside one text: anchor, text, place of its first word, hash, second hash (32 bits)."""
    start, end, doc = word_spans(buf, off)
    words = span_hash(prefix_sums(buf), start, end)
    n = len(words) - WINDOW + 1
    if n <= 0:
        z = np.zeros(0, U64)
        return z, z.astype(np.int64), z.astype(np.int64), z, z.astype(np.uint32)
    anchor = sliding_min(rolled(words, SEED_WORDS, 0xD6E8FEB86659FD93), WINDOW - SEED_WORDS + 1)
    whole = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    first = np.searchsorted(doc, np.arange(len(off) - 1), "left")
    one = rolled(words, WINDOW, 0xA0761D6478BD642F)
    two = (rolled(words, WINDOW, 0xE7037ED1A0B428DB) >> U64(32)).astype(np.uint32)
    return anchor[whole], doc[whole], whole - first[doc[whole]], one[whole], two[whole]


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(buckets)) >> U64(32)


def _anchor_blobs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            a, d = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((d, a))
            a, d = a[order], d[order]
            at = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
            many = d[at] != d[np.r_[at[1:], len(a)] - 1]
            a, d = a[at], d[at]
            edges = np.searchsorted(_bucket(a, buckets), np.arange(buckets + 1))
            cut = [(k, i, j) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
            return pa.RecordBatch.from_pydict(
                {
                    "bucket": pa.array([k for k, _, _ in cut], pa.int32()),
                    "anchor": pa.array([a[i:j].tobytes() for _, i, j in cut], pa.binary()),
                    "doc": pa.array([d[i:j].tobytes() for _, i, j in cut], pa.binary()),
                    "many": pa.array([np.packbits(many[i:j]).tobytes() for _, i, j in cut], pa.binary()),
                }
            )

        size = 0
        for rows, buf, off in chunks(batches):
            anchor, doc, _, _, _ = anchors_of(buf, off)
            if len(anchor):
                new = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
                held.append((anchor[new], ids(rows.column(0), LAST)[doc[new]]))
                size += len(new)
            if size >= FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()

    return lean(run)


def _probes(anchor: np.ndarray, bits: int) -> list[np.ndarray]:
    low, step = anchor & U64(0xFFFFFFFF), (anchor * U64(0x9E3779B97F4A7C15)) >> U64(32) | U64(1)
    return [((low + U64(k) * step) % U64(bits)).astype(np.int64) for k in range(PROBES)]


def _filter_part(bits: int):
    def run(blobs: pd.DataFrame) -> pd.DataFrame:
        a = np.concatenate([np.frombuffer(x, U64) for x in blobs.anchor])
        d = np.concatenate([np.frombuffer(x, np.int64) for x in blobs.doc])
        many = np.concatenate([np.unpackbits(np.frombuffer(m, np.uint8), count=len(x) // 8) for m, x in zip(blobs.many, blobs.anchor)]).astype(bool)
        order = np.argsort(a, kind="stable")
        a, d, many = a[order], d[order], many[order]
        same = np.flatnonzero(a[1:] == a[:-1])
        more = np.r_[a[many], a[same[d[same] != d[same + 1]]]]
        part = np.zeros(bits, bool)
        for p in _probes(more, bits):
            part[p] = True
        return pd.DataFrame({"bucket": blobs.bucket[:1], "part": [np.packbits(part).tobytes()]})

    return run


def _anchor_filter(rows: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """The Bloom filter of the anchors of two documents or more, a part for each bucket; FILTER_BITS in all."""
    bits = FILTER_BITS // buckets // 8 * 8
    dealt = rows.mapInArrow(_anchor_blobs(buckets), "bucket int, anchor binary, doc binary, many binary")
    out = np.zeros((buckets, bits // 8), np.uint8)
    for row in dealt.groupBy("bucket").applyInPandas(_filter_part(bits), "bucket int, part binary").toLocalIterator():
        out[row.bucket] = np.frombuffer(row.part, np.uint8)
    return out, bits


def _pass(table: np.ndarray, bits: int, anchor: np.ndarray) -> np.ndarray:
    bucket = _bucket(anchor, len(table)).astype(np.int64)
    good = np.ones(len(anchor), bool)
    for p in _probes(anchor, bits):
        good &= (table[bucket, p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & 1 == 1
    return good


def _window_blobs(buckets: int, shared, bits: int):
    """Rows (bucket, one, two, mark, doc, place, done): places of windows; those under done are settled here.

    A row of the input is known by its doc_id and ``mark``, 32 bits of its text's hash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        held: list[tuple[np.ndarray, ...]] = []

        def flush() -> pa.RecordBatch:
            one, two, mark, doc, place = (np.concatenate(x) for x in zip(*held))
            held.clear()
            order = np.lexsort((doc, two, one))
            o, t, d = one[order], two[order], doc[order]
            new = np.r_[True, (o[1:] != o[:-1]) | (t[1:] != t[:-1])]
            group = np.cumsum(new) - 1
            least = d == d[np.flatnonzero(new)][group]
            done = np.zeros(len(one), bool)
            done[order[~least]] = True
            # windows that are settled go with others of their document
            dealt = np.where(done, mix(doc.view(U64)) % U64(buckets), _bucket(one, buckets))
            sort = np.lexsort((place, mark, doc, done, dealt))
            key = (dealt[sort].astype(np.int64) << 1) | done[sort]
            at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            cols: dict[str, list] = {k: [] for k in ("bucket", "done", "one", "two", "mark", "doc", "place")}
            for i, j in zip(at, np.r_[at[1:], len(key)]):
                s = sort[i:j]
                cols["bucket"].append(int(key[i]) >> 1)
                cols["done"].append(bool(key[i] & 1))
                for k, x in (("one", one), ("two", two), ("mark", mark), ("doc", doc), ("place", place)):
                    cols[k].append(b"" if key[i] & 1 and k in ("one", "two") else x[s].tobytes())
            kinds = {"bucket": pa.int32(), "done": pa.bool_()}
            return pa.RecordBatch.from_pydict({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in cols.items()})

        size = 0
        for rows, buf, off in chunks(batches):
            anchor, doc, place, one, two = anchors_of(buf, off)
            if not len(anchor):
                continue
            turn = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
            hit = np.repeat(_pass(table, bits, anchor[turn]), np.diff(np.r_[turn, len(anchor)]))
            if hit.any():
                d = doc[hit]
                held.append((one[hit], two[hit], rows.column(2).to_numpy(zero_copy_only=False)[d].astype(np.uint32), ids(rows.column(0), LAST)[d], place[hit].astype(np.uint32)))
                size += len(d)
            if size >= FLUSH:
                yield flush()
                size = 0
        if held:
            yield flush()

    return lean(run)


def _runs(doc: np.ndarray, mark: np.ndarray, place: np.ndarray) -> pd.DataFrame:
    """Runs of windows: doc, mark, and packed pairs of (first place, windows)."""
    order = np.lexsort((place, mark, doc))
    doc, mark, place = doc[order], mark[order], place[order].astype(np.int64)
    if not len(doc):
        return pd.DataFrame({"doc": np.zeros(0, np.int64), "mark": np.zeros(0, np.int64), "runs": []})
    other = (doc[1:] != doc[:-1]) | (mark[1:] != mark[:-1])
    cut = np.flatnonzero(np.r_[True, other | (place[1:] > place[:-1] + 1)])
    last = np.r_[cut[1:], len(doc)] - 1
    pairs = np.stack([place[cut], place[last] - place[cut] + 1], 1)
    at = np.searchsorted(cut, np.flatnonzero(np.r_[True, other]))
    return pd.DataFrame({"doc": doc[cut[at]], "mark": mark[cut[at]].astype(np.int64), "runs": [pairs[i:j].tobytes() for i, j in zip(at, np.r_[at[1:], len(cut)])]})


def _settle_windows(blobs: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """The windows that go, dealt by document: one packed row for each bucket of documents."""
    done, rest = blobs[blobs.done], blobs[~blobs.done]
    kinds = {"doc": np.int64, "mark": np.uint32, "place": np.uint32}
    found = {c: [np.zeros(0, t), *(np.frombuffer(x, t) for x in done[c])] for c, t in kinds.items()}
    if len(rest):
        one, two = (np.concatenate([np.frombuffer(x, t) for x in rest[c]]) for c, t in (("one", U64), ("two", np.uint32)))
        more = {c: np.concatenate([np.frombuffer(x, t) for x in rest[c]]) for c, t in kinds.items()}
        order = np.lexsort((more["doc"], two, one))
        o, t, s = one[order], two[order], more["doc"][order]
        new = np.r_[True, (o[1:] != o[:-1]) | (t[1:] != t[:-1])]
        late = order[s != s[np.flatnonzero(new)][np.cumsum(new) - 1]]
        for c in kinds:
            found[c].append(more[c][late])
    doc, mark, place = (np.concatenate(found[c]) for c in kinds)
    target = (mix(doc.view(U64)) % U64(buckets)).astype(np.int64)
    order = np.lexsort((place, mark, doc, target))
    edges = np.searchsorted(target[order], np.arange(buckets + 1))
    cut = [(k, order[i:j]) for k, (i, j) in enumerate(zip(edges[:-1], edges[1:])) if j > i]
    return pd.DataFrame({"target": np.array([k for k, _ in cut], np.int32), "doc": [doc[x].tobytes() for _, x in cut], "mark": [mark[x].tobytes() for _, x in cut], "place": [place[x].tobytes() for _, x in cut]})


def _gather(blobs: pd.DataFrame) -> pd.DataFrame:
    return _runs(*(np.concatenate([np.frombuffer(x, t) for x in blobs[c]]) for c, t in (("doc", np.int64), ("mark", np.uint32), ("place", np.uint32))))


def kept_words(text: bytes, runs: bytes | None) -> tuple[int, list[bytes]]:
    """Number of words of a text, and those that no repeated window covers."""
    words = text.split()
    if not runs:
        return len(words), words
    edge = np.zeros(len(words) + 1, np.int64)
    pairs = np.frombuffer(runs, np.int64).reshape(-1, 2)
    np.add.at(edge, pairs[:, 0], 1)
    np.add.at(edge, np.minimum(pairs[:, 0] + pairs[:, 1] + WINDOW - 1, len(words)), -1)
    keep = np.cumsum(edge)[:-1] == 0
    return len(words), [words[i] for i in np.flatnonzero(keep)]


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        total, removed, texts = [], [], []
        for text, runs in zip(b.column(1), b.column(2)):
            n, kept = kept_words((text.as_py() or "").encode(), runs.as_py())
            total.append(n)
            removed.append(n - len(kept))
            texts.append(b" ".join(kept).decode())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())], ["doc_id", "n_words", "n_removed", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space) of every row."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").bitwiseAND(F.lit(0xFFFFFFFF)).alias("mark"))
    buckets = buckets_for(rows)
    table, bits = _anchor_filter(rows, buckets)
    shared = spark.sparkContext.broadcast(table)
    blobs = rows.mapInArrow(_window_blobs(buckets, shared, bits), "bucket int, done boolean, one binary, two binary, mark binary, doc binary, place binary")
    late = blobs.groupBy("bucket").applyInPandas(lambda x: _settle_windows(x, buckets), "target int, doc binary, mark binary, place binary")
    gathered = settle(late.groupBy("target").applyInPandas(_gather, "doc long, mark long, runs binary"), "repeats")
    gathered = gathered.withColumnRenamed("mark", "m")
    joined = rows.join(gathered, (F.coalesce("doc_id", F.lit(LAST)) == F.col("doc")) & (F.col("mark") == F.col("m")), "left").select("doc_id", "text", "runs")
    return joined.mapInArrow(lean(_cleaned), "doc_id long, n_words long, n_removed long, kept string")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, unnest(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), 1) AS n FROM documents),
w AS (SELECT *, CASE WHEN count(*) OVER f = 13 THEN string_agg(word, ' ') OVER f END AS win FROM d
      WINDOW f AS (PARTITION BY doc_id ORDER BY n ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
m AS (SELECT win, min(doc_id) AS least FROM w WHERE win IS NOT NULL GROUP BY win),
l AS (SELECT w.doc_id, w.n, w.word, coalesce(w.doc_id > m.least, false) AS late FROM w LEFT JOIN m ON w.win = m.win),
c AS (SELECT *, bool_or(late) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS gone FROM l),
k AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY n) FILTER (NOT gone) AS kept FROM c GROUP BY doc_id)
SELECT documents.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents LEFT JOIN k ON documents.doc_id = k.doc_id
"""
