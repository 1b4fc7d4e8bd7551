"""SimHash, substring and line dedup against brute force."""

import hashlib
from collections import Counter

import numpy as np
import xxhash

from foliant.llm import lines, simhash, substring

from ._rows import prose, table, texts

SPACES = " \t\n\x0b\x0c\r"


def _fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def _components(values, linked):
    parent = list(range(len(values)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if linked(values[i], values[j]):
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(values))]


def test_simhash(spark):
    base = prose(200, 20)
    rows = texts() + [(100 + i, base.replace("alpha", "alpha" if i % 3 else "omega", i % 5), "en", "a", 1, 0, 0.0, "") for i in range(30)]
    got = simhash.near_duplicates(table(spark, rows)).collect()
    prints = [_fingerprint(r[1]) for r in rows]
    roots = _components(prints, lambda a, b: (a ^ b).bit_count() <= 4)
    low = {}
    for r, root in zip(rows, roots):
        if r[0] is not None:
            low[root] = min(low.get(root, r[0]), r[0])
    assert Counter((g.doc_id, g.fingerprint, g.component_id) for g in got) == Counter((r[0], f"{p:016x}", low.get(root)) for r, p, root in zip(rows, prints, roots))


def test_simhash_keeps_one(spark):
    kept = simhash.keep_one(table(spark))
    assert kept.columns == table(spark).columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(set(rows)) and (0, texts()[0][1]) in rows and (2, texts()[0][1]) not in rows
    assert (2, prose(25, 9)) in rows


def test_ring_finds_every_close_pair():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 500, dtype=np.uint64)
    b = a.copy()
    for i in range(len(b)):
        for k in rng.choice(64, rng.integers(0, 5), replace=False):
            b[i] ^= np.uint64(1) << np.uint64(k)
    fp = np.r_[a, b]
    keys = simhash.ring_keys(fp)
    links = set()
    for row in keys:
        order = np.lexsort((fp, row))
        x, y = simhash.key_links(row[order], fp[order])
        links |= {frozenset(p) for p in zip(x.tolist(), y.tolist())}
    assert all(frozenset((p, q)) in links or p == q for p, q in zip(a.tolist(), b.tolist()))
    # keys of many fingerprints: the same components, whether a key is searched or paired
    big = np.uint64(7) ^ (np.uint64(1) << np.arange(64, dtype=np.uint64))
    big = np.unique(np.r_[big, big ^ np.uint64(1 << 40), big ^ np.uint64(0xFF << 30), rng.integers(0, 1 << 63, 40, dtype=np.uint64)])
    want = _components(big.tolist(), lambda p, q: (p ^ q).bit_count() <= 4)
    for small in (2, 64):
        joined = set()
        for row in simhash.ring_keys(big):
            order = np.lexsort((big, row))
            x, y = simhash.key_links(row[order], big[order], small)
            joined |= {frozenset(p) for p in zip(x.tolist(), y.tolist())}
        got = _components(big.tolist(), lambda p, q: frozenset((p, q)) in joined)
        assert len(set(want)) == len(set(got)) == len(set(zip(want, got)))


def _substring(rows):
    order = sorted({r[0] for r in rows if r[0] is not None}) + [None]
    seen, out = set(), []
    for d in order:
        new = set()
        for r in (r for r in rows if r[0] == d):
            w = (r[1] or "").encode().split()
            gone = [False] * len(w)
            for i in range(len(w) - 12):
                k = tuple(w[i : i + 13])
                new.add(k)
                if k in seen:
                    gone[i : i + 13] = [True] * 13
            kept = b" ".join(x for x, g in zip(w, gone) if not g)
            out.append((d, len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
        seen |= new
    return Counter(out)


def test_substring(spark):
    rows = texts() + [(50 + i, prose(20 + i, i) + " " + prose(30, 1), "en", "a", 1, 0, 0.0, "") for i in range(12)]
    got = substring.remove_repeats(table(spark, rows)).collect()
    assert Counter((g.doc_id, g.n_words, g.n_removed, hashlib.sha256(g.kept.encode()).hexdigest()) for g in got) == _substring(rows)


def _line_set(text: str) -> set[str]:
    return {text[i : i + 7] for i in range(max(1, len(text) - 6))}


def _line_similar(a: set, b: set) -> bool:
    return 5 * len(a & b) >= 4 * len(a | b)


def test_lines(spark):
    base = [prose(40, 70).replace("\n", " "), prose(35, 71).replace("\n", " ")]
    rows = texts() + [(200 + i, "\n".join([base[0].replace("alpha", "alpha" * (1 + (i % 4 == 1)), 1), "", "  " + base[1] + " ", f"own line {prose(6, i)}"]), "en", "a", 1, 0, 0.0, "") for i in range(25)]
    got = {(g.doc_id, g.text_hash): g for g in lines.duplicate_lines(table(spark, rows)).collect()}
    spots = sorted({(r[0] is None, r[0] or 0, i, r[1] or "", x.strip(SPACES)) for r in rows for i, x in enumerate((r[1] or "").split("\n")) if x.strip(SPACES)}, key=lambda s: s[:3])
    distinct = list(dict.fromkeys(s[4] for s in spots))
    roots = dict(zip(distinct, _components([_line_set(x) for x in distinct], _line_similar)))
    first = {}
    for s in spots:
        first.setdefault(roots[s[4]], s[:3])
    want = Counter()
    for null, d, i, text, line in spots:
        want[null, d] += first[roots[line]] != (null, d, i)
    assert {k: v for k, v in want.items() if v} == {k: n for k in want if (n := sum(len(g.removed) for (d, _), g in got.items() if ((d is None), d or 0) == k))}
    cleaned = lines.remove_lines(table(spark, rows))
    assert cleaned.columns == table(spark).columns and cleaned.count() == len(rows)
    by_id = {r.doc_id: r.text for r in cleaned.where("doc_id >= 200").collect()}
    assert by_id[224].startswith("\nown line") and by_id[200].startswith(base[0][:20])


def test_bands_have_high_recall():
    rng = np.random.default_rng(3)
    hit = 0
    for i in range(200):
        a = rng.integers(0, 1 << 63, 90, dtype=np.uint64)
        b = np.r_[a[:80], rng.integers(0, 1 << 63, 10, dtype=np.uint64)]  # similarity 0.8
        keys = lines.signatures(np.r_[a, b], np.array([90, 90]))
        hit += bool((keys[:, 0] == keys[:, 1]).any())
    assert hit >= 198


def test_search_of_a_large_band():
    import pandas as pd

    rng = np.random.default_rng(2)
    texts_ = []
    for i in range(90):
        words = prose(14, 300 + i % 3).replace("\n", " ").split()
        for k in rng.choice(len(words), rng.integers(0, 4), replace=False):
            words[k] = words[k] + "x"
        texts_.append(" ".join(words))
    texts_ = list(dict.fromkeys(texts_))
    links = lines._searched(pd.DataFrame({"line": range(len(texts_)), "words": [t.encode() for t in texts_], "key": 1}))
    sets = [_line_set(t) for t in texts_]
    pairs = {frozenset(p) for p in links.itertuples(index=False, name=None)}
    assert all(_line_similar(sets[a], sets[b]) for a, b in pairs) and len(texts_) > 40
    want = _components(sets, _line_similar)
    got = _components(list(range(len(sets))), lambda a, b: frozenset((a, b)) in pairs)
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got)))


def test_empty_tables(spark):
    none = table(spark, [])
    for found in (simhash.near_duplicates(none), simhash.keep_one(none), substring.remove_repeats(none), lines.duplicate_lines(none), lines.remove_lines(none)):
        assert found.count() == 0
