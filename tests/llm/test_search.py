"""Neighbours, contamination, mixing, quality and personal data against brute force."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from foliant.llm import ann, decontaminate, mixing, pii, quality

from ._rows import prose, table, texts


def _vectors(spark):
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=16).astype(np.float32).tolist(), 1, 2.0) for i in range(300)]
    rows += [(300 + i, rows[5][1], 1, 2.0) for i in range(60)]  # ties
    rows += [(400, None, 1, 2.0), (401, [0.0] * 16, 1, 2.0), (402, [1.0, None] * 8, 1, 2.0), (403, [float("nan")] * 16, 1, 2.0), (404, [float("inf")] * 16, 1, 2.0), (405, [], 1, 2.0), (420, [1.0, 2.0], 1, 2.0), (421, [3.0, 2.0], 1, 2.0), (None, rows[0][1], 1, 2.0), rows[20]]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, score double")


def test_nearest(spark):
    rows, df = _vectors(spark)
    good = {r[0]: np.array(r[1], float) for r in rows if r[0] is not None and r[1] and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])}
    want = []
    for q in (q for q in good if q % 20 == 0):
        scored = []
        for c in good:
            if c != q and len(good[c]) == len(good[q]):
                total = 0.0
                for a, b in zip(good[q], good[c]):
                    total += a * b
                scored.append((-total, c))
        want += [(q, k, c, -s) for k, (s, c) in enumerate(sorted(scored)[:20], 1)]
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df, F.col("vec_id") % 20 == 0).collect()]
    assert sorted(got) == sorted(want)
    assert ann.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_contamination(spark):
    items = [(1, prose(30, 50)), (2, prose(28, 51)), (3, None), (4, " \n "), (5, "tiny"), (5, prose(26, 52))]
    one, two = items[0][1], items[1][1]
    edited = one[:40] + "Q" + one[41:90] + one[93:]  # four edits
    rows = [
        (1, prose(50, 60) + " " + one + " end"),
        (2, "A " + two.upper().replace(" ", "  \n") + " b"),
        (3, prose(20, 61) + edited + prose(20, 62)),
        (4, prose(50, 63)),
        (5, one[: len(one) // 2]),
        (6, "a tiny word"),
        (None, two),
        (7, None),
        (8, ""),
    ]
    docs = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, bench).collect()}
    assert set(got) == {(1, 1), (2, 2), (3, 1), (6, 5), (None, 2)}
    assert got[1, 1].edits == 0 and rows[0][1][got[1, 1].start : got[1, 1].end] == one
    assert got[3, 1].edits == 4
    assert {r.doc_id for r in decontaminate.clean(docs, bench).collect()} == {4, 5, 7, 8}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0 and decontaminate.clean(docs.limit(0), bench).count() == 0


def _distance(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_no_region_within_the_budget_is_lost():
    rng = np.random.default_rng(8)
    items = decontaminate.Items([(k, decontaminate.normal(prose(12 + k, 80 + k))) for k in range(6)], 0.1)
    for trial in range(40):
        k = trial % 6
        body = list(" ".join(items_text(k).split()))
        for _ in range(rng.integers(0, int(items.edits[k]) + 3)):
            at = int(rng.integers(0, len(body)))
            body[at : at + int(rng.integers(0, 2))] = ["", "#", "##"][rng.integers(0, 3)][:1]
        text = prose(10, trial) + "".join(body) + prose(10, trial + 1)
        x = decontaminate.normal(text)
        found = {i for _, i, *_ in items.matches(x, np.array([0, len(x)]))}
        want = {i for i in range(6) if _distance(items.points[i].tolist(), x.tolist()) <= items.edits[i]}
        assert found == want


def test_short_items_have_the_same_rate():
    rng = np.random.default_rng(18)
    for m in range(1, 41):
        item = "".join(rng.choice(list("abcdefgh"), m))
        (items,) = decontaminate.Items.by_size([(m, item)], 0.1)
        assert items.edits[0] == m // 10 and m - items.q + 1 - items.q * items.edits[0] >= 1
        for _ in range(12):
            body = list(item)
            for _ in range(rng.integers(0, m // 10 + 2)):
                at = int(rng.integers(0, len(body))) if body else 0
                body[at : at + int(rng.integers(0, 2))] = ["", "#"][rng.integers(0, 2)]
            text = "".join(rng.choice(list("abcdefgh"), 30)) + "".join(body) + "".join(rng.choice(list("abcdefgh"), 30))
            x = decontaminate.normal(text)
            assert bool(items.matches(x, np.array([0, len(x)]))) == (_distance(item, text) <= m // 10), (item, text)


def test_long_repetitive_texts_take_bounded_memory():
    import tracemalloc

    (items,) = decontaminate.Items.by_size([(1, "-" * 100)], 0.1)
    for text in ("-" * 1_000_000, "=-" * 100_000 + "-" * 100):
        x = decontaminate.normal(text)
        tracemalloc.start()
        assert items.matches(x, np.array([0, len(x)]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 400 << 20


def items_text(k):
    return prose(12 + k, 80 + k)


def test_mixing(spark):
    rows = texts() + [(1000 + i, prose(5 + i % 40, i), "en", ["hot", "hot", "b", "a"][i % 4], 1, 0, 0.0, "") for i in range(300)]
    got = mixing.plan(table(spark, rows)).collect()
    sizes = [(r[0], r[3], len((r[1] or "").encode().split())) for r in rows]
    assert Counter((g.doc_id, g.source, g.size) for g in got) == Counter(sizes)
    per = defaultdict(int)
    for _, s, n in sizes:
        per[s] += n
    names = sorted((s for s in per if s is not None)) + [None]
    weight = dict(zip(names, [5.0, 2.0, 1.0] * len(names)))
    want, open_, rest = {}, set(names), 1.5 * sum(per.values())
    while True:  # the rounds as they are described
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * per[s]}
        want.update({s: 2.0 * per[s] for s in over} or share)
        rest -= sum(2.0 * per[s] for s in over)
        open_ -= over
        if not over or not open_:
            break
    for g in got:
        assert g.source_size == per[g.source] and abs(g.target - want[g.source]) < 1e-6 and g.taken <= 2 * g.size
    taken = defaultdict(int)
    for g in got:
        taken[g.source] += g.taken
    assert all(abs(taken[s] - want[s]) <= 1 for s in names)
    again = mixing.plan(table(spark, rows[::-1])).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = mixing.mix(table(spark, rows))
    assert mixed.columns == table(spark).columns
    words = defaultdict(int)
    for r in mixed.collect():
        words[r.source] += len(r.text.encode().split())
    assert dict(words) == {s: n for s, n in taken.items() if n}
    assert mixing.plan(table(spark, [])).count() == 0 and mixing.mix(table(spark, [])).count() == 0


def test_quality(spark):
    good = [(i, prose(40, i)) for i in range(200)]
    junk = [(200 + i, " ".join(w + "###" for w in prose(40, i).split())) for i in range(60)] + [(260 + i, "Le " * 30 + f"word{i}") for i in range(40)]
    rows = [(d, t, "en", "s", 1, 0, 9.0, "") for d, t in good + junk] + texts()[4:8] + [texts()[14]]
    labels = spark.createDataFrame([(d, int(d < 200), 0) for d in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    docs = table(spark, rows)
    found = quality.score(docs, quality.fit(docs, labels)).collect()
    assert Counter(r.doc_id for r in found) == Counter(r[0] for r in rows)
    held = [r for r in found if r.doc_id is not None and 12 < r.doc_id < 300 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(r.held_out for r in held) and len(held) > 30
    assert np.mean([(r.score >= 0.3) == (r.doc_id < 200) for r in held]) > 0.9
    assert all(0 <= r.score <= 1 for r in found)
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    only = labels.where("quality = 1 and doc_id < 3")
    assert {round(r.score, 6) for r in quality.score(docs, quality.fit(docs, only)).collect()} != set()
    assert quality.score(docs, quality.fit(docs, labels.limit(0))).first().score == 0.5
    assert quality.score(docs.limit(0), quality.fit(docs.limit(0), labels)).count() == 0


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def _base(text):
    def ok(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "card":
            total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(reversed(digits)))
            return 12 <= len(digits) <= 19 and total % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(k, m.group())]
    return [(k, a, b) for a, _, b, k in sorted(found)]


def test_personal_data(spark):
    rng = np.random.default_rng(6)
    odd = ["é a@b.c_d@e.f x", "1.2.3.4.5.6.7.8", "999.1.1.1.2", "00000000001.2.3.4", "+" * 50, "1" * 5000, "a@b.c" * 100, " ".join(["10.0.0.1"] * 600)]
    odd += ["".join(rng.choice(list("a@.+1 -(25é_"), 200)) for _ in range(60)]
    tell = "secret zanzibarword note for boss@corp.example today"
    rows = texts() + [(500 + i, t, "", "", 1, 0, 0.0, "") for i, t in enumerate(odd)]
    rows += [(700 + i, f"{prose(20, i)} {tell} {prose(5, i)}", "", "", 1, 0, 0.0, "") for i in range(6)] + [(800, "only zanzibarword here", "", "", 1, 0, 0.0, "")]
    got = pii.find(table(spark, rows)).collect()
    want = Counter((r[0], tuple(_base(r[1]))) for r in rows)
    assert Counter((g.doc_id, tuple((s.kind, s.start, s.end) for s in g.base)) for g in got) == want
    more = {g.doc_id: [s for s in g.spans if s.kind in ("remove", "generalise")] for g in got if g.doc_id is not None and g.doc_id >= 700}
    assert any(s.value == "zanzibarword" for s in more[800]) and all(any(s.value == "zanzibarword" for s in more[700 + i]) for i in range(6))
    clean = {r.doc_id: r.text for r in pii.sanitise(table(spark, rows)).where("doc_id >= 700").collect()}
    assert "boss@corp" not in clean[701] and "<EMAIL>" in clean[701] and "zanzibarword" not in clean[800]
    assert pii.find(table(spark, [])).count() == 0


def _revealing(rows):
    """Spans of revealing terms by brute force: doc_id and text to sorted (start, end, kind)."""
    docs = {(d, t or "") for d, t, *_ in rows}
    words = {r: set(re.findall(r"[^\W\d_]{3,}", r[1].lower())) for r in docs}
    held, inside = defaultdict(set), defaultdict(set)
    for r in docs:
        for k, a, b in _base(r[1]):
            held[k, r[1][a:b].lower()].add(r)
        for w in words[r]:
            inside[w].add(r)
    share = defaultdict(float)
    for e, own in held.items():
        for w in set().union(*(words[r] for r in own)):
            pmi = np.log(len(docs) * len(own & inside[w]) / len(own) / (len(inside[w]) + 1))
            share[w] = max(share[w], pmi / np.log(len(docs) / len(own)))
    out = {}
    for d, t in docs:
        base = [(a, b) for _, a, b in _base(t)]
        found = [(m.start(), m.end(), "remove" if share[m.group().lower()] >= 0.95 else "generalise") for m in re.finditer(r"[^\W\d_]{3,}", t) if share[m.group().lower()] >= 0.8]
        out[d, t] = [f for f in found if not any(a < f[1] and f[0] < b for a, b in base)]
    return out


def test_terms_of_the_whole_document(spark):
    far = " plain words that all share" * 20
    rows = [(1000 + i, "plain words that all share", "", "", 1, 0, 0.0, "") for i in range(300)]
    rows += [(100, f"Zorblax wrote{far} to one@corp.example and two@corp.example", "", "", 1, 0, 0.0, ""), (101, f"ask zorblax{far} here", "", "", 1, 0, 0.0, "")]
    rows += [(102 + i, f"{far} Quillfeather zorb{far} 10.1.2.3 \u0130stanbul", "", "", 1, 0, 0.0, "") for i in range(2)]
    rows += [(200 + i, f"boss@corp.example {prose(30, i)}", "", "", 1, 0, 0.0, "") for i in range(25)] + [(300, " ".join(f"w{chr(97 + i % 26)}{chr(97 + i // 26)}q" for i in range(200)) + " a@b.example", "", "", 1, 0, 0.0, "")]
    rows.append(rows[-1])
    want = _revealing([(d, t.replace("\u0130", "i")) for d, t, *_ in rows])
    got = {g.doc_id: [(s.start, s.end, s.kind) for s in g.spans if s.kind in ("remove", "generalise")] for g in pii.find(table(spark, rows)).collect()}
    assert got == {d: spans for (d, _), spans in want.items()}
    assert got[100][0][:2] == (0, 7) and got[101][0][:2] == (4, 11) and len(got[300]) == 200
    assert all(any(s[1] - s[0] == 12 for s in got[102 + i]) for i in range(2)) and got[1000] == []


def test_digest(spark, tmp_path):
    table(spark).write.parquet(str(tmp_path / "documents.parquet"))
    for r in pii.op3_pii_sanitise(spark, str(tmp_path)).where("doc_id = 11").collect():
        spans = _base(texts()[15][1])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == (1, 1, 1, 1)
