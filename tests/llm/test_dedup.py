import random

import numpy as np
import pytest

from scriptorium.llm import cdc, dartminhash as dm, hnsw

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n))


def edited(rnd, text, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = rnd.choice(WORDS) + "x"
    return " ".join(w)


def bag(text):
    doc, cell = dm.cells(*dm.shingle_hashes([dm.normal(text)]))
    return set(cell.tolist())


def brute(rows):
    """Class ids by all pairs."""
    key = [dm.normal(t) or "\0" + (t or "") for _, t in rows]
    bags = [bag(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(bags[i] & bags[j])
            if key[i] == key[j] or both and both >= 0.8 * (len(bags[i]) + len(bags[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: least[find(i)] for i, (d, _) in enumerate(rows)}


def test_signatures_estimate_weighted_similarity():
    rnd = random.Random(1)
    base = prose(rnd, 300)
    texts = [base, edited(rnd, base, 10), edited(rnd, base, 40), base + " " + " ".join(base.split()[:80]), prose(rnd, 300)]
    doc, cell = dm.cells(*dm.shingle_hashes([dm.normal(t) for t in texts]))
    sig = dm.signatures(doc, cell, len(texts), 4096)
    for i in range(len(texts)):
        for j in range(i):
            a, b = bag(texts[i]), bag(texts[j])
            assert abs((sig[i] == sig[j]).mean() - len(a & b) / len(a | b)) < 0.04


def test_signatures_of_fractional_weights():
    cell = dm.mix(np.arange(400, dtype=np.uint64))
    rng = np.random.default_rng(5)
    w = rng.random((2, 400))
    doc = np.repeat([0, 1], 400)
    sig = dm.signatures(doc, np.r_[cell, cell], 2, 4096, np.r_[w[0], w[1]])
    assert abs((sig[0] == sig[1]).mean() - np.minimum(*w).sum() / np.maximum(*w).sum()) < 0.04


def test_classes_equal_brute_force(spark):
    rnd = random.Random(7)
    rows, n = [], 0
    for size in (1, 1, 1, 3, 30, 90):
        base = prose(rnd, rnd.randrange(60, 160))
        for _ in range(size):
            rows.append((n, edited(rnd, base, rnd.choice((0, 0, 1, 2, 3, 4)))))
            n += 1
    rows += [(n, "one two"), (n + 1, "One, TWO!"), (n + 2, ""), (n + 3, None), (n + 4, "!!!"), (n + 5, "a"), (n + 6, "一 二 三 四 五 六"), (n + 7, "x " * 30000), (n + 8, "x " * 30001)]
    docs = spark.createDataFrame([(d, t, d, "s") for d, t in rows], "doc_id long, text string, digest long, rep string")
    got = {r["doc_id"]: r["class_id"] for r in dm.near_duplicates(spark, docs, block=8).collect()}
    assert got == brute(rows)


def test_classes_of_odd_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert dm.near_duplicates(spark, empty).count() == 0
    rows = [(None, "a b c d e f"), (None, None), (5, "a b c d e f"), (5, "a b c d e f"), (5, "other words are in this row"), (6, "a b c d e f")]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, kept int")
    got = sorted(map(tuple, dm.near_duplicates(spark, docs).collect()), key=repr)
    assert (6, 5, False) in got and sum(r[0] is None and r[2] for r in got) == 2
    left = dm.drop_near_duplicates(spark, docs)
    assert left.columns == docs.columns and sorted([r["doc_id"] for r in left.collect()], key=repr) == [5, None, None]


def naive_ends(data):
    out, last, n = [], 0, len(data)
    for e in range(1, n + 1):
        h = 0
        for j in range(cdc.WINDOW):
            if e - 1 - j >= 0:
                h += int(cdc._GEAR[data[e - 1 - j]]) << j
        h = (h & 0xFFFFFFFF) >> (cdc.WINDOW - 10) & 1023
        after = data[e] if e < n else 0
        most = cdc.AFTER_SPACE if data[e - 1] in b" \n\t\r" else cdc.WIDE if after >= 0xE0 else cdc.ELSE
        whole = after & 0xC0 != 0x80
        if whole and (h < most and e - last >= cdc.LEAST or e - last >= cdc.MOST) or e == n:
            out.append(e)
            last = e
    return out


@pytest.mark.parametrize("text", ["", "a", "hello world " * 40, "x" * 2000, "漢字かな" * 300, "é" * 700])
def test_chunk_ends(text):
    data = text.encode()
    got = cdc.ends(data)
    assert got == sorted(set(got)) and (not data or got[-1] == len(data))
    assert all(b - a <= cdc.MOST + 3 for a, b in zip([0, *got], got)) and all(data[:e].decode() or True for e in got)
    assert got == naive_ends(data)


def test_chunks_resist_insertions():
    rnd = random.Random(2)
    text = prose(rnd, 2000)
    one, two = ({d for d, _, _ in cdc.chunks(t.encode())} for t in (text, "Inserted words. " + text[:5000] + " more " + text[5000:]))
    assert len(one & two) > 0.97 * len(one)


def test_repeats_are_whole_shared_passages(spark):
    rnd = random.Random(3)
    passages = [prose(rnd, n) for n in (51, 60, 120, 400)]
    short = prose(rnd, 30)
    rows = [(i, prose(rnd, 80) + " " + passages[i % 4] + "\n" + prose(rnd, 40) + " " + short) for i in range(40)] + [(40 + i, prose(rnd, 200)) for i in range(20)]
    rows += [(60, None), (61, ""), (62, passages[0]), (63, "word " * 20000), (None, passages[1])]
    docs = spark.createDataFrame([(d, t, 3, "k") for d, t in rows], "doc_id long, text string, size int, first string")
    text = dict(rows)
    found = cdc.repeats(spark, docs).collect()
    hit = {r["doc_id"]: r for r in found}
    assert set(hit) == {*range(4, 40), 62}
    for d, r in hit.items():
        p = passages[0] if d == 62 else passages[d % 4]
        assert r["first_doc_id"] == (0 if d == 62 else d % 4) and p in text[d][r["start"] : r["end"]] and r["n_words"] >= 50
    out = {r["doc_id"]: r["text"] for r in cdc.without_repeats(spark, docs, chars_col=None).collect()}
    assert 62 not in out and {60, 61, 63, None} <= set(out)
    for p in passages[:2]:
        assert [d for d, t in out.items() if t and p in t and d is not None] == [passages.index(p)]
    assert all(out[d] == text[d] for d in [*range(4), *range(40, 60), 60, 61, 63, None])
    assert cdc.repeats(spark, docs.where("false")).count() == 0


def test_overlapping_spans_are_cut_once(spark):
    x = spark.createDataFrame([("0123456789", [(2, 5), (4, 7), (3, 4), (9, 10)]), ("ab", [(0, 2)])], "t string, s array<struct<start:long,end:long>>")
    assert [r[0] for r in x.select(cdc._cut_out(x["t"], x["s"])).collect()] == ["0178", ""]

def test_links_of_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    for c in range(5):
        x[c * 100 : c * 100 + 60] = x[c * 100] + 0.05 * rng.normal(size=(60, 16))
    x[700:720] = x[699]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0] * 15 + [float("inf")]), (2004, [1.0] * 15 + [None]), (2005, []), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [1e200] * 16), (2009, [1e-200] * 16), (None, [1.0] * 16)]
    docs = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<double>, key int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in hnsw.near_duplicates(spark, docs, shard_rows=200).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    for i in range(900):
        assert got[i][0] == near[i].sum()
        seen, todo = {i}, [i]
        while todo:
            for j in np.flatnonzero(near[todo.pop()]).tolist():
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        assert got[i][1] == min(seen)
    assert all(got[i] == (0, i, True) for i in range(2000, 2006))
    assert got[2006] == (1, 2006, True) and got[2007] == (1, 2006, False) and got[2008] == (1, 2008, True) and got[2009] == (1, 2008, False)
    assert hnsw.near_duplicates(spark, docs.where("false")).count() == 0


def test_audit_widens_the_beam():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(400, 8)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    bad = hnsw.Graph(x, [np.full((400, 2), -1)])  # no links: searches find their entries only
    beam = hnsw.audited(bad, x, 0.6, beam=4)
    r, c = bad.hits(x, 0.6, beam)
    assert beam > 4 and len(r) == (x @ x.T >= 0.6).sum()


def test_audit_measures_where_links_are_rare():
    # no query but eight has a hit, and the graph has no links: only planted probes can show that the search finds nothing
    rng = np.random.default_rng(7)
    x, q = (y / np.linalg.norm(y, axis=1)[:, None] for y in rng.normal(size=(2, 4000, 64)).astype(np.float32))
    q[11::500] = x[70:78]
    bad = hnsw.Graph(x, [np.full((4000, 2), -1)])
    beam = hnsw.audited(bad, q, 0.9)
    r, c = bad.hits(q, 0.9, beam)
    assert beam > hnsw.WIDEST and sorted(zip(r.tolist(), c.tolist())) == [(11 + 500 * i, 70 + i) for i in range(8)]
    good = hnsw.Graph.build(x, rng.random(4000))
    beam = hnsw.audited(good, q, 0.9)
    r, c = good.hits(q, 0.9, beam)
    assert beam <= hnsw.WIDEST and sorted(zip(r.tolist(), c.tolist())) == [(11 + 500 * i, 70 + i) for i in range(8)]


@pytest.mark.parametrize("n", [1, 2, 5, 40])
def test_small_graphs(n):
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 4)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    g = hnsw.Graph.build(x, rng.random(n))
    r, c = g.hits(x, 0.5, 4)
    assert len(r) == (x @ x.T >= 0.5).sum()


def test_no_text_leaves_a_null_class(spark):
    x = dm.near_duplicates(spark, spark.createDataFrame([(None, "a")], "doc_id long, text string")).first()
    assert x["class_id"] is None and x["kept"]


def test_common_counts():
    rng = np.random.default_rng(3)
    bags = [np.unique(rng.integers(0, 9000, n).astype("<u8")) for n in (5000, 0, 700, 3000, 1)]
    got = dm.common_counts(bags[:3], bags[1:])
    assert got.tolist() == [[len(np.intersect1d(a, b)) for b in bags[1:]] for a in bags[:3]]


def test_links_of_large_mixed_buckets_equal_brute_force(spark):
    # copies of one text with similarities around the threshold: many have a single link, to a copy with nearly the same edits
    rnd = random.Random(11)
    base, texts = prose(rnd, 150), []
    for _ in range(250):
        w = edited(rnd, base, rnd.choice((4, 5, 6)))
        texts += [w, edited(rnd, w, 2)]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert len(set(want.values())) > 100
    for block in (dm.BLOCK, 60):
        assert {r["doc_id"]: r["class_id"] for r in dm.near_duplicates(spark, docs, block=block).collect()} == want


def test_earlier_documents_with_parts_of_a_passage(spark):
    rnd = random.Random(12)
    rows, want = [], {}
    for k in range(12):
        p, n = prose(rnd, 52).split(), 10 * k
        parts = ([p[:45]], [p[:49], p[3:]], [p[:20], p[20:40], p[30:]])[k % 3]
        rows += [(n + i, prose(rnd, 40) + " " + " ".join(x) + " " + prose(rnd, 40)) for i, x in enumerate(parts)]
        rows += [(n + i, prose(rnd, 40) + " " + " ".join(p) + " " + prose(rnd, 40)) for i in (7, 8, 9)]
        want |= {n + i: (n + 7, " ".join(p)) for i in (8, 9)}
    text = dict(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"]: (r["first_doc_id"], text[r["doc_id"]][r["start"] : r["end"]]) for r in cdc.repeats(spark, docs).collect()} == want


def test_passages_of_short_words_and_copies_of_whole_texts(spark):
    rnd = random.Random(13)
    short = lambda n: " ".join("".join(rnd.choices("abcdefghij", k=rnd.choice((1, 2)))) for _ in range(n))
    rows, want = [], {}
    for k in range(40):  # passages of 52 words of one or two letters: few chunks or none
        p = short(52)
        rows += [(2 * k, short(30) + " " + p + " " + short(30)), (2 * k + 1, short(30) + " " + p + " " + short(30))]
        want[2 * k + 1] = (2 * k, p)
    whole = prose(rnd, 90)
    rows += [(100 + i, f" {whole}\n") for i in range(50)] + [(200, whole + " and more"), (201, "few words"), (202, "few words")]
    want |= {100 + i: (100, whole) for i in range(1, 50)} | {200: (100, whole)}
    rows += [(150, prose(rnd, 60)), (150, whole), (7, prose(rnd, 60))]  # repeated ids
    want[150] = (100, whole)
    docs = spark.createDataFrame([(d, t, i) for i, (d, t) in enumerate(rows)], "doc_id long, text string, version int")
    found = cdc.repeats(spark, docs.union(docs.where("doc_id = 3"))).collect()
    text = {d: {t for e, t in rows if e == d} for d, _ in rows}
    assert {r["doc_id"] for r in found} == set(want)
    for r in found:
        first, p = want[r["doc_id"]]
        assert r["first_doc_id"] == first and any(p in t[r["start"] : r["end"]] for t in text[r["doc_id"]])


def test_stretches_equal_brute_force(spark):
    # documents made of a few phrases: every repeated stretch of 50 words is found, and nothing else
    rnd = random.Random(14)
    phrases = [prose(rnd, n) for n in (7, 11, 13, 17, 23, 40)] + ["a b c d e f g h i j", "x " * 300, "word", "漢字かな交じり文 " * 3]
    rows = [(i, " ".join(rnd.choice(phrases) for _ in range(rnd.randint(1, 12)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = {d: t.split() for d, t in rows}
    first, spans = {}, {}
    for d, w in words.items():
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, w in words.items():
        spans[d] = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
    got = {d: set() for d in words}
    for r in cdc.repeats(spark, docs).collect():
        t = dict(rows)[r["doc_id"]]
        at = len(t[: r["start"]].split())
        got[r["doc_id"]] |= set(range(at, at + len(t[r["start"] : r["end"]].split())))
    assert got == spans and sum(map(bool, spans.values())) > 10
