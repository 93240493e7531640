"""Whole results against plain simulations and brute force, and the pipeline on odd tables."""

import random
import zlib

import numpy as np
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from scriptorium.llm import dartminhash as dm, hnsw, packing, pfair, zdict
from scriptorium.llm.tokens import default_vocabulary

WORDS = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r", "st")]


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) + rnd.choice(WORDS) for _ in range(n))


# mixing


def simulated(blocks, share_of):
    """Slots of all blocks by a plain earliest-deadline-first run, slot by slot. share_of: shares of the sources that have blocks left."""
    at = {s: 0 for s, n in blocks.items() if n}
    out, now = {}, 0
    while at:
        share = share_of(sorted(at, key=lambda s: (s is None, str(s))))
        q, t, next_, left = sum(share.values()), 0, dict.fromkeys(share, 0), len(share)
        while left > len(share) // 2:
            ready = [(-(-(i + 1) * q // share[s]), k, s) for k, s in enumerate(share) if (i := next_[s]) * q // share[s] <= t]
            _, _, s = min(ready)
            if at[s] < blocks[s]:
                out[s, at[s]] = now + t
                at[s] += 1
                left -= at[s] == blocks[s]
            next_[s] += 1
            t += 1
        now += t
        at = {s: i for s, i in at.items() if i < blocks[s]}
    return out


@pytest.mark.parametrize("blocks", [{"a": 37, "b": 5, "c": 1}, {"a": 400, "b": 3, "c": 90, "d": 91, "e": 1}, {"x": 7}, {f"s{i}": i + 1 for i in range(30)}])
def test_schedule_equals_a_plain_simulation(blocks):
    weights = {s: 1.0 + (len(s) + n) % 5 for s, n in blocks.items()}
    want = simulated(blocks, lambda names: pfair.shares({s: weights[s] for s in names}, 60))
    got = {(s, b): at + (b - first) // share * q + slots[(b - first) % share] for s, first, last, at, share, q, slots in pfair.schedule(blocks, weights, 60) for b in range(first, last)}
    assert got == want


def test_many_sources(spark):
    n = 50_000
    plan = pfair.schedule({f"s{i}": 1 + i % 7 for i in range(n)}, {f"s{i}": (1 + i % 7) ** 0.5 for i in range(n)})
    assert len(plan) <= 2 * n + 100
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % n).cast("string")).alias("source"))
    x = pfair.positions(spark, docs).agg(F.count("*"), F.count_distinct("position"), F.count_distinct("doc_id")).first()
    assert tuple(x) == (60_000,) * 3


# packing


def plain_best_two_fit(lengths, size):
    left, bins = sorted(lengths, reverse=True), []
    while left:
        own, gap = [], size
        while fits := [x for x in left if x <= gap]:
            own.append(fits[0])
            left.remove(fits[0])
            gap -= fits[0]
        if gap and len(own) > 1:
            x = own[-1]
            sums = [a + b for i, a in enumerate(left) for b in left[i + 1 :] if x < a + b <= gap + x]
            if sums:
                best = max(sums)
                a = next(a for a in left if best - a in left and (2 * a != best or left.count(a) > 1))
                own[-1:] = [a, best - a]
                left.remove(a)
                left.remove(best - a)
                left = sorted([*left, x], reverse=True)
        bins.append(sorted(own))
    return sorted(bins)


@pytest.mark.parametrize("seed", range(8))
def test_bins_equal_a_plain_best_two_fit(seed):
    rnd = random.Random(seed)
    lengths = [rnd.choice((rnd.randint(1, 100), rnd.randint(20, 60), 33)) for _ in range(120)]
    assert sorted(sorted(lengths[i] for i in b) for b in packing.best_two_fit(lengths, 100)) == plain_best_two_fit(lengths, 100)


# files of ids


def test_wide_ids_and_files_that_stay(spark, tmp_path):
    with pytest.raises(ValueError):
        zdict.serialised((70_000).to_bytes(4, "little"), 2)
    docs = spark.createDataFrame([(i // 3 if i % 5 else None, f"text number {i}") for i in range(90)], "doc_id long, text string")
    manifest, dictionary = zdict.write(spark, docs, default_vocabulary(), shard=10, width=4, destination=f"file://{tmp_path}/ids")
    got = zdict.read(spark, manifest, dictionary).collect()
    assert len(got) == 90 and sum(r["doc_id"] is None for r in got) == 18 and len(list((tmp_path / "ids").glob("*.ids"))) == manifest.count() > 3
    starts = sorted((r["start"], r["n_tokens"]) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


# near-duplicates


def test_first_text_of_an_id_stays(spark):
    rows = [(5, "zzz zz z", 1), (5, "aaa aa a", 2), (5, "aaa aa a", 1), (6, "bbb", 3), (None, "c", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest int")
    assert sorted(map(tuple, dm.drop_near_duplicates(spark, docs).collect()), key=repr) == sorted([(5, "aaa aa a", 1), (6, "bbb", 3), (None, "c", 4)], key=repr)


def test_repeated_vector_ids(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.99, 0.1]
    docs = spark.createDataFrame([(1, a, 0), (1, a, 0), (2, b, 0), (2, a, 0), (3, c, 0), (4, [2.0, 0.0, 0.0], 0)], "vec_id long, embedding array<double>, component_id int")
    got = hnsw.near_duplicates(spark, docs).collect()
    assert len(got) == 6 and {r["component_id"] for r in got if r["vec_id"] in (1, 4)} == {1}
    assert next(r for r in got if r["vec_id"] == 3)["n_links"] == 1


# pipeline


def bag(words):
    k = min(5, len(words))
    grams = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
    return {(g, sum(h == g for h in grams[:i])) for i, g in enumerate(grams)}


def expected(rows):
    """Texts that near-dedup and substring dedup leave, by all pairs and all stretches: id, text."""
    rows = sorted(set(rows))
    words = {d: t.lower().split() for d, t in rows}
    bags = {d: bag(w) for d, w in words.items()}
    root = {d: d for d, _ in rows}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for d, _ in rows:
        for e, _ in rows:
            both = len(bags[d] & bags[e])
            if e < d and (words[d] == words[e] or both and both >= 0.8 * (len(bags[d]) + len(bags[e]) - both)):
                root[max(find(d), find(e))] = min(find(d), find(e))
    kept = [(d, t) for d, t in rows if find(d) == d]
    first, out = {}, {}
    for d, t in kept:
        w = t.split(" ")
        for i in range(len(w) - 49):
            first.setdefault(tuple(w[i : i + 50]), d)
    for d, t in kept:
        w = t.split(" ")
        gone = {j for i in range(len(w) - 49) if first[tuple(w[i : i + 50])] < d for j in range(i, i + 50)}
        # a cut leaves the spaces at both of its ends
        text = "".join(("" if j in gone else x) + ("" if j in gone and j + 1 in gone or j == len(w) - 1 else " ") for j, x in enumerate(w))
        if not gone or text.strip():
            out[d] = text if gone else t
    return out


def test_pipeline_equals_brute_force(spark, tmp_path):
    rnd = random.Random(21)
    shared, texts = [prose(rnd, n) for n in (55, 80)], []
    for i in range(60):
        texts.append(prose(rnd, rnd.randint(20, 120)) + (" " + shared[i % 2] + " " + prose(rnd, 70) if i % 4 == 0 else ""))
    texts += [texts[0], texts[3] + " end", texts[8].replace(" ", " ", 1) + " x", shared[0], prose(rnd, 3000), "a", "A", ""]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(d, t, "en", f"s{d % 3}", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(d, 1, 0) for d, _ in rows], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")  # all good: nothing is rejected
    want = expected(rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer, pieces, bins = tokenizers.Tokenizer.from_file(default_vocabulary()), set(), {}
    for d, t in want.items():
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        pieces |= {(d, n, at, len(ids[at : at + 2048]), zlib.crc32(ids[at : at + 2048].tobytes())) for n, at in enumerate(range(0, len(ids), 2048))}
    assert {(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got} == pieces and len(got) == len(pieces)
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == bins.get(r["sequence_id"], 0)
        bins[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(bins.values()) <= 2048


def test_pipeline_stages_on_odd_tables(spark, tmp_path):
    rnd = random.Random(22)
    long = prose(rnd, 20_000)
    rows = [(1, long, None, None, None), (2, long + " end", "en", "a", 5), (None, None, None, None, None), (None, "some words", "en", "a", 3), (3, None, "en", "a", 0), (4, "", "en", None, 0), (5, "x y z", "en", "a", 5), (5, "x y z", "en", "a", 5), (5, "other words", "en", "b", 9)]
    clash = "rep string, digest int, _spans string, shard int, copy string, _mix__s string"
    docs = spark.createDataFrame([(*r, "r", 1, "s", 2, "c", "m") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + clash)
    spark.createDataFrame([(1, 1, 0), (None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, x in (("odd", docs), ("none", docs.where("false"))):
        for stage, f in corpus_pipeline.STAGES:
            columns, path = x.columns, f"{tmp_path}/{name}-{stage}"
            f(spark, x, str(tmp_path)).write.parquet(path)
            x = spark.read.parquet(path)
            assert stage == "pack" or x.columns == columns
        got = x.collect()
        assert {r["doc_id"] for r in got} == ({1, 3, 5, None} if name == "odd" else set())  # 2 is a near copy of 1, 3 and 4 have no words
