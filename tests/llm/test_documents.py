import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from pyspark.sql import functions as F

from scriptorium.llm import chat, cws, dartminhash, oracle, packing, pfair, quality, queries


def test_every_operator_has_a_query():
    known = entry.queries()
    assert {int(n[2:].split("_")[0]) for n in known if n.startswith("op")} == set(range(1, 11)) and "pipeline" in known


@pytest.mark.parametrize("name", sorted(oracle.ORACLES))
def test_oracles(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    sort = lambda df: sorted(map(repr, df[sorted(df.columns)].astype(object).where(df[sorted(df.columns)].notna(), None).values.tolist()))
    assert sort(queries.QUERIES[name](spark, data).toPandas()) == sort(con.execute(oracle.ORACLES[name]).df())


# mixing


def test_period_meets_deadlines_and_stays_within_a_block():
    for weights in ({"a": 1, "b": 1, "c": 1}, {"a": 7, "b": 2, "c": 1}, {"x": 0.61803, "y": 0.3, "z": 0.0001}):
        share = pfair.shares(weights, 100)
        slots = pfair.period_slots(share)
        q = sum(share.values())
        assert sorted(t for s in slots.values() for t in s) == list(range(q))
        for s, own in slots.items():
            for i, t in enumerate(own):
                assert i * q // share[s] <= t < -(-(i + 1) * q // share[s])
            for t in range(q + 1):
                assert abs(sum(x < t for x in own) - t * share[s] / q) < 1


def test_schedule_places_every_block_once():
    blocks = {"a": 37, "b": 5, "c": 1, "d": 0}
    rows = pfair.schedule(blocks, {"a": 1.0, "b": 2.0, "c": 5.0, "d": 1.0}, 16)
    used = [at + (b - first) // share * q + slots[(b - first) % share] for _, first, last, at, share, q, slots in rows for b in range(first, last)]
    assert len(used) == 43 and len(set(used)) == 43
    for s, n in blocks.items():
        assert sorted(b for r in rows if r[0] == s for b in range(r[1], r[2])) == list(range(n))


def test_positions_and_order(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", f"t{i}", i) for i in range(900)] + [(None, None, None, 1), (5, "hot", "again", 2), (7, None, "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string, block long")
    x = pfair.positions(spark, docs.drop("block"), {"hot": 2.0, "s0": 1.0}, block=4, period=50).collect()
    assert len(x) == len(rows) and len({r["position"] for r in x}) == len(rows)
    seen = {}
    for r in sorted(x, key=lambda r: r["position"]):
        assert r["release"] <= r["slot"] < r["deadline"] and r["position"] == r["slot"] * 4 + r["offset"]
        assert seen.setdefault(r["source"], 0) == r["block"] * 4 + r["offset"]
        seen[r["source"]] += 1
    m = pfair.mixed(spark, docs, block=4, period=50)
    assert m.columns == docs.columns and sorted(map(repr, m.collect())) == sorted(map(repr, docs.collect()))
    hot = [r["source"] for r in pfair.mixed(spark, docs, {"hot": 1.0, "s0": 1.0}, block=4, period=50).collect()]
    assert 0.1 < np.mean([s == "hot" for s in hot[:200]]) < 0.3  # one source of nine at equal weights, not two thirds
    assert pfair.positions(spark, docs.where("false").drop("block")).count() == 0


# quality


def test_isotonic_is_monotone_and_keeps_the_mean():
    rng = np.random.default_rng(1)
    x, w = np.sort(rng.random(50)), rng.integers(1, 9, 50).astype(float)
    y = np.clip(x + 0.3 * rng.normal(size=50), 0, 1)
    a, b = quality.isotonic(x, y, w)
    assert (np.diff(b) > 0).all() and (np.diff(a) > 0).all()
    assert quality.isotonic(np.array([]), np.array([]), np.array([]))[0].size == 0


def test_normal_equations_equal_a_direct_solution(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(spark, docs, labels, features=16)
    lab = {r["doc_id"]: r["quality"] for r in labels.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1}
    curve = {r[0] for r in labels.selectExpr(f"doc_id", f"pmod(xxhash64(doc_id), {quality.CALIBRATE}) = 0 as c").where("c").collect()}
    rows = [(quality.statistics(r["text"]), lab[r["doc_id"]]) for r in docs.collect() if r["doc_id"] in lab and r["doc_id"] not in curve]
    z, y = model.features(np.array([a for a, _ in rows])), np.array([b for _, b in rows], float)
    p = quality.RIDGE * np.eye(z.shape[1])
    p[-1, -1] = 1e-9
    assert np.allclose(np.linalg.solve(z.T @ z + p, z.T @ y), model.weights, atol=1e-6)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    x = [r for r in queries.op3_quality(spark, folder).collect()]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in x)
    held = [r["predicted"] == labels[r["doc_id"]] for r in x if r["held_out"] and r["doc_id"] in labels]
    assert np.mean(held) > 0.95


def test_quality_of_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"plain words number {i} here", "x") for i in range(30)] + [(100 + i, "bad&&& " * 9 + str(i), "y") for i in range(30)] + [(None, "null id", "z"), (7, None, "z"), (7, "", "z"), (8, "w " * 50000, "z")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 100)) for i in [*range(30), *range(100, 130)]] + [(None, 1), (3, None), (4, 1)], "doc_id long, quality int")
    model = quality.fit(spark, docs, labels)
    got = quality.scored(docs, model).collect()
    assert len(got) == 64 and all(0 <= r["score"] <= 1 for r in got)
    assert np.mean([r["predicted"] == (r["doc_id"] < 100) for r in got if r["doc_id"] is not None and r["doc_id"] not in (7, 8)]) > 0.9
    assert quality.accepted(docs, model).columns == docs.columns
    for none in (labels.where("false"), labels.where("quality = 1")):
        flat = quality.fit(spark, docs, none)
        assert {r["score"] for r in quality.scored(docs, flat).collect()} == {0.5 if none.count() == 0 else 1.0}
    assert quality.scored(docs.where("false"), model).count() == 0 and quality.scored(docs, quality.fit(spark, docs.where("false"), labels)).count() == 64


# fingerprints

MARK = 2**32 - 1


def test_fingerprints(spark):
    rnd = random.Random(9)
    vocab = [f"w{i}" for i in range(400)]
    texts = [" ".join(rnd.choices(vocab, k=rnd.randrange(5, 400))) for _ in range(120)]
    rows = [(i * 3, t) for i, t in enumerate(texts)] + [(400, None), (401, ""), (402, "same text"), (403, "same text"), (404, "é漢字 ü"), (405, "x" * 9), (-5, "negative id"), (None, "no id"), (402, "same text")]
    docs = spark.createDataFrame([(d, t, 1, "b") for d, t in rows], "doc_id long, text string, rn int, bucket string")
    got = sorted(cws.fingerprints(spark, docs).collect(), key=lambda r: (-(r["doc_id"] if r["doc_id"] is not None else -(2**63)), r["n_chars"]))
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(2**63)), r[1] or ""))
    assert len(got) == len(rows)
    errors = []
    for (d, t), (_, after), r, s in zip(order, [*order[1:], order[0]], got, [*got[1:], got[0]]):
        t, after = t or "", after or ""
        half = len(t) // 2
        edit = t[: len(t) - half] + after[:half]
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (d, len(t), hashlib.sha256(edit.encode()).hexdigest())
        for other, near in ((edit, r["near_edited"]), (after, r["near_next"])):
            a, b = ({w: x.split().count(w) for w in set(x.lower().split())} for x in (t, other))
            top = sum(max(a.get(w, 0), b.get(w, 0)) for w in {*a, *b})
            errors.append(near - (sum(min(a.get(w, 0), b.get(w, 0)) for w in {*a, *b}) / top if top else 1.0))
        part = lambda x: [x[i : i + 8] for i in range(0, len(x), 8)]
        if t.strip() and edit.strip():
            assert r["near_edited"] == pytest.approx(np.mean([x == y for x, y in zip(part(r["fingerprint"]), part(r["edited_fingerprint"]))]))
        if t.strip() and after.strip():
            assert r["near_next"] == pytest.approx(np.mean([x == y for x, y in zip(part(r["fingerprint"]), part(s["fingerprint"]))]))
    assert abs(np.mean(errors)) < 0.03 and np.std(errors) < 0.12
    assert len({r["fingerprint"] for r in got if r["doc_id"] in (402, 403)}) == 1
    assert cws.fingerprints(spark, docs.where("false")).count() == 0
    assert cws.fingerprints(spark, docs.where("doc_id = 405")).first()["near_next"] == 1.0


def test_samples_are_those_of_the_method(spark):
    """Against the formula with r, c and b: t = floor(ln w / r + b), the least c exp(-r (t - b + 1)); and a term that occurs once is drawn by one hash alone."""
    rnd = random.Random(4)
    counts = {n: (rnd.choice([0, 1, 1, 1, 2, 3, 9]), rnd.choice([0, 1, 1, 2, 2, 5, 700])) for n in range(60)}
    counts[3] = (1, 10**9)
    counted = spark.createDataFrame([(7, n, a, b) for n, (a, b) in counts.items()], "id long, n long, own long, other long").withColumn("term", F.xxhash64("n"))
    hashes = counted.crossJoin(spark.range(64).select(F.col("id").cast("int").alias("j"))).select("n", "term", "j", F.xxhash64("term", "j").alias("h"), F.xxhash64("term", -1 - F.col("j")).alias("g")).collect()
    got = cws.samples(counted, ["id"], {"a": "own", "e": "other"}).first()
    best, seen = {}, set()
    for r in hashes:
        x, y, s = -np.log1p(-((r["h"] >> 32) + 2**31 + 0.5) / 2**32), -np.log(((r["g"] & MARK) + 0.5) / 2**32), -np.log((((r["g"] >> 32) & MARK) + 0.5) / 2**32)
        step, c = s + np.log1p(y / x), x + y
        for name, w in zip("ae", counts[r["n"]]):
            if w:
                t = int(np.floor(np.log(w) / step + s / step))
                seen.add((w > 1, t > 0))
                value = np.log(c) - step * (t - s / step + 1)
                best[name, r["j"]] = min(best.get((name, r["j"]), (np.inf, 0)), (value, (r["term"] ^ (t * 0x9E3779B1)) & MARK))
    assert seen == {(False, False), (True, False), (True, True)}
    for name in "ae":
        assert [x & MARK for x in got[name]] == [best[name, j][1] for j in range(64)]
    once = cws.samples(counted.select("id", "term", F.lit(1).alias("w")), ["id"], {"a": "w"}).first()["a"]
    assert once == [min((r["h"] & ~MARK) | (r["term"] & MARK) for r in hashes if r["j"] == j) for j in range(64)]


def test_samples_agree_as_often_as_weights_are_alike(spark):
    rnd = random.Random(5)
    for high in (1, 2, 40):
        counts = [(rnd.randrange(high + 1), rnd.randrange(high + 1)) for _ in range(40)]
        counted = spark.createDataFrame([(0, n, a, b) for n, (a, b) in enumerate(counts)], "id long, n long, own long, other long").withColumn("term", F.xxhash64("n"))
        got = cws.samples(counted, ["id"], {"a": "own", "e": "other"}, 4096).first()
        assert len(got["a"]) == len(got["e"]) == 4096
        like = sum(min(c) for c in counts) / sum(max(c) for c in counts)
        assert abs(np.mean([a == e for a, e in zip(got["a"], got["e"])]) - like) < 0.03


def test_code_of_samples_is_compiled(spark):
    """The JVM leaves methods of more than 8000 bytes interpreted."""
    counted = spark.range(9).select("id", F.xxhash64("id").alias("term"), F.col("id").alias("own"), (9 - F.col("id")).alias("other"))
    df = cws.samples(counted, ["id"], {"a": "own", "e": "other"})
    df.collect()  # the last plan is known then
    made = df._jdf.queryExecution().debug().codegenToSeq()
    sizes = [made.apply(i)._3().maxMethodCodeSize() for i in range(made.size())]
    assert sizes and max(sizes) < 8000


# chat


def test_perspectives(spark):
    rows = [(1, 0, "system", "S"), (1, 1, "ann", "hi"), (1, 2, "bo", None), (1, 3, "cy", "x" * 2000), (1, 4, None, "who"), (2, 0, "system", "alone"), (None, 0, "ann", "n"), (1, 1, "ann", "hi"), (3, None, "ann", "first"), (3, 0, "bo", "second")] + [(4, t, "ab"[t % 2], f"m{t}") for t in range(700)]
    turns = spark.createDataFrame([(*r, "k") for r in rows], "conv_id long, turn long, role string, text string, key string")
    seg = chat.perspectives(turns)
    got = seg.collect()
    assert len(got) == 3 * 6 + 1 + 2 * 2 + 2 * 700
    whole = {(r["conv_id"], r["perspective"]): r for r in chat.whole(seg).collect()}
    assert set(whole) == {(1, "ann"), (1, "bo"), (1, "cy"), (None, "ann"), (3, "ann"), (3, "bo"), (4, "a"), (4, "b")}
    assert whole[3, "bo"]["rendering"] == "<|im_start|>user name=ann\nfirst<|im_end|>\n<|im_start|>assistant\nsecond<|im_end|>\n"
    text = whole[1, "ann"]["rendering"]
    assert text.startswith("<|im_start|>system\nS<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n") and "user name=unknown\nwho" in text
    assert [text[m["start"] : m["end"]] for m in whole[1, "ann"]["masks"]] == ["hi<|im_end|>"] * 2
    long = whole[4, "a"]
    assert [long["rendering"][m["start"] : m["end"]] for m in long["masks"]] == [f"m{t}<|im_end|>" for t in range(0, 700, 2)]
    for r in got:
        assert whole[r["conv_id"], r["perspective"]]["rendering"][r["start"] : r["end"]] == r["segment"]
    assert chat.perspectives(turns.where("false")).count() == 0


# pipeline


def test_pipeline_stages(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "substring_dedup", "mix", "pack"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    model = quality.fit(spark, docs, spark.read.parquet(f"{data}/labels.parquet"))
    want = {r["doc_id"] for r in quality.scored(docs, model).collect() if r["predicted"]}
    one = corpus_pipeline.quality_stage(spark, docs, data)
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == want
    two = corpus_pipeline.near_dedup_stage(spark, one, data)
    kept = {r["doc_id"] for r in dartminhash.near_duplicates(spark, one).where("kept").collect()}
    assert two.columns == columns and {r["doc_id"] for r in two.collect()} == kept
    three = corpus_pipeline.substring_dedup_stage(spark, two, data)
    rows = three.collect()
    assert three.columns == columns and {r["doc_id"] for r in rows} <= kept and all(r["n_chars"] == len(r["text"]) for r in rows)
    four = corpus_pipeline.mix_stage(spark, three, data)
    assert four.columns == columns and sorted(map(repr, four.collect())) == sorted(map(repr, rows))
    packed = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in packed.collect()} == {r["doc_id"] for r in rows} and before


def test_mix_reaches_the_sequences(spark, tmp_path, monkeypatch):
    rnd = random.Random(13)
    rows = [(i, " ".join(rnd.choices(("one", "two", "three", "four"), k=rnd.randrange(50, 400))), "hot" if i % 3 else f"s{i % 5}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    source = {d: s for d, _, s in rows}
    whole = packing.pack
    monkeypatch.setattr(packing, "pack", lambda *a, **k: whole(*a, **k, shard=200))
    hot = {}
    for name, table in (("with", corpus_pipeline.mix_stage(spark, docs, "")), ("without", docs.orderBy(F.xxhash64("doc_id")))):
        table.write.parquet(f"{tmp_path}/{name}")
        got = corpus_pipeline.pack_stage(spark, spark.read.parquet(f"{tmp_path}/{name}"), "").orderBy("sequence_id", "offset").collect()
        assert sorted(r["doc_id"] for r in got if r["piece"] == 0) == list(range(1500))
        used = {}
        for r in got:
            assert r["offset"] == used.get(r["sequence_id"], 0)
            used[r["sequence_id"]] = r["offset"] + r["length"]
        assert max(used.values()) <= 2048
        hot[name] = [np.mean([source[r["doc_id"]] == "hot" for r in part]) for part in (got[:400], got[-300:])]
    assert hot["with"][0] < 0.5 and hot["with"][1] > 0.8 and all(0.55 < x < 0.78 for x in hot["without"])
