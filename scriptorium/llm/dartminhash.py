"""Near-duplicate documents by DartMinHash over weighted word shingles.

A document is a bag of shingles of five words (lower case, letters and digits); a
shingle's weight is how often it occurs, so the likeness of two documents is their
generalised Jaccard similarity: summed minima over summed maxima of the weights.

Signatures. A shingle of weight w owns the region [0, w) of a weight axis. Darts fall
on the plane of that axis and a rank axis as a Poisson process with one dart per unit
of area; each dart has a coordinate, 0 to k-1. All of it comes from hashes of the
shingle, the unit cell of the weight axis and the dart's number, so all documents see
the same darts. A document keeps, per coordinate, the dart of least rank that hits its
region. Two documents keep the same dart with a probability equal to their similarity.
Ranks up to (k ln k + 2k) / total weight nearly always fill all coordinates, so the
work is about the number of shingles plus k ln k darts; a document with an unfilled
coordinate throws again with twice the rank.

Links. Documents that agree in all rows of some band are candidates: each bucket first
compares its members with its least member (a star), since most copies join a class
this way without any pair between them. Buckets whose members are still in different
classes are open, and open buckets that overlap form a group, in which all members of
different classes have to be compared. A group that fits into a block is compared at once.
For larger ones two steps do it without pairs as rows:

- A proof that no link is left. Only cells that some member of another class of the group
  has can be common with one. If a member of n cells has r such cells, a partner of m cells
  with a similarity of at least t needs r >= t (n + m) / (1 + t) and m >= t n; a
  member whose group has no bag of such a size has no link left and is done. A
  text with many edits of its own, so most of a large group, goes here; the work is
  proportional to the cells.
- Blocks. The members left are dealt to blocks of at most about ``BLOCK`` texts or
  ``BLOCK_BYTES`` of bags, and a task gets two blocks, whose common cells are counted by a
  matrix product. Two blocks of the group's commonest class have no pair to compare and do
  not meet.

Every link is checked against the exact similarity of the whole texts, and no candidate
pair of different classes is left out.

Defined results. A null text is an empty one. Texts with the same words are one text
(without any word: the same text), hence in one class; an empty class of words links to
nothing else. With fewer than five words, all words are the one shingle. Rows whose id is null get a null class
and are kept. A repeated row changes nothing. Extra columns are not read. An empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm.lean import lean
from scriptorium.plans.components import connected_components
from scriptorium.plans.workspace import Workspace

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 36, 7
#: Characters that a worker shingles at a time.
BATCH_CHARS = 250_000
#: Texts, or pairs of bags, that go to Python at a time.
TEXTS = 1000
#: Texts and bytes of bags in a block of a group, about; rows and columns that a matrix product takes at a time.
BLOCK, BLOCK_BYTES, STRIP, COLUMNS = 1024, 2 << 20, 256, 2048

_NOT_WORD = re.compile(r"[\W_]+")
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit integers (splitmix64)."""
    x = x + _GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def normal(text: str | None) -> str:
    """The words of a text, lower case, with one space between them."""
    return _NOT_WORD.sub(" ", (text or "").lower()).strip()


class _Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, as far as needed."""

    base = 0xD6E8FEB86659FD93
    up = down = np.ones(1, np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            with np.errstate(over="ignore"):
                cls.up = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, cls.base, np.uint64)], dtype=np.uint64)
                cls.down = np.cumprod(np.r_[np.uint64(1), np.full(n - 1, pow(cls.base, -1, 2**64), np.uint64)], dtype=np.uint64)
        return cls.up, cls.down


_BYTE = mix(np.arange(256, dtype=np.uint64))


def shingle_hashes(words: list[str], size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """words: texts as normal() gives them. (text's number, hash) of each shingle, in order, repeats included."""
    data = "\n".join(words).encode() + b"\n"
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((b == 32) | (b == 10))
    starts = np.r_[0, ends[:-1] + 1]
    last = b[ends] == 10
    doc = np.r_[0, np.cumsum(last)[:-1]]
    real = ends > starts  # a text without words has one empty word
    ends, starts, doc = ends[real], starts[real], doc[real]
    if not len(ends):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    up, down = _Powers.upto(len(b))
    total = np.r_[np.uint64(0), np.cumsum(_BYTE[b] * up[: len(b)], dtype=np.uint64)]
    count = np.bincount(doc, minlength=len(words))
    first = np.r_[0, np.cumsum(count)[:-1]]
    place = np.arange(len(doc)) - first[doc]
    span = np.minimum(count, size)[doc]
    at = np.flatnonzero(place + span <= count[doc])
    s, e = starts[at], ends[at + span[at] - 1]
    return doc[at], mix((total[e] - total[s]) * down[s])


def cells(doc: np.ndarray, shingle: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight: the n-th occurrence of a shingle in its document is the same cell in all documents. In order of (doc, shingle)."""
    order = np.lexsort((shingle, doc))
    d, h = doc[order], shingle[order]
    new = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])] if len(d) else np.empty(0, bool)
    starts = np.flatnonzero(new)
    turn = np.arange(len(d)) - np.repeat(starts, np.diff(np.r_[starts, len(d)]))
    return d, np.where(turn > 0, mix(h + turn.astype(np.uint64) * _GOLD), h)


def signatures(doc: np.ndarray, cell: np.ndarray, n: int, k: int, weight: np.ndarray | None = None) -> np.ndarray:
    """(n, k): for each of n documents the identity of the dart of least rank per coordinate; all -1 without cells.

    weight: by cell, how much of the cell's unit of the weight axis belongs to the
    document, 1 where it isn't given; darts beyond it miss.
    """
    best = np.full(n * k, np.iinfo(np.uint64).max, np.uint64)
    part = np.ones(len(cell)) if weight is None else weight
    area = np.bincount(doc, weights=part, minlength=n)
    with np.errstate(divide="ignore"):
        limit = (k * math.log(k) + 2 * k) / area
    todo = np.flatnonzero(area > 0)
    with np.errstate(over="ignore"):
        while len(todo):
            wanted = np.zeros(n, bool)
            wanted[todo] = True
            own = np.flatnonzero(wanted[doc])
            d, c, w, rank, turn = doc[own], cell[own], part[own], 0.0, 0
            while len(d):
                h = mix(c + np.uint64(turn) * np.uint64(0xA24BAED4963EE407))
                rank = rank - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                hit = rank <= limit[d]
                d, c, w, rank, h = d[hit], c[hit], w[hit], rank[hit], h[hit]
                g = mix(h)
                inside = ((g >> np.uint64(40)).astype(np.float64) + 0.5) * 2.0**-24 < w
                spot = d[inside] * k + ((g[inside] & np.uint64(0xFFFFFF)) % np.uint64(k)).astype(np.int64)
                value = (rank[inside].astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | (mix(g[inside]) & np.uint64(0xFFFFFFFF))
                np.minimum.at(best, spot, value)
                turn += 1
            unfilled = (best.reshape(n, k)[todo] == np.iinfo(np.uint64).max).any(1)
            todo = todo[unfilled]
            limit[todo] *= 2
    return np.where(area[:, None] > 0, (best & np.uint64(0xFFFFFFFF)).astype(np.int64).reshape(n, k), -1)


def band_keys(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n, bands): a hash of each band's number and rows."""
    x = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    values = sig.astype(np.uint64).reshape(len(sig), bands, rows)
    with np.errstate(over="ignore"):
        for i in range(rows):
            x = mix(x ^ (values[:, :, i] * _GOLD))
    return x.view(np.int64)


def _runs(texts: pa.Array) -> Iterator[tuple[int, list[str], list[str]]]:
    """Runs of about BATCH_CHARS characters: number of the first text, words of each, and each text that has no words."""
    start, run, bare, chars = 0, [], [], 0
    for i, text in enumerate(texts):
        raw = text.as_py() or ""
        run.append(normal(raw))
        bare.append("" if run[-1] else raw)
        chars += len(run[-1])
        if chars >= BATCH_CHARS:
            yield start, run, bare
            start, run, bare, chars = i + 1, [], [], 0
    if run:
        yield start, run, bare


def _sketcher(bands: int, rows: int, size: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, words, bare in _runs(batch.column(1)):
                once: dict[bytes, int] = {}
                digest = [hashlib.blake2b((w or "\0" + t).encode("utf-8", "surrogatepass"), digest_size=16).digest() for w, t in zip(words, bare)]
                which = np.array([once.setdefault(x, len(once)) for x in digest])
                kept = [""] * len(once)
                for i, w in zip(which, words):
                    kept[i] = w
                doc, shingle = shingle_hashes(kept, size)
                keys = band_keys(signatures(*cells(doc, shingle), len(kept), bands * rows), bands, rows)
                has = np.array([bool(w) for w in kept])
                rows_of = [keys[i] if has[i] else None for i in which]
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(words)), pa.array(digest, pa.binary()), pa.array(rows_of, pa.list_(pa.int64()))], ["doc_id", "digest", "bands"])

    return sketch


def _bagger(size: int):
    def bag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for start, words, _ in _runs(batch.column(1)):
                doc, cell = cells(*shingle_hashes(words, size))
                order = np.lexsort((cell, doc))
                bounds = np.searchsorted(doc[order], np.arange(len(words) + 1))
                data = cell[order].astype("<u8")
                yield pa.RecordBatch.from_arrays([ids.slice(start, len(words)), pa.array([data[a:b].tobytes() for a, b in zip(bounds, bounds[1:])], pa.binary())], ["id", "bag"])

    return bag


def _likeness(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (u, v, one, two): similarity of the two bags."""
    for batch in batches:
        out = np.zeros(batch.num_rows)
        one, two = batch.column(2), batch.column(3)
        for i in range(batch.num_rows):
            a, b = np.frombuffer(one[i].as_py(), "<u8"), np.frombuffer(two[i].as_py(), "<u8")
            both = len(np.intersect1d(a, b, assume_unique=True))
            out[i] = both / max(1, len(a) + len(b) - both)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["u", "v", "similarity"])


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rep, group, c, cell) from rows (rep, group, c, bag)."""
    for batch in batches:
        size = np.array([len(x.as_py()) // 8 for x in batch.column(3)], np.int64)
        cell = np.frombuffer(b"".join(x.as_py() for x in batch.column(3)), "<i8")
        own = np.repeat(np.arange(batch.num_rows), size)
        for at in range(0, len(own), 100_000):
            part = pa.array(own[at : at + 100_000])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(part) for k in range(3)), pa.array(cell[at : at + 100_000])], ["rep", "group", "c", "cell"])


def _unsettled(ws: Workspace, whole: DataFrame, similarity: float) -> DataFrame:
    """Rows (rep, group, c, bag) of ``whole`` that may still have a link to another class of their group."""
    flat = ws.save(whole.select("rep", "group", "c", "bag").mapInArrow(lean(_cells), "rep long, group long, c long, cell long"), "cells", TEXTS)
    common = flat.groupBy("group", "cell").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("group", "cell")
    common = flat.join(common.hint("merge"), ["group", "cell"]).groupBy("rep").agg(F.count("*").alias("r"))
    n = (F.length("bag") / 8).cast("long")
    # the sizes of a group's bags, each once
    sizes = whole.select("group", n.alias("n")).groupBy("group").agg(F.collect_set("n").alias("sizes"))
    x = whole.join(common, "rep").join(sizes, "group").withColumn("n", n)
    low, high = F.col("n") * similarity - 1e-6, F.col("r") * (1 + similarity) / similarity - F.col("n") + 1e-6
    left = ws.save(x.where(F.exists("sizes", lambda m: (m >= low) & (m <= high))).select("rep", "group", "c", "bag"), "unsettled")
    ws.drop(flat)
    return left


def common_counts(one: list[np.ndarray], two: list[np.ndarray]) -> np.ndarray:
    """(len(one), len(two)): how many cells two bags have in common."""
    cell = np.concatenate([*one, *two, np.empty(0, "<u8")])
    bag = np.repeat(np.arange(len(one) + len(two)), [len(x) for x in [*one, *two]])
    _, column = np.unique(cell, return_inverse=True)
    left = bag < len(one)
    width = column.max(initial=-1) + 1
    both = (np.bincount(column[left], minlength=width) > 0) & (np.bincount(column[~left], minlength=width) > 0)
    place = np.cumsum(both) - 1
    own = both[column]
    column, bag, left = place[column[own]], bag[own], left[own]
    order = np.argsort(column, kind="stable")
    column, bag, left = column[order], bag[order], left[order]
    out = np.zeros((len(one), len(two)), np.float32)  # whole numbers, exact below 2**24
    for at in range(0, int(both.sum()), COLUMNS):
        part = slice(*np.searchsorted(column, (at, at + COLUMNS)))
        c, b, l = column[part] - at, bag[part], left[part]
        x, y = np.zeros((len(one), c.max() + 1), np.float32), np.zeros((len(two), c.max() + 1), np.float32)
        x[b[l], c[l]] = 1
        y[b[~l] - len(one), c[~l]] = 1
        for row in range(0, len(one), STRIP):
            out[row : row + STRIP] += x[row : row + STRIP] @ y.T
    return out


def _crossed(similarity: float):
    """For two blocks of a group, or one with itself: links that join all classes with a link between them."""

    def links(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block, rep = table["block"].to_numpy(), table["rep"].to_numpy()
        bags = [np.frombuffer(x.as_py(), "<u8") for x in table["bag"]]
        size = np.array([len(x) for x in bags])
        _, label = np.unique(table["c"].to_numpy(), return_inverse=True)
        a, b = np.flatnonzero(block == i), np.flatnonzero(block == j)
        u, v = [], []
        if len(a) and len(b):
            both = common_counts([bags[k] for k in a], [bags[k] for k in b])
            for k, row in zip(a, both):
                row = row.astype(np.float64)
                near = b[row / np.maximum(1, size[k] + size[b] - row) >= similarity]
                others, first = np.unique(label[near], return_index=True)
                for other, at in zip(others, first):
                    if other != label[k]:
                        u.append(rep[k])
                        v.append(rep[near[at]])
                        label[label == other] = label[k]
        return pa.table({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    return links


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, digest of the words, band keys; null without words) of every whole text."""
    ids = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(lean(_sketcher(bands, rows, size)), "doc_id long, digest binary, bands array<long>")


def near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, size: int = SHINGLE_WORDS, block: int = BLOCK, ws: Workspace | None = None) -> DataFrame:
    """One row per document: doc_id, class_id (least id of its class), kept (doc_id = class_id)."""
    ws = ws or Workspace(spark, "dartminhash")
    sketch = ws.save(sketches(docs, id_col, text_col, bands, rows, size), "sketch", TEXTS)
    own = sketch.where("doc_id is not null")
    texts = ws.save(own.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")), "texts")

    # the members of buckets that hold two texts or more
    banded = texts.where("bands is not null").select("rep", F.explode("bands").alias("key"))
    bucket = banded.groupBy("key").agg(F.min("rep").alias("center"), F.count("*").alias("n")).where("n > 1").drop("n")
    members = ws.save(banded.join(bucket, "key"), "members")

    needed = ws.save(members.select(F.col("rep").alias("id")).distinct(), "needed")
    found = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(needed, "id", "left_semi")
    bags = ws.save(found.mapInArrow(lean(_bagger(size)), "id long, bag binary").groupBy("id").agg(F.min("bag").alias("bag")), "bags", TEXTS)

    stars = members.where("rep <> center").select(F.col("center").alias("u"), F.col("rep").alias("v")).distinct()
    one, two = (bags.select(F.col("id").alias(x), F.col("bag").alias(y)) for x, y in (("u", "one"), ("v", "two")))
    tried = stars.join(two, "v").join(one, "u").select("u", "v", "one", "two").mapInArrow(lean(_likeness), "u long, v long, similarity double")
    links = ws.save(tried.where(F.col("similarity") >= similarity).select("u", "v"), "stars", TEXTS)
    classes = ws.save(connected_components(links, ws), "classes")

    named = members.join(classes.withColumnsRenamed({"node": "rep"}), "rep", "left").select("key", "center", "rep", F.coalesce("component", "rep").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high")
    open_ = ws.save(named.join(mixed.select("key"), "key"), "open")
    ws.drop(members)
    if not open_.isEmpty():
        groups = connected_components(open_.select(F.col("center").alias("u"), F.col("rep").alias("v")), ws)
        whole = open_.select("rep", "c").distinct().join(groups.withColumnsRenamed({"node": "rep", "component": "group"}), "rep")
        whole = ws.save(whole.join(bags.withColumnsRenamed({"id": "rep"}), "rep").select("rep", "group", "c", "bag"), "groups")
        # a group that fits into a block is compared at once; the proof makes larger ones smaller
        by_group = whole.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.length("bag")).alias("bytes"))
        large = ws.save(by_group.where((F.col("n") > block) | (F.col("bytes") > BLOCK_BYTES)).select("group"), "large")
        if not large.isEmpty():
            left = _unsettled(ws, whole.join(large, "group", "left_semi"), similarity)
            whole = whole.join(large, "group", "left_anti").select(left.columns).union(left)
        by_class = whole.groupBy("group", "c").agg(F.count("*").alias("n"), F.sum(F.length("bag")).alias("bytes"))
        total = by_class.groupBy("group").agg(F.count("*").alias("classes"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"), F.max(F.struct("n", "c", "bytes")).alias("top")).where("classes > 1")
        blocks = lambda n, size: F.greatest(F.ceil(n / block), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("long")
        one_block = (F.col("n") <= block) & (F.col("bytes") <= BLOCK_BYTES)
        others = F.when(one_block, 1).otherwise(blocks(F.col("n") - F.col("top.n"), F.col("bytes") - F.col("top.bytes")))
        plan = total.select("group", F.col("top.c").alias("main"), others.alias("others"), F.when(one_block, 0).otherwise(blocks(F.col("top.n"), F.col("top.bytes"))).alias("mains"))
        # blocks of other classes come first and meet all blocks; those of the commonest class meet these only
        h, is_main = F.xxhash64("rep"), (F.col("c") == F.col("main")) & (F.col("mains") > 0)
        dealt = whole.join(plan, "group").withColumn("block", F.when(is_main, F.col("others") + F.pmod(h, F.greatest("mains", F.lit(1)))).otherwise(F.pmod(h, F.col("others"))))
        met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("others") + F.when(is_main, 0).otherwise(F.col("mains")) - 1)))
        met = met.select("group", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "rep", "c", "bag")
        more = ws.save(met.groupBy("group", "i", "j").applyInArrow(_crossed(similarity), "u long, v long"), "crossed")
        classes = ws.save(connected_components(links.union(more), ws), "classes")

    by_digest = texts.select("digest", "rep").join(classes.withColumnsRenamed({"node": "rep"}), "rep", "left").select("digest", F.coalesce("component", "rep").alias("class_id"))
    return own.select("doc_id", "digest").join(by_digest, "digest").select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept")).union(sketch.where("doc_id is null").select("doc_id", F.lit(None).cast("long"), F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The documents without those that a class of near-duplicates has beside its first.

    All columns stay. Of rows that repeat an id, the first by text (null first), then by all columns, stays.
    """
    steps = Workspace(spark, "dartminhash")
    classes = Workspace(spark, "dedup").save(near_duplicates(spark, docs, id_col, text_col, ws=steps, **how), "classes")
    steps.clear()
    gone = classes.where("not kept").select(F.col("doc_id").alias(id_col)).distinct()
    out = docs.join(gone, id_col, "left_anti").select(docs.columns)
    twice = classes.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(id_col))
    if twice.isEmpty():
        return out
    whole = F.struct(*(F.col(c) for c in docs.columns))
    again = out.join(twice, id_col, "left_semi").groupBy(F.col(id_col).alias("_id")).agg(F.min_by(whole, F.struct(F.col(text_col), F.to_json(whole))).alias("_row"))
    return out.join(twice, id_col, "left_anti").select(docs.columns).unionByName(again.select("_row.*"))
