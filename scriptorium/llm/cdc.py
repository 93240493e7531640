"""Substring deduplication by content-defined chunking with a gear hash.

A text's UTF-8 bytes run through a gear hash, h = 2 h + G[byte], of which bits that
depend on the last ``WINDOW`` bytes decide where a chunk ends: after white space for one
place in six, between wide characters (three bytes or more) for one in sixteen, elsewhere
between characters for one in 1024. Without such a place for ``MOST`` bytes a chunk ends
there. Only the bytes just before an end decide about it, so from ``WINDOW`` bytes after
its start on, a passage has the same ends in all texts.

Chunks are deduplicated by digest first: those that two documents or more hold mark where
documents may share a passage. A stretch of ``WORDS`` words, from white space to white
space, that two documents hold has the same chunks in both from the first end by the hash
on. So of all stretches only those are looked at whose chunks from there on are all held
by two documents (and the few that hold no such chunk, everywhere): no common stretch is
missed. The document of least id keeps a stretch, and later ones lose it: every
removed byte has an equal earlier one, whatever parts of a passage other documents hold.
Stretches are told apart by 96 bits of hashes. Of equal whole texts only that of least id
is cut into chunks; the others are one span from the first to the last word. Repeats
within one document stay.

Shuffles carry digests, hashes and ids, and each text once.

Defined results. A null or empty text has no chunks and no spans, as one of fewer than
``WORDS`` words. Rows whose id is null are left alone, and rows of one id do not refer to
each other. Spans are in code points. Documents whose whole text goes are dropped by
``without_repeats``. An empty table gives no rows. Extra columns are not read, and kept by
``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from scriptorium.llm.lean import lean
from scriptorium.llm.dartminhash import _BYTE, _Powers, mix
from scriptorium.plans.workspace import Workspace

WORDS = 50
#: Bytes that the hash covers, and of the smallest and largest chunk.
WINDOW, LEAST, MOST = 16, 1, 256
#: Of 1024 hash values, those that end a chunk after white space, between wide characters, between others.
AFTER_SPACE, WIDE, ELSE = 171, 64, 1
#: Texts that go to Python at a time.
TEXTS = 500

_GEAR = mix(np.arange(1000, 1256, dtype=np.uint64)).astype(np.uint32)
_OTHER = mix(np.arange(2000, 2256, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[*b" \n\t\r"]] = True


def natural_ends(b: np.ndarray) -> np.ndarray:
    """Where the hash ends chunks, before the end of the bytes."""
    h = _GEAR[b]
    step = 1
    while step < WINDOW:  # sums over the last 2, 4, 8, 16 bytes
        g = h.copy()
        g[step:] += h[:-step] << np.uint32(step)
        h, step = g, 2 * step
    # the highest bits of the window: all its bytes bear on them
    h = (h >> np.uint32(WINDOW - 10)) & np.uint32(1023)
    after = b[1:]
    least = np.where(_SPACE[b[:-1]], AFTER_SPACE, np.where(after >= 0xE0, WIDE, ELSE))
    return np.flatnonzero((h[:-1] < least) & ((after & 0xC0) != 0x80)) + 1


def _ends(b: np.ndarray, natural: np.ndarray) -> np.ndarray:
    n = len(b)
    if not n:
        return np.empty(0, np.int64)
    out = np.r_[natural, n]
    if np.diff(out, prepend=0).max() <= MOST:
        return out
    ends, last = [], 0
    for e in out.tolist():
        while e - last > MOST:
            last += MOST
            while last < n and b[last] & 0xC0 == 0x80:
                last += 1
            ends.append(last)
        if e - last >= LEAST:
            ends.append(e)
            last = e
    return np.array(ends, np.int64)


def ends(data: bytes) -> list[int]:
    """Where the chunks of ``data`` end."""
    b = np.frombuffer(data, np.uint8)
    return _ends(b, natural_ends(b)).tolist()


class _Hashes:
    """Hashes of slices of some bytes."""

    def __init__(self, b: np.ndarray, table: np.ndarray):
        up, self.down = _Powers.upto(len(b) + 1)
        self.total = np.r_[np.uint64(0), np.cumsum(table[b] * up[: len(b)], dtype=np.uint64)]

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.total[end] - self.total[start]) * self.down[start])


def chunks(data: bytes) -> Iterator[tuple[int, int, int]]:
    """(digest, start, end) of each chunk."""
    b = np.frombuffer(data, np.uint8)
    end = _ends(b, natural_ends(b))
    start = np.r_[0, end[:-1]] if len(end) else end
    yield from zip(_Hashes(b, _BYTE).of(start, end).view(np.int64).tolist(), start.tolist(), end.tolist())


def _words(b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of what stands between white space."""
    gap = np.r_[True, _SPACE[b], True]
    return np.flatnonzero(gap[:-1] & ~gap[1:]), np.flatnonzero(~gap[:-1] & gap[1:])


def _points(b: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.r_[0, np.cumsum((b & 0xC0) != 0x80)]


CHUNKS = "doc_id long, version binary, n_words long, start long, end long, digests array<long>"


def _chunker(words: int):
    """A row for each text of at least so many words: its digest, the span from the first to the last word, its distinct chunks."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, versions, counts, heads, tails, digests = [], [], [], [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = (text.as_py() or "").encode("utf-8", "replace")
                b = np.frombuffer(data, np.uint8)
                starts, stops = _words(b)
                if len(starts) < words:
                    continue
                at, end = _points(b), _ends(b, natural_ends(b))
                ids.append(doc)
                versions.append(hashlib.blake2b(data, digest_size=16).digest())
                counts.append(len(starts))
                heads.append(int(at[starts[0]]))
                tails.append(int(at[stops[-1]]))
                digests.append(np.unique(_Hashes(b, _BYTE).of(np.r_[0, end[:-1]], end).view(np.int64)))
            offsets = np.r_[0, np.cumsum([len(x) for x in digests])].astype(np.int32)
            flat = np.concatenate([*digests, np.empty(0, np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(versions, pa.binary()), *(pa.array(x, pa.int64()) for x in (counts, heads, tails)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))],
                [x.split()[0] for x in CHUNKS.split(", ")],
            )

    return cut


def stretches(data: bytes, shared: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, ...]:
    """(number of the first word, start, end, two hashes) of the stretches of so many words that other texts may hold, as ``shared`` digests tell."""
    b = np.frombuffer(data, np.uint8)
    starts, stops = _words(b)
    if len(starts) < words:
        return tuple(np.empty(0, np.int64) for _ in range(5))
    natural = natural_ends(b)
    end = _ends(b, natural)
    begin = np.r_[0, end[:-1]]
    ours = _Hashes(b, _BYTE)
    alone = np.r_[0, np.cumsum(~np.isin(ours.of(begin, end).view(np.int64), shared))]
    s, e = starts[: len(starts) - words + 1], stops[words - 1 :]
    # chunks from the first end that all holders of the stretch have, to the last before its end
    common = np.r_[natural, len(b)][np.searchsorted(natural, s + WINDOW)]
    first, past = np.searchsorted(begin, common), np.searchsorted(end, e - 1, "right")
    word = np.flatnonzero((past <= first) | (alone[np.maximum(past, first)] == alone[first]))
    s, e = s[word], e[word]
    return word, s, e, ours.of(s, e).view(np.int64), (_Hashes(b, _OTHER).of(s, e) >> np.uint64(32)).astype(np.uint32).view(np.int32)


STRETCHES = "doc_id long, version int, word int, start int, end int, one long, two int"


def _stretcher(words: int):
    """Rows (doc_id, text, digests of shared chunks): stretches in code points; version tells texts of one id apart."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in STRETCHES.split(", ")]
        for batch in batches:
            for doc, text, own in zip(*(batch.column(k) for k in range(3))):
                data = text.as_py().encode("utf-8", "replace")
                word, s, e, one, two = stretches(data, own.values.to_numpy(), words)
                if len(word):
                    at = _points(np.frombuffer(data, np.uint8))
                    version = int.from_bytes(hashlib.blake2b(data, digest_size=4).digest(), "little", signed=True)
                    small = [pa.array(x.astype(np.int32)) for x in (np.full(len(word), version), word, at[s], at[e])]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(word), doc.as_py(), np.int64)), *small, pa.array(one), pa.array(two)], names)

    return find


def repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Rows (doc_id, first_doc_id, start, end, n_words): stretches of a document that the earlier one keeps."""
    ws = Workspace(spark, "cdc")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null")
    cut = ws.save(d.mapInArrow(lean(_chunker(words)), CHUNKS), "chunks", TEXTS)
    # equal whole texts: combined before the shuffle, so copies by the thousand are one row a task
    texts = cut.groupBy("version").agg(F.min("doc_id").alias("first_doc_id"), F.count("*").alias("copies"))
    texts = ws.save(texts, "texts")
    copies = cut.drop("digests").join(texts.where("copies > 1").hint("merge"), "version").where("first_doc_id < doc_id")
    copies = ws.save(copies.select("doc_id", "first_doc_id", "start", "end", "n_words").distinct(), "copies")
    one = cut.join(texts.hint("merge"), "version").where("doc_id = first_doc_id").select("doc_id", "version", "digests")
    held = ws.save(one.groupBy("version").agg(F.first("doc_id").alias("doc_id"), F.first("digests").alias("digests")).select("doc_id", F.explode("digests").alias("digest")), "held")
    ws.drop(texts)
    ws.drop(cut)
    kept = held.groupBy("digest").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("digest")
    kept = ws.save(kept, "kept")
    # the sides grow with the documents, so they are merged at any size
    marked = held.join(kept.hint("merge"), "digest").select("doc_id", "digest").union(held.select("doc_id", F.lit(None).cast("long")).distinct())
    own = ws.save(marked.groupBy("doc_id").agg(F.collect_set("digest").alias("shared")), "shared")
    ws.drop(held)
    ws.drop(kept)
    both = d.where("text is not null").hint("merge").join(own, "doc_id").select("doc_id", "text", "shared")
    found = ws.save(both.mapInArrow(lean(_stretcher(words)), STRETCHES), "stretches", TEXTS)
    ws.drop(own)
    keeper = found.groupBy("one", "two").agg(F.min("doc_id").alias("first_doc_id"), F.max("doc_id").alias("last")).where("first_doc_id < last").drop("last")
    keeper = ws.save(keeper, "keepers")
    later = found.join(keeper.hint("merge"), ["one", "two"]).where("first_doc_id < doc_id").drop("one", "two")
    # stretches from one word to the next are one span
    text = ["doc_id", "version", "first_doc_id"]
    runs = later.withColumn("run", F.col("word") - F.dense_rank().over(Window.partitionBy(*text).orderBy("word")))
    spans = runs.groupBy(*text, "run").agg(F.min("start").cast("long").alias("start"), F.max("end").cast("long").alias("end"), (F.max("word") - F.min("word") + words).cast("long").alias("n_words"))
    spans = ws.save(spans.select("doc_id", "first_doc_id", "start", "end", "n_words").union(copies).distinct(), "spans")
    for old in (found, keeper, copies):
        ws.drop(old)
    return spans


def _cut_out(text: Column, spans: Column) -> Column:
    """``text`` without the spans, which may overlap: a fold over them in order of their starts."""
    part = lambda a, b: F.substring(text, a + F.lit(1), b - a)
    start = F.struct(F.lit(0).cast("int").alias("at"), F.lit("").alias("kept"))

    def step(acc: Column, s: Column) -> Column:
        begin = F.greatest(s["start"].cast("int"), acc["at"])
        return F.struct(F.greatest(s["end"].cast("int"), acc["at"]).alias("at"), F.concat(acc["kept"], part(acc["at"], begin)).alias("kept"))

    done = F.aggregate(F.array_sort(spans), start, step)
    return F.get(F.transform(F.array(done), lambda d: F.concat(d["kept"], part(d["at"], F.length(text)))), F.lit(0))


def without_repeats(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, chars_col: str | None = "n_chars") -> DataFrame:
    """``docs`` without the repeated stretches; documents that nothing is left of go. chars_col, where there is one, gets the new number of characters."""
    spans = repeats(spark, docs, id_col, text_col, words)
    name = "_spans"
    while name in docs.columns:
        name = f"_{name}"
    own = spans.groupBy("doc_id").agg(F.collect_set(F.struct("start", "end")).alias(name))
    own = own.select(F.col("doc_id").alias(f"{name}_id"), name)
    joined = docs.join(own, F.col(id_col).cast("long") == F.col(f"{name}_id"), "left")
    text = F.when(F.col(name).isNull(), F.col(text_col)).otherwise(_cut_out(F.col(text_col), F.col(name)))
    out = joined.withColumn(f"{name}_text", text)
    out = out.where(F.col(name).isNull() | F.col(f"{name}_text").rlike(r"\S"))
    new = {text_col: F.col(f"{name}_text")}
    if chars_col in docs.columns:
        new[chars_col] = F.when(F.col(name).isNull(), F.col(chars_col)).otherwise(F.length(f"{name}_text").cast(dict(docs.dtypes)[chars_col]))
    return out.select(*(new[c].alias(c) if c in new else F.col(c) for c in docs.columns))
