"""Packing documents into sequences of a fixed length by best-two-fit.

A document's ids with an end id are one piece; only a longer one is cut into whole
sequences and a rest. Pieces are dealt by a hash to shards of about ``SHARD`` pieces and
packed there: a bin takes the longest piece left, then again and again the longest that
fits (greedy fill). Then the bin's smallest piece is put back if two other pieces fit the
gap that it leaves more tightly: the pair with the largest sum that fits, if that is more
than the piece. Pieces of equal length are interchangeable, so a shard works on counts
by length, kept as bits of an integer; a search is a few shifts, whatever the number of
pieces. Bins of a shard that end less full than ``TIGHT`` are taken apart again, and
their pieces are packed once more in shards of their own, a few thousand to one, so that shards cost few bins.

With an order of the documents (``order``), shards are ranges of it instead: sequence
ids rise from range to range, and loose bins are packed anew among neighbouring ranges
and follow them, so any stretch of sequence ids holds documents of a stretch of the order.

Defined results. A null or empty text is the end id alone. Rows that repeat an id are
packed each for itself; where their texts differ, pieces of one doc_id and number occur
more than once. A null id is kept. Other columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm.lean import lean
from scriptorium.llm.tokens import encoder
from scriptorium.plans.workspace import Workspace

LENGTH = 2048
END_ID = 0
#: Pieces in a shard, about.
SHARD = 2048
#: Bins less full than this are packed anew in the second round.
TIGHT = 0.98

PIECES = "doc_id long, copy long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, extra: str | None = None) -> DataFrame:
    """Each document's pieces; copy tells rows that repeat an id apart within a batch. extra: a long column that comes along."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each, end, step = encoder(vocabulary).each, end_id.to_bytes(4, "little"), 4 * length
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for i, (doc, ids) in enumerate(zip(batch.column(0).to_pylist(), each(t.as_py() for t in batch.column(1)))):
                data = ids + end
                for n, at in enumerate(range(0, len(data), step)):
                    part = data[at : at + step]
                    for column, x in zip(rows, (doc, i, n, at // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            out, names = [pa.array(x, k) for x, k in zip(rows, kinds)], ["doc_id", "copy", "piece", "start", "length", "ids_crc32"]
            if extra:
                out, names = [*out, batch.column(2).take(out[1])], [*names, extra]
            yield pa.RecordBatch.from_arrays(out, names)

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *([F.col(extra).cast("long").alias(extra)] if extra else [])]
    return docs.select(*columns).mapInArrow(lean(cut), PIECES + (f", {extra} long" if extra else ""))


def best_two_fit(lengths: list[int], size: int) -> list[list[int]]:
    """Bins of indexes into ``lengths``, each at most ``size`` in sum; every length is 1 to ``size``."""
    left: dict[int, list[int]] = {}
    for i, x in enumerate(lengths):
        if not 0 < x <= size:
            raise ValueError(f"a length of {x} does not fit bins of {size}")
        left.setdefault(x, []).append(i)
    have = sum(1 << x for x in left)  # bit x: a piece of length x is left
    back = sum(1 << (size - x) for x in left)  # the same, mirrored, for sums

    def take(x: int) -> int:
        nonlocal have, back
        i = left[x].pop()
        if not left[x]:
            del left[x]
            have ^= 1 << x
            back ^= 1 << (size - x)
        return i

    def put(x: int, i: int) -> None:
        nonlocal have, back
        if x not in left:
            left[x] = []
            have |= 1 << x
            back |= 1 << (size - x)
        left[x].append(i)

    def longest(most: int) -> int:
        return (have & ((1 << (most + 1)) - 1)).bit_length() - 1 if most > 0 else 0

    def pair(total: int) -> tuple[int, int] | None:
        """Two pieces left with that sum."""
        both = have & (back >> (size - total))
        while both:
            x = both.bit_length() - 1
            if 2 * x != total or len(left[x]) > 1:
                return x, total - x
            both ^= 1 << x
        return None

    bins = []
    while left:
        own: list[tuple[int, int]] = []
        gap = size
        while gap > 0 and (x := longest(gap)) > 0:
            own.append((x, take(x)))
            gap -= x
        if gap and len(own) > 1:
            x, i = own[-1]  # the smallest: each was the longest that fitted
            for total in range(gap + x, x, -1):
                if two := pair(total):
                    own.pop()
                    own += [(y, take(y)) for y in two]
                    put(x, i)
                    break
        bins.append([i for _, i in own])
    return bins


def _packer(size: int, tight: float, shift: int):
    """For the pieces of a shard: their places, or no sequence (null) where the bin is to be packed anew."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("length", "doc_id", "piece", "copy")])
        lengths = table["length"].to_pylist()
        shard = table["shard"][0].as_py()
        sequence, offset = [None] * len(lengths), [None] * len(lengths)
        for n, own in enumerate(best_two_fit(lengths, size)):
            if sum(lengths[i] for i in own) < tight * size:
                continue
            at = 0
            for i in own:
                sequence[i], offset[i] = (shard << shift) + n, at
                at += lengths[i]
        return table.append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))

    return pack


PACKED = PIECES + ", shard long, sequence_id long, offset long"


def pack(spark: SparkSession, docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end_id: int = END_ID, shard: int = SHARD, tight: float = TIGHT, order: str | None = None) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    order: a column with the number of each document in an order, from 0 without large gaps.
    """
    ws = Workspace(spark, "packing")
    if order:
        cut = ws.save(pieces(docs, vocabulary, id_col, text_col, length, end_id, order), "pieces", 1000)
        return _in_order(ws, cut, order, length, shard, tight)
    cut = ws.save(pieces(docs, vocabulary, id_col, text_col, length, end_id), "pieces", 1000)

    def dealt(df: DataFrame, first: int) -> tuple[DataFrame, int]:
        n = max(1, math.ceil(df.count() / shard))
        return df.withColumn("shard", F.pmod(F.xxhash64("doc_id", "piece", "copy"), F.lit(n)) + first), first + n

    whole, n = dealt(cut, 0)
    once = ws.save(whole.groupBy("shard").applyInArrow(_packer(length, tight, 24), PACKED), "first")
    loose, _ = dealt(once.where("sequence_id is null").drop("shard", "sequence_id", "offset"), n)
    again = loose.groupBy("shard").applyInArrow(_packer(length, 0.0, 24), PACKED)
    out = once.where("sequence_id is not null").union(again)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def _in_order(ws: Workspace, cut: DataFrame, order: str, length: int, shard: int, tight: float) -> DataFrame:
    """Shards are ranges of the order. A second round takes so many ranges together that their loose pieces make up a shard about."""
    size = cut.agg(F.count("*").alias("n"), F.max(order).alias("last")).first()
    step = max(1, math.ceil(((size["last"] or 0) + 1) * shard / max(1, size["n"])))
    whole = cut.withColumn("shard", F.floor(F.col(order) / step)).drop(order)
    once = ws.save(whole.groupBy("shard").applyInArrow(_packer(length, tight, 24), PACKED), "first")
    loose = once.where("sequence_id is null").drop("sequence_id", "offset")
    ranges = math.ceil(((size["last"] or 0) + 1) / step)
    fan = max(1, ranges // max(1, math.ceil(loose.count() / shard)))
    # numbers of the second round follow those of the last range that it takes
    again = loose.withColumn("shard", F.floor(F.col("shard") / fan) * fan + (fan - 1)).groupBy("shard").applyInArrow(_packer(length, 0.0, 24), PACKED)
    again = again.withColumn("sequence_id", F.col("sequence_id") + F.lit(1 << 23))
    out = once.where("sequence_id is not null").union(again)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
