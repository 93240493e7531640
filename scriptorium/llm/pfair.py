"""Mixing sources to target weights by Pfair scheduling.

A source's documents, in an order drawn from hashes, form blocks of ``BLOCK`` documents.
Time has slots, one block each. Weights are whole shares a of q slots; block i of a
source is released at floor(i q / a) and due at ceil((i + 1) q / a), and of the released
blocks the one due earliest gets the slot. As the shares add up to q, every block meets
its deadline, so up to any slot a source has had less than one block more or fewer than
its share. The schedule repeats every q slots, so one period per phase is all that is
computed in sequence; the slot of any block follows from its number. A source without
blocks left leaves its slots empty, and a phase ends when half of its sources have none
left; the rest go on with weights in proportion. So phases together have at most twice
as many rows as there are sources. Nothing is dropped or repeated.

Scale. The driver handles a row per source and phase, and ``PERIOD`` slots in a period, or
``FINE`` for each source where that is more. Their table is broadcast up to ``SENT``
slots, and joined by source beyond. Ranks within a source come from counts of hash
buckets of about ``BUCKET`` rows and a window in each bucket, so a source with most rows
is spread over all tasks.

Defined results. A null source is a source of its own. Weights for absent sources are
ignored; a source without a given weight gets the square root of its number of
documents, in proportion to the others if all lack one, and the mean given weight else.
Ids may be null or repeat; order among equal rows has no effect on the schedule. An
empty table gives no rows. Extra columns are kept by ``mixed`` and not read otherwise.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from scriptorium.plans.workspace import Workspace

#: Documents in a block; slots in a period, and for each source at least; rows in a bucket, about; buckets that a window takes at once.
BLOCK, PERIOD, FINE, BUCKET, FAN = 16, 1000, 16, 2048, 512
#: Slots in a table that is broadcast (4 MB).
SENT = 1_000_000


def shares(weights: dict, period: int) -> dict:
    """Whole shares of ``period`` slots, at least 1 each, by largest remainder."""
    period = max(period, FINE * len(weights))
    total = sum(weights.values())
    exact = {s: w / total * (period - len(weights)) for s, w in weights.items()}
    out = {s: 1 + math.floor(x) for s, x in exact.items()}
    for s in sorted(exact, key=lambda s: (math.floor(exact[s]) - exact[s], str(s)))[: period - sum(out.values())]:
        out[s] += 1
    return out


def period_slots(share: dict) -> dict:
    """Slots of each source in one period, by earliest deadline among released blocks."""
    q = sum(share.values())
    order = sorted(share, key=lambda s: (s is None, str(s)))
    releases: list[list] = [[] for _ in range(q)]
    for n, s in enumerate(order):
        for i in range(share[s]):
            releases[i * q // share[s]].append((-(-(i + 1) * q // share[s]), n, i))
    ready: list = []
    slots: dict = {s: [] for s in share}
    for t in range(q):
        for x in releases[t]:
            heapq.heappush(ready, x)
        due, n, _ = heapq.heappop(ready)
        if due <= t:
            raise AssertionError("a block missed its deadline")
        slots[order[n]].append(t)
    return slots


def schedule(blocks: dict, weights: dict, period: int = PERIOD) -> list[tuple]:
    """Phases: rows (source, first block, end block, first slot, share, period, slots of the period).

    blocks: number of blocks by source. The slot of block b in a phase is
    first slot + (j // share) * period + slots[j % share], j = b - first block.
    """
    done = {s: 0 for s, n in blocks.items() if n > 0}
    now, rows = 0, []
    while done:
        share = shares({s: weights[s] for s in done}, period)
        slots, q = period_slots(share), sum(share.values())
        ends = {s: (j := blocks[s] - done[s] - 1) // share[s] * q + slots[s][j % share[s]] + 1 for s in done}
        length = sorted(ends.values())[(len(ends) - 1) // 2]
        for s in list(done):
            whole, rest = divmod(length, q)
            n = min(whole * share[s] + bisect_left(slots[s], rest), blocks[s] - done[s])
            if n:
                rows.append((s, done[s], done[s] + n, now, share[s], q, slots[s]))
                done[s] += n
            if done[s] == blocks[s]:
                del done[s]
        now += length
    return rows


def _target(counts: dict, weights: dict | None) -> dict:
    given = {s: float(w) for s, w in (weights or {}).items() if s in counts and w > 0}
    if not given:
        return {s: math.sqrt(n) for s, n in counts.items()}
    mean = sum(given.values()) / len(given)
    return {s: given.get(s, mean) for s in counts}


def positions(spark: SparkSession, docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """``docs`` with columns block, offset, release, deadline, slot, position.

    position orders the mix: slot * block + place in the block. release and deadline are
    slots, as the phase's weight sets them.
    """
    return _placed(spark, docs, weights, id_col, source_col, block, period, "")[0]


def _placed(spark: SparkSession, docs: DataFrame, weights: dict | None, id_col: str, source_col: str, block: int, period: int, prefix: str) -> tuple[DataFrame, int]:
    """positions() with ``prefix`` before the new columns, and the number of slots."""
    ws = Workspace(spark, "pfair")
    at = lambda x: f"{prefix}{x}"
    source = F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit(""))
    h = F.xxhash64(F.col(id_col).cast("string"), F.lit(17))
    bucket = F.pmod(h, F.lit(max(1, math.ceil(docs.count() / BUCKET))))
    s, b = at("_s"), at("_b")

    counts = docs.groupBy(source.alias(s), bucket.alias(b)).agg(F.count("*").alias("n"))
    counts = ws.save(counts.withColumn("f", F.floor(F.col(b) / FAN)), "counts")
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = counts.groupBy(s, "f").agg(F.sum("n").alias("n")).select(s, "f", F.coalesce(F.sum("n").over(before(s, "f")), F.lit(0)).alias("far"))
    near = counts.select(s, b, "f", F.coalesce(F.sum("n").over(before(s, "f", b)), F.lit(0)).alias("near"))
    starts = near.join(groups, [s, "f"]).select(s, b, (F.col("near") + F.col("far")).alias(at("_before")))

    by_source = {r[0]: r[1] for r in counts.groupBy(s).agg(F.sum("n")).collect()}
    target = _target(by_source, {f"={k}" if k is not None else "": w for k, w in (weights or {}).items()})
    plan = schedule({k: math.ceil(n / block) for k, n in by_source.items()}, target, period)
    first, last, from_, share, q, slots = (at(x) for x in ("_first", "_last", "_from", "_share", "_q", "_slots"))
    phases = spark.createDataFrame(plan, f"`{at('_p')}` string, `{first}` long, `{last}` long, `{from_}` long, `{share}` long, `{q}` long, `{slots}` array<int>")

    # the window and the join use one shuffle of the rows, by source and bucket
    dealt = docs.withColumns({s: source, b: bucket})
    dealt = dealt.withColumn(at("_r"), F.row_number().over(Window.partitionBy(s, b).orderBy(h, F.col(id_col))) - 1)
    rank = F.col(at("_before")) + F.col(at("_r"))
    ranked = dealt.join(starts, [s, b]).withColumns({at("block"): F.floor(rank / block), at("offset"): rank % block})
    n = F.col(at("block"))
    size = sum(len(r[-1]) for r in plan)
    placed = ranked.join(F.broadcast(phases) if size <= SENT else phases.hint("merge"), (F.col(s) == F.col(at("_p"))) & (n >= F.col(first)) & (n < F.col(last)))
    j = n - F.col(first)
    slot = F.col(from_) + F.floor(j / F.col(share)) * F.col(q) + F.get(F.col(slots), (j % F.col(share)).cast("int"))
    out = placed.select(
        *(F.col(c) for c in docs.columns), at("block"), at("offset"),
        (F.col(from_) + F.floor(j * F.col(q) / F.col(share))).alias(at("release")),
        (F.col(from_) + F.ceil((j + 1) * F.col(q) / F.col(share))).alias(at("deadline")),
        slot.alias(at("slot")), (slot * block + F.col(at("offset"))).alias(at("position")),
    )
    return out, max((r[3] + (j := r[2] - r[1] - 1) // r[4] * r[5] + r[6][j % r[4]] + 1 for r in plan), default=0)


def mixed(spark: SparkSession, docs: DataFrame, weights: dict | None = None, id_col: str = "doc_id", source_col: str = "source", block: int = BLOCK, period: int = PERIOD) -> DataFrame:
    """``docs``, all rows and columns, in the order of the mix: partitions are ranges of positions, sorted."""
    prefix = "_mix_"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = f"_{prefix}"
    placed, slots = _placed(spark, docs, weights, id_col, source_col, block, period, prefix)
    at = f"{prefix}position"
    # the slots are known, so ranges need no sample of the rows
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step = max(1, math.ceil(slots * block / parts))
    ranged = placed.select(*(F.col(c) for c in docs.columns), at).repartitionById(parts, F.floor(F.col(at) / step).cast("int"))
    return ranged.sortWithinPartitions(at).drop(at)
