"""Near-duplicate embeddings by hierarchical navigable small-world graphs, one per shard.

Equal vectors are collapsed first. The distinct ones are dealt by a hash to shards of
about ``SHARD_ROWS``; each shard gets its graph, built once and written. Then each
shard's vectors are queries against its own graph and those of the shards after it, so
each pair of vectors meets once. A search holds a beam of candidates; while every member
of a query's beam is a hit, the beam doubles, and beyond ``WIDEST`` the query scans the
shard exactly. For each slice of queries and shard an audit scans the shard for ``AUDIT``
of the queries and for ``PROBES`` made up ones, stored vectors turned by nearly the
largest angle that is still a hit, so that there are hits to miss even where the queries
have none; a vector's hit on itself does not count. While the beam search finds less
than ``RECALL`` of the hits of either kind, the beam of all queries doubles, at last to
an exact scan. Hits are verified by cosine in double precision. Links are counted where
they are found, a few queries at a time; of the pairs only a spanning forest per slice and
shard leaves a task, and connected components unite the forests.

The work grows with the number of shards times the number of vectors, as every shard is
asked; a larger shard costs memory (about 1 kB a vector) and saves work.

Defined results. Vectors that are null, zero, or hold null or non-finite components link
with nothing, and so do vectors of different lengths with each other. A repeated vec_id
is one vector for each distinct content; null ids are left out of links and have a null
component. Extra columns are not read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from scriptorium.llm.lean import lean
from scriptorium.plans.components import connected_components
from scriptorium.plans.workspace import Workspace

COSINE = 0.9
SHARD_ROWS = 32768
#: Vectors that one task searches for in one shard.
SLICE = 8192
#: Links of a node above the lowest level (twice as many there), beam while building, first beam and widest beam of searches.
LINKS, BUILD_BEAM, BEAM, WIDEST = 16, 48, 24, 768
AUDIT, PROBES, RECALL = 64, 128, 0.995
#: Nodes expanded at a time, queries searched at a time, queries whose hits are held at a time.
EXPAND, QUERIES, PART = 4, 256, 1024


def _diverse(sims: np.ndarray, ids: np.ndarray, x: np.ndarray, keep: int) -> np.ndarray:
    """(q, keep) of the candidates (q, c), -1 where none: those nearer to the query than to any chosen before, then the nearest others."""
    order = np.argsort(-sims, axis=1, kind="stable")
    sims, ids = np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)
    valid = ids >= 0
    v = x[np.maximum(ids, 0)]
    among = np.matmul(v, v.transpose(0, 2, 1))
    chosen = np.zeros_like(valid)
    nearest = np.full(sims.shape, -2.0, np.float32)
    for c in range(ids.shape[1]):
        take = valid[:, c] & (nearest[:, c] < sims[:, c]) & (chosen.sum(1) < keep)
        chosen[:, c] = take
        nearest = np.where(take[:, None], np.maximum(nearest, among[:, c]), nearest)
    rank = np.argsort(np.where(chosen, 0, np.where(valid, 1, 2)), axis=1, kind="stable")[:, :keep]
    return np.where(np.take_along_axis(valid, rank, 1), np.take_along_axis(ids, rank, 1), -1)


def search(x: np.ndarray, table: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beam search of all queries in step: (similarities, nodes), each (q, beam), best first, -1 where none."""
    q, n = len(queries), len(x)
    rows = np.arange(q)[:, None]
    seen = np.zeros((q, n + 1), bool)  # the last column stands for "none"
    ids = np.full((q, beam), -1)
    width = min(beam, entries.shape[1])
    ids[:, :width] = entries[:, :width]
    seen[rows, ids] = True
    sims = np.where(ids >= 0, np.einsum("qed,qd->qe", x[np.maximum(ids, 0)], queries), -2.0).astype(np.float32)
    done = ids < 0
    active = np.arange(q)
    while len(active):
        score = np.where(done[active], -3.0, sims[active])
        step = min(EXPAND, beam)
        best = np.argpartition(-score, step - 1, axis=1)[:, :step] if step < beam else np.broadcast_to(np.arange(beam), (len(active), beam))
        fresh = np.take_along_axis(score, best, 1) > -3.0
        has = fresh.any(1)
        active, best, fresh = active[has], best[has], fresh[has]
        if not len(active):
            break
        at = active[:, None]
        nodes = np.where(fresh, ids[at, best], -1)
        done[at, best] = True
        near = np.where((nodes >= 0)[:, :, None], table[np.maximum(nodes, 0)], -1).reshape(len(active), -1)
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[seen[at, near]] = -1
        seen[at, near] = True
        s = np.where(near >= 0, np.einsum("qed,qd->qe", x[np.maximum(near, 0)], queries[active]), -2.0).astype(np.float32)
        all_s, all_i = np.concatenate([sims[active], s], 1), np.concatenate([ids[active], near], 1)
        all_d = np.concatenate([done[active], near < 0], 1)
        top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
        sims[active], ids[active], done[active] = (np.take_along_axis(y, top, 1) for y in (all_s, all_i, all_d))
    order = np.argsort(-sims, axis=1, kind="stable")
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


class Graph:
    """A hierarchy of link tables over unit vectors x (n, d); tables[l] is (n, links), -1 where none, tables[0] the lowest level."""

    def __init__(self, x: np.ndarray, tables: list[np.ndarray]):
        self.x, self.tables = x, tables

    @classmethod
    def build(cls, x: np.ndarray, draw: np.ndarray, links: int = LINKS, beam: int = BUILD_BEAM) -> "Graph":
        """draw: a uniform number per vector that sets its highest level."""
        level = np.minimum((-np.log(draw) / math.log(links)).astype(int), 8)
        graph = cls(x, [])
        for height in range(int(level.max()), -1, -1):
            members = np.flatnonzero(level >= height)
            members = members[np.argsort(-level[members], kind="stable")]  # those of the level above come first
            graph._add_level(members, 2 * links if height == 0 else links, links, beam)
        return graph

    def entries(self, queries: np.ndarray, tables: list[np.ndarray]) -> np.ndarray | None:
        """Nearest nodes of the lowest of the given levels, by descent from the top."""
        found = None
        for table in reversed(tables):
            if found is None:
                found = np.broadcast_to(np.flatnonzero(table[:, 0] > -2)[:4], (len(queries), min(4, int((table[:, 0] > -2).sum()))))
            found = search(self.x, table, queries, found, 4)[1]
        return found

    def _add_level(self, members: np.ndarray, width: int, links: int, beam: int) -> None:
        x, table = self.x, np.full((len(self.x), width), -2)  # -2: no node of this level
        above = list(self.tables)
        size = 0
        while size < len(members):
            batch = members[size : size + max(32, min(QUERIES, size))]
            table[batch] = -1
            vectors = x[batch]
            inner = vectors @ vectors.T
            np.fill_diagonal(inner, -2.0)
            mates = np.argpartition(-inner, min(links, len(batch) - 1), axis=1)[:, : links + 1] if len(batch) > 1 else np.zeros((1, 1), int)
            sims, ids = np.take_along_axis(inner, mates, 1), batch[mates]
            ids = np.where(sims > -2, ids, -1)
            if size:
                start = self.entries(vectors, above) if above else None
                if start is None:
                    start = np.broadcast_to(members[: min(4, size)], (len(batch), min(4, size)))
                s, i = search(x, table, vectors, start, beam)
                i = np.where(i == batch[:, None], -1, i)
                sims, ids = np.concatenate([sims, s], 1), np.concatenate([ids, i], 1)
                sims, ids = _unique(sims, ids)
            chosen = _diverse(sims, ids, x, links)
            table[batch[:, None], np.arange(chosen.shape[1])] = chosen
            self._link_back(table, batch, chosen)
            size += len(batch)
        self.tables.insert(0, table)

    def _link_back(self, table: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        x, width = self.x, table.shape[1]
        source, target = np.repeat(batch, chosen.shape[1]), chosen.ravel()
        real = target >= 0
        source, target = source[real], target[real]
        strength = np.einsum("nd,nd->n", x[source], x[target])
        order = np.lexsort((-strength, target))
        source, target = source[order], target[order]
        nodes, first = np.unique(target, return_index=True)
        turn = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
        most = turn < width
        added = np.full((len(nodes), width), -1)
        added[np.searchsorted(nodes, target[most]), turn[most]] = source[most]
        ids = np.concatenate([table[nodes], added], 1)
        ids = ids[:, (ids >= 0).any(0)]
        sims = np.where(ids >= 0, np.einsum("nkd,nd->nk", x[np.maximum(ids, 0)], x[nodes]), -2.0).astype(np.float32)
        sims, ids = _unique(sims, ids)
        few = (ids >= 0).sum(1) <= width
        if few.any():
            rank = np.argsort(ids[few] < 0, axis=1, kind="stable")[:, :width]
            kept = np.take_along_axis(ids[few], rank, 1)
            table[nodes[few][:, None], np.arange(kept.shape[1])] = kept
            table[nodes[few][:, None], np.arange(kept.shape[1], width)] = -1
        if (~few).any():
            table[nodes[~few]] = _diverse(sims[~few], ids[~few], x, width)

    def hits(self, queries: np.ndarray, cosine: float, beam: int, widest: int = WIDEST) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) pairs of similarity at least ``cosine``; a query whose beam is all hits searches a wider one."""
        out, todo = [], np.arange(len(queries))
        while len(todo):
            exact = beam > widest or beam >= len(self.x)
            wider = []
            for a in range(0, len(todo), QUERIES):
                part = todo[a : a + QUERIES]
                if exact:
                    out.append(scan(self.x, queries[part], cosine, part))
                    continue
                start = self.entries(queries[part], self.tables[1:])
                if start is None:
                    start = np.broadcast_to(np.arange(min(4, len(self.x))), (len(part), min(4, len(self.x))))
                sims, ids = search(self.x, self.tables[0], queries[part], start, beam)
                full = (sims[:, -1] >= cosine) & (ids[:, -1] >= 0)
                wider.append(part[full])
                r, c = np.nonzero((sims >= cosine) & (ids >= 0) & ~full[:, None])
                out.append((part[r], ids[r, c]))
            todo, beam = np.concatenate(wider) if wider else todo[:0], beam * 2
        return np.concatenate([o[0] for o in out]), np.concatenate([o[1] for o in out])


def _unique(sims: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Repeats of an id in a row become -1."""
    order = np.argsort(ids, axis=1, kind="stable")
    i, s = np.take_along_axis(ids, order, 1).copy(), np.take_along_axis(sims, order, 1).copy()
    again = np.zeros(i.shape, bool)
    again[:, 1:] = i[:, 1:] == i[:, :-1]
    s[again | (i < 0)] = -2.0
    i[again] = -1
    return s, i


def scan(x: np.ndarray, queries: np.ndarray, cosine: float, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (name, node) pairs of similarity at least ``cosine``."""
    r, c = np.nonzero(queries @ x.T >= cosine)
    return names[r], c


def probes(x: np.ndarray, cosine: float, n: int) -> np.ndarray:
    """Unit vectors, each nearly as far from a stored one as a hit can be: a third of the way from the threshold to 1."""
    at = np.unique(np.linspace(0, len(x) - 1, min(n, len(x))).astype(int))
    away = np.random.default_rng(len(x)).normal(size=(len(at), x.shape[1]))
    away -= np.einsum("nd,nd->n", away, x[at])[:, None] * x[at]
    norm = np.sqrt(np.einsum("nd,nd->n", away, away))[:, None]
    near = min(1.0, cosine + (1 - cosine) / 3)
    out = near * x[at] + math.sqrt(1 - near * near) * away / np.maximum(norm, 1e-12)
    return (out / np.sqrt(np.einsum("nd,nd->n", out, out))[:, None]).astype(np.float32)


def _recall(graph: Graph, queries: np.ndarray, cosine: float, found: tuple[np.ndarray, np.ndarray], sample: np.ndarray) -> float:
    """Share of the hits of the sampled queries that were found, without those of a vector on itself; 1 if there are none."""
    r, c = scan(graph.x, queries[sample], cosine, sample)
    other = np.einsum("nd,nd->n", queries[r], graph.x[c]) < 1 - 1e-6
    truth = r[other] * len(graph.x) + c[other]
    return np.isin(truth, found[0] * len(graph.x) + found[1]).mean() if len(truth) else 1.0


def audited(graph: Graph, queries: np.ndarray, cosine: float, beam: int = BEAM, audit: int = AUDIT, recall: float = RECALL, planted: int = PROBES) -> int:
    """The beam with which searches pass the audit, beyond ``WIDEST`` for an exact scan. Evenly spaced queries and probes are audited."""
    both = [queries[np.unique(np.linspace(0, len(queries) - 1, min(audit, len(queries))).astype(int))], probes(graph.x, cosine, planted)]
    while beam <= WIDEST and any(_recall(graph, q, cosine, graph.hits(q, cosine, beam), np.arange(len(q))) < recall for q in both if len(q)):
        beam *= 2
    return beam


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(vec_id, embedding) with the digest of a vector that can link, else null."""
    for batch in batches:
        keys = []
        for v in batch.column(1):
            try:
                a = np.asarray(v.as_py(), np.float64) if v.is_valid else np.zeros(0)
            except TypeError:
                a = np.zeros(0)
            a = a + 0.0  # no negative zeros
            usable = a.ndim == 1 and len(a) and np.isfinite(a).all() and a.any()
            keys.append(hashlib.blake2b(a.tobytes(), digest_size=16).digest() if usable else None)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), batch.column(1)], ["vec_id", "key", "embedding"])


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]


def _builder(table: pa.Table) -> pa.Table:
    table = table.sort_by("rep")
    ids, mult = table["rep"].to_numpy(), table["mult"].to_numpy()
    x = np.array(table["embedding"].to_pylist(), np.float64)
    draw = np.array([(int.from_bytes(hashlib.blake2b(int(i).to_bytes(8, "little", signed=True), digest_size=8).digest(), "little") + 1) / 2**64 for i in ids])
    graph = Graph.build(_unit(x).astype(np.float32), draw)
    # links of upper levels as (node, links...) rows
    packed = [graph.tables[0].astype("<i4")] + [np.c_[(m := np.flatnonzero(t[:, 0] > -2)), t[m]].astype("<i4") for t in graph.tables[1:]]
    blob = lambda a: pa.array([a.tobytes()], pa.binary())
    return pa.table({
        "shard": table["shard"][:1].cast(pa.int64()), "d": pa.array([x.shape[1]], pa.int32()), "ids": blob(ids.astype("<i8")), "mult": blob(mult.astype("<i8")),
        "x": pa.array([_packed(x)], pa.binary()), "links": pa.array([[t.tobytes() for t in packed]], pa.list_(pa.binary())), "widths": pa.array([[t.shape[1] for t in packed]], pa.list_(pa.int32())),
    })


GRAPHS = "shard long, d int, ids binary, mult binary, x binary, links array<binary>, widths array<int>"


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors of a shard in parts of SLICE, as queries."""
    for batch in batches:
        for n in range(batch.num_rows):
            shard, d, ids, mult, x = (batch.column(k)[n].as_py() for k in range(5))
            width = d * int(x[:1])  # the first byte says how wide a component is
            for at in range(0, len(ids) // 8, SLICE):
                own = slice(8 * at, 8 * (at + SLICE))
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([ids[own]], pa.binary()), pa.array([mult[own]], pa.binary()), pa.array([x[:1] + x[1 + width * at : 1 + width * (at + SLICE)]], pa.binary())], ["q_shard", "q_ids", "q_mult", "q_x"])


def _graph(x: np.ndarray, links: list[bytes], widths: list[int]) -> Graph:
    tables = [np.frombuffer(links[0], "<i4").reshape(-1, widths[0]).astype(np.int64)]
    for blob, width in zip(links[1:], widths[1:]):
        rows = np.frombuffer(blob, "<i4").reshape(-1, width)
        table = np.full((len(x), width - 1), -2, np.int64)
        table[rows[:, 0]] = rows[:, 1:]
        tables.append(table)
    return Graph(x, tables)


class _Forest:
    """Edges that join what no edge before has joined."""

    def __init__(self):
        self.root: dict[int, int] = {}
        self.edges: list[tuple[int, int]] = []

    def find(self, a: int) -> int:
        root = self.root
        while root.setdefault(a, a) != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    def add(self, u: np.ndarray, v: np.ndarray) -> None:
        for a, b in zip(u.tolist(), v.tolist()):
            x, y = self.find(a), self.find(b)
            if x != y:
                self.root[max(x, y)] = min(x, y)
                self.edges.append((a, b))


def _floats(blob: bytes, d: int) -> np.ndarray:
    """Vectors from their bytes: in single precision where that loses nothing, as the first byte says."""
    return np.frombuffer(blob, "<f4" if blob[:1] == b"4" else "<f8", offset=1).reshape(-1, d).astype(np.float64)


def _packed(x: np.ndarray) -> bytes:
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    return b"4" + small.tobytes() if np.array_equal(small.astype(np.float64), x) else b"8" + x.astype("<f8").tobytes()


def _linker(cosine: float):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                row = {name: batch.column(k)[n].as_py() for k, name in enumerate(batch.schema.names)}
                ids_q, ids_x = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                mult_q, mult_x = np.frombuffer(row["q_mult"], "<i8"), np.frombuffer(row["mult"], "<i8")
                q, x = (_unit(_floats(row[k], row["d"])) for k in ("q_x", "x"))
                graph = _graph(x.astype(np.float32), row["links"], row["widths"])
                least, own = cosine - 1e-5, row["shard"] == row["q_shard"]
                single = q.astype(np.float32)
                beam = audited(graph, single, least)
                of_q, of_x, forest = np.zeros(len(q), np.int64), np.zeros(len(x), np.int64), _Forest()
                for at in range(0, len(q), PART):
                    a, b = graph.hits(single[at : at + PART], least, beam)
                    a = a + at
                    if own:  # the other direction is found by the other vector's search
                        apart = ids_q[a] != ids_x[b]
                        a, b = a[apart], b[apart]
                    exact = np.zeros(len(a))
                    for k in range(0, len(a), 65536):
                        exact[k : k + 65536] = np.einsum("nd,nd->n", q[a[k : k + 65536]], x[b[k : k + 65536]])
                    a, b = a[exact >= cosine], b[exact >= cosine]
                    np.add.at(of_q, a, mult_x[b])
                    if not own:
                        np.add.at(of_x, b, mult_q[a])
                    forest.add(ids_q[a], ids_x[b])
                u = np.concatenate([ids_q[of_q > 0], ids_x[of_x > 0], np.array([f[0] for f in forest.edges], np.int64)])
                v = [None] * (len(u) - len(forest.edges)) + [f[1] for f in forest.edges]
                count = np.concatenate([of_q[of_q > 0], of_x[of_x > 0], np.zeros(len(forest.edges), np.int64)])
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v, pa.int64()), pa.array(count)], ["u", "v", "n"])

    return link


def near_duplicates(spark: SparkSession, vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    ws = Workspace(spark, "hnsw")
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("embedding"))
    keyed = ws.save(v.mapInArrow(lean(_keys), "vec_id long, key binary, embedding array<double>"), "vectors")
    usable = keyed.where("key is not null and vec_id is not null")
    distinct = ws.save(usable.groupBy("key").agg(F.min("vec_id").alias("rep"), F.count_distinct("vec_id").alias("mult"), F.first("embedding").alias("embedding")), "distinct")
    distinct_rows = distinct.count()
    shards = max(1, math.ceil(distinct_rows / shard_rows))
    dealt = distinct.select(F.pmod(F.xxhash64("key"), F.lit(shards)).alias("part"), F.size("embedding").alias("d"), "rep", "mult", "embedding")
    dealt = dealt.withColumn("shard", F.col("d").cast("long") * 2**32 + F.col("part")).drop("part", "d")
    graphs = ws.save(dealt.groupBy("shard").applyInArrow(_builder, GRAPHS), "graphs")

    names = graphs.select("shard", "d")
    # shards of one length, numbered pairs; a stated set of queries (blocks) against every shard
    pairs = names.groupBy("d").agg(F.array_sort(F.collect_list("shard")).alias("s")).select(F.posexplode("s").alias("i", "q_shard"), "s").select("q_shard", F.explode(F.slice("s", F.col("i") + 1, F.size("s"))).alias("shard"))
    asked = graphs.select("shard", "d", "ids", "mult", "x").mapInArrow(lean(_slices), "q_shard long, q_ids binary, q_mult binary, q_x binary")
    tasks = max(1, math.ceil(distinct_rows / SLICE) * shards)
    work = pairs.join(asked, "q_shard").join(graphs, "shard").repartition(tasks, "q_shard", "shard", F.xxhash64("q_ids"))
    found = ws.save(work.mapInArrow(lean(_linker(cosine)), "u long, v long, n long"), "links")

    counts = found.where("v is null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("others"))
    parts = connected_components(found.where("v is not null"), ws)
    groups = distinct.select("key", "rep", "mult").join(counts, "rep", "left").join(parts.withColumnsRenamed({"node": "rep"}), "rep", "left")
    groups = groups.select("key", (F.coalesce("others", F.lit(0)) + F.col("mult") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = usable.select("vec_id", "key").join(groups, "key").select("vec_id", "n", "c")
    alone = keyed.where("key is null or vec_id is null").select("vec_id", F.lit(0).cast("long"), F.col("vec_id"))
    return out.union(alone).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("c"), F.lit(True)).alias("kept"))
