"""Nearest neighbours by inner product in robust-pruned directed graphs, one per shard.

Vectors get one more component, so that all have the largest norm of the table; then the
nearest by distance is the one with the largest inner product. Each shard's graph is built in
batches of doubling size: a greedy search from the shard's middle proposes neighbours, and
pruning keeps those that no kept one is ``alpha`` times closer to. A query walks each shard's
graph with a beam; what it finds is ranked by exact inner products in double precision.

How wide the beam must be depends on the data, above all on the spread of the norms. Each shard
tries it out when it is built: 32 of its vectors are searched for, and the beam is doubled
until it finds nearly all that exact search finds. A shard in which a beam of ``MOST_BEAM`` does
not, such as one of very many nearly equal vectors, is scanned whole.

Equal vectors are one node with their least ids, as many as an answer can name. So a vector
that is a third of the table neither fills a shard nor hides its neighbours, and no answer
changes, for equal scores rank by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import written

SHARD_ROWS = 8192
#: Queries that walk a graph together.
QUERY_ROWS = 512
DEGREE, BEAM, ALPHA = 32, 64, 1.2
SEARCH_BEAM = 96
#: Vectors that a shard is tried out with, and the share of nearest ones that must be found.
TRIAL, LEAST_RECALL = 32, 0.98
MOST_BEAM = 384


def _distance(x: np.ndarray, norms: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to its own candidates, less the query's own norm."""
    return norms[ids] - 2 * np.einsum("qcd,qd->qc", x[ids], q)


def beam_search(
    x: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, q: np.ndarray, beam: int
) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` nearest nodes that a greedy walk finds for each query, nearest first.

    Missing ones have id -1 and an infinite distance.
    """
    n = len(q)
    ids = np.full((n, beam), -1)
    dist = np.full((n, beam), np.inf, np.float32)
    ids[:, 0] = start
    dist[:, 0] = _distance(x, norms, q, ids[:, :1])[:, 0]
    done = np.zeros((n, beam), bool)
    active = np.arange(n)
    while len(active):
        open_ = ~done[active] & (ids[active] >= 0)
        some = open_.any(1)
        active, open_ = active[some], open_[some]
        if not len(active):
            break
        place = open_.argmax(1)
        done[active, place] = True
        near = graph[ids[active, place]]
        mine = ids[active]
        new = (near >= 0) & ~(near[:, :, None] == mine[:, None, :]).any(2)
        d = np.where(new, _distance(x, norms, q[active], np.maximum(near, 0)), np.inf)
        all_ids = np.concatenate((mine, near), 1)
        all_d = np.concatenate((dist[active], d.astype(np.float32)), 1)
        flags = np.concatenate((done[active], np.zeros(near.shape, bool)), 1)
        order = np.argsort(all_d, 1, kind="stable")[:, :beam]
        dist[active] = np.take_along_axis(all_d, order, 1)
        done[active] = np.take_along_axis(flags, order, 1)
        got = np.take_along_axis(all_ids, order, 1)
        ids[active] = np.where(np.isinf(dist[active]), -1, got)
    return ids, dist


def robust_prune(
    x: np.ndarray, norms: np.ndarray, points: np.ndarray, candidates: np.ndarray, degree: int, alpha: float
) -> np.ndarray:
    """For each point at most ``degree`` of its candidates (-1: none), diverse and near."""
    candidates = np.where(candidates == points[:, None], -1, candidates)
    own = np.sort(candidates, 1)
    twice = np.zeros(candidates.shape, bool)
    order = np.argsort(candidates, 1, kind="stable")
    np.put_along_axis(twice, order[:, 1:], own[:, 1:] == own[:, :-1], 1)
    alive = (candidates >= 0) & ~twice
    safe = np.maximum(candidates, 0)
    d = _distance(x, norms, x[points], safe) + norms[points][:, None]
    order = np.argsort(np.where(alive, d, np.inf), 1, kind="stable")
    safe, d, alive = (np.take_along_axis(a, order, 1) for a in (safe, d, alive))
    vectors, sizes = x[safe], norms[safe]
    out = np.full((len(points), degree), -1)
    rows = np.arange(len(points))
    for k in range(degree):
        some = alive.any(1)
        if not some.any():
            break
        pick = alive.argmax(1)
        out[some, k] = safe[rows, pick][some]
        between = sizes + sizes[rows, pick][:, None] - 2 * np.einsum("pcd,pd->pc", vectors, vectors[rows, pick])
        alive &= alpha * alpha * np.maximum(between, 0) > d
        alive[rows, pick] = False
    return out


def build_graph(
    x: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA
) -> tuple[np.ndarray, int]:
    """Neighbours of each vector (-1: none) and the node where searches start."""
    n = len(x)
    norms = np.einsum("nd,nd->n", x, x)
    graph = np.full((n, degree), -1)
    start = int(np.argmin(norms - 2 * x @ x.mean(0)))
    order = np.random.default_rng(5).permutation(n)
    order = np.concatenate(([start], order[order != start]))
    at = 1
    while at < n:
        batch = order[at : at + min(at, 512, max(1, n // 20))]
        at += len(batch)
        found, _ = beam_search(x, norms, graph, start, x[batch], beam)
        graph[batch] = robust_prune(x, norms, batch, found, degree, alpha)
        source = np.repeat(batch, degree)
        target = graph[batch].reshape(-1)
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        used = (graph[nodes] >= 0).sum(1)
        for low in range(0, len(nodes), 512):
            part = slice(low, low + 512)
            width = int(count[part].max())
            cell = np.arange(width)
            back = np.where(cell < count[part][:, None], source[np.minimum(first[part][:, None] + cell, len(source) - 1)], -1)
            both = np.concatenate((graph[nodes[part]], back), 1)
            full = used[part] + count[part] > degree
            if full.any():
                graph[nodes[part][full]] = robust_prune(x, norms, nodes[part][full], both[full], degree, alpha)
            rest = ~full
            packed = np.take_along_axis(both[rest], np.argsort(both[rest] < 0, 1, kind="stable"), 1)
            graph[nodes[part][rest]] = packed[:, :degree]
    return graph, start


def valid_vectors(vectors: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """vec_id, v (array<double>): rows that take part, repeated rows once.

    Left out: null ids, null and zero vectors, null or non-finite components, and vectors of
    another length than most have (of equally frequent ones the longest).
    """
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null")
    finite = F.forall("v", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = rows.where(finite & F.exists("v", lambda e: e != 0))
    size = rows.groupBy(F.size("v").alias("s")).count().orderBy(F.desc("count"), F.desc("s")).first()
    return rows.where(F.size("v") == (size.s if size else -1))


def wide_enough(
    x: np.ndarray, graph: np.ndarray, start: int, answers: int, beam: int = SEARCH_BEAM, least: float = LEAST_RECALL
) -> int:
    """The beam from ``beam`` on, doubling, with which searches for some of the vectors find their
    nearest; the number of vectors where ``MOST_BEAM`` is not wide enough."""
    n = len(x)
    k = min(answers + 1, n)
    q = x[np.random.default_rng(7).permutation(n)[:TRIAL]].copy()
    q[:, -1] = 0
    score = q @ x.T
    reached = np.partition(score, n - k, 1)[:, n - k]
    norms = np.einsum("nd,nd->n", x, x)
    while beam < n and beam <= max(MOST_BEAM, answers + 1):
        found, _ = beam_search(x, norms, graph, start, q, beam)
        hit = (np.take_along_axis(score, np.maximum(found, 0), 1) >= reached[:, None]) & (found >= 0)
        if np.minimum(hit.sum(1), k).sum() >= least * k * len(q):
            return beam
        beam *= 2
    return n


_SHARD = "shard int, ids binary, counts binary, vectors binary, graph binary, start int, beam int"
_ARROW = pa.schema(
    {"shard": pa.int32(), "ids": pa.binary(), "counts": pa.binary(), "vectors": pa.binary(), "graph": pa.binary(), "start": pa.int32(), "beam": pa.int32()}
)


def build_index(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    answers: int = 20,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """One row per shard with its nodes and graph, as a written table; every valid row is in it."""
    rows = valid_vectors(vectors, vec_id, vector).distinct()
    least = Window.partitionBy("v").orderBy("vec_id")
    # equal scores rank by id, so of equal vectors an answer names the least ids
    rows = rows.withColumn("r", F.row_number().over(least)).where(F.col("r") <= answers + 1)
    nodes = written(rows.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e)
    n, most = nodes.agg(F.count(F.lit(1)), F.max(norm)).first()
    shards = max(1, -(-n // shard_rows))
    taken = pa.schema({"v": pa.list_(pa.float64()), "ids": pa.list_(pa.int64()), "shard": pa.int32()})

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches([b.cast(taken) for b in batches], taken)
        if not len(table):
            return
        v, ids = table["v"].combine_chunks(), table["ids"].combine_chunks()
        v = np.asarray(v.flatten(), np.float64).reshape(len(table), -1)
        counts = np.diff(ids.offsets.to_numpy()).astype(np.int32)
        extra = np.sqrt(np.maximum(most - (v * v).sum(1), 0))
        x = np.concatenate((v, extra[:, None]), 1).astype(np.float32)
        graph, start = build_graph(x)
        row = {
            "shard": table["shard"][0].as_py(), "ids": ids.flatten().to_numpy().tobytes(), "counts": counts.tobytes(),
            "vectors": np.ascontiguousarray(np.concatenate((v, extra[:, None]), 1)).tobytes(),
            "graph": graph.astype(np.int32).tobytes(), "start": start, "beam": wide_enough(x, graph, start, answers),
        }
        yield pa.RecordBatch.from_pylist([row], _ARROW)

    dealt = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    # every shard is a task of its own
    return written(dealt.repartitionById(shards, "shard").select("v", "ids", "shard").mapInArrow(build, _SHARD), "graphs")


class _Shard:
    """A shard as searches use it."""

    def __init__(self, row: dict):
        get = lambda name, kind: np.frombuffer(row[name], kind)
        self.counts = get("counts", np.int32).astype(np.int64)
        self.ids = get("ids", np.int64)
        self.x = get("vectors", np.float64).reshape(len(self.counts), -1)
        self.graph = get("graph", np.int32).reshape(len(self.counts), -1)
        self.single = self.x.astype(np.float32)
        self.norms = np.einsum("nd,nd->n", self.single, self.single)
        self.first = np.cumsum(self.counts) - self.counts
        self.start, self.beam = row["start"], row["beam"]

    def _scanned(self, q: np.ndarray, k: int) -> np.ndarray:
        """All nodes that reach each query's ``k``-th best score (-1: none)."""
        score = q @ self.x[:, :-1].T
        n = score.shape[1]
        if n <= k:
            return np.broadcast_to(np.arange(n), score.shape)
        # the product may round otherwise than the exact score: nearly equal ones stay
        near = np.partition(score, n - k, 1)[:, n - k]
        reach = score >= (near - 1e-9 * (1 + np.abs(near)))[:, None]
        width = int(reach.sum(1).max())
        place = np.argsort(~reach, 1, kind="stable")[:, :width]
        return np.where(np.take_along_axis(reach, place, 1), place, -1)

    def answers(self, name: np.ndarray, q: np.ndarray, beam: int, answers: int) -> pa.RecordBatch:
        """query_id, vec_id, score of the best that each query finds here."""
        found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
        wide = np.concatenate((q, np.zeros((len(q), 1))), 1).astype(np.float32)
        if self.beam >= len(self.counts):
            nodes = self._scanned(q, answers + 1)
        else:
            beam = min(max(beam, self.beam, answers + 1), len(self.counts))
            nodes, _ = beam_search(self.single, self.norms, self.graph, self.start, wide, beam)
        exact = np.einsum("qcd,qd->qc", self.x[np.maximum(nodes, 0), :-1], q)
        for i in range(len(q)):
            mine = nodes[i][nodes[i] >= 0]
            n = self.counts[mine]
            at = np.repeat(self.first[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            got, score = self.ids[at], np.repeat(exact[i][nodes[i] >= 0], n)
            other = got != name[i]
            got, score = got[other], score[other]
            order = np.lexsort((got, -score))[:answers]
            found["query_id"].append(np.full(len(order), name[i]))
            found["vec_id"].append(got[order])
            found["score"].append(score[order])
        kinds = (np.int64, np.int64, np.float64)
        return pa.RecordBatch.from_pydict({k: np.concatenate([np.zeros(0, t), *v]) for (k, v), t in zip(found.items(), kinds)})


def search(
    index: DataFrame, queries: DataFrame, *, answers: int = 20, beam: int = SEARCH_BEAM, query_rows: int = QUERY_ROWS
) -> DataFrame:
    """query_id, rank, vec_id, score for ``queries`` (query_id long, v array<double>).

    A task holds one shard, and queries pass it in batches. With fewer shards than cores the
    queries are dealt to several tasks of a shard; with more, no shard is copied. A row
    with the query's id is no candidate. Fewer candidates than ``answers`` give fewer rows.
    """
    spark = index.sparkSession
    shards = [r.shard for r in index.select("shard").collect()]  # one number per shard
    out = "query_id long, vec_id long, score double"
    if not shards:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    parts = max(1, -(-2 * spark.sparkContext.defaultParallelism // len(shards)))
    place = F.create_map(*[F.lit(x) for k, s in enumerate(sorted(shards)) for x in (s, k * parts)]) if len(shards) < 1000 else None
    first = place[F.col("shard")] if place is not None else F.col("shard") * parts
    own = [c for c in index.columns if c != "shard"]
    held = index.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    held = held.select((first + F.col("part")).cast("int").alias("cell"), *own)
    part = F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")
    every = F.explode(F.array(*[F.lit(s) for s in shards])).alias("shard")
    asked = queries.select("query_id", "v", part.alias("part"), every).select((first + F.col("part")).cast("int").alias("cell"), "query_id", "v")
    both = held.unionByName(asked, allowMissingColumns=True)
    cells = (len(shards) if place is not None else max(shards) + 1) * parts
    dealt = both.repartitionById(cells, "cell").sortWithinPartitions("cell", F.asc_nulls_first("query_id"))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = None
        for batch in batches:
            begins = pc.is_null(batch.column("query_id")).to_numpy(zero_copy_only=False)
            if begins.any():  # a task has one cell, and its shard comes first
                k = int(begins.argmax())
                shard = _Shard({name: batch.column(name)[k].as_py() for name in own})
                batch = batch.filter(pa.array(~begins))
            if shard is None or not batch.num_rows:
                continue
            name = batch.column("query_id").to_numpy()
            q = np.asarray(batch.column("v").flatten(), np.float64).reshape(len(name), -1)
            for low in range(0, len(name), query_rows):
                step = slice(low, low + query_rows)
                yield shard.answers(name[step], q[step], beam, answers)

    found = dealt.mapInArrow(walk, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.dropDuplicates().withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= answers)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(
    vectors: DataFrame,
    *,
    every: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    answers: int = 20,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose id ``every`` divides its nearest others.

    Nearness is the largest inner product; ties go to the smaller id. Rows that
    :func:`valid_vectors` leaves out are neither queries nor candidates. Of rows with equal id
    and different vectors each is a candidate, and the answers to them are merged. An empty
    table gives no rows; other columns are not read.
    """
    index = build_index(vectors, vec_id=vec_id, vector=vector, answers=answers, shard_rows=shard_rows)
    asked = valid_vectors(vectors, vec_id, vector).where(F.col("vec_id") % every == 0).distinct()
    return search(index, asked.withColumnRenamed("vec_id", "query_id"), answers=answers)
