"""Exact top-k by integer inner product: branch and bound over columns of components.

Vectors are stored in shards by component: first that with the greatest sum of squares over
the table, for all vectors of the shard, then the next. A block of queries adds up products
over a few components at a time. After each step a pair can gain at most the product of the
norms of what is left of its two vectors; pairs that cannot reach the query's k-th best score
any more are dropped, and the columns are compacted to the surviving candidates. While many
survive, a step is one product of matrices; later it gathers the pairs left.

Shards are cut along falling norms, so the first ones give high k-th best scores and many later
ones are left out whole. All sums are of whole numbers and exact: in single or double
precision where no sum can leave its exact range, in Python's integers elsewhere.

Equal vectors are one node with their least ids, as many as an answer can name. So a vector
that is a third of the table is one candidate, and no answer changes, for ties rank by id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.session import written

#: Candidates of a shard, and queries of a block: what one task holds at a time.
SHARD_ROWS, QUERY_ROWS = 8192, 8192
#: Queries that meet a shard in one product, and components added between two cuts.
CHUNK, STEP = 256, 8
#: Below this share of pairs they are gathered one by one.
SPARSE = 1 / 32
#: Vectors with greater components are stored apart, so that others keep to fast arithmetic.
LARGE = 1 << 22

_PACKED = "shard long, part int, ids binary, counts binary, columns binary"


def whole_vectors(vectors: DataFrame, vec_id: str, vector: str, scale: float) -> DataFrame:
    """vec_id, v (array<long>): ``floor(scale * x)`` of each component, repeated rows once.

    Left out: null ids, null vectors, null or non-finite components. Whole numbers beyond 64
    bits count as the nearest of 64 bits.
    """
    x = F.col(f"`{vector}`").cast("array<double>")
    rows = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("vec_id"), x.alias("x"))
    rows = rows.where("vec_id is not null and x is not null")
    rows = rows.where(F.forall("x", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf"))))
    whole: Column = F.transform("x", lambda e: F.floor(F.lit(float(scale)) * e).cast("long"))
    return rows.select("vec_id", whole.alias("v")).distinct()


def _matrix(lists: pa.ListArray, order: np.ndarray) -> np.ndarray:
    """Components by vectors, in the given order; what a shorter vector lacks is zero."""
    bounds = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.flatten().to_numpy()
    sizes = np.diff(bounds)
    out = np.zeros((len(lists), len(order)), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(bounds[:-1] - bounds[0], sizes)] = flat
    return np.ascontiguousarray(out[:, order].T)


def _packed(shard: int, part: int, ids: np.ndarray, counts: np.ndarray, columns: np.ndarray) -> dict:
    return {
        "shard": shard, "part": part, "ids": ids.astype(np.int64).tobytes(),
        "counts": counts.astype(np.int32).tobytes(), "columns": columns.tobytes(),
    }


def _unpacked(row: dict, dims: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    counts = np.frombuffer(row["counts"], np.int32).astype(np.int64)
    columns = np.frombuffer(row["columns"], np.int64).reshape(dims, len(counts))
    return np.frombuffer(row["ids"], np.int64), counts, columns


def _rest(columns: np.ndarray) -> np.ndarray:
    """Norms of what is left of each vector from each component on: components + 1 by vectors."""
    squares = columns.astype(np.float64) ** 2
    left = np.cumsum(squares[::-1], 0)[::-1]
    return np.sqrt(np.concatenate((left, np.zeros((1, columns.shape[1])))))


def _kind(dims: int, a: np.ndarray, b: np.ndarray) -> type:
    """A type in which no sum of products of the two can be inexact."""
    most = dims * max(map(abs, (int(a.min()), int(a.max())))) * max(map(abs, (int(b.min()), int(b.max()))))
    return np.float32 if most < 1 << 23 else np.float64 if most < 1 << 52 else object


def _sure(bound: np.ndarray) -> np.ndarray:
    return bound * (1 + 1e-5) + 1


def survivors(
    queries: np.ndarray, q_rest: np.ndarray, columns: np.ndarray, c_rest: np.ndarray,
    least: np.ndarray, hidden: tuple[np.ndarray, np.ndarray], answers: int, step: int = STEP,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, candidate and score of all pairs that can be among a query's ``answers`` best.

    ``least`` is each query's score to reach; pairs of ``hidden`` (query, candidate) are none.
    """
    dims, m = queries.shape
    kind = _kind(dims, queries, columns) if dims and m and columns.shape[1] else np.float64
    if kind is object:
        scores = np.clip(queries.T.astype(object) @ columns.astype(object), -(1 << 63), (1 << 63) - 1)
        row, at = np.nonzero(scores >= np.where(np.isinf(least), -(1 << 140), least)[:, None])
        return row, at, scores[row, at]
    q = np.ascontiguousarray(queries.T.astype(kind))
    columns = columns.astype(kind)
    live = np.arange(columns.shape[1])
    total = np.zeros((m, len(live)), kind)
    total[hidden] = -np.inf
    wide, q_rest, c_rest = least.astype(kind)[:, None], q_rest.astype(kind), c_rest.astype(kind)
    for at in range(0, dims, step):
        end = min(at + step, dims)
        total += q[:, at:end] @ columns[at:end, live]
        if end == dims:
            break
        keep = total + _sure(q_rest[end][:, None] * c_rest[end, live]) >= wide
        if np.count_nonzero(keep) < SPARSE * keep.size:
            row, place = np.nonzero(keep)
            return _gathered(q, q_rest, columns, c_rest, wide[:, 0], row, live[place], total[row, place], end, step)
        some = keep.any(0)
        if np.count_nonzero(some) < 0.8 * len(some):
            live, total = live[some], total[:, some]
    if len(live) > answers:
        reached = np.partition(total, len(live) - answers, 1)[:, -answers][:, None]
        wide = np.maximum(wide, reached)
    row, place = np.nonzero((total >= wide) & (total > -np.inf))
    return row, live[place], total[row, place].astype(np.int64)


def _gathered(q, q_rest, columns, c_rest, least, row, at, score, end, step):
    """The other components for single pairs, cut after every step."""
    dims = columns.shape[0]
    while end < dims and len(row):
        start, end = end, min(end + step, dims)
        for k in range(start, end):
            score = score + q[row, k] * columns[k, at]
        keep = score + _sure(q_rest[end, row] * c_rest[end, at]) >= least[row]
        row, at, score = row[keep], at[keep], score[keep]
    keep = score >= least[row]
    return row[keep], at[keep], score[keep].astype(np.int64)


class Block:
    """A block of queries and the best answers it has met so far."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, answers: int):
        order = np.argsort(np.abs(columns).max(0, initial=0), kind="stable")
        self.ids, self.columns, self.answers = ids[order], np.ascontiguousarray(columns[:, order]), answers
        self.rest = _rest(self.columns)
        self.least = np.full(len(ids), -np.inf)
        self.best: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def meet(self, ids: np.ndarray, counts: np.ndarray, columns: np.ndarray) -> None:
        """Take in a shard of candidates."""
        rest, first = _rest(columns), np.cumsum(counts) - counts
        node = np.repeat(np.arange(len(counts)), counts)
        by_id = np.argsort(ids, kind="stable")
        longest = rest[0].max(initial=0.0)
        for low in range(0, len(self.ids), CHUNK):
            rows = np.arange(low, min(low + CHUNK, len(self.ids)))
            rows = rows[_sure(self.rest[0, rows] * longest) >= self.least[rows]]
            if not len(rows):
                continue
            # nodes that stand for nothing but the query itself
            a, b = (np.searchsorted(ids[by_id], self.ids[rows], side) for side in ("left", "right"))
            own = np.repeat(np.arange(len(rows)), b - a)
            own_node = node[by_id[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())]]
            alone = counts[own_node] == 1
            row, at, score = survivors(
                self.columns[:, rows], self.rest[:, rows], columns, rest, self.least[rows],
                (own[alone], own_node[alone]), self.answers,
            )
            n = counts[at]
            place = np.repeat(first[at] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            self._add(low // CHUNK, np.repeat(rows[row], n), ids[place], np.repeat(score, n))

    def _add(self, chunk: int, row: np.ndarray, vec_id: np.ndarray, score: np.ndarray) -> None:
        other = vec_id != self.ids[row]
        new = row[other], vec_id[other], score[other]
        if chunk in self.best:
            new = tuple(np.concatenate(x) for x in zip(self.best[chunk], new))
        row, vec_id, score = new
        order = np.lexsort((vec_id, -score, row))
        row, vec_id, score = row[order], vec_id[order], score[order]
        begin = np.searchsorted(row, row)
        rank = np.arange(len(row)) - begin
        keep = rank < self.answers
        self.best[chunk] = row[keep], vec_id[keep], score[keep]
        last = rank == self.answers - 1
        self.least[row[last]] = score[last].astype(np.float64)

    def rows(self) -> Iterator[pa.RecordBatch]:
        for row, vec_id, score in self.best.values():
            yield pa.RecordBatch.from_pydict({"query_id": self.ids[row], "vec_id": vec_id, "score": score.astype(np.int64)})


def exact_nearest(
    vectors: DataFrame,
    *,
    every: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    answers: int = 20,
    scale: float = 64,
    shard_rows: int = SHARD_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score (long): the ``answers`` best others of each row whose id ``every`` divides.

    The score is the inner product of ``floor(scale * x)``; equal scores rank by smaller id.
    Null ids, null vectors and vectors with null or non-finite components take no part; zero
    and empty vectors do. What a vector lacks of the longest one's components counts as
    zero. Repeated rows count once. Of rows with equal id and different vectors each is a
    candidate, no row with the query's id is one, and the answers to such queries are ranked
    together. Sums beyond 64 bits count as the nearest of 64 bits. An empty table
    gives no rows; other columns are not read.

    Queries of a block are held by a task and the shards pass it one by one. Each block meets
    every shard, so work grows with queries times candidates; more ``query_rows`` send each
    shard to fewer tasks.
    """
    spark = vectors.sparkSession
    rows = whole_vectors(vectors, vec_id, vector, scale)
    least_ids = Window.partitionBy("v").orderBy("vec_id")
    nodes = rows.withColumn("r", F.row_number().over(least_ids)).where(F.col("r") <= answers + 1)
    nodes = written(nodes.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "nodes")
    n = nodes.count()
    each = nodes.select(F.posexplode("v").alias("k", "x")).select("k", F.col("x").cast("double").alias("x"))
    # one row per component
    mass = {r.k: r.mass for r in each.groupBy("k").agg(F.sum(F.col("x") * F.col("x")).alias("mass")).collect()}
    order = np.array(sorted(mass, key=lambda k: (-mass[k], k)), np.int64)
    dims = len(order)
    asked = written(rows.where(F.col("vec_id") % every == 0), "asked")
    n_asked = asked.count()
    out = "query_id long, vec_id long, score long"
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        me, table = TaskContext.get().partitionId(), pa.Table.from_batches(batches, pa.schema({"v": pa.list_(pa.int64()), "ids": pa.list_(pa.int64())}))
        if not len(table):
            return
        v, ids = table["v"].combine_chunks(), table["ids"].combine_chunks()
        columns = _matrix(v, order)
        counts = np.diff(ids.offsets.to_numpy())
        big = np.abs(columns.astype(np.float64)).max(0, initial=0) >= LARGE
        flat = ids.flatten().to_numpy()
        for k, pick in enumerate((big, ~big)):
            if pick.any():
                row = _packed(2 * me + k, me, flat[np.repeat(pick, counts)], counts[pick], columns[:, pick])
                yield pa.RecordBatch.from_pylist([row], _schema())

    def block(key: tuple, table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        columns = _matrix(table["v"].combine_chunks(), order)
        return pa.Table.from_pylist([_packed(-1, key[0].as_py(), ids, np.ones(len(ids)), columns)], _schema())

    norm = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    along = nodes.withColumn("norm", norm).repartitionByRange(max(1, -(-n // shard_rows)), F.desc("norm"), F.xxhash64("v"))
    index = written(along.select("v", "ids").mapInArrow(shards, _PACKED), "shards")
    blocks = max(1, -(-n_asked // query_rows))
    asked = asked.withColumn("block", F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int"))
    queries = written(asked.groupBy("block").applyInArrow(block, _PACKED), "blocks")

    # every block meets every shard: shards are dealt to parts, so that all cores have cells
    parts = max(1, min(index.count(), -(-2 * spark.sparkContext.defaultParallelism // blocks)))
    cell = lambda b, p: (b * parts + p).cast("int").alias("cell")
    columns = ["shard", "ids", "counts", "columns"]
    some = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("p")
    held = queries.select("part", *columns, some).select(cell(F.col("part"), F.col("p")), *columns)
    all_blocks = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b")
    passing = index.select("part", *columns, all_blocks).select(cell(F.col("b"), F.col("part") % parts), *columns)
    dealt = held.unionByName(passing).repartitionById(blocks * parts, "cell").sortWithinPartitions("cell", "shard")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, own = None, None
        for batch in batches:
            for k in range(batch.num_rows):
                row = {name: batch.column(name)[k].as_py() for name in batch.schema.names}
                ids, counts, matrix = _unpacked(row, dims)
                if row["shard"] < 0:
                    if now is not None:
                        yield from now.rows()
                    own, now = row["cell"], Block(ids, matrix, answers)
                elif own == row["cell"]:  # a block may be empty
                    now.meet(ids, counts, matrix)
        if now is not None:
            yield from now.rows()

    found = dealt.mapInArrow(search, out)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= answers)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _schema() -> pa.Schema:
    return pa.schema({"shard": pa.int64(), "part": pa.int32(), "ids": pa.binary(), "counts": pa.binary(), "columns": pa.binary()})
