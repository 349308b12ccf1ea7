"""Exact top-k search: a KD-tree for each shard, best-first with box bounds, the kth score handed on from wave to wave.

Shards are the cells of a coarse KD-tree over all vectors, so a shard's box is tight and whole shards can be ruled out.
Queries are dealt to blocks by the same cells. In each wave a block searches its most promising open shards; the kth
scores found then close the shards whose box reaches none of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.llm.common import cut, drop_table, pick

#: Vectors of a shard and of a block of queries at most, about, and bytes of either; they bound a task's memory.
SHARD = 8192
BLOCK = 1024
BYTES = 32 << 20
#: Vectors of a leaf.
LEAF = 256
#: Vectors that the coarse tree is fitted on, and of these the least number of a cell.
SAMPLE = 16384
LEAST_OF_CELL = 8
#: Blocks of queries that meet a shard in one task, and shard boxes of a row.
TOGETHER = 32
CHUNK = 256
#: Doubles hold integers exactly up to here; beyond it the search works in extended precision, exact up to a long.
EXACT = float(1 << 53)


class Tree(NamedTuple):
    """Nodes (first, after the last, left child, right child; -1 in a leaf) and their tight boxes; points in its order."""

    nodes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    points: np.ndarray
    ids: np.ndarray


def build(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """A node is split at the median of the coordinate in which its box is widest."""
    order = np.arange(len(points))
    nodes: list[tuple[int, int, int, int]] = []
    low: list[np.ndarray] = []
    high: list[np.ndarray] = []

    def add(a: int, b: int) -> int:
        mine = points[order[a:b]]
        at = len(nodes)
        nodes.append((a, b, -1, -1))
        low.append(mine.min(0))
        high.append(mine.max(0))
        if b - a > leaf:
            axis = int((high[at] - low[at]).argmax())
            middle = (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(mine[:, axis], middle)]
            nodes[at] = (a, b, add(a, a + middle), add(a + middle, b))
        return at

    if len(points):
        add(0, len(points))
    return Tree(np.array(nodes, np.int64).reshape(-1, 4), np.array(low), np.array(high), points[order], ids[order])


def reached(queries: np.ndarray, least: np.ndarray, tree: Tree) -> tuple[np.ndarray, ...]:
    """(query row, leaf, bound) for the leaves that a query can't rule out; what is under a node ruled out is not looked at."""
    up, down = np.maximum(queries, 0), np.minimum(queries, 0)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    stack = [(0, np.arange(len(queries)))] if len(tree.nodes) else []
    while stack:
        at, rows = stack.pop()
        bound = up[rows] @ tree.high[at] + down[rows] @ tree.low[at]
        reach = bound >= least[rows]
        rows, bound = rows[reach], bound[reach]
        left, right = tree.nodes[at, 2:].tolist()
        if not len(rows):
            continue
        if left < 0:
            out.append((rows, np.full(len(rows), at), bound))
        else:
            stack += [(left, rows), (right, rows)]
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def places(keys: np.ndarray) -> np.ndarray:
    """Of sorted keys, each one's place among its equals, from 0."""
    new = np.append(True, keys[1:] != keys[:-1])[: len(keys)]
    head = np.flatnonzero(new)
    return np.arange(len(keys)) - np.repeat(head, np.diff(np.append(head, len(keys))))


def search(queries: np.ndarray, ids: np.ndarray, kth: np.ndarray, tree: Tree, k: int) -> tuple[np.ndarray, ...]:
    """(query row, vector id, score) of each query's best k in the tree that reach its kth score so far, itself left out.

    Best-first: a query visits its leaves by falling bound until that is below its kth score. All queries take their
    turns together, so that those at one leaf meet it in one product.
    """
    points = tree.points
    if len(points) and np.abs(queries).max(initial=0) * max(np.abs(tree.low[0]).max(), np.abs(tree.high[0]).max()) * points.shape[1] >= EXACT:
        queries, points = queries.astype(np.longdouble), points.astype(np.longdouble)
        tree = tree._replace(low=tree.low.astype(np.longdouble), high=tree.high.astype(np.longdouble))
    least = kth.astype(points.dtype)
    row, leaf, bound = reached(queries, least, tree)
    order = np.lexsort((-bound, row))
    turn = places(row[order])
    order = order[np.lexsort((leaf[order], turn))]
    row, leaf, bound, turn = row[order], leaf[order], bound[order], np.sort(turn)
    turns = np.searchsorted(turn, np.arange(turn[-1] + 2)) if len(turn) else [0]
    best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, points.dtype))
    for first, last in zip(turns[:-1], turns[1:], strict=True):
        still = np.flatnonzero(bound[first:last] >= least[row[first:last]]) + first
        if not len(still):
            break
        new = [best]
        heads = np.flatnonzero(np.append(True, leaf[still][1:] != leaf[still][:-1]))
        for mine in np.split(still, heads[1:]):
            a, b = tree.nodes[leaf[mine[0]], :2].tolist()
            rows = row[mine]
            score = queries[rows] @ points[a:b].T
            r, c = np.nonzero((score >= least[rows][:, None]) & (tree.ids[a:b][None, :] != ids[rows][:, None]))
            new.append((rows[r], tree.ids[a:b][c], score[r, c]))
        q, vec, score = (np.concatenate(x) for x in zip(*new, strict=True))
        by = np.lexsort((vec, -score, q))
        place = places(q[by])
        best = tuple(x[by[place < k]] for x in (q, vec, score))
        full = by[place == k - 1]
        least[q[full]] = np.maximum(least[q[full]], score[full])
    return best


def coarse(sample: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Axis and value of each split of a whole binary tree of so many levels over the sample, level by level."""
    axes, values = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)

    def split(at: int, mine: np.ndarray) -> None:
        if at >= len(axes) or not len(mine):
            return
        axes[at] = (mine.max(0) - mine.min(0)).argmax()
        column = mine[:, axes[at]]
        values[at] = np.median(column)
        split(2 * at + 1, mine[column < values[at]])
        split(2 * at + 2, mine[column >= values[at]])

    split(0, sample)
    return axes, values


def cell_of(vectors: np.ndarray, axes: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = np.zeros(len(vectors), np.int64)
    for _ in range((len(axes) + 1).bit_length() - 1):
        at = 2 * at + 1 + (vectors[np.arange(len(vectors)), axes[at]] >= values[at])
    return at - len(axes)


def top_k(df: DataFrame, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id, score: for each row whose vec_id is divisible by every its k best others by inner product.

    Components become floor(scale * x) as doubles. Ties go to the smaller vec_id; with fewer than k others all are given. A
    vector that is null, empty or holds null or non-finite components, or has no vec_id, takes no part, nor do vectors of
    another dimension than the query's meet it. Repeated rows are candidates each by itself but for the query's own vec_id, and
    a query once, by its least vector. Other columns are left out. An empty table gives none. Exact while scores are longs.
    """
    rows = pick(df, vec_id, embedding).toDF("vec_id", "embedding").where("vec_id is not null and size(embedding) > 0")
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where(fine).select("vec_id", v.alias("v"), F.size("embedding").alias("dim"))
    out = None
    for dim, n in sorted(tuple(r) for r in rows.groupBy("dim").count().collect()):
        found = _top_k(rows.where(F.col("dim") == dim).select("vec_id", "v"), n, k, every, dim)
        out = found if out is None else out.union(found)
    empty = df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return empty if out is None else out


def _bundle(rows: DataFrame, number: Column, most: int, shift: int, trees: bool) -> DataFrame:
    """Rows (vec_id, v, cell) in bundles of about so many at most, of one cell or 2**shift neighbouring ones; a cell with
    more is dealt over several by a number of each row, the same whenever a task runs again."""
    fields = [("name", T.LongType()), *((n, T.BinaryType()) for n in ("ids", "vectors", *(("nodes", "low", "high") if trees else ())))]
    kept = T.StructType([T.StructField(*f) for f in fields])

    def gather(frame: pd.DataFrame) -> pd.DataFrame:
        vectors, ids = np.stack(frame["v"].to_numpy()).astype(np.float64), frame["vec_id"].to_numpy(np.int64)
        out = {"name": [frame["name"].iloc[0]]}
        if trees:
            tree = build(vectors, ids)
            ids, vectors = tree.ids, tree.points
            out |= {"nodes": [tree.nodes.tobytes()], "low": [tree.low.tobytes()], "high": [tree.high.tobytes()]}
        return pd.DataFrame(out | {"ids": [ids.tobytes()], "vectors": [vectors.tobytes()]})[kept.names]

    group = F.shiftright("cell", shift)
    counts = rows.groupBy(group.alias("group")).agg(F.ceil(F.count("*") / F.lit(most)).alias("parts"))
    dealt = rows.withColumn("group", group).join(F.broadcast(counts), "group")
    part = F.pmod(F.xxhash64(number), F.col("parts"))
    return cut(dealt.select("vec_id", "v", (F.shiftleft("group", 40) + part).alias("name")).groupBy("name").applyInPandas(gather, kept))


def _routed(rows: DataFrame, n: int, dim: int, shard: int) -> tuple[DataFrame, int]:
    """Every row with its cell, and the depth of the coarse tree. The tree is fitted on a sample of bounded size by hash."""
    most = max(1, min(SAMPLE, BYTES // (8 * dim)))
    depth = 0
    while (n >> depth) > shard and (min(n, most) >> (depth + 1)) >= LEAST_OF_CELL:
        depth += 1
    if not depth:
        return cut(rows.withColumn("cell", F.lit(0).cast("long"))), 0
    # twice as many as are wanted, as the hash deals unevenly and rows of one id fall together; the limit bounds the driver
    sample = rows.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, n // (2 * most)))) == 0).select("v").limit(most)
    taken = sample.toPandas()["v"]
    axes, values = coarse(np.stack(taken.to_numpy()) if len(taken) else np.zeros((0, dim)), depth)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(cell_of(vectors, axes, values))], names=["vec_id", "v", "cell"])

    return cut(rows.mapInArrow(route, T.StructType([*rows.schema.fields, T.StructField("cell", T.LongType())]))), depth


def _top_k(rows: DataFrame, n: int, k: int, every: int, dim: int) -> DataFrame:
    spark = rows.sparkSession
    shard, block = (max(1, min(most, BYTES // (8 * dim))) for most in (SHARD, BLOCK))
    routed, depth = _routed(rows.select(F.col("vec_id").cast("long").alias("vec_id"), "v"), n, dim, shard)
    # the place of a row in the written table spreads repeated rows too
    shards = _bundle(routed, F.monotonically_increasing_id(), shard, 0, True).withColumnRenamed("name", "shard")
    asked = routed.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "cell")).alias("one")).select("vec_id", "one.v", "one.cell")
    wanted = -(-n // (every * block))
    shift = max(0, depth - (wanted - 1).bit_length())
    queries = _bundle(asked, F.col("vec_id"), block, shift, False).toDF("block", "query_ids", "query_vectors")
    drop_table(routed)
    n_shards, n_blocks = shards.count(), queries.count()
    chunks = -(-n_shards // CHUNK)

    def together(frame: pd.DataFrame) -> pd.DataFrame:
        # the root comes first, so its box is the first dim numbers
        each = {c: b"".join(x[: 8 * dim] for x in frame[c]) for c in ("low", "high")}
        return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "shards": [frame["shard"].to_numpy(np.int64).tobytes()], "low": [each["low"]], "high": [each["high"]]})

    boxes = shards.select("shard", "low", "high", F.pmod(F.xxhash64("shard"), F.lit(max(1, chunks))).alias("chunk"))
    boxes = boxes.select("chunk", "shard", *(F.substring(c, 1, 8 * dim).alias(c) for c in ("low", "high")))
    boxes = cut(boxes.groupBy("chunk").applyInPandas(together, "chunk long, shards binary, low binary, high binary"))

    def least_of(ids: np.ndarray, kth) -> np.ndarray:
        known = dict(kth) if kth is not None else {}
        return np.array([known.get(i, -np.inf) for i in ids.tolist()], np.longdouble)

    def open_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, query_ids, vectors, kth, names, low, high in zip(*(batch.column(c).to_pylist() for c in ("block", "query_ids", "query_vectors", "kth", "shards", "low", "high")), strict=True):
                q, names = np.frombuffer(vectors).reshape(-1, dim), np.frombuffer(names, np.int64)
                # in doubles a bound beyond 2**53 may round; a little slack keeps it a bound
                bounds = np.maximum(q, 0) @ np.frombuffer(high).reshape(-1, dim).T + np.minimum(q, 0) @ np.frombuffer(low).reshape(-1, dim).T
                slack = np.where(np.abs(bounds) < EXACT / 2, 0.0, np.inf)
                some = (bounds + slack >= least_of(np.frombuffer(query_ids, np.int64), kth)[:, None]).any(0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(some.sum(), name)), pa.array(names[some]), pa.array(bounds.mean(0)[some])], names=["block", "shard", "promise"])

    def meet(key, asking: pd.DataFrame, one: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(one):
            low, high, points = (np.frombuffer(one[c].iloc[0]).reshape(-1, dim) for c in ("low", "high", "vectors"))
            tree = Tree(np.frombuffer(one["nodes"].iloc[0], np.int64).reshape(-1, 4), low, high, points, np.frombuffer(one["ids"].iloc[0], np.int64))
            for name, query_ids, vectors, kth in zip(*(asking[c] for c in ("block", "query_ids", "query_vectors", "kth")), strict=True):
                q_ids = np.frombuffer(query_ids, np.int64)
                row, vec, score = search(np.frombuffer(vectors).reshape(-1, dim), q_ids, least_of(q_ids, kth), tree, k)
                out.append(pd.DataFrame({"block": name, "query_id": q_ids[row], "vec_id": vec, "score": score.astype(np.int64)}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("block", "query_id", "vec_id", "score")})

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(20_000, n_shards * -(-n_blocks // TOGETHER)))
    best = done = None
    most = 1
    while n_blocks:
        kth = F.lit(None).cast("map<long,long>")
        asking = queries.withColumn("kth", kth)
        if best is not None:
            known = best.where(F.col("rank") == k).groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("query_id", "score"))).alias("kth"))
            asking = queries.join(known, "block", "left")
        pairs = asking.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long")))).join(boxes, "chunk")
        still = pairs.mapInArrow(open_shards, "block long, shard long, promise double")
        if done is not None:
            still = still.join(done, ["block", "shard"], "left_anti")
        turn = F.row_number().over(Window.partitionBy("block").orderBy(F.col("promise").desc(), "shard"))
        now = cut(still.withColumn("turn", turn).where(F.col("turn") <= most).select("block", "shard"))
        if now.isEmpty():
            break
        here = now.withColumn("slice", F.floor((F.row_number().over(Window.partitionBy("shard").orderBy("block")) - 1) / TOGETHER))
        left = here.join(asking, "block").repartition(width, "shard", "slice")
        right = here.select(F.col("shard").alias("of"), F.col("slice").alias("part")).distinct().join(shards, F.col("of") == F.col("shard")).drop("shard").repartition(width, "of", "part")
        found = left.groupBy("shard", "slice").cogroup(right.groupBy("of", "part")).applyInPandas(meet, "block long, query_id long, vec_id long, score long")
        before, best = best, cut((found if best is None else found.unionByName(best.drop("rank"))).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
        if before is not None:
            drop_table(before)
        done = now if done is None else done.union(now)
        most *= 4
    if best is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return best.select("query_id", "rank", "vec_id", "score")
