"""Embedding near-dedup: Euclidean p-stable hashing of normalised vectors, then exact cosines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskgraph.llm.common import components, cut, drop_table, pick
from riskgraph.llm.meet import filter_of, in_filter, meetings, met

#: Tables, projections a table, and width of a projection's steps. Unit vectors of cosine 0.98 are 0.2 apart, so one step
#: agrees with probability 0.84, a table with 0.35, and no table of the 20 with 0.0002.
TABLES, PROJECTIONS, WIDTH = 20, 6, 1.0
#: Orthogonal directions of a sketch, and steps from 0 to 1 in each; a sketch is as many signed bytes.
SKETCH, STEPS = 8, 127
#: Pairs looked at together.
BLOCK = 1 << 20


def projections(dim: int, tables: int, each: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Gaussian directions and uniform offsets; the same in every task."""
    draw = np.random.Generator(np.random.PCG64([seed, dim]))
    return draw.standard_normal((dim, tables * each)), draw.uniform(0, 1, tables * each)


def signatures(unit: np.ndarray, tables: int, each: int, width: float) -> np.ndarray:
    """A 64-bit bucket key of every vector in every table."""
    directions, offsets = projections(unit.shape[1], tables, each)
    steps = np.floor(unit @ directions / width + offsets).astype(np.int64).astype(np.uint64).reshape(len(unit), tables, each)
    key = np.zeros((len(unit), tables), np.uint64)
    for i in range(each):
        key = (key ^ steps[:, :, i]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def sketches(unit: np.ndarray, seed: int = 11) -> np.ndarray:
    """The vectors in a few orthogonal directions, in steps: a projection, so no two are further apart in it than they are."""
    dim = unit.shape[1]
    axes = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, min(dim, SKETCH))))[0]
    out = np.zeros((len(unit), SKETCH), np.int8)
    out[:, : axes.shape[1]] = np.rint(np.clip(unit @ axes, -1, 1) * STEPS)
    return out


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors with a largest component of 1, and their lengths; sums of squares neither overflow nor vanish."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x, np.sqrt((x * x).sum(1))


def stacked(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and matrix of the vectors of each dimension in a column of lists."""
    ends = np.asarray(column.offsets)
    values = column.values.to_numpy(zero_copy_only=False)
    dims = np.diff(ends)
    for dim in np.unique(dims).tolist():
        rows = np.flatnonzero(dims == dim)
        yield rows, values[ends[:-1][rows][:, None] + np.arange(dim)]


def near_duplicates(df: DataFrame, threshold: float = 0.98, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", tables: int = TABLES, each: int = PROJECTIONS, width: float = WIDTH) -> DataFrame:
    """vec_id, n_links, component_id and kept for every row of df.

    Vectors of one label link when their cosine, in double precision, is at least threshold, if they share a bucket in
    some table. n_links: other rows linked directly; component_id: the least vec_id reachable, null only if all reached are;
    kept: that is vec_id itself. A null label or vector, a zero vector and one with null or non-finite components link with
    nothing; vectors of other dimension don't meet. Rows are vectors of their own, also those of one vec_id or of none;
    repeated rows link with each other. Other columns are left out; an empty table gives an empty one.

    Equal vectors of a label are one class. Only a class's number and an eight-byte sketch go to its bucket in each table; those
    with no neighbour there, as far as sketches tell, are done with. The rest of a bucket is a family named by its least
    member, so that vectors that share several buckets are mostly one family, and meets once more with whole vectors. A pair
    counts only in the first family that both share. Of the links of a task only a spanning forest leaves it.
    """
    rows = pick(df, vec_id, embedding, label).toDF("vec_id", "embedding", "label")
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine & F.col("label").isNotNull(), F.lit(False)))
    halves = (F.lpad(F.hex(F.xxhash64(F.lit(k), F.col("label").cast("string"), "embedding")), 16, "0") for k in (1, 2))
    keyed = rows.withColumn("class", F.when(F.col("fine"), F.unhex(F.concat(*halves))))
    each_row = cut(keyed.select("vec_id", "class"))
    classes = each_row.where("class is not null").groupBy("class").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    source = keyed.where("fine").select("class", F.xxhash64(F.col("label").cast("string")).alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    # a sketch's steps are each half a step off at most
    apart = np.sqrt(2 - 2 * threshold) * STEPS + np.sqrt(SKETCH) + 0.01

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            keys = batch.column(0).to_pylist()
            new = [i for i, key in enumerate(keys) if not (key in seen or seen.add(key))]
            batch = batch.take(pa.array(new, pa.int64()))
            labels = batch.column(1).to_numpy().view(np.uint64)
            ids = np.array([int.from_bytes(keys[i][:8], "little", signed=True) for i in new], np.int64)
            for at, x in stacked(batch.column(2)):
                x, norm = scaled(x)
                bucket = signatures(x / norm[:, None], tables, each, width) + ((labels[at] + np.uint64(x.shape[1])) * np.uint64(0xD6E8FEB86659FD93))[:, None]
                bucket += np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                sketch = sketches(x / norm[:, None]).view(np.int64).ravel()
                yield pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64).ravel()), pa.array(np.repeat(ids[at], tables)), pa.array(np.repeat(sketch, tables))], names=schema.names)

    schema = T.StructType([T.StructField(c, T.LongType()) for c in ("family", "node", "sketch")])
    dealt = source.mapInArrow(hashed, schema)
    member = T.StructType(schema.fields[:2])

    def close(table: pa.Table) -> pa.Table:
        """The members of each meeting that have a neighbour there, as far as sketches tell."""
        sketch = table["sketch"].to_numpy().view(np.int8).reshape(-1, SKETCH).astype(np.float32)
        some = np.zeros(len(sketch), bool)
        for at, block in meetings(table, np.zeros(len(sketch), np.int8)):
            x = sketch[at]
            square, step = (x * x).sum(1), max(1, BLOCK // len(at))
            for a in range(0, len(x), step):
                near = square[a : a + step, None] + square[None] - 2 * (x[a : a + step] @ x.T) <= apart * apart
                near[np.arange(len(near)), np.arange(a, a + len(near))] = False
                if block is not None:
                    near &= block[a : a + step, None] != block[None]
                some[at[a : a + step]] |= near.any(1)
        return table.select(member.names).filter(pa.array(some))

    alive = cut(met(dealt, F.lit(24)).groupBy("task").applyInArrow(close, member).distinct())
    first = alive.groupBy("family").agg(F.min("node").alias("name"))
    named = alive.join(first, "family").select(F.col("name").alias("family"), "node").distinct()
    of_node = cut(named.groupBy("node").agg(F.sort_array(F.collect_set("family")).alias("families")))
    drop_table(alive)
    wanted = df.sparkSession.sparkContext.broadcast(filter_of(of_node.select(F.col("node").alias("member"))))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_pylist()
            ids = np.array([int.from_bytes(k[:8], "little", signed=True) for k in keys], np.int64)
            some = pa.array(in_filter(wanted.value, ids.view(np.uint64)))
            batch, ids = batch.filter(some), pa.array(ids).filter(some)
            vectors = [b""] * len(batch)
            for at, x in stacked(batch.column(2)):
                for i, v in zip(at.tolist(), x, strict=True):
                    vectors[i] = v.tobytes()
            yield pa.RecordBatch.from_arrays([ids, batch.column(0), pa.array(vectors, pa.binary())], names=whole.names)

    whole = T.StructType([T.StructField("id", T.LongType()), T.StructField("class", T.BinaryType()), T.StructField("vector", T.BinaryType())])
    vectors = source.mapInArrow(fetch, whole).groupBy("class").agg(F.max(F.struct("id", "vector")).alias("x")).join(classes, "class")
    held = of_node.join(vectors.select("class", "x.id", "x.vector", "copies"), F.col("node") == F.col("id")).drop("id", "node").withColumnRenamed("class", "node")
    held = cut(held.withColumn("family", F.explode("families")))
    reply = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType()), T.StructField("n", T.LongType())])

    def meet(table: pa.Table) -> pa.Table:
        """Of all meetings of a task: links of each class (b null), and spanning forests of them (n null)."""
        nodes, blobs, of, copies = table["node"].to_pylist(), table["vector"].to_pylist(), table["families"].to_pylist(), table["copies"].to_numpy()
        family, dims = table["family"].to_numpy(), np.array([len(b) for b in blobs], np.int64)
        links, forest = np.zeros(len(nodes), np.int64), []
        for all_at, all_block in meetings(table, dims):
            for dim in np.unique(dims[all_at]).tolist():
                at, block = all_at[dims[all_at] == dim], None if all_block is None else all_block[dims[all_at] == dim]
                x, norm = scaled(np.frombuffer(b"".join(blobs[k] for k in at.tolist())).reshape(len(at), -1))
                earlier = [[f for f in of[k] if f < family[at[0]]] for k in at.tolist()]
                most = max(map(len, earlier))
                # who has fewer families than others gets odd marks that no one shares
                marks = np.array([f + [None] * (most - len(f)) for f in earlier], object).reshape(len(at), most)
                numbers = {f: i for i, f in enumerate({f for row in earlier for f in row})}
                marks = np.array([[numbers[f] if f is not None else -1 - i for f in row] for i, row in enumerate(marks.tolist())], np.int64).reshape(len(at), most)
                tree = list(range(len(at)))

                def root(a: int, tree: list[int] = tree) -> int:
                    while tree[a] != a:
                        tree[a] = tree[tree[a]]
                        a = tree[a]
                    return a

                step = max(1, BLOCK // len(at))
                for a in range(0, len(at), step):
                    near = (x[a : a + step] @ x.T) / np.outer(norm[a : a + step], norm) >= threshold
                    if block is not None:
                        near &= block[a : a + step, None] != block[None, :]
                    p, q = np.nonzero(near)
                    p += a
                    p, q = p[p < q], q[p < q]
                    if most:
                        met_before = np.zeros(len(p), bool)
                        for i in range(most):
                            met_before |= (marks[p, i, None] == marks[q]).any(1)
                        p, q = p[~met_before], q[~met_before]
                    links[at] += np.bincount(p, copies[at[q]], len(at)).astype(np.int64) + np.bincount(q, copies[at[p]], len(at)).astype(np.int64)
                    for u, v in zip(p.tolist(), q.tolist(), strict=True):
                        u, v = root(u), root(v)
                        if u != v:
                            tree[max(u, v)] = min(u, v)
                            forest.append((nodes[at[u]], nodes[at[v]]))
        linked = np.flatnonzero(links).tolist()
        a = [nodes[k] for k in linked] + [f[0] for f in forest]
        b = [None] * len(linked) + [f[1] for f in forest]
        return pa.Table.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(links[linked].tolist() + [None] * len(forest), pa.int64())], names=reply.names)

    found = cut(met(held, F.length("vector")).groupBy("task").applyInArrow(meet, reply))
    drop_table(held)
    counts = found.where("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("links"))
    joined = components(found.where("b is not null").select("a", "b")).withColumnRenamed("node", "class")
    of = classes.join(counts, "class", "left").join(joined, "class", "left").withColumn("component", F.coalesce("component", "class"))
    named = of.join(of.groupBy("component").agg(F.min("least").alias("component_id")), "component")
    named = named.select("class", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id")
    out = each_row.join(named, "class", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("class").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
