"""Near-duplicate embeddings by a forest of random-projection trees.

Every tree splits the vectors of a label again and again by random directions at the
mean of what the node holds; vectors near the cut go to both sides, as far as a pair at the
least cosine is likely to lie apart. Nodes are split level by level for the whole table, from
sums over all of their rows, until they are small or too dense to split. Vectors in
one leaf are compared; a leaf that stays large is compared in blocks. A pair that
meets in several leaves counts in the first of them. Equal vectors count as one class.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lotline.llm.common import batch_task, stored
from lotline.llm.graph import components, group_bounds, local_roots, sorted_groups
from lotline.llm.ngram_join import blocked

COSINE = 0.98
TREES = 4
LEAF = 1024
DIRECTIONS = 4  # cuts of a node per level
LEVELS = 12
# Half-width of the overlap of both sides, in the size of the difference of a pair at COSINE per dimension.
OVERLAP = 1.6


def margin(dim: Column, cosine: float = COSINE) -> Column:
    return F.lit(OVERLAP * (2 - 2 * cosine) ** 0.5) / F.sqrt(dim)


def unit(vectors: list[np.ndarray]) -> np.ndarray:
    """Vectors of one length as unit vectors in double precision."""
    x = np.array(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column: pa.Array) -> list[np.ndarray]:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = np.asarray(column.offsets), column.values.to_numpy(zero_copy_only=False)
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:])]


def project_batches(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Adds ``p``: the projections on the directions of the tree at this level."""
    directions: dict[tuple[int, int], np.ndarray] = {}
    for batch in batches:
        trees, vectors = np.asarray(batch.column("tree")), _vectors(batch.column("vec"))
        dims = np.array([len(v) for v in vectors], dtype=np.int64)
        out = np.zeros((len(vectors), DIRECTIONS))
        for tree, dim in set(zip(trees.tolist(), dims.tolist())):
            if (tree, dim) not in directions:
                drawn = np.random.default_rng([tree, level, dim]).standard_normal((dim, DIRECTIONS))
                directions[tree, dim] = drawn / np.sqrt((drawn**2).sum(axis=0))
            rows = np.flatnonzero((trees == tree) & (dims == dim))
            out[rows] = unit([vectors[i] for i in rows]) @ directions[tree, dim]
        ends = pa.array(np.arange(0, out.size + 1, DIRECTIONS, dtype=np.int32))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.ListArray.from_arrays(ends, pa.array(out.reshape(-1)))], names=[*batch.schema.names, "p"]
        )


def compare_batches(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Per vector, the rows of the vectors it is linked to, and links that connect those of a group.

    Rows are ``node, low, high, block, key, size, vec, leaves``, sorted by the first three.
    A row of the result has ``n_links`` or an end ``b``.
    """
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n_links", pa.int64())])
    for table in sorted_groups(batches, 3):
        for start, count in zip(*group_bounds(table, 3)):
            if count < 2:
                continue
            group = table.slice(start, count)
            node = group.column("node")[0].as_py()
            keys, blocks, sizes = (group.column(c).to_numpy() for c in ("key", "block", "size"))
            x = unit(_vectors(group.column("vec")))
            linked = x @ x.T >= cosine
            np.fill_diagonal(linked, False)
            if group.column("low")[0] != group.column("high")[0]:
                linked &= blocks[:, None] != blocks
            if not linked.any():
                continue
            roots = local_roots(linked)
            # A pair counts in the least leaf that holds both.
            shared: dict[int, list[int]] = {}
            for i, leaves in enumerate(group.column("leaves").to_pylist()):
                for leaf in leaves:
                    if leaf < node:
                        shared.setdefault(leaf, []).append(i)
            for rows in shared.values():
                if len(rows) > 1:
                    linked[np.ix_(rows, rows)] = False
            hit, moved = np.flatnonzero(linked.any(axis=1)), np.flatnonzero(roots != np.arange(count))
            none = [None]
            columns = [
                [*keys[hit].tolist(), *keys[moved].tolist()],
                [*none * len(hit), *keys[roots[moved]].tolist()],
                [*(linked[hit] @ sizes).tolist(), *none * len(moved)],
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def leaves_of(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """``node, n, key`` of every class (``key, label, vec``) in every leaf that holds it; ``n`` are its rows."""
    tree = F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")
    rows = classes.select("key", "vec", "label", tree)
    node = F.xxhash64("tree", "label", F.size("vec"))
    rows = rows.select("key", "vec", "tree", node.alias("node"))
    names = ["key", "vec", "tree", "node"]
    leaves = None
    for level in range(LEVELS + 1):
        counts = stored(rows.groupBy("node").agg(F.count("*").alias("n")), "nodes")
        sized = rows.join(counts, "node")
        small = F.col("n") <= LEAF
        done = sized.filter(small) if level < LEVELS else sized
        done = done.select("node", "n", "key")
        leaves = done if leaves is None else leaves.unionByName(done)
        if level == LEVELS or not counts.filter(~small).take(1):
            return leaves
        vec_type = classes.schema["vec"].dataType.simpleString()
        large = sized.filter(~small).select(*names, "n").mapInArrow(
            batch_task("vector_forest", "project_batches", level),
            f"key long, vec {vec_type}, tree int, node long, n long, p array<double>",
        )
        large = stored(large, "projected")
        parts = range(DIRECTIONS)
        stats = large.groupBy("node").agg(
            *(F.avg(F.col("p")[i]).alias(f"m{i}") for i in parts), *(F.stddev_pop(F.col("p")[i]).alias(f"s{i}") for i in parts)
        )
        stats = stored(stats, "cuts")
        large = large.join(stats, "node")
        width = margin(F.size("vec"), cosine)
        sides = []
        cut = F.lit(False)
        for i in parts:
            off = F.col("p")[i] - F.col(f"m{i}")
            splits = F.col(f"s{i}") > 2 * width
            cut = cut | splits
            sides.append((~splits | (off <= width), splits & (off >= -width)))

        def fits(code: Column) -> Column:
            held = F.lit(True)
            for i, (low, high) in enumerate(sides):
                held = held & F.when(F.getbit(code, F.lit(i)) == 0, low).otherwise(high)
            return held

        codes = F.filter(F.sequence(F.lit(0), F.lit(2**DIRECTIONS - 1)), fits)
        # A node that no direction cuts is a leaf, whatever its size.
        dense = large.filter(~cut).select("node", "n", "key")
        leaves = leaves.unionByName(dense)
        rows = large.filter(cut).select("key", "vec", "tree", "node", F.explode(codes).alias("code"))
        rows = rows.select("key", "vec", "tree", F.xxhash64("node", "code", F.lit(level)).alias("node"))
        rows = stored(rows, "rows")


def near_vectors(
    vectors: DataFrame,
    *,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    cosine: float = COSINE,
) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row.

    Rows are linked when their labels are equal and not NULL and the cosine of their vectors, in double
    precision, is at least ``cosine``. Vectors that are NULL, empty, zero or hold NULL or
    non-finite components link with nothing, nor do vectors of unequal length. ``n_links``
    counts the other rows linked directly, ``component_id`` is the smallest id that links
    reach, ``kept`` tells whether that is the row's own. Rows that repeat an id are vectors
    of their own. An empty table gives no rows; other columns are ignored.
    """
    rows = vectors.select(
        F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vec"), F.col(f"`{label}`").alias("label")
    )
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & F.col("vec").isNotNull() & finite & F.exists("vec", lambda x: x != 0)
    usable = F.coalesce(usable, F.lit(False))
    rows = rows.withColumn("key", F.when(usable, F.xxhash64("label", "vec")))
    rows = rows.withColumn("key2", F.when(usable, F.xxhash64("vec", "label", F.lit(1))))
    classes = rows.filter("key is not null").groupBy("key", "key2").agg(
        F.min("vec_id").alias("class_id"),
        F.count("*").alias("size"),
        F.first("label").alias("label"),
        F.first("vec").alias("vec"),
    )
    classes = stored(classes, "vectors")
    leaves = stored(leaves_of(classes, cosine), "leaves")
    lists = leaves.groupBy("key").agg(F.collect_list("node").alias("leaves"))
    known = stored(classes.select("key", "size", "vec").join(lists, "key"), "leaf-lists")
    met = leaves.filter("n > 1").join(known, "key")
    met = blocked(met, ["node"], F.ceil(F.col("n") / LEAF), F.xxhash64("key"))
    n = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.select("node", "low", "high", "block", "key", "size", "vec", "leaves")
    met = met.repartition(n, "node", "low", "high").sortWithinPartitions("node", "low", "high")
    found = met.mapInArrow(batch_task("vector_forest", "compare_batches", cosine), "a long, b long, n_links long")
    found = stored(found, "vector-links")
    counts = found.filter("n_links is not null").groupBy(F.col("a").alias("key")).agg(F.sum("n_links").alias("n_links"))
    roots = components(found.filter("b is not null").select("a", "b")).withColumnRenamed("id", "key")
    named = classes.select("key", "class_id", "size").join(counts, "key", "left").join(roots, "key", "left")
    named = named.withColumn("root", F.coalesce("root", "key"))
    least = named.groupBy("root").agg(F.min("class_id").alias("component_id"))
    links = (F.col("size") - 1 + F.coalesce("n_links", F.lit(0))).alias("n_links")
    told = stored(named.join(least, "root").select("key", links, "component_id"), "vector-groups")
    out = rows.select("vec_id", "key").join(told, "key", "left")
    out = out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    )
    return out.withColumn("kept", F.col("component_id").eqNullSafe(F.col("vec_id")))
