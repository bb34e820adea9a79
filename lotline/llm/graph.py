"""Connected components of links, as joins and sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lotline.llm.common import stored


def _least(pairs: DataFrame) -> DataFrame:
    """``u, m``: the least of every ``u`` and its neighbours; stored, so that a hot ``u`` can be split in the join."""
    return stored(pairs.groupBy("u").agg(F.least("u", F.min("v")).alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """``id, root`` of every id in ``edges`` (``a, b``); the root is the least id that links reach.

    Alternates large-star and small-star steps until nothing changes: a handful of
    rounds, each a few shuffles of the edges. Neighbours of an id are never gathered.
    """
    ends = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v")
    pairs = stored(ends.distinct(), "pairs")
    mark = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    while mark[0]:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stored(large.distinct(), "pairs")
        least = _least(large)
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = stored(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "pairs")
        before, mark = mark, pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
    stars = pairs.select(F.col("u").alias("id"), F.col("v").alias("root"))
    return stars.unionByName(stars.select(F.col("root").alias("id"), "root").distinct())


def local_roots(linked: np.ndarray) -> np.ndarray:
    """Least member of the component of each row of a square matrix of links."""
    roots = np.arange(len(linked))
    rows, cols = np.nonzero(linked)
    while len(rows):
        before = roots.copy()
        np.minimum.at(roots, rows, roots[cols])
        np.minimum.at(roots, cols, roots[rows])
        roots = roots[roots]
        if (roots == before).all():
            break
    return roots


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Runs of rows with equal first ``keys`` columns (64-bit integers) of batches sorted by them.

    Yields tables of whole groups, many small ones together.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [np.asarray(batch.column(i)) for i in range(keys)]
        last = np.logical_and.reduce([column == column[-1] for column in columns])
        start = int(np.argmax(last))  # the last group may go on in the next batch
        if held:
            end = held[-1]
            same = all(np.asarray(end.column(i))[-1] == columns[i][0] for i in range(keys))
            if same and start == 0:
                held.append(batch)
                continue
            if not same:
                yield pa.Table.from_batches(held)
                held = []
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
        elif held:
            yield pa.Table.from_batches(held)
        held = [batch.slice(start)]
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(table: pa.Table, keys: int) -> tuple[np.ndarray, np.ndarray]:
    """First row and number of rows of each group of such a table."""
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for i in range(keys):
        column = table.column(i).to_numpy()
        change[1:] |= column[1:] != column[:-1]
    starts = np.flatnonzero(change)
    return starts, np.diff(np.append(starts, table.num_rows))
