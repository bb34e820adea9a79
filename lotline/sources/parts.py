"""A table kept as parts that a list names.

The rows of a part share a slot, such as a business date or a bucket of keys. Parts are written
aside; the list that names the live ones is numbered and never overwritten: a change writes
the next number by one rename, which fails when another writer was first. So readers see a change
whole or not at all, a failed change leaves the table as it was, and no change is lost.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable, Collection
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from lotline.sources.snapshots import _files

# Attempts of a change that other writers overtake.
TRIES = 5


@dataclass(frozen=True)
class Parts:
    """One state of the table: ``live`` holds slot and folder of each part, ``done`` the last batch of each source."""

    number: int = 0
    live: tuple[tuple[str, str], ...] = ()
    retired: tuple[str, ...] = ()
    done: dict[str, int] = field(default_factory=dict)
    schema: str = ""

    def slots(self) -> dict[str, list[str]]:
        """Folders of each slot."""
        found: dict[str, list[str]] = {}
        for slot, folder in self.live:
            found.setdefault(slot, []).append(folder)
        return found


def _numbers(spark: SparkSession, path: str) -> list[int]:
    context, hadoop = _files(spark, path)
    place = hadoop.Path(path)
    if not context.util().exists(place):
        return []
    names = (status.getPath().getName() for status in context.util().listStatus(place))
    return sorted(int(m[1]) for m in (re.fullmatch(r"parts-(\d+)", name) for name in names) if m)


def _list(path: str, number: int) -> str:
    return f"{path}/parts-{number}"


def parts_of(spark: SparkSession, path: str) -> Parts:
    """The newest state; one without parts where nothing was written."""
    numbers = _numbers(spark, path)
    if not numbers:
        return Parts()
    context, hadoop = _files(spark, path)
    stream = context.open(hadoop.Path(_list(path, numbers[-1])))
    try:
        told = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Parts(**told | {"live": tuple(map(tuple, told["live"])), "retired": tuple(told["retired"])})


def _rename(spark: SparkSession, path: str, draft: str, target: str) -> None:
    """Rename a file; raises when the target is there."""
    context, hadoop = _files(spark, path)
    none = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context.rename(hadoop.Path(draft), hadoop.Path(target), none)


def _publish(spark: SparkSession, path: str, state: Parts) -> bool:
    """Write the list of ``state``; False when its number is taken."""
    context, hadoop = _files(spark, path)
    options = spark._jvm.org.apache.hadoop.fs.Options
    create = spark.sparkContext._gateway.new_array(options.CreateOpts, 1)
    create[0] = options.CreateOpts.createParent()
    draft = f"{path}/.{uuid.uuid4().hex}"
    stream = context.create(hadoop.Path(draft), spark._jvm.java.util.EnumSet.of(hadoop.CreateFlag.CREATE), create)
    stream.write(bytearray(json.dumps(asdict(state)), "utf-8"))
    stream.close()
    try:
        _rename(spark, path, draft, _list(path, state.number))
    except Py4JJavaError as error:
        context.delete(hadoop.Path(draft), False)
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def _change(spark: SparkSession, path: str, step: Callable[[Parts], Parts | None]) -> Parts:
    """Publish what ``step`` makes of the newest state; nothing when that is None.

    Folders that the last replacement retired are removed by the next, so readers that have begun finish.
    """
    for _ in range(TRIES):
        state = parts_of(spark, path)
        after = step(state)
        if after is None:
            return state
        gone = {folder for _, folder in state.live} - {folder for _, folder in after.live}
        after = replace(after, number=state.number + 1, retired=tuple(sorted(gone)) or state.retired)
        if not _publish(spark, path, after):
            continue
        context, hadoop = _files(spark, path)
        for folder in state.retired if gone else ():
            context.delete(hadoop.Path(f"{path}/{folder}"), True)
        for number in _numbers(spark, path):
            if number < after.number - 1:
                context.delete(hadoop.Path(_list(path, number)), False)
        return after
    raise RuntimeError(f"{path} is being changed by others")


def _write(df: DataFrame, path: str, slot: str) -> tuple[tuple[str, str], ...]:
    """Write one part per value of the column ``slot``; slots and folders."""
    folder = f"data-{uuid.uuid4().hex}"
    parts = df.withColumn("_slot", F.coalesce(F.col(slot).cast("string"), F.lit("none")))
    parts.hint("rebalance", "_slot").write.partitionBy("_slot").parquet(f"{path}/{folder}")
    context, hadoop = _files(df.sparkSession, path)
    names = (status.getPath().getName() for status in context.util().listStatus(hadoop.Path(f"{path}/{folder}")))
    return tuple((name[len("_slot=") :], f"{folder}/{name}") for name in sorted(names) if name.startswith("_slot="))


def _read(spark: SparkSession, path: str, folders: Collection[str], schema: str) -> DataFrame:
    kind = StructType.fromJson(json.loads(schema))
    if not folders:
        return spark.createDataFrame([], kind)
    return spark.read.schema(kind).parquet(*(f"{path}/{folder}" for folder in folders))


def read_parts(spark: SparkSession, path: str, wanted: Callable[[str], bool] = lambda slot: True) -> DataFrame | None:
    """One scan over the live parts whose slot is wanted; None where nothing was written."""
    state = parts_of(spark, path)
    if not state.schema:
        return None
    return _read(spark, path, [folder for slot, folder in state.live if wanted(slot)], state.schema)


def append_batch(df: DataFrame, path: str, slot: str, source: str, batch: int) -> Parts:
    """Add the rows of a batch; a batch of ``source`` that is in already is not added again."""
    spark = df.sparkSession
    if (state := parts_of(spark, path)).done.get(source, -1) >= batch:
        return state
    added, schema = _write(df, path, slot), df.schema.json()

    def step(now: Parts) -> Parts | None:
        if now.done.get(source, -1) >= batch:
            return None
        return replace(now, live=now.live + added, done=now.done | {source: batch}, schema=schema)

    return _change(spark, path, step)


def fold_slot(
    spark: SparkSession, path: str, state: Parts, slot: str, column: str, merge: Callable[[DataFrame], DataFrame]
) -> Parts:
    """Replace the parts of one slot in ``state`` by ``merge`` of their rows; other slots are not read.

    Parts that were added since stay; nothing is done when some have been folded by others.
    """
    mine = state.slots().get(slot, [])
    if len(mine) < 2:
        return state
    added = _write(merge(_read(spark, path, mine, state.schema)), path, column)

    def step(now: Parts) -> Parts | None:
        if not set(mine) <= {folder for _, folder in now.live}:
            return None
        return replace(now, live=tuple(p for p in now.live if p[1] not in mine) + added)

    return _change(spark, path, step)


def replace_keys(
    rows: DataFrame, changed: DataFrame | None, path: str, slot: str, source: str, batch: int
) -> Parts:
    """Put ``rows`` in the place of all stored rows whose keys are in ``changed``; of all rows when that is None.

    ``changed`` holds distinct keys and the column ``slot``, which must follow from the keys and is in ``rows`` too. Only
    parts of those slots are read and written. A batch that is in already is not stored again.
    """
    spark = rows.sparkSession
    state = parts_of(spark, path)
    if state.done.get(source, -1) >= batch:
        return state
    touched = None
    if changed is not None:
        # As many values as there are slots.
        touched = {str(row[0]) for row in changed.select(slot).distinct().collect()}
        mine = [folder for one, folder in state.live if one in touched]
        old = _read(spark, path, mine, state.schema or rows.schema.json())
        same = [F.col(f"old.`{key}`").eqNullSafe(F.col(f"new.`{key}`")) for key in changed.columns]
        rows = old.alias("old").join(changed.alias("new"), same, "left_anti").unionByName(rows)
    added, schema = _write(rows, path, slot), rows.schema.json()

    def step(now: Parts) -> Parts | None:
        if now.done.get(source, -1) >= batch:
            return None
        if touched is None:
            return replace(now, live=added, done=now.done | {source: batch}, schema=schema)
        if [p for p in now.live if p[0] in touched] != [p for p in state.live if p[0] in touched]:
            raise RuntimeError(f"{path} was changed by others; the batch must be repeated")
        kept = tuple(p for p in now.live if p[0] not in touched)
        return replace(now, live=kept + added, done=now.done | {source: batch}, schema=schema)

    return _change(spark, path, step)
