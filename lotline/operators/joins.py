"""Join helpers.

No join here carries a broadcast hint for data of unknown size: Spark compares
the size of a side with ``spark.sql.autoBroadcastJoinThreshold``, at planning and
again at run time, and otherwise shuffles and lets adaptive execution split hot
partitions. ``salted_join`` spreads hot keys explicitly where that is not enough.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

# A key above this share of the rows is hot; there are fewer than 1/share such keys.
HOT_SHARE = 0.01

# Items that the summary behind ``hot_keys`` tracks per possible hot key: its error is a quarter of the share at most.
TRACKED = 16
MOST_TRACKED = 1_000_000

# Tasks that ``spread`` deals rows out to, per task of other shuffles.
SPREAD = 4

# Bits of the set that a window keeps of its keys: 16 MB, in words of 64 bits, whatever the number of keys.
BITS = 1 << 27


def _key_hash(df: DataFrame, keys: Sequence[str]) -> Column:
    """Hash of the keys, NULL where one is NULL; whole numbers of any width hash alike."""
    whole = {"tinyint", "smallint", "int"}
    types = dict(df.select(*keys).dtypes)
    plain = [F.col(key).cast("bigint") if types[key] in whole else F.col(key) for key in keys]
    missing = reduce(or_, (F.col(key).isNull() for key in keys))
    return F.when(~missing, F.xxhash64(*plain))


def spread(df: DataFrame, keys: Sequence[str], times: int = SPREAD) -> DataFrame:
    """``df`` dealt out by ``keys`` to ``times`` as many tasks as other shuffles, which are not merged at run time.

    For steps that hold tables of their rows in memory; joins and groups by these keys need no further shuffle.
    """
    return df.repartition(times * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


class Window:
    """Rows of a short period or selection that a report joins to whole tables.

    A set of bits, one of ``BITS`` set per key, is taken from all key sets in one pass over the
    rows, and broadcast to cut those tables in their scan stage, ahead of any shuffle. It is never larger than
    its 16 MB per key set, and as small as the keys are few. A bit may let other keys through (7 of
    100 at ten million keys), so the exact join follows.
    """

    def __init__(self, rows: DataFrame, *key_sets: Sequence[str]):
        self.rows = rows
        self.key_sets = [list(keys) for keys in key_sets]

    def _words(self, mark: str) -> DataFrame:
        """The words that hold a bit, with their number; the key sets follow one another."""
        bits = [
            F.pmod(_key_hash(self.rows, keys), F.lit(BITS)) + F.lit(i * BITS) for i, keys in enumerate(self.key_sets)
        ]
        found = self.rows.select((bits[0] if len(bits) == 1 else F.explode(F.array(*bits))).alias("_bit"))
        set_bits = F.expr("bit_or(shiftleft(1L, cast(_bit & 63 as int)))").alias(f"{mark}bits")
        return found.na.drop().groupBy(F.shiftright("_bit", 6).alias(f"{mark}word")).agg(set_bits)

    def _marked(self, facts: DataFrame, keys: Sequence[str], how: str) -> tuple[DataFrame, Column]:
        """``facts`` with the word of their bit, and the bit, NULL where there is no such word."""
        mark = "_"
        while any(name.startswith(mark) for name in facts.columns):
            mark += "_"
        bit = F.pmod(_key_hash(facts, keys), F.lit(BITS)) + F.lit(self.key_sets.index(list(keys)) * BITS)
        placed = facts.withColumn(f"{mark}bit", bit).withColumn(f"{mark}at", F.shiftright(f"{mark}bit", 6))
        words = F.broadcast(self._words(mark))
        joined = placed.join(words, F.col(f"{mark}at") == F.col(f"{mark}word"), how)
        return joined, F.expr(f"getbit({mark}bits, cast({mark}bit & 63 as int))")

    def cut(self, facts: DataFrame, keys: Sequence[str]) -> DataFrame:
        """``facts`` without most of the rows whose keys are not in the window, and without those that miss a key."""
        marked, bit = self._marked(facts, keys, "inner")
        return marked.filter(bit == 1).select(*(f"`{name}`" for name in facts.columns))

    def split(self, facts: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
        """Rows of ``facts`` whose keys may be in the window, and those whose keys are not or are missing."""
        marked, bit = self._marked(facts, keys, "left")
        names = [f"`{name}`" for name in facts.columns]
        bit = F.coalesce(bit, F.lit(0))
        return marked.filter(bit == 1).select(*names), marked.filter(bit == 0).select(*names)


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """One row per key, the smallest by ``order`` (NULL first), then by ``keep``.

    A minimum over structs combines on the map side, so a key with very many rows
    is never sorted in one task as a window would.
    """
    ranked = [*order, *(name for name in keep if name not in order)]
    return (
        df.groupBy(*keys)
        .agg(F.min(F.struct(*ranked)).alias("_first"))
        .select(*keys, *(F.col("_first")[name].alias(name) for name in keep))
    )


def require_unique(dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``dim`` by its non-NULL keys; the query fails when a key repeats, as a scalar lookup would.

    The check is part of the plan, so nothing runs ahead of the query.
    """
    rest = [name for name in dim.columns if name not in keys]
    values = F.min(F.struct(*(F.col(f"`{name}`") for name in rest)))
    rows = dim.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count("*").alias("_n"), values.alias("_v"))
    told = F.concat(F.lit(f"lookup key {tuple(keys)} is not unique: "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_n") > 1, F.raise_error(told)).otherwise(F.col("_v"))
    return rows.select(*keys, checked.alias("_v")).select(*(f"_v.{name}" if name in rest else name for name in dim.columns))


def lookup_one(fact: DataFrame, dim: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``fact`` with the columns of the one row of ``dim`` with its keys, NULL where there is none.

    The query fails when a key of ``fact`` repeats in ``dim``, as a scalar lookup would; others may repeat. ``dim`` is cut to
    the keys in use first, so a short ``fact`` never shuffles the whole of it.
    """
    rest = [name for name in dim.columns if name not in keys]
    used = Window(fact, keys).cut(dim, keys)
    found = used.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(F.struct(*(F.col(f"`{name}`") for name in rest))).alias("_v"))
    told = F.concat(F.lit(f"lookup key {tuple(keys)} is not unique: "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_n") > 1, F.raise_error(told)).otherwise(F.col("_v"))
    joined = fact.join(found, list(keys), "left").withColumn("_v", checked)
    return joined.select(*fact.columns, *(F.col("_v")[name].alias(name) for name in rest))


def lookup_merge(fact: DataFrame, dim: DataFrame, keys: Mapping[str, str]) -> DataFrame:
    """Left join on ``{fact column: lookup column}``; all lookup columns are kept.

    Keys are compared as text. Equal names appear once, repeated lookup keys
    multiply rows.
    """
    marked = {right: f"_key_{i}" for i, right in enumerate(keys.values())}
    side = dim.withColumns({mark: F.col(f"`{name}`").cast("string") for name, mark in marked.items()})
    side = side.drop(*(right for left, right in keys.items() if left == right))
    match = [F.col(f"`{left}`").cast("string") == F.col(marked[right]) for left, right in keys.items()]
    return fact.join(side, match, "left").drop(*marked.values())


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> Column:
    """Hashes of the keys that hold more than ``share`` of the rows with a key, as one array.

    One pass over the keys: every task sums up the items it sees most in a sketch of bounded size, and the sketches are
    merged. Its counts are never too low, so no hot key is missed; a key just below ``share`` may be told too.
    """
    most = -int(-1 // share)
    tracked = min(MOST_TRACKED, TRACKED * most)
    hashes = df.select(_key_hash(df, keys).alias("_key")).na.drop()
    top = hashes.agg(F.expr(f"approx_top_k(_key, {min(most, tracked)}, {tracked})").alias("top"), F.count("*").alias("n"))
    often = F.filter("top", lambda item: item["count"] > F.lit(share) * F.col("n"))
    return top.select(F.transform(often, lambda item: item["item"])).scalar()


def salted_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    salts: int = 0,
    share: float = HOT_SHARE,
) -> DataFrame:
    """Inner or left equi join that spreads the hot keys of ``left`` over ``salts`` tasks.

    Rows of a hot key, or without key, get a salt from their content and input
    partition, which a repeated task finds again and which spreads equal rows too;
    only the matching rows of ``right`` are copied once per salt. With ``salts`` below
    2 it is a plain join. ``left`` is read twice, for its hot keys (``1 / share`` at most) and for the join.
    """
    if how not in ("inner", "left"):
        raise ValueError("salted_join supports inner and left joins")
    if salts < 2:
        return left.join(right, list(keys), how)
    hot = hot_keys(left, keys, share)
    spread = F.pmod(F.xxhash64(*left.columns, F.spark_partition_id()), F.lit(salts)).cast("int")
    lone = F.coalesce(F.array_contains(hot, _key_hash(left, keys)), F.lit(True))
    copied = F.coalesce(F.array_contains(hot, _key_hash(right, keys)), F.lit(False))
    copies = F.when(copied, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    salted_left = left.withColumn("_salt", F.when(lone, spread).otherwise(0))
    joined = salted_left.join(right.withColumn("_salt", F.explode(copies)), [*keys, "_salt"], how)
    return joined.drop("_salt")
