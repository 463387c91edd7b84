"""File-server users: active ones, adding and removing, specs with built-ins, quota balances."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from platterlake.functions.numbers import capacity_bytes

#: The built-in users and whether each is a system user.
BUILT_IN = {"Syst": True, "Boot": False, "Welcome": False}
KEY = "image_id"


def full_id(grp, name):
    """`group.name`, or the bare name."""
    return F.when(F.coalesce(grp, F.lit("")) == "", name).otherwise(F.concat_ws(".", grp, name))


def active(users: DataFrame) -> DataFrame:
    return users.where("in_use")


def add_users(users: DataFrame, new: DataFrame, key: str = KEY) -> DataFrame:
    """The table with new users: the n-th takes the n-th free slot of the image, or one behind the last.

    A name that an active user has (any case) is refused: it isn't added again.
    """
    names = active(users).select(key, F.upper("name").alias("_name")).distinct()
    fresh = new.withColumn("_name", F.upper("name")).dropDuplicates([key, "_name"]).join(names, [key, "_name"], "left_anti")
    fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("_name")))
    holes = users.where("not in_use").withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy("slot"))).select(key, "_n", F.col("slot").alias("_slot"))
    size = users.groupBy(key).agg((F.max("slot") + 1).alias("_size"), F.count_if(~F.col("in_use")).alias("_holes"))
    placed = fresh.join(holes, [key, "_n"], "left").join(size, key, "left")
    behind = F.coalesce("_size", F.lit(0)) + F.col("_n") - 1 - F.coalesce("_holes", F.lit(0))
    added = placed.withColumn("slot", F.coalesce("_slot", behind).cast("long")).withColumn("in_use", F.lit(True)).drop("_n", "_name", "_slot", "_size", "_holes")
    kept = users.join(added.select(key, "slot"), [key, "slot"], "left_anti")
    return kept.unionByName(added, allowMissingColumns=True)


def remove_users(users: DataFrame, names: DataFrame, key: str = KEY) -> DataFrame:
    """Named users' slots become free; the rows stay as tombstones."""
    gone = names.select(key, F.upper("name").alias("_name")).distinct().withColumn("_gone", F.lit(True))
    marked = users.withColumn("_name", F.upper("name")).join(gone, [key, "_name"], "left")
    return marked.withColumn("in_use", F.col("in_use") & F.col("_gone").isNull()).drop("_name", "_gone")


def parse_specs(specs: DataFrame, text: str = "spec") -> DataFrame:
    """(name, is_system, quota) of `NAME[:S][:quota]`, parts in any order."""
    rest = F.slice(F.split(text, ":"), 2, 99)
    quota = F.filter(rest, lambda x: F.upper(x) != "S")
    return specs.select(F.split(text, ":")[0].alias("name"), F.exists(rest, lambda x: F.upper(x) == "S").alias("is_system"), capacity_bytes(F.get(quota, F.lit(0))).alias("quota"))


def with_built_ins(spark: SparkSession, specs: DataFrame, omit: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(users, issues): the built-in users with the specs over them; an override must keep the system flag."""
    fixed = spark.createDataFrame([(n, s) for n, s in BUILT_IN.items() if n not in omit], "name string, is_system boolean")
    own = specs.select(F.upper("name").alias("_k"), F.col("name").alias("_n"), F.col("is_system").alias("_s"), "quota")
    both = fixed.withColumn("_k", F.upper("name")).join(own, "_k", "full_outer")
    users = both.select(F.coalesce("_n", "name").alias("name"), F.coalesce("is_system", "_s").alias("is_system"), "quota")
    wrong = both.where("is_system <> _s")
    return users, wrong.select(F.lit("system-flag").alias("code"), F.col("_n").alias("path"))


def balances(users: DataFrame, writes: DataFrame, key: str = "user") -> DataFrame:
    """Balance after each write (user, seq, bytes), where all are accepted: data and map blocks are paid for."""
    data = F.ceil(F.col("bytes") / 256).cast("long")
    cost = (data + F.ceil(data / 48).cast("long")) * 256
    spent = F.sum("cost").over(Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    return writes.withColumn("cost", cost).join(users.select(key, "free_space"), key).withColumn("balance", (F.col("free_space") - spent).cast("long"))


def accepted_writes(users: DataFrame, writes: DataFrame, key: str = "user") -> DataFrame:
    """(user, seq, cost, accepted, balance) where a write that costs more than is left is refused and costs nothing.

    Each balance depends on the decision before it: a user's writes are folded in order as they come by, and nothing but
    what the user has left is held.
    """
    data = F.ceil(F.col("bytes") / 256).cast("long")
    cost = (data + F.ceil(data / 48).cast("long")) * 256
    priced = writes.select(key, F.col("seq").cast("long").alias("seq"), cost.alias("cost")).join(users.select(key, F.col("free_space").cast("long").alias("free_space")), key)
    kind = priced.schema[key].dataType.simpleString()

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user, left = object(), 0
        for batch in batches:
            accepted, balance = [], []
            for u, spent, at_first in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if u != user:
                    user, left = u, at_first
                accepted.append(spent <= left)
                left -= spent if accepted[-1] else 0
                balance.append(left)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(accepted, pa.bool_()), pa.array(balance, pa.int64())], [key, "seq", "cost", "accepted", "balance"])

    in_order = priced.where(F.col(key).isNotNull()).repartition(key).sortWithinPartitions(key, "seq", "cost")
    return in_order.mapInArrow(decide, f"`{key}` {kind}, seq bigint, cost bigint, accepted boolean, balance bigint")
