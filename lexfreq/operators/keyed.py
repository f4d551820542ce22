"""First row per key, upserts, top-k per group, global rank."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexfreq.session import stored

_PICK = "__pick"


def top_k_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int,
                    rank: str | None = None) -> DataFrame:
    """The first k rows of each group in the given order.

    The limit on row_number reaches the input side of the shuffle (WindowGroupLimit), so each task
    sends at most k rows per group however large the group is.
    """
    column = rank or _PICK
    picked = (df.withColumn(column, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
              .filter(F.col(column) <= k))
    return picked if rank else picked.drop(column)


def columns_per_value(column: Column, values: Sequence, prefix: str, figure: Callable[[Column], Column]) -> list[Column]:
    """One aggregate for each given value of a column, and `<prefix>other` for all other values and null."""
    known = F.coalesce(column.isin(list(values)), F.lit(False))
    return [*(F.coalesce(figure(column == v), F.lit(0)).alias(f"{prefix}{v}") for v in values),
            F.coalesce(figure(~known), F.lit(0)).alias(f"{prefix}other")]


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One whole row per key: the first in the given order."""
    return top_k_per_group(df, keys, order, 1)


def merge_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: Sequence[Column],
                 update_cols: Sequence[str] | None = None) -> DataFrame:
    """Upsert `new` into `old`, which is unique by the keys.

    Without `update_cols` a new row replaces the old one as a whole. With it, a key that exists
    keeps its other columns. `order` decides between rows of `new` that share a key: the first wins.
    """
    new = first_per_key(new, keys, order)
    rest = [c for c in old.columns if c not in keys]
    taken = rest if update_cols is None else list(update_cols)
    left = old.select(*keys, F.struct(*rest).alias("__old"))
    right = new.select(*keys, F.struct(*[F.col(c) for c in rest]).alias("__new"))
    both = left.join(right, list(keys), "full_outer")
    was, now = F.col("__old"), F.col("__new")
    merged = [
        (F.when(now.isNotNull(), now[c]).otherwise(was[c]) if update_cols is None
         else F.coalesce(now[c], was[c]) if c in taken
         else F.when(was.isNotNull(), was[c]).otherwise(now[c])).alias(c)
        for c in rest]
    return both.select(*keys, *merged).select(*old.columns)


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "rank") -> DataFrame:
    """1-based position in a total order, without moving all rows into one task.

    The rows are range-sorted and stored with their partition and their place in it, which fixes both;
    then the sizes of the partitions before it are added to the position inside a partition.
    """
    stamped = stored(df.orderBy(*order)
                     .withColumn("__at", F.monotonically_increasing_id())
                     .withColumn("__part", F.shiftright("__at", 33))
                     .withColumn("__at", F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))), "ranked")
    sizes = stamped.groupBy("__part").agg(F.count("*").alias("__n"))
    # One row per partition of the sort, so this window and the broadcast are as small as the partition count.
    before = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    return (stamped.join(F.broadcast(offsets), "__part")
            .withColumn(rank, (F.col("__before") + F.col("__at") + 1).cast("long"))
            .drop("__part", "__at", "__before"))
