"""Ordered indices and top-k without one task that holds a whole table or a hot group."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from paceline.session import materialized


def dense_index(df: DataFrame, order_col: str, name: str, ranges: int | None = None) -> DataFrame:
    """Add the 0-based position of each row by a unique column, of any type that orders.

    Rows are dealt to sorted ranges once, numbered inside their range and written; the rows of each range that was written
    shift the numbers of those behind it. What follows reads the written rows: neither the input nor a window runs again.
    `ranges` is as many as the session has shuffle partitions where it is not given.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = df.repartitionByRange(ranges, order_col).sortWithinPartitions(order_col)
    # The lower half of the generated id counts the rows of a task; a task that runs again numbers alike.
    within = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    written = materialized(ordered.withColumns({"_range": F.spark_partition_id(), "_within": within}), "positions")
    sizes = {row["_range"]: row["count"] for row in written.groupBy("_range").count().collect()}  # one row per range
    before = [0, *accumulate(sizes.get(i, 0) for i in range(ranges - 1))]
    position = F.get(F.array(*[F.lit(n).cast("bigint") for n in before]), F.col("_range")) + F.col("_within")
    return written.withColumn(name, position).drop("_range", "_within")


def first_rows(df: DataFrame, n: int, keys: Sequence[Column], cuts: int = 64, small: int = 4096) -> DataFrame:
    """The first `n` rows by `keys`, ascending, in no order and partitioned as `df` is; together the keys must tell rows apart.

    The n-th key is found by a histogram that is refined: so many keys of smallest hash cut the rows into intervals, one
    pass counts these, and the interval that holds the n-th key is cut in turn, until it has `small` rows at most. The rows
    up to that key are then a filter. Only the keys are written and read again; no task holds n rows.
    """
    key = F.struct(*[column.alias(f"k{i}") for i, column in enumerate(keys)])
    part = materialized(df.select(key.alias("key")), "order-keys")
    fields = part.schema["key"].dataType.fields
    size, rank = part.count(), n
    if n >= size:
        return df
    if n <= 0:
        return df.limit(0)

    def literal(values: Sequence) -> Column:
        return F.struct(*[F.lit(value).cast(field.dataType).alias(field.name) for value, field in zip(values, fields)])

    while size > small:
        sample = part.orderBy(F.xxhash64("key")).limit(cuts).distinct().orderBy("key").collect()
        bounds = [literal(row["key"]) for row in sample]
        below = F.size(F.filter(F.array(*bounds), lambda bound: bound < F.col("key")))
        counts = dict(sorted(tuple(row) for row in part.groupBy(below.alias("below")).count().collect()))  # one row per interval
        for interval, count in counts.items():
            if rank <= count:
                break
            rank -= count
        if count == size:
            raise ValueError("keys that order rows must tell them apart")
        size = count
        if interval:
            part = part.filter(F.col("key") > bounds[interval - 1])
        if interval < len(bounds):
            part = part.filter(F.col("key") <= bounds[interval])
    ordered = part.orderBy("key").limit(rank + 1).collect()
    last = ordered[rank - 1]["key"]
    if ordered[rank:] == [(last,)]:
        raise ValueError("keys that order rows must tell them apart")
    return df.filter(key <= literal(last))


def running_sums(
    df: DataFrame, key: Sequence[str], order_col: str, values: Sequence[str], width: int = 1024, prefix: str = "before_"
) -> DataFrame:
    """Add `before_<value>`: the sum of each value over the key's rows with a smaller `order_col`, a whole number unique in the key.

    A scan in two levels: rows are summed inside blocks of `width` consecutive numbers, blocks are summed up and scanned,
    and each block's carry joins its rows. No task orders more than the rows of a block or the blocks of a key.
    `df` is written once, since both levels read it.
    """
    block = "_block"
    rows = materialized(df.withColumn(block, F.col(order_col) - F.pmod(F.col(order_col), F.lit(width))), "running-sums")
    totals = rows.groupBy(*key, block).agg(*[F.sum(value).alias(value) for value in values])
    earlier_blocks = W.partitionBy(*key).orderBy(block).rowsBetween(W.unboundedPreceding, -1)
    carries = totals.select(*key, block, *[F.sum(value).over(earlier_blocks).alias(f"_carry_{value}") for value in values])
    earlier_rows = W.partitionBy(*key, block).orderBy(order_col).rowsBetween(W.unboundedPreceding, -1)
    inside = rows.select("*", *[F.sum(value).over(earlier_rows).alias(f"_inside_{value}") for value in values])
    # Every block has a carry, so an inner join keeps all rows.
    joined = inside.join(carries, [*key, block])
    zero = F.lit(0)
    summed = {f"{prefix}{v}": F.coalesce(f"_carry_{v}", zero) + F.coalesce(f"_inside_{v}", zero) for v in values}
    return joined.select(*df.columns, *[value.alias(name) for name, value in summed.items()])


def top_k_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int | Column, name: str, salt_on: str, salts: int = 1024
) -> DataFrame:
    """Rows ranked 1..k inside each group, the rank in column `name`.

    Each group is first ranked in `salts` parts and cut to k rows per part, so the second
    ranking sees at most `k * salts` rows of a group, however large the group is. For a small k
    the engine also cuts every part before the first shuffle.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt_on), F.lit(salts)))
    first = W.partitionBy(*group, "_salt").orderBy(*order)
    second = W.partitionBy(*group).orderBy(*order)
    return (
        salted.withColumn("_part_rank", F.row_number().over(first))
        .filter(F.col("_part_rank") <= k)
        .drop("_part_rank", "_salt")
        .withColumn(name, F.row_number().over(second))
        .filter(F.col(name) <= k)
    )


def block_carries(
    df: DataFrame, key: Sequence[str], block: str, minima: Mapping[str, Column], maxima: Mapping[str, Column]
) -> DataFrame:
    """Per (key, block): the extremes of the key's earlier blocks as `carry_<name>`, and whether there
    are earlier (`carry_any`) and later (`carry_more`) ones.

    Blocks are summed up first, with partial aggregates, so only one row per block is ordered.
    """
    totals = df.groupBy(*key, block).agg(
        F.count("*").alias("_rows"),
        *[F.min(value).alias(name) for name, value in minima.items()],
        *[F.max(value).alias(name) for name, value in maxima.items()],
    )
    blocks = W.partitionBy(*key).orderBy(block)
    before = blocks.rowsBetween(W.unboundedPreceding, -1)
    return totals.select(
        *key,
        block,
        *[F.min(name).over(before).alias(f"carry_{name}") for name in minima],
        *[F.max(name).over(before).alias(f"carry_{name}") for name in maxima],
        F.lag(block).over(blocks).isNotNull().alias("carry_any"),
        F.lead(block).over(blocks).isNotNull().alias("carry_more"),
    )


def running_extremes(
    df: DataFrame,
    key: Sequence[str],
    order_col: str,
    block: str,
    minima: Mapping[str, Column],
    maxima: Mapping[str, Column],
    last: str,
) -> DataFrame:
    """Running minima and maxima along `order_col` of each key, and whether a row is its key's last.

    Rows are scanned inside their block, which holds a bounded number of a key's rows, and then
    meet the carry columns of `block_carries`, which `df` must have.
    """
    rows = W.partitionBy(*key, block).orderBy(order_col)
    so_far = rows.rowsBetween(W.unboundedPreceding, W.currentRow)
    return df.select(
        *[name for name in df.columns if not name.startswith("carry_")],
        *[F.least(F.min(value).over(so_far), F.col(f"carry_{name}")).alias(name) for name, value in minima.items()],
        *[F.greatest(F.max(value).over(so_far), F.col(f"carry_{name}")).alias(name) for name, value in maxima.items()],
        (F.lead(order_col).over(rows).isNull() & ~F.coalesce("carry_more", F.lit(False))).alias(last),
    )
