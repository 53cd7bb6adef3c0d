"""Seeded order, exact splits, few-shot sampling, batches.

A global row number never needs the rows in one task. Two ways, both over the
order columns alone (the other columns are joined once, at the end):

* an md5 order key is uniform, so its first four hex digits are 65,536 even
  buckets, whatever the input; rows are numbered within a bucket and the counts
  of the buckets (a table of fixed size) give the offsets;
* any other order is cut into range partitions by Spark's own sampling (of the
  whole order, so ties of a hot first column are cut by the next column) and
  written, as range bounds differ from run to run; the totals of the partitions,
  as many rows as there are partitions, give the offsets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.fixed import DEFAULT_SEED, TEST_FRACTION
from ..session import stored

BUCKET_HEX_DIGITS = 4


def seeded_order(df: DataFrame, key: str, seed: int = DEFAULT_SEED, name: str = "ord") -> DataFrame:
    """Deterministic pseudo-random order key md5('<seed>:<key>')."""
    return df.withColumn(name, F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))


def running_total(df: DataFrame, value: Column, order_by: Sequence[str], partition_by: Sequence[str] = (),
                  name: str = "cum") -> DataFrame:
    """Inclusive running sum of ``value`` in ``order_by`` order within
    ``partition_by`` groups; the columns together identify a row and are of any
    sortable type, none null."""
    spark = df.sparkSession
    cols = [*partition_by, *order_by]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = df.select(*cols, value.cast("long").alias("_v")).repartitionByRange(parts, *cols)
    keys = stored(keys.withColumn("_p", F.spark_partition_id()), "ranges")
    totals = keys.groupBy("_p", *partition_by).agg(F.sum("_v").alias("_t"))
    before = Window.partitionBy(*partition_by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_p", *partition_by, F.coalesce(F.sum("_t").over(before), F.lit(0)).alias("_off"))
    within = Window.partitionBy("_p", *partition_by).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    done = keys.withColumn("_in", F.sum("_v").over(within)).join(offsets, ["_p", *partition_by])
    return df.join(done.select(*cols, (F.col("_off") + F.col("_in")).cast("long").alias(name)), cols)


def global_rank(df: DataFrame, order_by: Sequence[str], name: str = "rn") -> DataFrame:
    """1-based row number over a total order (see the module)."""
    return running_total(df, F.lit(1), order_by, (), name)


def hashed_rank(df: DataFrame, ord_col: str, key: str, name: str = "rn", total: str | None = None) -> DataFrame:
    """``global_rank`` over (``ord_col``, ``key``) where ``ord_col`` is an md5 order
    key of the unique ``key``: even buckets without a look at the data. The
    numbers within buckets are written once. ``total`` names a column for the
    number of rows."""
    bucket = Window.partitionBy("_b")
    keys = df.select(ord_col, key).withColumn("_b", F.substring(F.col(ord_col), 1, BUCKET_HEX_DIGITS))
    keys = keys.withColumn("_in", F.row_number().over(bucket.orderBy(ord_col, key))).withColumn("_n", F.count(F.lit(1)).over(bucket))
    keys = stored(keys, "ranks")
    sizes = keys.where(F.col("_in") == 1).select("_b", "_n")  # 16^4 rows at most
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"), F.sum("_n").over(every).alias("_total"))
    done = keys.join(F.broadcast(offsets), "_b")
    extra = [F.col("_total").alias(total)] if total else []
    return df.join(done.select(ord_col, key, (F.col("_off") + F.col("_in")).cast("long").alias(name), *extra), [ord_col, key])


def split_dataset(df: DataFrame, key: str, seed: int = DEFAULT_SEED,
                  test_frac: float = TEST_FRACTION) -> DataFrame:
    """Ordered split by the seeded order of the unique ``key``: test = last
    ceil(frac * n) rows, validation = the same number right before it, train = the
    rest. Adds ``ord``, ``rn`` and ``split``."""
    o = seeded_order(df, key)
    ranked = hashed_rank(o, "ord", key, total="_n")
    n_test = F.ceil(F.lit(test_frac) * F.col("_n"))
    split = (F.when(F.col("rn") > F.col("_n") - n_test, F.lit("test"))
             .when(F.col("rn") > F.col("_n") - 2 * n_test, F.lit("validation"))
             .otherwise(F.lit("train")))
    return ranked.withColumn("split", split).drop("_n")


def few_shot(train: DataFrame, vocab: DataFrame, n: int, label: str = "label",
             order: Sequence[str] = ("ord", "id")) -> DataFrame:
    """D3: the first ``n`` training rows per vocabulary label (case-sensitive);
    fewer when a class is small. Spark plans the ``row_number() <= n`` filter
    as a WindowGroupLimit that also runs before the shuffle."""
    t = train.join(vocab.select(F.col("label").alias(label)), label, "left_semi")
    w = Window.partitionBy(label).orderBy(*order)
    return t.withColumn("shot_rank", F.row_number().over(w)).where(F.col("shot_rank") <= n)


def shot_prefix(shots: DataFrame, text: Column, seed: int = DEFAULT_SEED, key: str = "id",
                group: Sequence[str] = ()) -> DataFrame:
    """Concatenate rendered shots in a reshuffled (seeded) order: one row
    per group. The input is at most n x |labels| rows per group."""
    order = F.md5(F.concat(F.lit(f"{seed}:shot:"), F.col(key).cast("string")))
    parts = shots.select(*group, F.struct(order.alias("o"), F.col(key).alias("k"), text.alias("t")).alias("s"))
    return parts.groupBy(*group).agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "").alias("prefix"),
        F.count(F.lit(1)).alias("n_shots"))


def assign_batches(df: DataFrame, order_by: Sequence[str], size: int, hashed: bool = False) -> DataFrame:
    """T4: consecutive batches of ``size`` rows in ``order_by`` order (last batch
    short). ``hashed``: the order is an md5 key and its unique source column.
    Adds ``rn`` and ``batch``."""
    ranked = hashed_rank(df, *order_by) if hashed else global_rank(df, order_by)
    return ranked.withColumn("batch", F.floor((F.col("rn") - 1) / F.lit(size)).cast("long"))
