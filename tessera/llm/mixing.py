"""Mixing sources to target weights by Pfair scheduling.

A source's rows are put in a fixed pseudo-random order and cut into blocks of
``block`` rows. Weights are whole shares w of D = ``shares``. Block i of a source
may start at slot floor(i D / w), its release, and must be done by slot
ceil((i + 1) D / w), its deadline; in each slot the released block with the
earliest deadline runs (ties: the first source by name). As the shares add up to
D, no slot is idle and no deadline is missed, so after t slots every source has
had floor(t w / D) or ceil(t w / D) blocks: less than one block from its target.
The schedule repeats every D slots, so D slots are scheduled, whatever the input
(one row, by a fold over the slots), and block i runs at slot
(i div w) D + place of its (i mod w)-th block in that table.

A source whose blocks have run out leaves its later slots empty; the others keep
theirs, so all rows are kept and the weights hold as long as all sources last.

Row numbers within a source never need the source in one task: rows fall into
hash buckets of about ``BUCKET`` rows, a window numbers the rows of a bucket, and
counts by bucket, added up in two levels, give the buckets' offsets. All is
DataFrame and SQL functions. D is ``SHARES``, or ``PER_SOURCE`` shares for every source
if these are more; the tables of sources and slots have at most D rows, and are
broadcast if D is at most ``SMALL``.

Defined cases: a null source is a source like any other; sources without a given
weight have none and raise an error, given sources without rows only leave slots
empty; rows that share a doc_id keep a row each (their order among them is
arbitrary); more sources than a given number of shares raise an error; extra columns are kept; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.errors import PySparkValueError
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh

SHARES, PER_SOURCE = 1000, 4
#: Shares up to which the tables of sources and slots are broadcast.
SMALL = 200_000
BLOCK = 32
BUCKET = 4096
SEED = 42
_GROUP = 1024


def _key(col: str) -> Column:
    """The source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def row_counts(docs: DataFrame, source_col: str = "source") -> DataFrame:
    """(key, n) by source."""
    return docs.groupBy(_key(source_col).alias("key")).agg(F.count(F.lit(1)).alias("n"))


def damped(counts: DataFrame, power: float = 0.5) -> DataFrame:
    """(key, weight) with weights as the row counts to a power below one, which
    lifts small sources: the default target."""
    return counts.select("key", F.pow(F.col("n").cast("double"), F.lit(power)).alias("weight"))


def given(spark, weights: dict[str | None, float]) -> DataFrame:
    """(key, weight) from a plain mapping."""
    rows = [("" if s is None else f"={s}", float(w)) for s, w in weights.items() if w > 0]
    return spark.createDataFrame(rows, "key string, weight double")


def whole_shares(weights: DataFrame, shares: int = SHARES) -> DataFrame:
    """(key, w): whole shares by largest remainder, one at least, ``shares`` in all.
    One window over the table of weights, which has ``shares`` rows at most."""
    every = Window.partitionBy(F.lit(0))
    n = F.count(F.lit(1)).over(every)
    exact = (F.lit(shares) - n) * F.col("weight") / F.sum("weight").over(every)
    base = weights.select("key", exact.alias("x"), n.alias("sources")).withColumn("f", F.floor("x"))
    rest = F.lit(shares) - F.col("sources") - F.sum("f").over(every)
    place = F.row_number().over(every.orderBy(F.desc(F.col("x") - F.col("f")), "key"))
    w = (F.col("f") + 1 + F.when(place <= rest, 1).otherwise(0)).cast("long")
    fits = F.when(F.col("sources") <= shares, w).otherwise(F.raise_error(F.lit("more sources than shares")).cast("long"))
    return base.select("key", fits.alias("w"))


def schedule(parts: DataFrame, shares: int = SHARES) -> DataFrame:
    """(key, w, k, place): the slot of each source's k-th block within one round of
    ``shares`` slots, earliest deadline first among released blocks."""
    one = parts.agg(F.array_sort(F.collect_list(F.struct("key", "w"))).alias("s"))
    pick = f"""array_min(transform(s, (x, i) ->
                if(acc.done[i] < x.w AND (acc.done[i] * {shares}L) div x.w <= t,
                   named_struct('deadline', ((acc.done[i] + 1) * {shares}L + x.w - 1) div x.w, 'i', bigint(i)), null))).i"""
    fold = f"""aggregate(
        sequence(0L, {shares - 1}L),
        named_struct('done', transform(s, x -> 0L), 'ran', array_repeat(0L, 0)),
        (acc, t) -> aggregate(array({pick}), acc, (a, p) ->
            named_struct('done', transform(a.done, (d, i) -> if(i = p, d + 1, d)), 'ran', array_append(a.ran, p))),
        acc -> acc.ran)"""
    ran = one.where(F.size("s") > 0).select("s", F.posexplode(F.expr(fold)).alias("place", "i"))
    ran = ran.select(F.col("place").cast("long").alias("place"), F.expr("s[int(i)].key").alias("key"), F.expr("s[int(i)].w").alias("w"))
    k = F.row_number().over(Window.partitionBy("key").orderBy("place")) - 1
    return ran.withColumn("k", k.cast("long")).select("key", "w", "k", "place")


def mix(docs: DataFrame, weights: DataFrame | None = None, shares: int | None = None, block: int = BLOCK,
        source_col: str = "source", id_col: str = "doc_id", bucket: int = BUCKET, names: tuple[str, ...] = ("_slot", "_place", "_block", "_w")) -> DataFrame:
    """The rows of ``docs`` with the slot of their block, their place in it, the
    block's number in its source and the source's share, in columns ``names``.
    Rows ordered by slot and place are in mixed order."""
    slot, place, number, w = names
    counts = row_counts(docs, source_col)
    if shares is None:
        sources = (counts if weights is None else weights).count()
        shares = max(SHARES, PER_SOURCE * sources)
    elif (damped(counts) if weights is None else weights).count() > shares:
        raise PySparkValueError("more sources than shares")
    # as many rows as shares at most, which is known here
    small = F.broadcast if shares <= SMALL else (lambda df: df)
    parts = whole_shares(weights if weights is not None else damped(counts), shares)
    table = schedule(parts, shares)
    # inner columns live in one struct, so that columns of docs cannot clash with them
    rows = docs.select(F.struct("*").alias("row"), _key(source_col).alias("key"), F.xxhash64(F.col(id_col), F.lit(SEED)).alias("h"))
    sized = counts.select("key", F.ceil(F.col("n") / bucket).cast("long").alias("buckets"))
    rows = rows.join(small(sized), "key").withColumn("b", F.pmod("h", "buckets"))
    within = Window.partitionBy("key", "b").orderBy("h", F.col(f"row.{id_col}"))
    rows = rows.withColumn("rn", F.row_number().over(within) - 1)
    held = docs.select(_key(source_col).alias("key"), F.xxhash64(F.col(id_col), F.lit(SEED)).alias("h"))
    held = held.join(small(sized), "key").groupBy("key", F.pmod("h", "buckets").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    held = held.withColumn("g", F.expr(f"b div {_GROUP}"))
    prior = Window.partitionBy("key", "g").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    inner = held.withColumn("o", F.coalesce(F.sum("n").over(prior), F.lit(0)))
    groups = held.groupBy("key", "g").agg(F.sum("n").alias("gn"))
    outer = groups.withColumn("go", F.coalesce(F.sum("gn").over(Window.partitionBy("key").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offsets = inner.join(outer, ["key", "g"]).select("key", "b", (F.col("o") + F.col("go")).alias("offset"))
    rows = rows.join(offsets, ["key", "b"]).withColumn("r", F.col("rn") + F.col("offset"))
    rows = rows.withColumn("block", F.expr(f"r div {block}"))
    shared = parts.select("key", F.col("w").alias("pw"))
    rows = rows.join(small(shared), "key", "left")
    known = F.when(F.col("pw").isNull(), F.raise_error(F.concat(F.lit("no weight for source "), F.col("key"))).cast("long")).otherwise(F.expr("block % pw"))
    rows = rows.withColumn("k", known).join(small(table.select("key", "k", F.col("place").alias("p"))), ["key", "k"])
    return rows.select(
        "row.*", F.expr(f"(block div pw) * {shares} + p").alias(slot), F.expr(f"r % {block}").alias(place), F.col("block").alias(number), F.col("pw").alias(w))


def mixed(docs: DataFrame, weights: DataFrame | None = None, shares: int | None = None, block: int = BLOCK) -> DataFrame:
    """The rows of ``docs`` in mixed order: range partitions of slots, each sorted,
    so that files written from it hold the mixture from first to last."""
    names = tuple(fresh(docs.columns, x) for x in ("_slot", "_place", "_block", "_w"))
    out = mix(docs, weights, shares, block, names=names)
    return out.repartitionByRange(*names[:2]).sortWithinPartitions(*names[:2]).select(docs.columns)
