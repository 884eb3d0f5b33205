"""Row limits that mean "lowest id first", and repeatable samples.

A split may hold nearly all rows, so none of these sorts a split in one task or
moves texts: the limit is found on the id column alone and applied as a filter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

_RADIX = 16


def kth_smallest(df: DataFrame, column: str, k: int) -> int | None:
    """The k-th smallest value of an integer column, exactly; null values do not count.

    Narrows the value 16 bits at a time. Each step is one pass over one column
    with partial aggregation to at most 65,536 counts, whatever the data looks
    like; the running total over those counts is the only single-task step.
    Returns the largest value if there are fewer than ``k``, None if ``k`` < 1.
    """
    values = df.select(F.col(column).cast("long").alias("v")).where("v is not null")
    low, high, rows = values.agg(F.min("v"), F.max("v"), F.count("v")).first()
    if k < 1 or rows == 0:
        return None
    if k >= rows:
        return high
    bits = max(low.bit_length(), high.bit_length())
    shift = min((bits // _RADIX) * _RADIX, 48)
    rank = k
    while True:
        bucket = F.shiftright("v", shift)
        counts = values.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
        running = counts.withColumn("upto", F.sum("n").over(Window.orderBy("bucket")))
        prefix, before = (
            running.where(F.col("upto") >= rank)
            .agg(F.min_by(F.struct("bucket", F.expr("upto - n")), "bucket").alias("hit"))
            .select("hit.*")
            .first()
        )
        if shift == 0:
            return prefix
        rank -= before
        first = prefix << shift
        values = values.where(F.col("v").between(first, first + (1 << shift) - 1))
        shift -= _RADIX


#: Groups whose bounds are resolved to literals, so that they reach the scan; more are joined.
FEW_GROUPS = 256


def preview_head(df: DataFrame, n: int = 4, by: tuple[str, ...] = ("split",), id: str = "id") -> DataFrame:
    """The ``n`` rows of lowest id in each group of ``by``; null ids come last and are not shown.

    Every task passes on at most ``n`` ids per group. The bounds of few groups
    become literals that the scan can skip row groups by; those of many are
    joined to the rows. Rows that tie on the bound are ranked by all their
    columns, so exactly ``n`` stay.
    """
    lowest = Window.partitionBy(*by).orderBy(id)
    ranked = df.select(*by, id).where(F.col(id).isNotNull()).withColumn("rank", F.row_number().over(lowest))
    bounds = ranked.where(F.col("rank") <= n).groupBy(*by).agg(F.max(id).alias("bound"))
    found = bounds.limit(FEW_GROUPS + 1).collect()
    if len(found) > FEW_GROUPS:
        match = [df[c].eqNullSafe(bounds[c]) for c in by]
        near = df.join(bounds, [*match, df[id] <= bounds["bound"]], "left_semi")
    else:
        wanted = F.lit(False)
        for row in found:
            group = F.col(id) <= row["bound"]
            for c in by:
                group &= F.col(c).isNull() if row[c] is None else F.col(c) == row[c]
            wanted |= group
        near = df.where(wanted)
    first = F.row_number().over(Window.partitionBy(*by).orderBy(id, F.xxhash64(*df.columns)))
    return near.withColumn("_n", first).where(F.col("_n") <= n).drop("_n")


def train_cap(df: DataFrame, samples: int | str = "max", id: str = "id") -> DataFrame:
    """At most ``samples`` rows of the train split, lowest ids first; others, null splits too, untouched.

    Of train rows that tie on the last id just as many stay as there is room for.
    """
    if samples == "max":
        return df
    in_train = F.coalesce(F.col("split") == "train", F.lit(False))
    others = df.where(~in_train)
    train = df.where(in_train)
    bound = kth_smallest(train, id, int(samples))
    if bound is None:
        return others
    below, at = train.where(F.col(id) < bound), train.where(F.col(id) == bound)
    counts = train.where(F.col(id) <= bound).agg(F.count_if(F.col(id) < bound), F.count_if(F.col(id) == bound)).first()
    room = int(samples) - counts[0]
    if counts[1] <= room:
        return df.where(~in_train | (F.col(id) <= bound))
    # Equal ids need an order of their own; only rows of one id get here.
    return others.unionByName(below).unionByName(at.orderBy(F.xxhash64(*df.columns)).limit(room))


def sample_one(df: DataFrame, seed: str, by: str = "dataset", id: str = "id") -> DataFrame:
    """One random row per group, the same for the same seed.

    The row of the smallest hash of (id, seed); should two hashes agree, the
    lower id. Only hash and id are aggregated, with partial aggregation; the
    ids drawn for few groups become literals that reach the scan.
    """
    digest = F.md5(F.concat(F.col(id).cast("string"), F.lit(seed)))
    rank = F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")
    drawn = df.groupBy(by).agg(F.min(F.struct(rank.alias("rank"), F.col(id).alias("id"))).alias("least"))
    drawn = drawn.select(by, "least.id")
    found = drawn.limit(FEW_GROUPS + 1).collect()
    if len(found) > FEW_GROUPS:
        near = df.join(drawn, df[by].eqNullSafe(drawn[by]) & (df[id] == drawn["id"]), "left_semi")
    else:
        wanted = F.lit(False)
        for row in found:
            wanted |= (F.col(by).isNull() if row[by] is None else F.col(by) == row[by]) & (F.col(id) == row["id"])
        near = df.where(wanted)
    first = F.row_number().over(Window.partitionBy(by).orderBy(F.xxhash64(*df.columns)))
    return near.withColumn("_n", first).where("_n = 1").drop("_n")
