"""Resident bytes of address ranges from a bitmap of pages, by prefix sums."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resident_ranges(bits: np.ndarray, page: int, first: int, last: int, base: int, address: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Resident bytes of [address, address + size) in a region whose pages are bits[first..last].

    base: the address of page ``first``. 0 for ranges that leave the region's pages.
    """
    sums = np.concatenate([[0], np.cumsum(bits.astype(np.int64))])
    low, high = address // page - base // page + first, (address + size - 1) // page - base // page + first
    ok = (size > 0) & (low >= first) & (high <= last) & (high < len(bits))
    lo, hi = np.clip(low, 0, len(bits) - 1), np.clip(high, 0, len(bits) - 1)
    tail = (address + size) % page
    whole = (sums[hi + 1] - sums[lo]) * page - bits[lo] * (address % page) - np.where(tail > 0, bits[hi] * (page - tail), 0)
    return np.where(ok, whole, 0)


#: Pages that are summed together: prefix sums have two levels, of pages in a block and of blocks.
BLOCK = 4096


def resident_of(ranges: DataFrame, key: str, pages: DataFrame, page: int) -> DataFrame:
    """ranges (key, address, size, ...) with resident_bytes; pages (page, resident): one row for each page number.

    Prefix sums over the pages answer each range by two look-ups, of its first and its last byte, however
    long it is.
    """
    block = F.floor(F.col("page") / BLOCK)
    bits = pages.select("page", block.alias("block"), F.col("resident").cast("long").alias("bit"))
    sums = bits.groupBy("block").agg(F.sum("bit").alias("n"))
    base = sums.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base"))  # a row for BLOCK pages
    within = F.sum("bit").over(Window.partitionBy("block").orderBy("page")) - F.col("bit")
    prefix = bits.withColumn("within", within).join(base, "block").select("page", "bit", (F.col("base") + F.col("within")).alias("before"))
    ends = F.array(F.struct(F.col("address").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("address") + F.col("size") - 1).alias("at"), F.lit(1).alias("sign")))
    some = ranges.where("size > 0").select(key, F.explode(ends).alias("e")).select(key, "e.sign", F.expr(f"e.at div {page}").alias("page"), F.expr(f"e.at % {page}").alias("offset"))
    upto = F.col("before") * page + F.col("bit") * (F.col("offset") + F.when(F.col("sign") > 0, 1).otherwise(0))
    found = some.join(prefix, "page").groupBy(key).agg(F.sum(F.col("sign") * upto).alias("resident_bytes"))
    return ranges.join(found, key, "left").withColumn("resident_bytes", F.coalesce("resident_bytes", F.lit(0).cast("long")))


def resident_spans(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """spans (snapshot_id, region, address, size, ...; disjoint) with resident: their bytes in resident pages.

    runs (snapshot_id, region, low, high, start, size): each region's pages lie in [low, high), the resident
    ones in runs [start, start + size); a region without any has one run of size 0. A span that leaves its
    region's pages has 0. Regions are worked on apart, each span by a look-up at both of its ends.
    """
    cell = ["snapshot_id", "region"]
    bounds = runs.groupBy(*cell).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    here = spans.join(bounds, cell).where("size > 0 and address >= low and address + size <= high").select(*cell, "address", "size")
    before = F.sum("size").over(Window.partitionBy(*cell).orderBy("start")) - F.col("size")
    run = F.struct("start", "size", before.alias("before"))
    sorted_runs = runs.select(*cell, F.col("start").alias("at"), F.lit(0).alias("sign"), F.lit(None).cast("long").alias("address"), run.alias("run"))
    ends = F.array(F.struct(F.col("address").alias("at"), F.lit(-1).alias("sign")), F.struct((F.col("address") + F.col("size")).alias("at"), F.lit(1).alias("sign")))
    points = here.select(*cell, "address", F.explode(ends).alias("e")).select(*cell, "e.at", "e.sign", "address", F.lit(None).cast(sorted_runs.schema["run"].dataType).alias("run"))
    last = F.last("run", True).over(Window.partitionBy(*cell).orderBy("at", F.abs("sign")))
    found = sorted_runs.unionByName(points).withColumn("run", last).where("sign <> 0")
    upto = F.col("run.before") + F.least(F.col("at") - F.col("run.start"), F.col("run.size"))
    sums = found.groupBy(*cell, "address").agg(F.sum(F.col("sign") * F.coalesce(upto, F.lit(0))).alias("resident"))
    return spans.join(sums, [*cell, "address"], "left").withColumn("resident", F.coalesce("resident", F.lit(0).cast("long")))
