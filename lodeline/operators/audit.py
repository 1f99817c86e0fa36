"""Integrity audits: staging checks, re-derivation, digests, inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeline.runtime import bounded, materialize


def staging_audit(rows: DataFrame, key: str, number: str, required: list[str]) -> DataFrame:
    """Rows, distinct keys, least and greatest number, rows with a required column missing; one pass."""
    missing = F.lit(False)
    for c in required:
        missing = missing | F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")
    return rows.agg(F.count("*").alias("n_rows"), F.countDistinct(key).alias("n_keys"), F.min(number).alias("least"), F.max(number).alias("greatest"), F.count_if(missing).alias("n_incomplete"))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """``side`` and the columns of rows that only one of the tables holds, repeated rows counted."""
    b = b.select(*a.columns)
    return a.exceptAll(b).withColumn("side", F.lit("only_first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("only_second")))


MOST_IN_ONE = 1_000_000


def _few(rows: DataFrame, what: str) -> DataFrame:
    """The rows, if one task may hold them."""
    if rows.limit(MOST_IN_ONE + 1).count() > MOST_IN_ONE:
        raise ValueError(f"more than {MOST_IN_ONE} {what}")
    return rows


def order_digest(rows: DataFrame, value: Column, by: Column, blocks: int = 1) -> DataFrame:
    """SHA-256 over the lines ``value`` in the order of ``by``.

    With more than one block the digest is that of the blocks' digests, so that no task holds all rows; a number column is cut in ranges.
    """
    lines = rows.select(value.cast("string").alias("v"), by.alias("k"))
    one = lambda d: F.sha2(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "v"))), lambda x: x["v"]), "\n"), F.lit("\n")), 256)
    if blocks == 1:
        lines = _few(lines, "rows of a digest in one block")
        return lines.agg(F.count("*").alias("n_rows"), one(lines).alias("digest"))
    ranged = lines.withColumn("block", F.floor(F.col("k") / blocks))
    per = ranged.groupBy("block").agg(F.count("*").alias("n"), one(ranged).alias("d"))
    return per.agg(F.sum("n").alias("n_rows"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "d"))), lambda x: x["d"]), "\n"), 256).alias("digest"))


def inventory_rules(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """``path, n_rules``: objects that don't match exactly one prefix. Rules are a small table."""
    met = objects.join(bounded(rules, 10_000, "rules"), F.startswith(F.col("path"), F.col("prefix")), "left")
    return met.groupBy("path").agg(F.count("prefix").alias("n_rules")).filter("n_rules <> 1")


def unused_rules(objects: DataFrame, rules: DataFrame) -> DataFrame:
    """Prefixes that no object has."""
    used = objects.join(bounded(rules, 10_000, "rules"), F.startswith(F.col("path"), F.col("prefix"))).select("prefix").distinct()
    return rules.select("prefix").join(used, "prefix", "left_anti")


def release_totals(objects: DataFrame) -> DataFrame:
    """Objects, bytes and the hash over all lines of an inventory in order; the hash needs them together, so at most ``MOST_IN_ONE`` are allowed."""
    return _few(objects, "objects of a release").agg(F.count("*").alias("objects"), F.sum("size_bytes").alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "path", "sha256", F.col("size_bytes").cast("string")))), "\n"), 256).alias("inventory_hash"))


def repeated(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def gaps(ranges: DataFrame, start: str, end: str) -> DataFrame:
    """Ranges that don't begin where the one before ends. Ranges meet by equi-join on their ends."""
    first = ranges.agg(F.min(start).alias("first"))
    ends = ranges.select(F.col(end).alias(start)).distinct()
    return ranges.join(ends, start, "left_anti").join(F.broadcast(first), F.col(start) != F.col("first")).drop("first")


def numbered(rows: DataFrame, order: list[Column], name: str = "row_number", by: list[str] | None = None) -> DataFrame:
    """Contiguous numbers from 0 within ``by``, or over all rows with ranges sorted in parallel and offsets added."""
    if by:
        return rows.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order)) - 1)
    parts = max(1, rows.sparkSession.sparkContext.defaultParallelism)
    # stored: both readers below have to see the same ranges, also after an executor is lost
    ordered = materialize(rows.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()))
    local = ordered.withColumn("_n", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    counts = local.groupBy("_p").agg(F.count("*").alias("_c"))
    offsets = counts.withColumn("_o", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # one row for each partition
    return local.join(F.broadcast(offsets.select("_p", "_o")), "_p").withColumn(name, F.col("_o") + F.col("_n")).drop("_p", "_n", "_o")


def latest(deliveries: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The newest row of each key; an aggregate of structs, so that repeated deliveries are combined before the shuffle."""
    rest = [c for c in deliveries.columns]
    picked = deliveries.groupBy(key).agg(F.max(F.struct(*[o.alias(f"_{i}") for i, o in enumerate(order)], F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"))).alias("m"))
    return picked.select("m.row.*")


def not_contiguous(rows: DataFrame, by: list[str], number: str, first: int = 1) -> DataFrame:
    """Groups whose numbers aren't ``first, first + 1, ...`` without gaps or repeats; one aggregate a group, no sort."""
    g = rows.groupBy(*by).agg(F.count("*").alias("n"), F.countDistinct(number).alias("d"), F.min(number).alias("lo"), F.max(number).alias("hi"))
    return g.filter((F.col("lo") != first) | (F.col("d") != F.col("n")) | (F.col("hi") - F.col("lo") + 1 != F.col("n"))).select(*by, "n")


def rebuilt_equals_stored(stored: dict[str, DataFrame], rebuilt: dict[str, DataFrame]) -> dict[str, int]:
    """Rows that differ, by table, between what is stored and what is derived anew; all zero for a valid build."""
    if set(stored) != set(rebuilt):
        raise ValueError(f"other tables: {sorted(set(stored) ^ set(rebuilt))}")
    return {name: difference(stored[name], rebuilt[name]).count() for name in stored}
