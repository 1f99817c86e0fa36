"""Sources and sinks: CSV snapshots, JSON lines with closed keys, TREC runs, canonical queries, vector shards, manifests."""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Sequence
from pathlib import Path, PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodeline.runtime import drop_folder, publish


def read_csv(spark: SparkSession, path: str, header: Sequence[str]) -> DataFrame:
    """All-text CSV with quoted line breaks; the header must be exactly ``header``."""
    first = spark.read.option("multiLine", True).option("escape", '"').csv(path).limit(1).collect()
    found = [str(v or "").lstrip("﻿") for v in first[0]] if first else []
    if found != list(header):
        raise ValueError(f"header differs: {found[:5]}")
    schema = StructType([StructField(h, StringType()) for h in header])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "FAILFAST").option("enforceSchema", True).csv(path)


def csv_audit(rows: DataFrame, key: str, required: Sequence[str]) -> DataFrame:
    """Rows, unsafe and repeated keys, rows with blank required columns."""
    blank = F.lit(False)
    for c in required:
        blank = blank | (F.trim(F.coalesce(F.col(c), F.lit(""))) == "")
    return rows.agg(F.count("*").alias("n_rows"), (F.count(key) - F.countDistinct(key)).alias("n_repeated"), F.count_if(~F.coalesce(F.col(key), F.lit("")).rlike("^[0-9]+$")).alias("n_unsafe"), F.count_if(blank).alias("n_blank"))


def read_json_lines(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """One object per line with exactly the schema's keys; anything else is an error when the plan runs."""
    names = sorted(schema.fieldNames())
    lines = spark.read.text(path).filter(F.trim("value") != "")
    keys = F.array_sort(F.json_object_keys("value"))
    ok = F.coalesce(keys == F.array(*[F.lit(n) for n in names]), F.lit(False))
    checked = F.when(ok, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("unexpected keys: "), F.substring("value", 1, 80))).cast("string"))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST", "allowNonNumericNumbers": "false"}).alias("o")).select("o.*")


def write_json_lines(df: DataFrame, path: str) -> None:
    """Sorted keys, one object per line; an existing target is an error."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])).alias("value")).write.mode("errorifexists").text(path)


QUERY_SCHEMA = "qid string, query string, as_of string, location_codes array<string>, duty_codes array<string>"


def read_queries(spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Canonical queries with ``violation`` (null for a good one): safe id, trimmed text, zoned time inside the window, sorted unique codes."""
    schema = StructType.fromDDL(QUERY_SCHEMA) if hasattr(StructType, "fromDDL") else spark.createDataFrame([], QUERY_SCHEMA).schema
    q = read_json_lines(spark, path, schema)
    moment = F.try_to_timestamp("as_of")
    by_value = lambda c: F.array_sort(F.array_distinct(c), lambda a, b: F.when(F.length(a) != F.length(b), F.length(a) - F.length(b)).when(a < b, -1).when(a > b, 1).otherwise(0))
    rule = (
        F.when(~F.col("qid").rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"), F.lit("unsafe qid"))
        .when((F.trim("query") != F.col("query")) | (F.col("query") == ""), F.lit("text not trimmed"))
        .when(~F.col("as_of").rlike(r"(Z|[+-]\d{2}:?\d{2})$") | moment.isNull(), F.lit("time without zone"))
        .when((moment < F.lit(start).cast("timestamp")) | (moment >= F.lit(end).cast("timestamp")), F.lit("outside window"))
        .when((by_value(F.col("location_codes")) != F.col("location_codes")) | (by_value(F.col("duty_codes")) != F.col("duty_codes")), F.lit("codes not sorted"))
    )
    return q.withColumn("as_of_ts", moment).withColumn("violation", rule)


def read_trec(spark: SparkSession, path: str) -> DataFrame:
    from lodeline.operators.evaluate import parse_trec

    return parse_trec(spark.read.text(path).withColumnRenamed("value", "line"))


def write_trec(ranked: DataFrame, path: str, tag: str) -> None:
    from lodeline.operators.evaluate import trec_rows

    trec_rows(ranked, tag).orderBy("qid", "rank").select("line").write.mode("errorifexists").text(path)


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    rows = read_csv(spark, path, ["CodeNo", "CodeNameA", "CodeNameB", "CodeNameC"])
    return rows.select(*[F.col(c).alias(c.lower()) for c in rows.columns])


def write_index(index, path: str) -> None:
    """Postings by field, statistics, and the marker last."""
    index.postings.write.mode("errorifexists").partitionBy("field").parquet(f"{path}/postings")
    index.terms.write.mode("errorifexists").partitionBy("field").parquet(f"{path}/terms")
    index.fields.write.mode("errorifexists").parquet(f"{path}/fields")
    index.fields.sparkSession.createDataFrame([("lexical-index-1",)], "format string").write.mode("errorifexists").json(f"{path}/_complete")


def read_index(spark: SparkSession, path: str):
    from lodeline.operators.lexical import Index

    if spark.read.json(f"{path}/_complete").first()["format"] != "lexical-index-1":
        raise ValueError("unknown index format")
    return Index(spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/fields"), spark.read.parquet(f"{path}/terms"))


def write_vector_shards(vectors: DataFrame, path: str, shard_size: int) -> None:
    """Vectors by shard of ``job_index``; shards that hold the same rows already, by number and hash, stay, the others are written."""
    spark = vectors.sparkSession
    sharded = vectors.withColumn("shard", F.floor(F.col("job_index") / shard_size).cast("int"))
    try:
        totals = lambda d, n: d.groupBy("shard").agg(F.struct(F.count("*"), F.sum(F.xxhash64(*vectors.columns).cast("decimal(38,0)"))).alias(n))
        done, wanted = totals(spark.read.parquet(path), "n"), totals(sharded, "m")
        complete = wanted.join(done, "shard").filter("n = m").select("shard")
        sharded = sharded.join(complete, "shard", "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
    sharded.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shard").parquet(path)


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """``path, sha256, size_bytes`` of the files under a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("size_bytes"))


def replace_table(staged: DataFrame, path: str, key: str, number: str, required: list[str]) -> None:
    """Write the rows beside the table, audit what was written in one pass, and only then put it in the table's place."""
    from lodeline.operators.audit import staging_audit

    spark, beside = staged.sparkSession, f"{path}.staged"
    staged.write.mode("overwrite").parquet(beside)
    a = staging_audit(spark.read.schema(staged.schema).parquet(beside), key, number, required).first()
    if a["n_rows"] != a["n_keys"] or a["n_incomplete"]:
        drop_folder(spark, beside)
        raise ValueError(f"staging audit failed: {a}")
    drop_folder(spark, path)
    publish(spark, beside, path)


def canonical_json(value: object) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def policy_hash(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def write_json(path: str, value: object) -> None:
    """Written beside the target, then renamed; a left-over partial file is an error."""
    target, part = Path(path), Path(f"{path}.partial")
    with part.open("x", encoding="utf-8") as f:
        f.write(canonical_json(value) + "\n")
    part.rename(target)


def exact_keys(value: dict, keys: set[str]) -> dict:
    if set(value) != keys:
        raise ValueError(f"unexpected keys: {sorted(set(value) ^ keys)}")
    return value


def zip_members(path: str, names: Sequence[str], most: int = 1 << 33) -> dict[str, str]:
    """The one member of each name; unsafe paths, repeated and oversized members are errors."""
    out: dict[str, str] = {}
    with zipfile.ZipFile(path) as z:
        for info in z.infolist():
            p = PurePosixPath(info.filename)
            if p.is_absolute() or ".." in p.parts:
                raise ValueError(f"unsafe path: {info.filename}")
            if p.name in names:
                if p.name in out or info.file_size > most:
                    raise ValueError(f"repeated or oversized member: {p.name}")
                out[p.name] = info.filename
    if set(out) != set(names):
        raise ValueError(f"missing members: {sorted(set(names) - set(out))}")
    return out
