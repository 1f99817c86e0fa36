"""Queries of the general problems 4 and 5."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeline.operators import multivalue, pay_units
from lodeline.runtime import bounded, enough_tasks, table

SKILL_FIELDS = ["電腦技能資料", "工作技能", "專業證照"]


MOST_NAMES, NAME = 1_000_000, "graph_skills"


def _names(spark: SparkSession, sf: str) -> set[str]:
    return {r["skill"] for r in bounded(table(spark, sf, NAME).select("skill").dropna(), MOST_NAMES, f"names in {NAME}").collect()}  # a fixed table


def _skill_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The skill fields of every delivery with the vendor of its posting as their source."""
    raw = enough_tasks(table(spark, sf, "jobs_raw").select("source_row", F.col("職缺編號").alias("job_id"), *SKILL_FIELDS))
    return multivalue.with_source(raw, table(spark, sf, "jobs"), "job_id", "vendor_id").select("source_row", *SKILL_FIELDS, "source")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return multivalue.split_fields(_skill_rows(spark, sf), SKILL_FIELDS, _names(spark, sf))


def p4_delimiters(spark: SparkSession, sf: str) -> DataFrame:
    return multivalue.inferred(multivalue.fields_long(_skill_rows(spark, sf), SKILL_FIELDS, "source"), _names(spark, sf))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    jobs = enough_tasks(table(spark, sf, "jobs").select("job_id", "salary_text", "salary_min", "salary_max", "vendor_id", "source_modified_at"))
    return pay_units.monthly_pay(jobs, table(spark, sf, "pay_units")).select("job_id", "min_twd_month", "max_twd_month")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p4_found": p4_found, "p4_delimiters": p4_delimiters, "p5_found": p5_found}


def oracle_sql() -> dict[str, str]:
    return {}
