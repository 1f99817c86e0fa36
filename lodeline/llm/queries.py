"""Queries of the problems tagged llm, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodeline.llm import looks, near_duplicates, packing, prefix_bpe, similar_vectors, truncation
from lodeline.runtime import enough_tasks, table


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.found_pairs(table(spark, sf, "jobs").select("job_id", "title", "description"))


def p1_classes(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.advertisement_classes(table(spark, sf, "jobs").select("job_id", "title", "description"))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return similar_vectors.found_pairs(table(spark, sf, "vectors"), table(spark, sf, "embedding_shards"))


def p2_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    return similar_vectors.neighbours(table(spark, sf, "vectors"), table(spark, sf, "embedding_shards"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return looks.look_pairs(enough_tasks(table(spark, sf, "jobs").select("job_id", "title", "description")))


def p3_forms(spark: SparkSession, sf: str) -> DataFrame:
    return looks.with_forms(enough_tasks(table(spark, sf, "jobs").select("job_id", "title", "description")), {"title": "title_form", "description": "description_form"}).select("job_id", "title_form", "description_form")


def p3_classes(spark: SparkSession, sf: str) -> DataFrame:
    return looks.look_classes(enough_tasks(table(spark, sf, "jobs").select("job_id", "title", "description")))


def p3_spellings(spark: SparkSession, sf: str) -> DataFrame:
    return looks.spellings(enough_tasks(table(spark, sf, "jobs").select("title", "description")), ["title", "description"], looks.look_alikes(spark))


def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    return prefix_bpe.encoded(enough_tasks(table(spark, sf, "documents").select("doc_id", "text")))


def p7_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed_documents(enough_tasks(table(spark, sf, "documents").select("doc_id", "text")))


def p7_usage(spark: SparkSession, sf: str) -> DataFrame:
    return packing.usage(p7_packing(spark, sf))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.found(enough_tasks(table(spark, sf, "documents").select("doc_id", "source", "text")))


def p8_report(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.report(enough_tasks(table(spark, sf, "documents").select("doc_id", "source", "text")))


def p8_lengths(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.cutting_lengths(truncation.endings(enough_tasks(table(spark, sf, "documents").select("doc_id", "source", "text"))))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p1_classes": p1_classes, "p2_found": p2_found, "p2_neighbours": p2_neighbours, "p3_found": p3_found, "p3_forms": p3_forms, "p3_classes": p3_classes, "p3_spellings": p3_spellings, "p6_ids": p6_ids, "p7_packing": p7_packing, "p7_usage": p7_usage, "p8_found": p8_found, "p8_report": p8_report, "p8_lengths": p8_lengths}


def oracle_sql() -> dict[str, str]:
    return {}
