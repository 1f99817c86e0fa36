"""Times with and without zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TAIPEI = "Asia/Taipei"
WINDOW_DAYS = 180


def naive_to_utc(col: Column, zone: str = TAIPEI) -> Column:
    """Wall-clock time of the zone (no zone of its own) as UTC wall-clock time."""
    return F.to_utc_timestamp(col.cast("timestamp"), zone)


def parse_strict(col: Column) -> Column:
    """ISO 8601 with a zone; null for anything else."""
    return F.when(col.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(col))


def parse_source(col: Column, zone: str = TAIPEI) -> Column:
    """ISO 8601; a time without a zone is the zone's wall clock."""
    naive = F.when(~col.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & col.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.to_utc_timestamp(F.try_to_timestamp(col), zone))
    return F.coalesce(parse_strict(col), naive)


def epoch_ms(col: Column) -> Column:
    """Milliseconds since 1970; negative ones are an error."""
    ms = F.unix_millis(col.cast("timestamp"))
    return F.when(ms < 0, F.raise_error(F.lit("time before 1970")).cast("bigint")).otherwise(ms)


def end_of_day(date: Column, zone: str = TAIPEI) -> Column:
    """The last millisecond of the zone's day, in UTC."""
    return F.to_utc_timestamp((F.date_add(date.cast("date"), 1).cast("timestamp") - F.expr("interval 1 millisecond")), zone)


def freshness(updated: Column, as_of: Column, days: int = WINDOW_DAYS) -> Column:
    """1 for now, 0 at ``days`` of age and for the future."""
    age = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(updated.cast("timestamp"))) / 86_400_000_000.0
    return F.when(age < 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - age / days))


def iso_utc(col: Column) -> Column:
    return F.date_format(col.cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
