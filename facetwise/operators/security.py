"""Row-level grants: which values of the permission field a user may see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import Schema


def visible(records: DataFrame, schema: Schema, grants: DataFrame | None, users: tuple[int, ...]) -> DataFrame:
    """Records that some of the users may see, each once. Nothing is hidden without a permission field or users."""
    if not schema.permission_field or not users or grants is None:
        return records
    name = schema[schema.permission_field].name
    seen = grants.filter(F.col("user_id").isin(list(users))).select(F.col("fk_field").cast(records.schema[name].dataType).alias("__granted")).distinct()
    return records.join(seen, records[name] == seen["__granted"], "left_semi")


def grant(grants: DataFrame, rows: list[tuple], reset: bool = False) -> DataFrame:
    """Grants with (user_id, value) rows added, each once; reset: what these values had goes first."""
    new = grants.sparkSession.createDataFrame(rows, grants.schema)
    if reset:
        grants = grants.join(new.select("fk_field").distinct(), "fk_field", "left_anti").select(*grants.columns)
    return grants.unionByName(new).distinct()


def revoke(grants: DataFrame, rows: list[tuple]) -> DataFrame:
    gone = grants.sparkSession.createDataFrame(rows, grants.schema)
    return grants.join(gone, ["user_id", "fk_field"], "left_anti").select(*grants.columns)


def clear(grants: DataFrame, user: int | None = None, value=None) -> DataFrame:
    """Without the grants of a user, or of a value, or without any."""
    if user is not None:
        return grants.filter(F.col("user_id") != user)
    return grants.filter(F.col("fk_field") != F.lit(value)) if value is not None else grants.limit(0)
