"""Adding vectors by key: the shuffle every trainer and document operator ends in."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordspace.operators.partial import add_rows, pack_rows
from wordspace.space import INT_VECTOR, PACKED_INT, PACKED_REAL, REAL_VECTOR


def _key_type(rows: DataFrame) -> str:
    return rows.schema["key"].dataType.simpleString()


def packed_schema(key_type: str, real: bool = False) -> str:
    """Schema of the packed rows between two steps of a sum."""
    number, vec = ("double", PACKED_REAL) if real else ("bigint", PACKED_INT)
    return f"key {key_type}, weight bigint, factor {number}, vec {vec}"


def _rows(rows: DataFrame, real: bool) -> DataFrame:
    """The columns the summing step reads; rows with no factor of their own count once.

    Rows without a key are a group of their own, as in SQL.
    """
    factor = F.col("factor") if "factor" in rows.columns else F.lit(1)
    return rows.select("key", "weight", factor.cast("double" if real else "bigint").alias("factor"), "vec")


def pack(rows: DataFrame, size: int) -> DataFrame:
    """The rows with their ``vec`` packed, for steps that move it repeatedly.

    A vector with values beyond two bytes becomes several rows, told apart by ``factor``.
    """
    real = "array<double>" in rows.schema["vec"].dataType.simpleString()
    if "factor" not in rows.columns:
        rows = rows.withColumn("factor", F.lit(1).cast("double" if real else "bigint"))
    first = [c for c in rows.columns if c not in ("factor", "vec")]
    rows = rows.select(*first, "factor", "vec")
    fields = [f"{c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns[:-1]]
    schema = ", ".join([*fields, f"vec {PACKED_REAL if real else PACKED_INT}"])
    return rows.mapInArrow(pack_rows(size), schema)


def combine_local(rows: DataFrame, size: int, real: bool = False, unit: bool = False) -> DataFrame:
    """One packed partial row per key and task, without a shuffle."""
    dtype = np.float64 if real else np.int64
    return _rows(rows, real).mapInArrow(add_rows(size, dtype, unit=unit), packed_schema(_key_type(rows), real))


#: Into how many groups by map task the rows of a key are dealt before they meet.
FAN = 64


def spread_sum(partial: DataFrame, size: int, real: bool = False, fan: int = FAN) -> DataFrame:
    """Fewer partial rows of the same sums, for a few keys that have one from every map task.

    Rows meet by key and by the task they come from, dealt to ``fan`` groups, so the final merge
    takes that many rows of a key, and a task of this step one in so many. The plan is
    only built here: how many tasks there are is not asked, as that would run them.
    """
    salted = _rows(partial, real).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(fan)))
    return combine_local(salted.repartition("key", "salt").drop("salt"), size, real)


def merge_by_key(
    partial: DataFrame, size: int, real: bool = False, centre: np.ndarray | None = None, partitions: int | None = None
) -> DataFrame:
    """Add the partial rows of every key: ``(key, weight, vec)``, one row per key.

    One shuffle by key. Rows arrive sorted and are summed as they stream past, so a key
    needs one table row of memory however many partial rows it has; and it has about one
    per map task, because the tasks combined it already. ``centre`` is subtracted
    ``weight`` times from each finished vector. With ``partitions`` keys are dealt to so many, as a
    table of as many buckets has them.
    """
    met = _rows(partial, real).repartition(*([partitions] if partitions else []), "key")
    return add_sorted(met, size, real, centre)


def add_sorted(met: DataFrame, size: int, real: bool = False, centre: np.ndarray | None = None) -> DataFrame:
    """As :func:`merge_by_key` for rows of which those of a key are in one partition already."""
    dtype = np.float64 if real else np.int64
    schema = f"key {_key_type(met)}, weight bigint, vec {REAL_VECTOR if real else INT_VECTOR}"
    return _rows(met, real).sortWithinPartitions("key").mapInArrow(add_rows(size, dtype, ordered=True, centre=centre), schema)


def sum_vectors(
    rows: DataFrame, size: int, real: bool = False, unit: bool = False, centre: np.ndarray | None = None, few: bool = False
) -> DataFrame:
    """Sum of ``factor * vec`` and of ``weight`` per key; ``unit`` normalises each ``vec`` first.

    ``few`` says that a few keys have rows everywhere, whose sums then meet in two steps.
    """
    partial = combine_local(rows, size, real, unit)
    return merge_by_key(spread_sum(partial, size, real) if few else partial, size, real, centre)


def negate(rows: DataFrame) -> DataFrame:
    """The rows with every vector counted against instead of for its key."""
    factor = F.col("factor") if "factor" in rows.columns else F.lit(1)
    return rows.withColumn("factor", -factor)
