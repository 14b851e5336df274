"""Finding vectors by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordspace.functions.vectors import index_vector
from wordspace.sources.scratch import materialize
from wordspace.space import VectorSpace


def point(row_column: str, field: str) -> Column:
    """A field of a row column."""
    return F.col(row_column)[field]


def row_as_map(rows: DataFrame, key: str = "key") -> DataFrame:
    """``(key, cells)``: the other columns as a string map, the key under ``word``."""
    pairs = [F.lit("word"), F.col(key).cast("string")]
    for field in rows.schema:
        if field.name != key:
            value = F.col(field.name)
            simple = field.dataType.simpleString()
            as_text = F.to_json(value) if simple.startswith(("struct", "array", "map")) else value.cast("string")
            pairs += [F.lit(field.name), as_text]
    return rows.select(F.col(key), F.create_map(*pairs).alias("cells"))


def map_as_row(cells: DataFrame, schema: str, key: str = "key") -> DataFrame:
    """The inverse of :func:`row_as_map`: the columns of ``schema`` read from ``cells``, the key from ``word``."""
    fields = cells.sparkSession.createDataFrame([], schema).schema
    columns = []
    for field in fields:
        value = F.col("cells")["word" if field.name == key else field.name]
        simple = field.dataType.simpleString()
        nested = simple.startswith(("struct", "array", "map"))
        columns.append((F.from_json(value, simple) if nested else value.cast(field.dataType)).alias(field.name))
    return cells.select(*columns)


def get(lexicon: DataFrame, key: str) -> DataFrame:
    """The row of one key, or no row; the filter reaches the stored files."""
    return lexicon.filter(F.col("key") == key)


def get_keys(lexicon: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the keys a lexicon has. ``keys`` needs a column ``key``."""
    return lexicon.join(keys.select("key").distinct(), "key", "left_semi")


def missing_keys(lexicon: DataFrame, keys: DataFrame) -> DataFrame:
    """The keys a lexicon has no row for."""
    return keys.select("key").distinct().join(lexicon.select("key"), "key", "left_anti")


def _missing(count: int, some: list[str]) -> LookupError:
    shown = ", ".join(sorted(some))
    return LookupError(f"the lexicon has no data for {count} keys, for example: {shown}" if count > len(some) else f"the lexicon has no data for: {shown}")


def get_or_error(lexicon: DataFrame, keys: DataFrame | list[str]) -> DataFrame:
    """As :func:`get_keys`, raising when any of the keys is missing.

    A list of keys is a filter that reaches the stored files, and is read once; the keys
    of a table are joined. The error counts all missing keys and names ten.
    """
    if isinstance(keys, list):
        found = materialize(lexicon.filter(F.col("key").isin(keys)))
        lost = sorted(set(keys) - {row.key for row in found.select("key").collect()})
        if lost:
            raise _missing(len(lost), lost[:10])
        return found
    lost = materialize(missing_keys(lexicon, keys))
    if count := lost.count():
        raise _missing(count, [row.key for row in lost.orderBy("key").limit(10).collect()])
    return get_keys(lexicon, keys)


def get_or_index(lexicon: DataFrame, keys: DataFrame, space: VectorSpace) -> DataFrame:
    """``(key, known, vec)``: the stored vector, or the index vector of an unknown key."""
    wanted = keys.select("key").distinct()
    found = get_keys(lexicon, wanted).select("key", "vec")
    return wanted.join(found, "key", "left").select(
        "key",
        F.col("vec").isNotNull().alias("known"),
        F.coalesce("vec", index_vector(F.col("key"), space)).alias("vec"),
    )
