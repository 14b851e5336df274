"""Taking rows out of a table of documents by a list of their ids."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordspace.sources.scratch import materialize

#: Most rows of a list that is broadcast, at a few dozen bytes each; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def unused(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores after them where ``docs`` has such a column."""
    out = []
    for name in names:
        while name.lower() in (c.lower() for c in docs.columns):
            name += "_"
        out.append(name)
    return out


def bounded(rows: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A written table of narrow rows, marked for broadcast if it has at most ``limit`` rows."""
    return F.broadcast(rows) if rows.count() <= limit else rows


def without(docs: DataFrame, listed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose keys are not listed; nulls equal each other."""
    return _joined(docs, listed, keys, "left_anti")


def only(docs: DataFrame, listed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The rows of ``docs`` whose keys are listed."""
    return _joined(docs, listed, keys, "left_semi")


def _joined(docs, listed, keys, how):
    keys = keys or listed.columns
    names = unused(docs, *(f"listed_{k}" for k in keys))
    named = materialize(listed.select(*(F.col(k).alias(name) for k, name in zip(keys, names))).distinct())
    same = reduce(lambda a, b: a & b, (docs[k].eqNullSafe(F.col(name)) for k, name in zip(keys, names)))
    return docs.join(bounded(named), same, how)


def survivors(docs: DataFrame, key: str, mark: Column, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``found`` keeps, with all their columns.

    ``found`` is a written table of ``(id, mark, kept)`` with a row per row of ``docs``, where
    ``mark`` is that digest of the text. Of rows alike in both, it keeps one at most.
    """
    names = unused(docs, "id_of_row", "mark_of_row")
    lost, kept = (found.filter(c).select("id", "mark").toDF(*names) for c in ("NOT kept", "kept"))
    marked = docs.withColumns(dict(zip(names, (F.col(key), mark))))
    # Rows alike in both, of which one stays, are on both sides.
    single = only(marked, lost.intersect(kept)).dropDuplicates(names)
    return without(marked, lost).unionByName(single).drop(*names)
