"""Text files as DataFrames."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wordspace.functions.text import (
    BODY_END, BODY_MARKS, body_sentences, each, join_trimmed, lines_to_text, prepare_by_type, sgml_to_sentences,
)
from wordspace.sources.scratch import materialize


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, text)``: one row per file under a path, the file path as its id."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("text")
    )


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``(value)``: one row per line of the files under a path."""
    return spark.read.text(path)


def spread(rows: DataFrame, partitions: int | None = None) -> DataFrame:
    """The rows dealt evenly to the given number of partitions, or as they are.

    For texts of few splits whose rows take long to work on; the shuffle moves every text.
    """
    return rows if partitions is None else rows.repartition(partitions)


def prepare(files: DataFrame, how=None) -> DataFrame:
    """``(doc_id, text)`` with the text prepared by ``how``, a function of columns.

    The default goes by the extension of each file.
    """
    text = prepare_by_type(F.col("doc_id"), F.col("text")) if how is None else how(F.col("text"))
    return files.select(F.col("doc_id").cast("string").alias("doc_id"), text.alias("text"))


def prepare_plain(files: DataFrame) -> DataFrame:
    """All files as plain text."""
    return prepare(files, lines_to_text)


def prepare_sgml(files: DataFrame) -> DataFrame:
    """All files as newswire text."""
    return prepare(files, sgml_to_sentences)


def _numbered(batches):
    """Rows of byte ranges in order, with ``first``: the marks of their range before them."""
    current, total = None, 0
    for batch in batches:
        first = np.empty(batch.num_rows, np.int64)
        for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "range", "marks")))):
            if row[:2] != current:
                current, total = row[:2], 0
            first[i], total = total, total + row[2]
        yield batch.append_column("first", pa.array(first))


def newswire_bodies(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, body, text)``: the bodies of newswire files of any size, each prepared as in a whole file.

    ``doc_id`` is the file's path and ``body`` the number of the body in it, from 0. The lines of a
    file's bodies, in order, are what :func:`prepare_sgml` makes of the file, but for empty bodies at
    its end; a body without sentences has an empty text. Files are read in byte ranges of the session's
    ``spark.sql.files.maxPartitionBytes``, each from the first closing mark within it to the first
    beyond it, so a file is as many tasks as it has ranges and what has to fit a row is what
    stands between two closing marks. Files are UTF-8 and not compressed.

    Which pieces are bodies depends on how many marks there are before: those of a range are
    counted as it is read, and ranges by the sums of the ranges before. Texts are joined
    with one row per range, which Spark broadcasts where its size allows.
    """
    read = spark.read.option("lineSep", BODY_END).text(path)
    marks = F.size(F.split("value", "<BODY>", -1)).cast("bigint")  # one of them is the mark at the end
    cut = read.select(
        F.col("_metadata.file_path").alias("doc_id"), F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("range"), marks.alias("marks"), "value",
    )
    cut = materialize(cut.mapInArrow(_numbered, "doc_id string, bytes bigint, range bigint, marks bigint, value string, first bigint"))
    long = F.octet_length("value") + F.lit(len(BODY_END)).cast("bigint")
    ranges = cut.groupBy("doc_id", "range").agg(
        F.sum("marks").alias("marks"), F.sum(long).alias("long"), F.max("bytes").alias("bytes"), F.max("first").alias("last")
    )
    before, whole = Window.partitionBy("doc_id").orderBy("range"), Window.partitionBy("doc_id")
    ranges = ranges.select(
        "doc_id", "range", (F.sum("marks").over(before) - F.col("marks")).alias("before"),
        # The last row of a file may have no mark at its end.
        F.when((F.sum("long").over(whole) > F.col("bytes")) & (F.col("range") == F.max("range").over(whole)), F.col("last")).alias("open"),
    )
    rows = cut.join(materialize(ranges), ["doc_id", "range"]).select(
        "doc_id", "value", (F.col("before") + F.col("first")).alias("first"), F.col("first").eqNullSafe(F.col("open")).alias("open")
    )
    # Marks on either side keep the blanks beside them, as in the whole file; they add an empty piece each.
    led, ended = F.col("first") > 0, ~F.col("open")
    mark = F.lit(BODY_END)
    framed = F.concat(F.when(led, mark).otherwise(""), "value", F.when(ended, mark).otherwise(""))
    pieces = F.split(join_trimmed(framed), BODY_MARKS, -1)
    own = F.slice(pieces, 1 + led.cast("int"), F.size(pieces) - led.cast("int") - ended.cast("int"))
    found = each(rows, own, "piece", "doc_id", "first", at="at").withColumn("at", F.col("first") + F.col("at"))
    bodies = found.filter("at % 2 = 1").select("doc_id", F.shiftright("at", 1).alias("body"), "piece")
    said = bodies.select("doc_id", "body", body_sentences(F.col("piece")).alias("said"))
    return said.select("doc_id", "body", F.when(F.size("said") > 0, F.array_join("said", "\n")).alias("text"))
