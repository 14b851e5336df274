"""Exact duplicates with frequent texts split off.

Texts are equal when their digests without white space are. A Misra-Gries summary (Spark's
``freqItems``) names at most ``1 / support`` digests, among them every one that holds more
than that share of the rows. Those are counted exactly with partial aggregation, their
winners are broadcast and settle their rows without moving them; only the other
digests, each below that share, meet by an ordinary shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordspace.llm.removal import survivors
from wordspace.sources.scratch import materialize

#: Fixed value: the characters that do not count.
BLANKS = " \t\n\x0b\x0c\r"

#: A digest with more than this share of the rows is sure to be named, so at most 1,000 are.
SUPPORT = 0.001


def digest(text: Column) -> Column:
    """SHA-256, in lower-case hex, of the text in UTF-8 without blanks; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, "").cast("binary"), 256)


def _groups(rows: DataFrame) -> DataFrame:
    """Size and winner of each digest: most code points, then smallest id (null last), then any one row."""
    order = F.struct(-F.col("points"), F.col("doc").isNull(), F.col("doc"), F.col("row"))
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.min(order).alias("winner"))


def assign(docs: DataFrame, key: str = "doc_id", text: str = "text", support: float = SUPPORT) -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Null texts are empty and empty texts equal each other. Of rows alike in text and id
    exactly one is kept. Columns other than the two named are not looked at.
    """
    rows = materialize(
        docs.select(
            F.col(key).alias("doc"), F.length(F.coalesce(F.col(text), F.lit(""))).cast("bigint").alias("points"),
            digest(F.col(text)).alias("digest"), F.monotonically_increasing_id().alias("row"),
        )
    )
    named = rows.freqItems(["digest"], support).select(F.explode("digest_freqItems").alias("digest"))
    frequent = materialize(_groups(rows.join(F.broadcast(named), "digest", "left_semi")))
    settled = rows.join(F.broadcast(frequent), "digest")
    others = rows.join(F.broadcast(frequent.select("digest")), "digest", "left_anti")
    met = others.join(_groups(others), "digest")
    return settled.unionByName(met).select(
        F.col("doc").alias(key), F.col("winner.doc").alias("keep_id"), "group_size",
        (F.col("row") == F.col("winner.row")).alias("kept"), F.col("digest").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = assign(docs, key, text).select(F.col(key).alias("id"), F.col("text_sha256").alias("mark"), "kept")
    return survivors(docs, key, digest(F.col(text)), materialize(found))
