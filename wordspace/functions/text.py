"""Text preparation as column expressions; everything stays in the JVM.

The patterns use the explicit ASCII white-space class instead of ``\\s`` so that
they mean the same to every regex dialect that checks the results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators of tokens, sentences and lines.
TOKEN_BREAK = r"[ \t\n\x0B\f\r]+"
SENTENCE_BREAK = r"(\n|\r)+"
LINE_BREAK = r"\r\n|\n|\r"

# Patterns of the newswire clean-up.
BODY_MARKS = r"(<BODY>)|(&#3;</BODY>)"
BODY_END = "&#3;</BODY>"
ACRONYM_TAIL = r"(?<=[A-Z]\.)([A-Z])\."
ACRONYM_HEAD = r"([A-Z])\.(?=[A-Z])"
SENTENCE_GAP = r"(?<=(\S)\.{1,3}(\"?))\s+(?=(\"?[A-Z]))"
ONE_WORD_LINE = r"^\s*\w+\s*$"

# Characters up to U+0020 at either end of a line, the range a Java trim removes.
OUTER_BLANKS = r"^[\x00-\x20]+|[\x00-\x20]+$"


def token_array(text: Column, keep_empty: bool = False) -> Column:
    """White-space tokens of a text; empty strings are dropped unless asked for."""
    parts = F.split(text, TOKEN_BREAK)
    return parts if keep_empty else F.filter(parts, lambda t: t != "")


def sentence_array(text: Column) -> Column:
    """Sentences of a prepared text: one per run of line ends, empties dropped."""
    return F.filter(F.split(text, SENTENCE_BREAK), lambda s: s != "")


def line_array(text: Column) -> Column:
    """Lines of a text; a final line end opens no further line."""
    return F.split(F.regexp_replace(text, r"(\r\n|\n|\r)\z", ""), LINE_BREAK)


def lines_to_text(text: Column) -> Column:
    """Join the lines of a text by single spaces, making it one sentence."""
    return F.array_join(line_array(text), " ")


def join_trimmed(text: Column) -> Column:
    """The lines of a text, trimmed and joined by single spaces."""
    return F.array_join(F.transform(line_array(text), lambda l: F.regexp_replace(l, OUTER_BLANKS, "")), " ")


def body_sentences(body: Column) -> Column:
    """The sentences of one newswire body, without full stops and lines of one word."""
    plain = F.regexp_replace(body, ACRONYM_TAIL, "$1")
    plain = F.regexp_replace(plain, ACRONYM_HEAD, "$1")
    bare = F.transform(F.split(plain, SENTENCE_GAP), lambda s: F.replace(s, F.lit("."), F.lit("")))
    return F.filter(bare, lambda s: ~s.rlike(ONE_WORD_LINE))


def sgml_to_sentences(text: Column) -> Column:
    """Sentences of the ``<BODY>`` blocks of a newswire file, one per line."""
    # Splitting discards empty trailing pieces, so closing marks are cut off first.
    closed = F.regexp_replace(join_trimmed(text), rf"({BODY_MARKS})+\z", "")
    bodies = F.filter(F.split(closed, BODY_MARKS), lambda _, i: i % 2 == 1)
    return F.array_join(F.flatten(F.transform(bodies, body_sentences)), "\n")


def prepare_by_type(path: Column, text: Column) -> Column:
    """Prepare each file by its own extension: newswire files by body, others by line."""
    return F.when(path.rlike(r"\.sgml?$"), sgml_to_sentences(text)).otherwise(lines_to_text(text))


def tag_contents(text: Column, tag: str) -> Column:
    """Text after the first ``<tag>`` up to the next ``</tag>``.

    An unclosed tag runs to the end of the text; a missing one gives NULL.
    """
    after = F.get(F.split(text, rf"\Q<{tag}>\E", 2), F.lit(1))
    return F.substring_index(after, f"</{tag}>", 1)


def each(rows: DataFrame, array: Column | str, name: str, *keep: str, at: str | None = None) -> DataFrame:
    """One row per array element, with its place in column ``at`` if named.

    The outer generator and a filter on what it produced stand for a plain explode:
    for that, the optimizer would evaluate the array twice more, as a filter on its size.
    """
    array = F.col(array) if isinstance(array, str) else array
    generated = F.explode_outer(array).alias(name) if at is None else F.posexplode_outer(array).alias(at, name)
    return rows.select(*keep, generated).filter(F.col(name).isNotNull())


def sentences(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, sent, sentence)``, numbered from 0 inside each document."""
    return each(docs, sentence_array(F.col(text)), "sentence", doc, at="sent")


def tokens(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, sent, pos, word)`` of every document."""
    return each(sentences(docs, doc, text), token_array(F.col("sentence")), "word", doc, "sent", at="pos")


def document_words(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``(doc, word)``, one row per occurrence, without regard to sentences."""
    return each(docs, token_array(F.col(text)), "word", doc)


def split_topics(
    docs: DataFrame, doc: str = "doc_id", text: str = "text",
    topics_tag: str = "topics", body_tag: str = "body",
) -> DataFrame:
    """``(doc, topics, body, rejected)``; a document lacking either tag is rejected."""
    parts = docs.select(
        doc,
        tag_contents(F.col(text), topics_tag).alias("topics"),
        tag_contents(F.col(text), body_tag).alias("body"),
    )
    return parts.withColumn("rejected", F.col("topics").isNull() | F.col("body").isNull())
