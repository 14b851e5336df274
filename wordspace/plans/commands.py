"""The commands a user runs: prepare texts, train, count, clear, compare, assign."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from wordspace.functions.text import split_topics
from wordspace.operators.documents import text_vectors
from wordspace.operators.lookup import get_or_error
from wordspace.operators.similarity import compare
from wordspace.operators.topics import TOPICS_PER_TEXT, assign_topics, topic_vectors
from wordspace.operators.training import Trainer, from_sentences, train
from wordspace.sources.files import lines, prepare, whole_files
from wordspace.sources.scratch import materialize
from wordspace.sources.store import KINDS, Store, Table, TableMissing, buckets_for
from wordspace.space import VectorSpace

REPORT = "kind string, processed bigint, rejected bigint, added bigint, total bigint, seconds double"


class Workbench:
    """Commands over the tables of one store."""

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.store = spark, Store(spark, root, buckets)

    def process_dir(self, path: str, dataset: str, how=None) -> int:
        """Prepare the files under a path and put them into a corpus; returns how many there were.

        Texts that the corpus has from other files stay; those of the same files are replaced.
        """
        return self._put(dataset, prepare(whole_files(self.spark, path), how))

    def put_texts(self, texts: DataFrame, dataset: str, doc: str = "doc_id", text: str = "text") -> int:
        """Put the texts of any DataFrame into a corpus; returns how many there were.

        Earlier texts stay but for those with one of the ids now given.
        """
        return self._put(dataset, texts.select(F.col(doc).cast("string").alias("doc_id"), F.col(text).alias("text")))

    def _put(self, dataset: str, rows: DataFrame) -> int:
        self.store.add("corpus", dataset, rows)
        return self.store.added("corpus", dataset)

    def texts(self, dataset: str) -> DataFrame:
        """``(doc_id, text)`` of a corpus."""
        return self.store.open("corpus", dataset).rows

    def _open(self, kind: str, name: str, create: bool, space: VectorSpace | None, texts: DataFrame | None = None) -> Table:
        buckets = None if texts is None else buckets_for(texts)
        return self.store.create(kind, name, space, buckets) if create else self.store.open(kind, name)

    def train(
        self, kind: str, lexicon: str, texts: str | DataFrame, create: bool = False,
        space: VectorSpace | None = None, trainer: Trainer = from_sentences,
    ) -> DataFrame:
        """Train a word or topic lexicon on a corpus and make the result its current version.

        Returns a one-row report. Its counts are those of the tables as written, and of the
        texts as they are read for training, which happens once (a task run again after a
        lost executor may count its texts again). Null texts are left out and counted as
        rejected, and so are topic texts that lack ``<topics>`` or ``<body>``.
        """
        begun = time.monotonic()
        docs = self.texts(texts) if isinstance(texts, str) else texts
        if KINDS.get(kind) == "words":
            old = self._open(kind, lexicon, create, space, docs)
            seen = Observation()
            column = "text" if "text" in docs.columns else docs.columns[0]
            counted = docs.observe(seen, F.count("*").alias("processed"), F.count_if(F.col(column).isNull()).alias("rejected"))
            batch = train(counted, old.space, trainer, partitions=self.store.buckets_of(kind, lexicon))
            new = self.store.merge(kind, lexicon, batch, dealt=True)
            processed, rejected = seen.get["processed"], seen.get["rejected"]
        elif KINDS.get(kind) == "topics":
            words = self.store.open("words", lexicon)
            old = self._open(kind, lexicon, create, words.space)
            parts = materialize(split_topics(docs))
            processed, rejected = parts.count(), parts.filter("rejected").count()
            new = self.store.merge(kind, lexicon, topic_vectors(parts.filter("NOT rejected"), words.rows, words.space))
        else:
            raise ValueError(f"not a kind of lexicon: {kind}")
        total = new.rows.count()
        row = (KINDS[kind], processed, rejected, total - old.rows.count(), total, time.monotonic() - begun)
        return self.spark.createDataFrame([row], REPORT)

    def count(self, kind: str, name: str) -> int:
        return self.store.count(kind, name)

    def clear(self, kind: str, name: str) -> int:
        return self.store.clear(kind, name)

    def compare_words(self, lexicon: str, word_a: str, word_b: str) -> float | None:
        """Similarity of two words; raises if the lexicon lacks either."""
        words = self.store.open("words", lexicon)
        pair = self.spark.createDataFrame([(word_a, word_b)], "a string, b string")
        found = get_or_error(words.rows, [word_a, word_b])
        return compare(found, pair, words.space).first().similarity

    def _file_vectors(self, words: Table, paths: list[str], unit: str) -> DataFrame:
        files = None
        for number, path in enumerate(paths):
            # Line by line, so a large file is read in many splits; its lines add up under one key.
            rows = lines(self.spark, path).select(F.lit(number).alias("doc_id"), F.col("value").alias("text"))
            files = rows if files is None else files.unionByName(rows)
        return text_vectors(files, words.rows, words.space, unit=unit)

    def compare_documents(self, lexicon: str, path_a: str, path_b: str, unit: str = "token") -> float | None:
        """Similarity of two text files; None where one has no known word."""
        words = self.store.open("words", lexicon)
        vectors = materialize(self._file_vectors(words, [path_a, path_b], unit))
        pair = self.spark.createDataFrame([(0, 1)], "a int, b int")
        return compare(vectors, pair, words.space).first().similarity

    def assign_topics_to_text(
        self, lexicon: str, path: str, top: int = TOPICS_PER_TEXT, ascending: bool = False, unit: str = "token"
    ) -> list[str]:
        """Names of the topics closest to a text file, best first."""
        words = self.store.open("words", lexicon)
        topics = self.store.open("topics", lexicon)
        vectors = self._file_vectors(words, [path], unit)
        best = assign_topics(vectors, topics.rows, words.space, top, ascending)
        return [row.right_key for row in best.orderBy("rank").collect()]


__all__ = ["TableMissing", "Workbench"]
