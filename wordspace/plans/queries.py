"""One named query per operator, over the given tables.

Each takes ``(spark, sf_dir)`` and reads its tables whole. Vectors are reported either
cell by cell or, for large lexicons, by a digest of every vector.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordspace.functions import text as T
from wordspace.functions import vectors as V
from wordspace.operators import documents, lookup, similarity, sums, topics, training, windows
from wordspace.operators.partial import OUTPUT_CELLS, read_cells
from wordspace.plans.commands import Workbench
from wordspace.sources import files
from wordspace.sources.scratch import materialize, scratch_path
from wordspace.space import VectorSpace

SPACE = VectorSpace(size=1024, k=8, radius=3)
SEED = 7


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table whose rows take long to work on, in as many partitions as the session asks for."""
    wanted = spark.conf.get("wordspace.partitions", None)
    return files.spread(_table(spark, sf_dir, name), int(wanted) if wanted else None)


def _lexicon(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The window lexicon of a table's texts, written out for the steps that share it."""
    return materialize(training.train(_texts(spark, sf_dir, name), SPACE, training.from_windows))


def _rounded(value: Column, places: int = 6) -> Column:
    return F.round(value, places) + F.lit(0.0)


def _digest_batches(batches):
    for batch in batches:
        edges, dims, vals = read_cells(batch.column("vec"))
        begin = 0
        while begin < batch.num_rows:
            # A bounded number of cells at once: rows have up to as many as the space has dimensions.
            end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + OUTPUT_CELLS, "right")) - 1)
            cells, own = slice(edges[begin], edges[end]), edges[begin : end + 1] - edges[begin]
            at, val = dims[cells].astype(np.int64) + 1, vals[cells]
            columns = [batch.column("key").slice(begin, end - begin), pa.array(np.diff(own).astype(np.int64))]
            for term in (val, val * val, at * val, at * val * val):
                columns.append(pa.array(np.diff(np.concatenate(([0], np.cumsum(term)))[own])))
            yield pa.RecordBatch.from_arrays(columns, ["key", "cells", "total", "squares", "moment", "spread"])
            begin = end


def digest(lexicon: DataFrame) -> DataFrame:
    """Per key: number of cells, and sums that any wrong cell would change."""
    return lexicon.select("key", "vec").mapInArrow(
        _digest_batches, "key string, cells bigint, total bigint, squares bigint, moment bigint, spread bigint"
    )


def cells_of(rows: DataFrame, *keep: str) -> DataFrame:
    return rows.select(*keep, V.cells(F.col("vec")))


# Texts


def lines_to_text(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", T.lines_to_text(F.col("text")).alias("text"))


def sentences(spark, sf_dir):
    return T.sentences(_table(spark, sf_dir, "documents"))


def tokens(spark, sf_dir):
    return T.tokens(_table(spark, sf_dir, "documents"))


def token_counts(spark, sf_dir):
    kept = T.token_array(F.col("text"), keep_empty=True)
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        F.size(kept).cast("bigint").alias("parts"),
        F.size(T.token_array(F.col("text"))).cast("bigint").alias("tokens"),
    )


def sgml_sentences(spark, sf_dir):
    wrapped = F.concat(F.lit("<HEAD>\n<BODY>"), "text", F.lit("\n&#3;</BODY></HEAD>"))
    return _texts(spark, sf_dir, "documents").select("doc_id", T.sgml_to_sentences(wrapped).alias("text"))


def newswire_ranges(spark, sf_dir):
    """Documents as the bodies of files of many, read by byte ranges: each text and how often it comes."""
    path = scratch_path(spark)
    wrapped = F.concat(F.lit("<HEAD>\n<BODY>"), F.coalesce("text", F.lit("")), F.lit("\n&#3;</BODY></HEAD>"))
    _table(spark, sf_dir, "documents").select(wrapped).write.text(path)
    bodies = files.newswire_bodies(spark, path).withColumn("text", F.coalesce("text", F.lit("")))
    return bodies.groupBy("text").agg(F.count("*").alias("n"))


def tag_contents(spark, sf_dir):
    html = F.col("html")
    return _table(spark, sf_dir, "pages").select(
        "page_id", *(T.tag_contents(html, tag).alias(tag) for tag in ("title", "h1", "article", "body"))
    )


def topic_texts(spark, sf_dir):
    return T.split_topics(_table(spark, sf_dir, "pages"), "page_id", "html", topics_tag="title", body_tag="body")


# Files and stored tables


def scan_lines(spark, sf_dir):
    path = scratch_path(spark)
    _table(spark, sf_dir, "documents").select("text").write.text(path)
    return files.lines(spark, path).groupBy("value").agg(F.count("*").alias("n"))


def process_dir(spark, sf_dir):
    path = scratch_path(spark)
    _table(spark, sf_dir, "benchmark").select("item_id", "text").write.partitionBy("item_id").text(path)
    bench = Workbench(spark, scratch_path(spark))
    bench.process_dir(path, "benchmark")
    item = F.regexp_extract("doc_id", r"item_id=(\d+)", 1).cast("bigint")
    return bench.texts("benchmark").select(item.alias("item_id"), "text")


def stored_corpus(spark, sf_dir):
    bench = Workbench(spark, scratch_path(spark))
    bench.put_texts(_table(spark, sf_dir, "documents"), "documents")
    return bench.texts("documents").select("doc_id", F.md5("text").alias("md5"))


def corpus_extended(spark, sf_dir):
    """A corpus of documents, added to by conversations and by changed texts of a part of the documents."""
    bench = Workbench(spark, scratch_path(spark))
    docs, turns = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "conversations")
    bench.put_texts(docs, "all")
    bench.put_texts(turns.withColumn("doc_id", F.concat(F.lit("c"), "conv_id", F.lit(":"), "turn")), "all")
    bench.put_texts(docs.filter("lang = 'de'").withColumn("text", F.concat("text", F.lit(" Ende"))), "all")
    return bench.texts("all").select("doc_id", F.md5("text").alias("md5"))


def prepared_plain(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return files.prepare_plain(rows)


def _newswire(spark, sf_dir):
    wrapped = F.concat(F.lit("<HEAD>\n<BODY>"), "text", F.lit("\n&#3;</BODY></HEAD>"))
    return _texts(spark, sf_dir, "documents").withColumn("text", wrapped)


def prepared_sgml(spark, sf_dir):
    return files.prepare_sgml(_newswire(spark, sf_dir))


def prepared_by_type(spark, sf_dir):
    """Documents as files, the German ones as newswire files."""
    kind = F.when(F.col("lang") == "de", F.when(F.col("doc_id") % 2 == 0, ".sgm").otherwise(".sgml")).otherwise(".txt")
    found = files.prepare(_newswire(spark, sf_dir).withColumn("doc_id", F.concat("doc_id", kind)))
    return found.withColumn("doc_id", F.substring_index("doc_id", ".", 1))


def map_as_row(spark, sf_dir):
    rows = _table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    return lookup.map_as_row(lookup.row_as_map(rows, "doc_id"), "doc_id bigint, quality bigint, toxic bigint", "doc_id")


def training_report(spark, sf_dir):
    """Training on top of a lexicon; the system's turns count as texts that are not there."""
    bench = Workbench(spark, scratch_path(spark))
    bench.put_texts(_table(spark, sf_dir, "documents"), "documents")
    turns = _table(spark, sf_dir, "conversations").withColumn("text", F.expr("CASE WHEN role <> 'system' THEN text END"))
    bench.put_texts(turns, "conversations", "conv_id")
    bench.train("words", "all", "documents", create=True, space=SPACE, trainer=training.from_windows)
    report = bench.train("words", "all", "conversations", trainer=training.from_windows)
    meta = bench.store.metadata("words", "all")
    return report.join(meta.withColumn("kind", F.lit("words")), "kind").drop("seconds")


def cleared_lexicon(spark, sf_dir):
    bench = Workbench(spark, scratch_path(spark))
    made = bench.store.exists("words", "all")
    bench.train("words", "all", _table(spark, sf_dir, "conversations"), True, SPACE, training.from_windows)
    before, after = bench.count("words", "all"), bench.clear("words", "all")
    found = bench.store.exists("words", "all")
    return spark.createDataFrame(
        [(made, found, before, after)], "existed boolean, exists boolean, before bigint, after bigint"
    )


def row_as_map(spark, sf_dir):
    cells = lookup.row_as_map(_table(spark, sf_dir, "labels"), "doc_id")
    return cells.select("doc_id", *(F.col("cells")[c].alias(c) for c in ("word", "quality", "toxic")))


# Vectors


def _benchmark_words(spark, sf_dir):
    return T.document_words(_table(spark, sf_dir, "benchmark"), "item_id").select("word").distinct()


def index_vectors(spark, sf_dir):
    words = _benchmark_words(spark, sf_dir)
    return cells_of(words.withColumn("vec", V.index_vector(F.col("word"), SPACE)), "word")


def permuted_vectors(spark, sf_dir):
    words = _benchmark_words(spark, sf_dir).withColumn("vec", V.index_vector(F.col("word"), SPACE))
    both = words.select("word", F.explode(F.array(F.lit(-3), F.lit(5))).alias("by"), "vec")
    return cells_of(both.withColumn("vec", V.permute(F.col("vec"), F.col("by"), SPACE.size)), "word", "by")


def _index_rows(words: DataFrame, key: str) -> DataFrame:
    """The index vectors of ``(key, word, n)`` rows, counted ``n`` times each."""
    vectors = words.select("word").distinct().withColumn("vec", V.index_vector(F.col("word"), SPACE))
    return words.join(vectors, "word").select(
        F.col(key).alias("key"), F.col("n").alias("weight"), F.col("n").alias("factor"), "vec"
    )


def vector_sums(spark, sf_dir):
    words = T.document_words(_table(spark, sf_dir, "benchmark"), "item_id")
    counted = words.groupBy("item_id", "word").agg(F.count("*").alias("n"))
    return cells_of(sums.sum_vectors(_index_rows(counted, "item_id"), SPACE.size), "key", "weight")


def vector_differences(spark, sf_dir):
    """Occurrences of each item's words less one of each: the repeated words remain."""
    words = T.document_words(_table(spark, sf_dir, "benchmark"), "item_id")
    counted = words.groupBy("item_id", "word").agg(F.count("*").alias("n"))
    every = _index_rows(counted, "item_id")
    once = sums.negate(_index_rows(counted.withColumn("n", F.lit(1).cast("bigint")), "item_id"))
    return cells_of(sums.sum_vectors(every.unionByName(once), SPACE.size), "key")


def normalized_vectors(spark, sf_dir):
    lexicon = training.train(_texts(spark, sf_dir, "benchmark"), SPACE, training.from_windows)
    unit = lexicon.select("key", V.normalize(F.col("vec")).alias("vec"))
    return cells_of(unit, "key").withColumn("val", _rounded(F.col("val")))


def mean_vector(spark, sf_dir):
    lexicon = training.train(_texts(spark, sf_dir, "documents"), SPACE, training.from_windows)
    mean = documents.mean_vector(lexicon, SPACE)
    return cells_of(mean, "weight").select("weight", "dim", _rounded(F.col("val"), 9).alias("val"))


# Training


def train_window(spark, sf_dir):
    return digest(training.train(_texts(spark, sf_dir, "documents"), SPACE, training.from_windows))


def train_sentence(spark, sf_dir):
    return digest(training.train(_texts(spark, sf_dir, "conversations"), SPACE, training.from_sentences))


def train_sentence_default(spark, sf_dir):
    """Ordered training in the space a lexicon has by default."""
    return digest(training.train(_texts(spark, sf_dir, "conversations"), VectorSpace(), training.from_sentences))


def train_sentence_documents(spark, sf_dir):
    return digest(training.train(_texts(spark, sf_dir, "documents"), SPACE, training.from_sentences))


def train_lines(spark, sf_dir):
    path = scratch_path(spark)
    _table(spark, sf_dir, "conversations").select("text").write.text(path)
    return digest(training.train(files.lines(spark, path), SPACE, training.from_lines))


def merge_lexicon(spark, sf_dir):
    """The lexicon of one table trained further on another."""
    first = _lexicon(spark, sf_dir, "documents")
    more = _texts(spark, sf_dir, "conversations")
    return digest(training.train(more, SPACE, training.from_windows, first))


def stored_lexicon_extended(spark, sf_dir):
    """A stored lexicon of the documents, then of two more tables, each batch merged into it where it is."""
    bench = Workbench(spark, scratch_path(spark))
    bench.train("words", "all", _texts(spark, sf_dir, "documents"), True, SPACE, training.from_windows)
    for name in ("conversations", "benchmark"):
        bench.train("words", "all", _texts(spark, sf_dir, name), trainer=training.from_windows)
    return digest(bench.store.open("words", "all").rows)


def stored_lookup(spark, sf_dir):
    """The words of the benchmark in a stored lexicon, from the files that can hold them."""
    bench = Workbench(spark, scratch_path(spark))
    bench.train("words", "all", _texts(spark, sf_dir, "conversations"), True, SPACE, training.from_windows)
    keys = _benchmark_words(spark, sf_dir).withColumnRenamed("word", "key")
    return digest(bench.store.lookup("words", "all", keys))


def stored_columns(spark, sf_dir):
    """A stored lexicon with columns of its own, which stay when it is trained further."""
    bench = Workbench(spark, scratch_path(spark))
    first = training.train(_texts(spark, sf_dir, "conversations"), SPACE, training.from_windows)
    bench.store.write("words", "all", first.withColumn("letters", F.length("key")).withColumn("initial", F.substring("key", 1, 1)), SPACE)
    bench.train("words", "all", _texts(spark, sf_dir, "benchmark"), trainer=training.from_windows)
    rows = bench.store.open("words", "all").rows
    return digest(rows).join(rows.select("key", "letters", "initial"), "key")


def train_on_empty(spark, sf_dir):
    """Training on top of a lexicon without words."""
    return digest(training.train(_texts(spark, sf_dir, "conversations"), SPACE, training.from_windows, training.empty_lexicon(spark)))


def merge_lines(spark, sf_dir):
    """The lexicon of one file of sentences trained further on another."""
    lexicon = None
    for name in ("conversations", "benchmark"):
        path = scratch_path(spark)
        _table(spark, sf_dir, name).select("text").write.text(path)
        lexicon = materialize(training.train(files.lines(spark, path), SPACE, training.from_lines, lexicon))
    return digest(lexicon)


# Lookups and comparison


def known_words(spark, sf_dir):
    """The vectors of words that all have to be known."""
    words = T.document_words(_table(spark, sf_dir, "conversations"), "conv_id").select(F.col("word").alias("key"))
    return digest(lookup.get_or_error(_lexicon(spark, sf_dir, "conversations"), words))


def word_points(spark, sf_dir):
    """One cell column of each row."""
    found = _lexicon(spark, sf_dir, "conversations")
    return found.select("key", F.size(lookup.point("vec", "dims")).cast("bigint").alias("cells"))


def word_lookup(spark, sf_dir):
    keys = _benchmark_words(spark, sf_dir).withColumnRenamed("word", "key")
    return digest(lookup.get_keys(_lexicon(spark, sf_dir, "conversations"), keys))


def missing_words(spark, sf_dir):
    keys = _benchmark_words(spark, sf_dir).withColumnRenamed("word", "key")
    return lookup.missing_keys(_lexicon(spark, sf_dir, "conversations"), keys)


def lookup_or_index(spark, sf_dir):
    keys = _benchmark_words(spark, sf_dir).withColumnRenamed("word", "key")
    found = lookup.get_or_index(_lexicon(spark, sf_dir, "conversations"), keys, SPACE)
    return digest(found).join(found.select("key", "known"), "key")


def _neighbour_pairs(spark, sf_dir):
    """Distinct pairs of adjacent words."""
    pairs = T.token_array(F.col("text"))
    following = F.transform(pairs, lambda w, i: F.struct(w.alias("a"), F.get(pairs, i + 1).alias("b")))
    rows = _table(spark, sf_dir, "benchmark").select(F.inline(following))
    return rows.filter("b IS NOT NULL").distinct()


def compare_words(spark, sf_dir):
    lexicon = _lexicon(spark, sf_dir, "conversations")
    found = similarity.compare(lexicon, _neighbour_pairs(spark, sf_dir), SPACE)
    return found.withColumn("similarity", _rounded(F.col("similarity")))


def _item_vectors(spark, sf_dir):
    lexicon = _lexicon(spark, sf_dir, "conversations")
    return documents.text_vectors(_texts(spark, sf_dir, "benchmark"), lexicon, SPACE, key="item_id")


def document_vectors(spark, sf_dir):
    found = _item_vectors(spark, sf_dir).withColumnRenamed("key", "item_id")
    return cells_of(found, "item_id", "weight").withColumn("val", _rounded(F.col("val")))


def document_vectors_documents(spark, sf_dir):
    docs = _texts(spark, sf_dir, "documents")
    found = documents.text_vectors(docs, _lexicon(spark, sf_dir, "documents"), SPACE)
    zero = F.lit(0.0)
    total = F.aggregate("vec.vals", zero, lambda s, v: s + v)
    places = F.zip_with("vec.dims", "vec.vals", lambda d, v: (d + 1) * v)
    return found.select(
        F.col("key").alias("doc_id"), "weight", _rounded(V.length(F.col("vec")), 5).alias("length"),
        _rounded(total, 5).alias("total"), _rounded(F.aggregate(places, zero, lambda s, v: s + v), 3).alias("moment"),
    )


def line_vectors(spark, sf_dir):
    """As :func:`document_vectors`, from texts that list one word per line."""
    listed = _texts(spark, sf_dir, "benchmark").withColumn("text", F.regexp_replace("text", "[ \\t]+", "\n"))
    lexicon = _lexicon(spark, sf_dir, "conversations")
    found = documents.text_vectors(listed, lexicon, SPACE, key="item_id", unit="line").withColumnRenamed("key", "item_id")
    return cells_of(found, "item_id", "weight").withColumn("val", _rounded(F.col("val")))


def compare_documents(spark, sf_dir):
    """Every text of the benchmark with the next one."""
    vectors = materialize(_item_vectors(spark, sf_dir))
    items = _table(spark, sf_dir, "benchmark")
    pairs = items.select(F.col("item_id").alias("a"), (F.col("item_id") + 1).alias("b"))
    found = similarity.compare(vectors, pairs, SPACE)
    return found.withColumn("similarity", _rounded(F.col("similarity")))


def compare_document_batch(spark, sf_dir):
    vectors = materialize(_item_vectors(spark, sf_dir))
    found = similarity.all_similarities(vectors, vectors, SPACE)
    return found.withColumn("similarity", _rounded(F.col("similarity")))


def best_matches(spark, sf_dir):
    """The five texts of the benchmark most like each."""
    vectors = materialize(_item_vectors(spark, sf_dir))
    found = similarity.all_similarities(vectors, vectors, SPACE, top=5)
    return found.withColumn("similarity", _rounded(F.col("similarity")))


def similar_pairs(spark, sf_dir):
    """The texts of the benchmark that are alike to a tenth at least."""
    vectors = materialize(_item_vectors(spark, sf_dir))
    found = similarity.similar_pairs(vectors, vectors, SPACE, 0.1)
    return found.withColumn("similarity", _rounded(F.col("similarity")))


def similarity_lists(spark, sf_dir):
    vectors = materialize(_item_vectors(spark, sf_dir))
    lists = similarity.similarity_lists(similarity.all_similarities(vectors, vectors, SPACE))
    listed = lists.select("left_key", F.posexplode("similarities").alias("at", "similarity"))
    return listed.withColumn("similarity", _rounded(F.col("similarity")))


# Topics


def _topic_documents(spark, sf_dir, which=None):
    """The documents in the form topic training reads, their topics language and source."""
    docs = _texts(spark, sf_dir, "documents")
    docs = docs if which is None else docs.filter(which)
    names = [F.coalesce(name, F.lit("")) for name in ("lang", "source")]
    body = F.concat(
        F.lit("<topics>\n"), names[0], F.lit("\n"), names[1], F.lit("\n</topics>\n<body>"), "text", F.lit("</body>")
    )
    return T.split_topics(docs.select("doc_id", body.alias("text")))


def _topics(spark, sf_dir, lexicon, which=None):
    docs = _topic_documents(spark, sf_dir, which).filter("NOT rejected")
    return topics.topic_vectors(docs, lexicon, SPACE)


def train_topics(spark, sf_dir):
    found = _topics(spark, sf_dir, _lexicon(spark, sf_dir, "conversations"))
    return cells_of(found, "key", "weight").withColumn("val", _rounded(F.col("val"), 4))


def merge_topics(spark, sf_dir):
    """Topics of all documents but the French ones, then trained further on all but the English ones.

    Documents without a language are on the first side.
    """
    lexicon = _lexicon(spark, sf_dir, "conversations")
    sides = (~F.col("lang").eqNullSafe("fr"), F.col("lang") != "en")
    old, new = (materialize(_topics(spark, sf_dir, lexicon, side)) for side in sides)
    return cells_of(topics.merge_topics(old, new, SPACE), "key", "weight").withColumn("val", _rounded(F.col("val"), 4))


def assign_topics(spark, sf_dir):
    lexicon = _lexicon(spark, sf_dir, "conversations")
    texts = documents.text_vectors(_texts(spark, sf_dir, "benchmark"), lexicon, SPACE, key="item_id")
    best = topics.assign_topics(texts, _topics(spark, sf_dir, lexicon), SPACE)
    return best.select(
        F.col("left_key").alias("item_id"), "rank", F.col("right_key").alias("topic"),
        _rounded(F.col("similarity")).alias("similarity"),
    )


# Windows, ranges, seeded orders, top rows


def context_windows(spark, sf_dir):
    found = windows.context_windows(_table(spark, sf_dir, "conversations"), SPACE.radius, ["conv_id", "turn"])
    return found.withColumn("context", F.array_join("context", " "))


def seeded_order(spark, sf_dir):
    return windows.seeded_order(_table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id", SEED)


def _word_counts(spark, sf_dir):
    words = F.size(T.token_array(F.col("text")))
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words"))


def seeded_numbers(spark, sf_dir):
    """Five places of each turn, chosen by the seed."""
    picks = windows.seeded_picks(F.col("words"), 5, SEED)
    return _word_counts(spark, sf_dir).select("conv_id", "turn", F.posexplode(picks).alias("nth", "id"))


def shuffled_tokens(spark, sf_dir):
    words = windows.shuffle_array(T.token_array(F.col("text")), SEED)
    return _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(words, " ").alias("text"))


def number_range(spark, sf_dir):
    """Every third place of each turn."""
    return _word_counts(spark, sf_dir).select("conv_id", "turn", F.explode(windows.steps(F.lit(0), F.col("words"), 3)).alias("id"))


def range_of_numbers(spark, sf_dir):
    """Every 97th place in all the characters of the documents."""
    total = _table(spark, sf_dir, "documents").agg(F.sum("n_chars")).first()[0]
    return windows.number_range(spark, 0, total, 97)


def seeded_distinct(spark, sf_dir):
    """As many distinct numbers as there are documents, below a thousand times their characters."""
    rows, total = _table(spark, sf_dir, "documents").agg(F.count("*"), F.sum("n_chars")).first()
    return windows.seeded_numbers(spark, 1000 * total, rows, SEED)


def top_by(spark, sf_dir):
    rows = _table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return similarity.top_by(rows, 20, "n_chars", "doc_id")


QUERIES = {
    query.__name__: query
    for query in (
        lines_to_text, sentences, tokens, token_counts, sgml_sentences, newswire_ranges, tag_contents, topic_texts,
        scan_lines, process_dir, stored_corpus, corpus_extended, prepared_plain, prepared_sgml, prepared_by_type,
        training_report, cleared_lexicon, row_as_map, map_as_row,
        index_vectors, permuted_vectors, vector_sums, vector_differences, normalized_vectors, mean_vector,
        train_window, train_sentence, train_sentence_default, train_sentence_documents, train_lines, merge_lexicon, train_on_empty, merge_lines,
        stored_lexicon_extended, stored_lookup, stored_columns,
        word_lookup, known_words, word_points, missing_words, lookup_or_index, compare_words,
        document_vectors, line_vectors, document_vectors_documents, compare_documents, compare_document_batch,
        best_matches, similar_pairs, similarity_lists, train_topics, merge_topics, assign_topics,
        context_windows, seeded_order, seeded_numbers, shuffled_tokens, number_range, range_of_numbers,
        seeded_distinct, top_by,
    )
}


def similar_frequent_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five words most like each of the fifty most frequent ones, among themselves."""
    docs = _table(spark, sf_dir, "documents")
    counts = T.document_words(docs).groupBy(F.col("word").alias("key")).count()
    frequent = similarity.top_by(counts, 50, "count", "key")
    vectors = materialize(lookup.get_keys(_lexicon(spark, sf_dir, "documents"), frequent))
    best = similarity.all_similarities(vectors, vectors, SPACE, top=6).filter("left_key <> right_key")
    return best.select(
        F.col("left_key").alias("word"), F.col("right_key").alias("similar"),
        _rounded(F.col("similarity")).alias("similarity"),
    )
