"""Token budgets by a tree of weights, and the documents that fill them.

The budget runs down the tree (domain, language, source): a node shares what it gets among
its children by weight, no child gets more than its leaves can give in the allowed number of
epochs, and what a child cannot take goes to its siblings first. As a node's own limit is
that of all its leaves, a shortage reaches the siblings of an ancestor only when all
below that ancestor is used up. A leaf takes whole epochs and then, from the seeded order of
one more epoch, the longest run of documents from its beginning that fits the rest.

Where that run ends is found from sums over 4,096 slices of the order, so a leaf of any
size is never sorted whole; the end is one key per leaf, and documents are marked by
comparing with it where they lie. All budgets are whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordspace.llm.removal import bounded, unused
from wordspace.sources.scratch import materialize

#: Shares of the budget: by domain, and in every domain by language; sources share alike.
DOMAINS = {"domain0": 5, "domain1": 3, "domain2": 2}
LANGUAGES = {"en": 4, "de": 2, "fr": 2, "es": 1}
WEIGHTS = DOMAINS | {f"{d}/{lang}": weight for d in DOMAINS for lang, weight in LANGUAGES.items()}

#: Share of all tokens that the mix holds, in percent, and how often a document may be used.
PERCENT, EPOCHS, SEED = 80, 2, 17

#: Hex digits of the seeded order that make a slice.
SLICE = 3


def domain(source: Column) -> Column:
    """The domain of a source: the number in its name by threes; 0 without a number."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "[0-9]{1,9}", 0)
    return F.concat(F.lit("domain"), F.coalesce(number.try_cast("int") % 3, F.lit(0)).cast("string"))


def tokens(text: Column) -> Column:
    """How many words between blanks a text has; null has none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("bigint")


def _weight(path: Column, weights: dict[str, int]) -> Column:
    if not weights:
        return F.lit(1).cast("bigint")
    table = F.create_map(*(F.lit(x) for pair in weights.items() for x in pair))
    return F.coalesce(F.try_element_at(table, path), F.lit(1)).cast("bigint")


def share(nodes: DataFrame) -> DataFrame:
    """``(path, parent, weight, most, given)`` with ``budget``: what each node gets of its parent's ``given``.

    Among siblings in order of the room per weight, each is filled as long as its fair part
    of what is left is more than its room; the others share the rest by weight, rounded
    down. A weight of zero or less gets nothing.
    """
    by = Window.partitionBy("parent").orderBy("ratio", "path")
    able = nodes.withColumn("most", F.when(F.col("weight") > 0, F.col("most")).otherwise(0))
    able = able.withColumn("weight", F.greatest("weight", F.lit(0).cast("bigint")))
    able = able.withColumn("ratio", F.when(F.col("weight") > 0, F.col("most") / F.col("weight")).otherwise(0.0))
    left = F.col("given") - F.coalesce(F.sum("most").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    heavy = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    filled = F.col("most") * F.col("heavy") <= F.col("weight") * F.col("left")
    able = able.withColumns({"left": left, "heavy": heavy}).withColumn("filled", filled)
    first = F.first(F.when(~F.col("filled"), F.struct("left", "heavy")), ignorenulls=True)
    able = able.withColumn("open", first.over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    part = F.expr("weight * open.left div open.heavy")
    return able.select("path", "parent", F.when(F.col("filled"), F.col("most")).otherwise(part).alias("budget"))


def budgets(leaves: DataFrame, depth: int, total: int, weights: dict[str, int] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """``(path, tokens, budget)`` per leaf; ``leaves`` has ``(names, tokens)`` with ``depth`` names each."""
    join = lambda n: F.array_join(F.slice("names", 1, n), "/")
    given = None
    for level in range(1, depth + 1):
        nodes = leaves.groupBy(join(level).alias("path"), join(level - 1).alias("parent"))
        nodes = nodes.agg((F.sum("tokens") * epochs).alias("most")).withColumn("weight", _weight(F.col("path"), weights))
        if given is None:
            nodes = nodes.withColumn("given", F.lit(total).cast("bigint"))
        else:
            nodes = nodes.join(given.select(F.col("path").alias("parent"), F.col("budget").alias("given")), "parent")
        given = materialize(share(nodes))
    return leaves.select(join(depth).alias("path"), "tokens").join(given.select("path", "budget"), "path")


def _order(epoch: Column, key: Column, seed: int) -> Column:
    """The place of a document in the order of an epoch, as text."""
    key = F.coalesce(key.cast("string"), F.lit(""))
    return F.concat(F.md5(F.concat_ws("#", F.lit(str(seed)), epoch.cast("string"), key).cast("binary")), F.lit("#"), key)


def _marked(docs, names, key, text, weights, percent, epochs, seed):
    """The documents with four columns added, and their names: path, tokens, budget of the leaf, copies."""
    path = F.array(*(F.coalesce(name.cast("string"), F.lit("")) for name in names))
    narrow = materialize(docs.select(F.col(key).alias("key"), path.alias("names"), tokens(F.col(text)).alias("tokens")))
    leaves = materialize(narrow.groupBy("names").agg(F.sum("tokens").alias("tokens")))
    total = (leaves.agg(F.sum("tokens")).first()[0] or 0) * percent // 100
    plan = budgets(leaves, len(names), total, weights, epochs)
    plan = materialize(plan.withColumn("epoch", F.expr("coalesce(budget div nullif(tokens, 0), 0)")).withColumn("rest", F.expr("budget - epoch * tokens")))
    part = bounded(plan.select("path", "epoch", "rest"))
    ordered = narrow.select("key", F.array_join("names", "/").alias("path"), "tokens").join(part, "path")
    ordered = ordered.withColumn("order", _order(F.col("epoch"), F.col("key"), seed)).withColumn("slice", F.substring("order", 1, SLICE))
    slices = ordered.groupBy("path", "rest", "slice").agg(F.sum("tokens").alias("tokens"))
    upto = F.sum("tokens").over(Window.partitionBy("path").orderBy("slice"))
    slices = slices.withColumn("before", upto - F.col("tokens")).withColumn("upto", upto).filter("before <= rest AND upto > rest")
    last = slices.groupBy("path").agg(F.min(F.struct("slice", "before")).alias("at")).select("path", "at.slice", "at.before")
    # The documents of one slice of each leaf; rows of one key count together.
    near = ordered.join(bounded(materialize(last)), ["path", "slice"]).groupBy("path", "slice", "rest", "before", "order").agg(F.sum("tokens").alias("tokens"))
    run = F.col("before") + F.sum("tokens").over(Window.partitionBy("path", "slice").orderBy("order"))
    ends = near.withColumn("run", run).filter("run > rest").groupBy("path").agg(F.min("order").alias("end"))
    path_, tokens_, budget_, copies_, epoch_, end_ = unused(docs, "path", "tokens", "budget", "copies", "epoch", "end")
    ends = materialize(plan.select("path", "epoch", "budget").join(ends, "path", "left").select("path", "epoch", "budget", "end"))
    ends = bounded(ends.toDF(path_, epoch_, budget_, end_))
    marked = docs.withColumns({path_: F.array_join(path, "/"), tokens_: tokens(F.col(text))}).join(ends, path_)
    more = F.coalesce(_order(F.col(epoch_), F.col(key), seed) < F.col(end_), F.lit(False))
    return marked.withColumn(copies_, F.col(epoch_) + more.cast("bigint")), (path_, tokens_, budget_, copies_)


def assign(
    docs: DataFrame, names: list[Column], key: str = "doc_id", text: str = "text", weights: dict[str, int] = WEIGHTS,
    percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """``(key, path, n_tokens, budget, copies)``, one row per row of ``docs``: how often the mix holds it.

    Null names are empty ones, null texts have no tokens, and rows of one id and leaf are
    taken together. A leaf without tokens is not used. The sum of copies times tokens
    falls short of a leaf's budget by less than one document.
    """
    marked, added = _marked(docs, names, key, text, weights, percent, epochs, seed)
    return marked.select(key, *added).toDF(key, "path", "n_tokens", "budget", "copies")


def mix(
    docs: DataFrame, names: list[Column], key: str = "doc_id", text: str = "text", weights: dict[str, int] = WEIGHTS,
    percent: int = PERCENT, epochs: int = EPOCHS, seed: int = SEED,
) -> DataFrame:
    """The documents that the mix holds, with all their columns and ``mix_copies``."""
    marked, (*_, copies) = _marked(docs, names, key, text, weights, percent, epochs, seed)
    held = marked.filter(F.col(copies) > 0).select(*docs.columns, copies)
    return held.withColumnRenamed(copies, *unused(docs, "mix_copies"))
