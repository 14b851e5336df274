"""Near duplicates by improved consistent weighted sampling (Ioffe 2010).

A text is its runs of five words with TF-IDF weights. For each of 48 sampling functions a
text keeps one (shingle, level) such that two texts keep the same one with a probability
equal to their weighted Jaccard similarity. Twelve bands of four samples make candidates;
links are verified by the exact similarity of the whole texts, and classes are the
components of the links.

Document frequencies come from a count-min sketch of fixed size over all texts, so the
weights depend on the share of texts a shingle is in, and behave alike at every size.

Equal texts are one text from the start. Texts of a band's bucket are compared by their
samples, in blocks of bounded size, and each block hands on one row per text: the first text
it hangs together with through pairs half of whose samples agree. The components of those rows
are sets of texts that may be classes. In each, again in bounded blocks, the similarity of all
such pairs is computed exactly, whether they share a band or not, and a block hands on one row
per text: the first text it is linked to, and how many links it has. So a group of copies costs
rows as many as its texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordspace.llm.components import components
from wordspace.llm.packed import squeeze, unsqueeze
from wordspace.llm.removal import bounded, survivors
from wordspace.llm.words import mix, pieces, word_hashes
from wordspace.sources.scratch import materialize

SHINGLE = 5
THRESHOLD = 0.8
#: How much more the rarest shingles weigh than one that all texts have. Texts that differ do so in
#: rare shingles, so a large factor would push copies below the threshold.
RARITY = 0.25
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
#: Samples of two texts that have to agree for an exact comparison: 5 standard deviations below the mean
#: at the threshold, so of a million pairs there about one is passed over.
AGREE = 24
#: Texts of a bucket that are compared by their samples at once.
BLOCK = 1024
#: Bytes of texts that are compared exactly at once.
TEXT_BLOCK = 1 << 20

_DEPTH, _WIDTH, _CHUNK = 2, 1 << 20, 1 << 14
_LOW = (1 << 44) - 1


def text_id(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")).cast("binary"))


def shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(text number, shingle, how often)`` of the distinct shingles of each text, in order.

    A text of fewer words than a shingle is one shingle; one without words has none.
    """
    hashes, bounds = word_hashes(column)
    counts = np.diff(bounds)
    width = np.minimum(np.repeat(counts, counts), SHINGLE)
    text = np.repeat(np.arange(counts.size), counts)
    place = np.arange(hashes.size) - np.repeat(bounds[:-1], counts)
    start = place <= np.repeat(counts, counts) - width
    run = np.zeros(hashes.size, np.uint64)
    for step in range(SHINGLE):
        part = hashes[step:] * np.uint64(0x9E3779B97F4A7C15 + 2 * step * 0x632BE59BD9B4E019 & (1 << 64) - 1 | 1)
        run[: part.size] += np.where(width[: part.size] > step, mix(part + np.uint64(step)), np.uint64(0))
    keys = text[start].astype(np.uint64) << np.uint64(44) | mix(run[start]) >> np.uint64(20)
    keys.sort()
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if keys.size else np.empty(0, np.int64)
    often = np.diff(np.append(first, keys.size))
    keys = keys[first]
    return (keys >> np.uint64(44)).astype(np.int64), keys & np.uint64(_LOW), often


def _cells(shingle: np.ndarray, row: int) -> np.ndarray:
    return (shingle * np.uint64((0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[row]) >> np.uint64(44)).astype(np.int64)


def _count(batches):
    sketch, texts = np.zeros((_DEPTH, _WIDTH), np.int64), 0
    for batch in batches:
        for piece in pieces(batch, "text"):
            texts += piece.num_rows
            shingle = shingles(piece.column("text"))[1]
            for row in range(_DEPTH):
                sketch[row] += np.bincount(_cells(shingle, row), minlength=_WIDTH)
    parts = sketch.reshape(-1, _CHUNK)
    used = np.flatnonzero(parts.any(axis=1))
    yield pa.RecordBatch.from_pydict(
        {"chunk": [*used.tolist(), -1], "counts": [*(squeeze(parts[i]) for i in used), squeeze(np.array([texts]))]},
        pa.schema([("chunk", pa.int64()), ("counts", pa.binary())]),
    )


def _add_up(batches):
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for chunk, counts in zip(batch.column("chunk").to_pylist(), batch.column("counts")):
            own = unsqueeze(counts.as_py(), 1 if chunk < 0 else _CHUNK, np.int64)
            sums[chunk] = sums[chunk] + own if chunk in sums else own
    yield pa.RecordBatch.from_pydict(
        {"chunk": list(sums), "counts": [squeeze(v) for v in sums.values()]},
        pa.schema([("chunk", pa.int64()), ("counts", pa.binary())]),
    )


def rarity(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Per cell of the sketch, 1 + RARITY log(1 + N/n) / log(1 + N) for n of N texts.

    The sketch is a few MB whatever the input; map tasks send on the parts they used, and
    sums of parts are taken as they stream past.
    """
    ddl = "chunk bigint, counts binary"
    counted = docs.select(F.col(text).alias("text")).mapInArrow(_count, ddl)
    added = materialize(counted.repartition("chunk").mapInArrow(_add_up, ddl))
    sketch, texts = np.zeros(_DEPTH * _WIDTH, np.int64), 0
    for row in added.collect():
        if row.chunk < 0:
            texts = int(unsqueeze(row.counts, 1, np.int64)[0])
        else:
            sketch[row.chunk * _CHUNK : (row.chunk + 1) * _CHUNK] = unsqueeze(row.counts, _CHUNK, np.int64)
    share = np.log1p(texts / np.maximum(sketch, 1)) / np.log1p(max(texts, 1))
    return (1 + RARITY * np.minimum(share, 1)).astype(np.float32).reshape(_DEPTH, _WIDTH)


def weights(shingle: np.ndarray, often: np.ndarray, rare: np.ndarray) -> np.ndarray:
    found = rare[0][_cells(shingle, 0)]
    for row in range(1, _DEPTH):
        np.maximum(found, rare[row][_cells(shingle, row)], out=found)
    return found * often.astype(np.float32)


class Sampler:
    """Consistent weighted samples of many texts at once.

    The random numbers of a shingle under a sampling function are read from tables by a
    hash of the two; equal values are told apart by further bits of that hash.
    """

    def __init__(self, samples: int = SAMPLES):
        random = np.random.default_rng(20)
        size = 1 << 16
        self.r = random.gamma(2, 1, size).astype(np.float32)
        self.log_c = np.log(random.gamma(2, 1, size)).astype(np.float32)
        self.beta = random.random(size).astype(np.float32)
        self.inverse = 1 / self.r
        self.factors = random.integers(1, 1 << 63, samples, dtype=np.uint64) | np.uint64(1)

    def __call__(self, begins: np.ndarray, shingle: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """One row per text (its shingles begin at ``begins``), one 64-bit sample per function."""
        out = np.empty((begins.size, self.factors.size), np.uint64)
        log_w, spread = np.log(weight), mix(shingle)
        for k, factor in enumerate(self.factors):
            hashed = spread * factor
            at = (hashed >> np.uint64(48)).astype(np.int32)
            r, beta = self.r[at], self.beta[at]
            level = np.floor(log_w * self.inverse[at] + beta)
            # Positive throughout, so the bits of the numbers sort like the numbers.
            value = self.log_c[at] - r * (level - beta + 1) + np.float32(256)
            order = np.maximum(value, np.float32(0)).view(np.uint32).astype(np.uint64) << np.uint64(32)
            order |= hashed >> np.uint64(16) & np.uint64(0xFFFFFFFF)
            out[:, k] = mix(np.minimum.reduceat(order, begins))
        return out


def _sign(rare):
    def task(batches):
        sampler, table = Sampler(), rare.value
        for batch in batches:
            for piece in pieces(batch, "text"):
                text, shingle, often = shingles(piece.column("text"))
                begins = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1]))) if text.size else np.empty(0, np.int64)
                if not begins.size:
                    continue
                samples = sampler(begins, shingle, weights(shingle, often, table))
                keys = np.zeros((begins.size, BANDS), np.uint64)
                for row in range(ROWS):
                    keys = mix(keys + samples[:, row::ROWS])
                short = np.ascontiguousarray(samples.astype(np.uint16)).view(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("id").take(pa.array(text[begins])),
                        pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.view(np.int64).ravel())),
                        pa.array([row.tobytes() for row in short], pa.binary()),
                    ],
                    ["id", "keys", "samples"],
                )

    return task


def _agreeing(samples: np.ndarray, rows: np.ndarray, columns: np.ndarray, least: int) -> np.ndarray:
    """Which rows agree with which columns often enough."""
    agree = np.zeros((rows.size, columns.size), np.int16)
    for k in range(SAMPLES):
        agree += samples[rows, k][:, None] == samples[columns, k][None]
    return agree >= least


def _first_linked(size: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``size`` numbers hangs together with by the pairs given."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _sides(table: pa.Table, key) -> tuple[np.ndarray, np.ndarray]:
    """The rows of the two blocks of a group."""
    block, left, right = np.asarray(table.column("block")), key[1].as_py(), key[2].as_py()
    rows = np.flatnonzero(block == left)
    return rows, rows if left == right else np.flatnonzero(block == right)


def _samples(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("samples").to_pylist()), np.uint16).reshape(-1, SAMPLES)


NEAR = pa.schema([("a", pa.string()), ("b", pa.string()), ("n", pa.int64())])
NEAR_DDL = "a string, b string, n bigint"


def _near(ids: pa.ChunkedArray, left: list, right: list) -> pa.Table:
    """One row per text with a partner: the first text it hangs together with, and its partners.

    The first is the one of the smallest id, so that blocks that share it give the same rows.
    """
    left = np.concatenate(left) if left else np.empty(0, np.int64)
    right = np.concatenate(right) if right else np.empty(0, np.int64)
    order = pc.sort_indices(ids).to_numpy().astype(np.int64)
    place = np.argsort(order)
    label = order[_first_linked(len(ids), place[left], place[right])][place]
    partners = np.bincount(left, minlength=len(ids)) + np.bincount(right, minlength=len(ids))
    some = np.flatnonzero(partners)
    columns = [ids.take(pa.array(some)), ids.take(pa.array(label[some])), pa.chunked_array([pa.array(partners[some])])]
    return pa.Table.from_arrays(columns, schema=NEAR)


def _by_samples(key, table):
    samples, (rows, columns) = _samples(table), _sides(table, key)
    left, right = [], []
    for begin in range(0, rows.size, 128):
        some = rows[begin : begin + 128]
        i, j = np.nonzero(_agreeing(samples, some, columns, AGREE))
        less = some[i] != columns[j] if key[1] != key[2] else some[i] < columns[j]
        left.append(some[i][less])
        right.append(columns[j][less])
    return _near(table.column("id"), left, right)


def _by_text(rare, threshold: float):
    def group(key, table):
        samples, (rows, columns) = _samples(table), _sides(table, key)
        text, shingle, often = shingles(table.column("text").combine_chunks())
        weight = weights(shingle, often, rare.value).astype(np.float64)
        _, place = np.unique(shingle, return_inverse=True)
        bounds = np.searchsorted(text, np.arange(table.num_rows + 1))
        total = np.bincount(text, weight, table.num_rows)
        # All entries of the columns side by side; one row at a time is laid out over all shingles.
        entries = np.concatenate([np.arange(bounds[c], bounds[c + 1]) for c in columns]) if columns.size else np.empty(0, np.int64)
        owner = np.repeat(np.arange(columns.size), np.diff(bounds)[columns])
        own_place, own_weight = place[entries], weight[entries]
        dense = np.zeros(int(place.max(initial=-1)) + 1)
        left, right = [], []
        for begin in range(0, rows.size if columns.size else 0, 128):
            some = rows[begin : begin + 128]
            agreeing = _agreeing(samples, some, columns, AGREE)
            for row, partners in zip(some, agreeing):
                if key[1] == key[2]:
                    partners = partners & (columns > row)
                if not partners.any():
                    continue
                mine = slice(bounds[row], bounds[row + 1])
                dense[place[mine]] = weight[mine]
                looked = partners[owner]
                common = np.bincount(owner[looked], np.minimum(dense[own_place[looked]], own_weight[looked]), columns.size)
                dense[place[mine]] = 0
                linked = partners & (common >= threshold * (total[row] + total[columns] - common) - 1e-9)
                right.append(columns[linked])
                left.append(np.full(right[-1].size, row))
        return _near(table.column("id"), left, right)

    return group


def _in_blocks(rows: DataFrame, key: str, compare) -> DataFrame:
    """``rows`` with ``blocks`` and a ``block`` each; block i meets each block j once, as the left one if i <= j."""
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = rows.withColumn("with", other).withColumns({"left": F.least("block", "with"), "right": F.greatest("block", "with")})
    return met.drop("with", "blocks").groupBy(key, "left", "right").applyInArrow(compare, NEAR_DDL)


def _may_be_near(signed: DataFrame) -> DataFrame:
    """``(node, label)``: the texts whose samples agree often enough with another's, and a label per set."""
    banded = signed.select("id", F.posexplode("keys").alias("band", "key")).select("id", F.xxhash64("band", "key").alias("key"))
    banded = materialize(banded)
    # Buckets of the same texts, as copies make in most bands, are compared once.
    same = [F.bit_xor(F.xxhash64("id", F.lit(salt))).alias(f"set{salt}") for salt in (0, 1)]
    buckets = banded.groupBy("key").agg(F.count("*").alias("size"), *same).filter("size > 1")
    buckets = buckets.groupBy("size", "set0", "set1").agg(F.min("key").alias("key"))
    buckets = buckets.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    members = banded.join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    members = members.join(signed.select("id", "samples"), "id")
    return components(_in_blocks(members, "key", _by_samples).select("a", "b").distinct())


def links(docs: DataFrame, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(node, label, n_links)`` by ``text_id``: each distinct text linked to another, its class and links."""
    spark = docs.sparkSession
    # Weights count every document; samples are compared once per distinct text.
    rare = spark.sparkContext.broadcast(rarity(docs, text))
    rows = docs.select(text_id(F.col(text)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    signed = materialize(rows.mapInArrow(_sign(rare), "id string, keys array<bigint>, samples binary").dropDuplicates(["id"]))
    near = _may_be_near(signed).withColumnRenamed("node", "id")
    texts = rows.join(bounded(near), "id").dropDuplicates(["id"])
    texts = materialize(texts.join(signed.select("id", "samples"), "id"))
    sizes = texts.groupBy("label").agg(F.ceil(F.sum(F.octet_length("text") + 64) / TEXT_BLOCK).cast("int").alias("blocks"))
    placed = texts.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    found = materialize(_in_blocks(placed, "label", _by_text(rare, threshold)))
    counts = found.groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n_links"))
    return components(found.select("a", "b").distinct()).join(counts, "node")


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(key, class_id, class_size, n_links, kept)``, one row per row of ``docs``.

    ``class_id`` is the smallest id of the class (null ids last) and the row that is kept;
    of rows alike in id and text one is. ``n_links`` counts the verified links of the row's
    text to other texts. Texts without words, null ones too, are alike only if equal.
    """
    return _classes(docs, key, text, threshold).drop("mark")


def _classes(docs: DataFrame, key: str, text: str, threshold: float) -> DataFrame:
    rows = docs.select(F.col(key).alias("doc"), text_id(F.col(text)).alias("mark"), F.monotonically_increasing_id().alias("row"))
    named = links(docs, text, threshold).withColumnRenamed("node", "mark")
    rows = materialize(
        rows.join(named, "mark", "left").withColumns(
            {"label": F.coalesce("label", "mark"), "n_links": F.coalesce("n_links", F.lit(0).cast("bigint"))}
        )
    )
    first = F.min(F.struct(F.col("doc").isNull(), F.col("doc"), F.col("row"))).alias("first")
    groups = rows.groupBy("label").agg(first, F.count("*").alias("class_size"))
    return rows.join(groups, "label").select(
        F.col("doc").alias(key), F.col("first.doc").alias("class_id"), "class_size", "n_links",
        (F.col("row") == F.col("first.row")).alias("kept"), "mark",
    )


def drop_near(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, with all its columns."""
    found = _classes(docs, key, text, threshold)
    return survivors(docs, key, text_id(F.col(text)), materialize(found.select(F.col(key).alias("id"), "mark", "kept")))
