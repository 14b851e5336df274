"""Vectors of texts from the vectors of their words."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from wordspace.functions.text import each, line_array, token_array
from wordspace.functions.vectors import length
from wordspace.operators.partial import OUTPUT_CELLS, plain_cells, read_cells
from wordspace.operators.sums import pack, sum_vectors
from wordspace.space import REAL_VECTOR, VectorSpace

# Room for the vectors of the most frequent words, sent to every executor.
FREQUENT_BYTES = 64 << 20

# Words for each of those whose vectors are sent compressed.
COMPRESSED = 7

# Room for the vectors of a block of texts in the task that finishes them.
BLOCK_BYTES = 384 << 20

# Places per cell from which a vector is compressed as its cells, not as all its places.
SPARSE = 4

# Occurrences of other words that are listed by word at once.
BLOCK_TOKENS = 1 << 20

# Bytes of rows of one block that are joined, and of all rows that wait for that.
JOINED_BYTES, HELD_BYTES = 1 << 20, 64 << 20


def mean_vector(lexicon: DataFrame, space: VectorSpace) -> DataFrame:
    """``(weight, vec)``: number of words and mean of their normalised vectors, one row."""
    rows = lexicon.select(
        F.lit(0).alias("key"), F.lit(1).cast("bigint").alias("weight"), F.col("vec")
    )
    total = sum_vectors(rows, space.size, real=True, unit=True, few=True)
    n = F.col("weight")
    return total.select(
        n,
        F.struct(F.col("vec.dims").alias("dims"), F.transform("vec.vals", lambda v: v / n).alias("vals")).alias("vec"),
    )


def _mean_array(lexicon: DataFrame, space: VectorSpace) -> np.ndarray:
    """The mean vector on the driver: ``size`` numbers, whatever the lexicon holds."""
    mean = np.zeros(space.size)
    row = mean_vector(lexicon, space).first()
    if row is not None:
        mean[row.vec.dims] = row.vec.vals
    return mean


def _frequent(words: DataFrame, space: VectorSpace) -> list[str]:
    """The most frequent words of a text collection, known or not, by falling frequency.

    At most as many as ``FREQUENT_BYTES`` holds vectors, a number fixed by ``size`` alone, and for each ``COMPRESSED`` more.
    Any word left out has less than one part in that number of all occurrences, so none
    of them can overload a task of the join that serves the rest.
    """
    room = _room(space) * (1 + COMPRESSED)
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(room).select("word").collect()
    return [row.word for row in top]


def _room(space: VectorSpace) -> int:
    return max(16, FREQUENT_BYTES // (8 * space.size))


def _numbered(batches, at_once: int = 1 << 10):
    """Sorted texts, so many at a time: ``(block, at, keys, tokens)``, ``at`` the number of each text's key in its block."""
    last, at = None, -1
    for batch in batches:
        for begin in range(0, batch.num_rows, at_once):
            part = batch.slice(begin, at_once)
            block, keys = part.column("block"), part.column("key")
            code, own = keys.dictionary_encode("encode").indices.to_numpy(), block.to_numpy()
            fresh = np.ones(part.num_rows, bool)
            fresh[1:] = (code[1:] != code[:-1]) | (own[1:] != own[:-1])
            fresh[0] = last is None or last != (own[0], keys[0].as_py())
            if last is None or last[0] != own[0]:
                at = -1
            numbers = at + np.cumsum(fresh)
            # A block begins at 0.
            starts = np.flatnonzero(own[1:] != own[:-1]) + 1
            for start in starts.tolist():
                numbers[start:] -= numbers[start]
            last, at = (own[-1], keys[-1].as_py()), int(numbers[-1])
            yield own, numbers, keys, part.column("tokens")


def _known(tokens: pa.ListArray, number_of) -> tuple[np.ndarray, np.ndarray]:
    """The number of every token and the text it is in, tokens numbered below 0 left out."""
    found = tokens.flatten().dictionary_encode()
    number = np.array([number_of(w) for w in found.dictionary.to_pylist()], np.int64)
    number = number[found.indices.to_numpy()] if number.size else number
    text = np.repeat(np.arange(len(tokens)), np.diff(tokens.offsets.to_numpy()))
    return number[number >= 0], text[number >= 0]


def _list_frequent(words_at):
    """Every text with the numbers of its frequent words."""

    def run(batches):
        row_of = words_at.value
        for block, at, keys, tokens in _numbered(batches):
            number, text = _known(tokens, lambda w: row_of.get(w, -1))
            edges = np.searchsorted(text, np.arange(len(tokens) + 1)).astype(np.int32)
            columns = [
                pa.array(block), pa.ListArray.from_arrays(pa.array(np.arange(at.size + 1, dtype=np.int32)), pa.array(at.astype(np.int32))),
                keys, pa.ListArray.from_arrays(pa.array(edges), pa.array(number.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["block", "at", "key", "words"])

    return run


def _list_rare(words_at, numbers_at=None):
    """Which texts of a block have a word that is not frequent, as often as they have it; a word has a row per so many tokens.

    With ``numbers_at`` only its words are listed, by their numbers there.
    """

    def rows(blocks, texts, words, names):
        block, text, word = (np.concatenate(side) for side in (blocks, texts, words))
        order = np.lexsort((text, block, word))
        block, text, word = block[order], text[order].astype(np.int32), word[order]
        first = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(block, prepend=-1) != 0))
        edges = np.append(first, word.size)
        step = max(1, OUTPUT_CELLS // 8)
        for lo in range(0, first.size, step):
            hi = min(lo + step, first.size)
            offsets = pa.array((edges[lo : hi + 1] - edges[lo]).astype(np.int32))
            texts = pa.ListArray.from_arrays(offsets, pa.array(text[edges[lo] : edges[hi]]))
            own = word[first[lo:hi]]
            if names is None:
                one = pa.ListArray.from_arrays(pa.array(np.arange(hi - lo + 1, dtype=np.int32)), pa.array(own.astype(np.int32)))
                columns = {"block": block[first[lo:hi]], "at": texts, "words": one, "kind": pa.array([""] * (hi - lo), pa.string())}
            else:
                columns = {"word": pa.array([names[i] for i in own.tolist()], pa.string()), "block": block[first[lo:hi]], "at": texts}
            yield pa.RecordBatch.from_pydict(columns)

    def run(batches):
        frequent = words_at.value
        fixed = numbers_at.value if numbers_at is not None else None
        numbers: dict[str, int] = {}

        def number_of(w):
            if fixed is not None:
                return fixed.get(w, -1)
            return -1 if w in frequent else numbers.setdefault(w, len(numbers))

        blocks, texts, words, held = [], [], [], 0
        for block, at, _, tokens in _numbered(batches):
            word, text = _known(tokens, number_of)
            blocks.append(block[text])
            texts.append(at[text])
            words.append(word)
            held += word.size
            if held > BLOCK_TOKENS:
                yield from rows(blocks, texts, words, list(numbers) if fixed is None else None)
                numbers, blocks, texts, words, held = {}, [], [], [], 0
        if held:
            yield from rows(blocks, texts, words, list(numbers) if fixed is None else None)

    return run


def _kind(vals: np.ndarray) -> str:
    """The narrowest type that holds the numbers."""
    if vals.dtype.kind == "f":
        return "f8"
    low, high = (vals.min(), vals.max()) if vals.size else (0, 0)
    return next(k for k in ("i1", "i2", "i8") if np.iinfo(k).min <= low and high <= np.iinfo(k).max)


def _compress(size: int):
    """``(word, factor, kind, cells, vec)``: compressed vectors, numbers as wide as they have to be.

    Of a sparse vector the gaps between its cells and their values, of another the values of all places: a sum of
    index vectors has few different numbers, which take some four bits each then where a packed cell takes four bytes.
    If all of a sparse vector are 1 or -1, a bit each, as it stands if it is too short to be compressed.
    """

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)
        for batch in batches:
            edges, dims, vals = read_cells(batch.column("vec"))
            factors, kinds, cells, packed = [], [], np.diff(edges), []
            for begin, end in zip(edges.tolist(), edges[1:].tolist()):
                dim, val = dims[begin:end].astype(np.int64), vals[begin:end]
                norm = np.linalg.norm(val)
                factors.append(1 / norm if norm > 0 else 0.0)
                kind = _kind(val)
                if SPARSE * val.size <= size:
                    gaps = np.diff(dim, prepend=-1) - 1
                    most = gaps.max(initial=0)
                    wide = next(k for k in ("u1", "u2", "u4") if most <= np.iinfo(k).max)
                    gaps = gaps.astype(wide).tobytes()
                    if kind == "i1" and (np.abs(val) == 1).all():
                        said = gaps + np.packbits(val < 0).tobytes()
                        less = codec.compress(said, asbytes=True)
                        kinds.append(wide + ("b1" if len(less) < len(said) else "b0"))
                        packed.append(min(said, less, key=len))
                        continue
                    kind, said = wide + kind, gaps + val.astype(kind).tobytes()
                else:
                    whole = np.zeros(size, kind)
                    whole[dim] = val
                    said = whole.tobytes()
                kinds.append(kind)
                packed.append(codec.compress(said, asbytes=True))
            columns = [
                batch.column("word"), pa.array(factors, pa.float64()), pa.array(kinds, pa.string()),
                pa.array(cells.astype(np.int32)), pa.array(packed, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["word", "factor", "kind", "cells", "vec"])

    return run


def _places_and_values(codec, kind: str, cells: int, vec: pa.Buffer, size: int):
    """A vector of :func:`_compress`: where its values go, and the values."""
    if kind[-2] == "b":
        gap = np.dtype(kind[:2])
        signs = -(-cells // 8)
        said = codec.decompress(vec, cells * gap.itemsize + signs) if kind[-1] == "1" else vec
        places = np.cumsum(np.frombuffer(said, gap, cells).astype(np.int64) + 1) - 1
        below = np.unpackbits(np.frombuffer(said, np.uint8, signs, cells * gap.itemsize), count=cells)
        return places, 1 - 2 * below.astype(np.int8)
    value = np.dtype(kind[-2:])
    if len(kind) == 2:
        return slice(None), np.frombuffer(codec.decompress(vec, size * value.itemsize), value)
    if not cells:
        return slice(0, 0), np.empty(0)
    gap = np.dtype(kind[:2])
    said = codec.decompress(vec, cells * (gap.itemsize + value.itemsize))
    places = np.cumsum(np.frombuffer(said, gap, cells).astype(np.int64) + 1) - 1
    return places, np.frombuffer(said, value, offset=cells * gap.itemsize)


def _join_rows(schema: pa.Schema):
    """``(block, rows)``: the rows of a block as compressed tables, of some megabyte each.

    What goes to a block are short rows, whose columns have much in common.
    """

    def run(batches):
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=1))
        held, sizes = {}, {}

        def joined(block):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, schema, options=options) as out:
                out.write_table(pa.Table.from_batches(held.pop(block)).combine_chunks())
            del sizes[block]
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["block", "rows"])

        for batch in batches:
            batch = batch.select(schema.names)
            blocks = batch.column("block").to_numpy()
            order = np.argsort(blocks, kind="stable")
            own, first = np.unique(blocks[order], return_index=True)
            batch = batch.take(pa.array(order))
            for block, lo, hi in zip(own.tolist(), first.tolist(), [*first[1:].tolist(), order.size]):
                # A copy, as a part would hold on to the whole.
                part = batch.slice(lo, hi - lo).take(pa.array(np.arange(hi - lo)))
                held.setdefault(block, []).append(part)
                sizes[block] = sizes.get(block, 0) + part.nbytes
                if sizes[block] > JOINED_BYTES:
                    yield joined(block)
            while sum(sizes.values()) > HELD_BYTES:
                yield joined(max(sizes, key=sizes.get))
        for block in list(held):
            yield joined(block)

    return run


def _part_rows(batches):
    """The rows of :func:`_join_rows`."""
    for batch in batches:
        for blob in batch.column("rows"):
            yield from pa.ipc.open_stream(blob.as_buffer())


def _add_blocks(key_type: pa.DataType, size: int, centre: np.ndarray, matrix_at, compressed_at):
    """``(key, weight, vec)`` of the texts of whole blocks, from their rows of :func:`_list_frequent` and of other words."""
    at_once = max(16, OUTPUT_CELLS // size)

    class Part:
        """The vectors of some keys in progress."""

        def __init__(self):
            self.sums = np.zeros((at_once, size))
            self.weights = np.zeros(at_once, np.int64)
            self.keys = [None] * at_once

        def finished(self):
            own = np.flatnonzero(self.weights)
            weights = self.weights[own]
            block = (self.sums[own] - weights[:, None] * centre).reshape(-1)
            at = np.flatnonzero(block != 0)
            vecs = plain_cells(np.searchsorted(at, np.arange(own.size + 1) * size), at % size, block[at])
            keys = pa.array([self.keys[i] for i in own.tolist()], key_type)
            return pa.RecordBatch.from_arrays([keys, pa.array(weights), vecs], ["key", "weight", "vec"])

    def run(batches):
        factor_of, matrix = matrix_at.value
        compressed = compressed_at.value
        codec = pa.Codec("zstd")
        parts: dict[tuple, Part] = {}

        def place(block, at):
            part = parts.get((block, at // at_once))
            if part is None:
                part = parts[block, at // at_once] = Part()
            return part, at % at_once

        for batch in _part_rows(batches):
            blocks, places = batch.column("block").to_pylist(), batch.column("at")
            starts, at = places.offsets.to_numpy().tolist(), places.values.to_numpy()
            words = batch.column("words")
            edges, words = words.offsets.to_numpy().tolist(), words.values.to_numpy()
            factors, kinds, cells = (batch.column(c).to_pylist() for c in ("factor", "kind", "cells"))
            keys, vecs = batch.column("key"), batch.column("vec")
            for i, kind in enumerate(kinds):
                if kind is None:
                    part, row = place(blocks[i], int(at[starts[i]]))
                    part.keys[row] = keys[i].as_py()
                    which, times = np.unique(words[edges[i] : edges[i + 1]], return_counts=True)
                    if which.size:
                        part.weights[row] += edges[i + 1] - edges[i]
                        part.sums[row] += (times * factor_of[which]) @ matrix[which]
                    continue
                own = [(factors[i], kind, cells[i], vecs[i].as_buffer())] if kind else compressed[words[edges[i]]]
                for factor, *vec in own:
                    where, values = _places_and_values(codec, *vec, size)
                    values = values * factor
                    for one in at[starts[i] : starts[i + 1]].tolist():
                        part, row = place(blocks[i], one)
                        part.weights[row] += 1
                        part.sums[row][where] += values
        while parts:
            done = parts.popitem()[1].finished()
            if done.num_rows:
                yield done

    return run


def _words(spark, words: list[str], name: str = "word") -> DataFrame:
    return spark.createDataFrame([(word,) for word in words], f"{name} string")


def _rows_of(lexicon: DataFrame, words: list[str]) -> DataFrame:
    """The rows of a bounded number of words."""
    return lexicon.join(F.broadcast(_words(lexicon.sparkSession, words, "key")), "key", "left_semi")


def _matrix(frequent: DataFrame, size: int) -> tuple[dict, np.ndarray, np.ndarray]:
    """Keys, reciprocal lengths and vectors of a bounded number of lexicon rows, numbers as wide as they have to be."""
    rows = frequent.toArrow()
    vecs = rows.column("vec").combine_chunks()
    if isinstance(vecs, pa.ChunkedArray):
        vecs = pa.concat_arrays(vecs.chunks) if vecs.num_chunks else pa.array([], vecs.type)
    dims, vals = vecs.field("dims"), vecs.field("vals").flatten().to_numpy()
    row = np.repeat(np.arange(len(vecs)), np.diff(dims.offsets.to_numpy()))
    matrix = np.zeros((len(vecs), size), _kind(vals))
    matrix[row, dims.flatten().to_numpy()] = vals
    lengths = np.sqrt(np.bincount(row, np.square(vals, dtype=np.float64), minlength=len(vecs)))
    factors = np.divide(1.0, lengths, out=np.zeros(len(vecs)), where=lengths > 0)
    return {key: i for i, key in enumerate(rows.column("key").to_pylist())}, factors, matrix


def text_vectors(
    texts: DataFrame, lexicon: DataFrame, space: VectorSpace,
    key: str = "doc_id", text: str = "text", unit: str = "token",
) -> DataFrame:
    """``(key, weight, vec)``: sum of normalised word vectors less their mean, per key.

    ``weight`` is the number of known words; keys without any have no row. Texts of the
    same key are added up, also those without a key. With ``unit='line'`` each line is looked up whole, as for a
    file that lists one word per line.

    Texts are dealt to blocks by key, as many as the vectors of a block's keys may take room in a task, and every vector is
    finished in the task of its block: none of a text is ever shuffled. The most frequent words are added there from a
    matrix of bounded size, the next from a bounded number of compressed vectors that every block has. The others meet their
    vectors in a join by word, once per block that has them, and go to the block compressed. The mean is taken off once per
    finished vector, in proportion to ``weight``.
    """
    spark = texts.sparkSession
    sc = spark.sparkContext
    split = {"token": token_array, "line": line_array}[unit]
    named = texts.filter(F.col(text).isNotNull()).select(F.col(key).alias("key"), F.col(text).alias("text"))
    key_type = named.schema["key"].dataType

    frequent = _frequent(each(named, split(F.col("text")), "word", "key"), space)
    most, more = frequent[: _room(space)], frequent[_room(space) :]
    row_of, *vectors = _matrix(_rows_of(lexicon, most), space.size)
    compress = _compress(space.size)
    units = lexicon.select(F.col("key").alias("word"), "vec")
    unit = "word string, factor double, kind string, cells int, vec binary"
    number_of, compressed = {}, []
    for batch in _rows_of(lexicon, more).select(F.col("key").alias("word"), "vec").mapInArrow(compress, unit).toArrow().to_batches():
        for word, factor, kind, cells, vec in zip(*(column.to_pylist() for column in batch.columns)):
            if word not in number_of:
                number_of[word] = len(compressed)
                compressed.append([])
            compressed[number_of[word]].append((factor, kind, cells, vec))
    listed = sc.broadcast(frozenset(frequent))

    blocks = max(sc.defaultParallelism, math.ceil(named.count() * 8 * space.size / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int")
    dealt = named.withColumn("block", block).repartitionById(blocks, "block").sortWithinPartitions("block", "key")
    rows = dealt.select("block", "key", split(F.col("text")).alias("tokens"))
    name = key_type.simpleString()
    here = rows.mapInArrow(_list_frequent(sc.broadcast(row_of)), f"block int, at array<int>, key {name}, words array<int>")
    between = rows.mapInArrow(_list_rare(listed, sc.broadcast(number_of)), "block int, at array<int>, words array<int>, kind string")
    counted = rows.mapInArrow(_list_rare(listed), "word string, block int, at array<int>")
    # Dealt by word, rows are grouped and joined where they are.
    grouped = counted.repartition("word").groupBy("word", "block").agg(F.flatten(F.collect_list("at")).alias("at"))
    others = units.join(F.broadcast(_words(spark, frequent)), "word", "left_anti").mapInArrow(compress, unit)
    there = grouped.join(others, "word").drop("word")
    met = here.unionByName(between, allowMissingColumns=True).unionByName(there, allowMissingColumns=True)
    lists = pa.list_(pa.int32())
    schema = pa.schema(
        [
            ("block", pa.int32()), ("at", lists), ("key", to_arrow_type(key_type)), ("words", lists),
            ("factor", pa.float64()), ("kind", pa.string()), ("cells", pa.int32()), ("vec", pa.binary()),
        ]
    )
    joined = met.mapInArrow(_join_rows(schema), "block int, rows binary").repartitionById(blocks, "block")
    kernel = _add_blocks(to_arrow_type(key_type), space.size, _mean_array(lexicon, space), sc.broadcast(vectors), sc.broadcast(compressed))
    return joined.mapInArrow(kernel, f"key {name}, weight bigint, vec {REAL_VECTOR}")


def common_vectors(
    texts: DataFrame, lexicon: DataFrame, space: VectorSpace, key: str = "doc_id", text: str = "text", unit: str = "token",
) -> DataFrame:
    """As :func:`text_vectors` for a few keys, each of many texts.

    Words are counted by key before they meet their vectors, and added up right after the join by word: a vector is shuffled
    once, and a sum once per key and task.
    """
    split = {"token": token_array, "line": line_array}[unit]
    words = each(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), split(F.col("text")), "word", "key")
    counted = words.groupBy("word", "key").count()
    one = F.lit(1).cast("bigint").alias("weight")
    factor = F.coalesce(1 / F.nullif(length(F.col("vec")), F.lit(0.0)), F.lit(0.0))
    units = pack(lexicon.select(F.col("key").alias("word"), one, factor.alias("factor"), "vec"), space.size)
    n = F.col("count")
    joined = counted.join(units, "word").select("key", (n * F.col("weight")).alias("weight"), (n * F.col("factor")).alias("factor"), "vec")
    return sum_vectors(joined, space.size, real=True, centre=_mean_array(lexicon, space), few=True)
