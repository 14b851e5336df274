"""Comparing vectors: given pairs, all pairs, and the best matches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordspace.functions.vectors import cosine_function
from wordspace.operators.documents import FREQUENT_BYTES
from wordspace.sources.scratch import materialize
from wordspace.space import REAL_VECTOR, VectorSpace

# Room for the rows of a block and for the product of two.
BLOCK_BYTES = 32 << 20

# Room for the right side of a search for best matches that is sent to every worker at once,
# and how many such blocks the left side is taken past before block pairs are cheaper.
BROADCAST_BYTES = 64 << 20
BROADCASTS = 8

# How many vectors the others are placed by, and rings of equal width about each, for a search above a threshold.
PIVOTS = 16
RINGS = 32
# Room for what rounding does to an angle.
ANGLE_SLACK = 1e-6

# Similarities that differ by less than this many decimals rank by name.
RANK_DECIMALS = 12


def compare(vectors: DataFrame, pairs: DataFrame, space: VectorSpace, a: str = "a", b: str = "b") -> DataFrame:
    """``pairs`` with the similarity of the vectors named in two columns.

    NULL where a vector is missing or zero. The vectors the pairs name are picked out
    first and written, so the vector table is read once and only those rows go on.

    The keys named most often are served last, by broadcast: at most ``FREQUENT_BYTES`` of
    vectors whatever the data. The joins by key before that carry no vector but those of
    the other keys, each of which names less than one part in that many of the rows; rows
    with a frequent key pass through them spread by a hash of their own.
    """
    both = pairs.select(F.explode(F.array(a, b)).alias("key"))
    counts = materialize(both.filter(F.col("key").isNotNull()).groupBy("key").count())
    wanted = materialize(vectors.select("key", "vec").join(counts, "key", "left_semi"))
    room = max(16, FREQUENT_BYTES // (8 * space.size))
    top = counts.orderBy(F.desc("count"), "key").limit(room).select("key")
    frequent = wanted.join(F.broadcast(top), "key", "left_semi")

    rows = pairs
    for key in (a, b):
        marked = top.select(F.col("key").alias(key), F.lit(True).alias(f"_often_{key}"))
        rows = rows.join(F.broadcast(marked), key, "left")
    for key in (a, b):
        often = F.col(f"_often_{key}").isNotNull()
        rows = rows.withColumn(f"_key_{key}", F.when(~often, F.col(key))).withColumn(
            f"_salt_{key}", F.when(often, F.xxhash64(a, b)).otherwise(0)
        )
        seldom = wanted.select(
            F.col("key").alias(f"_key_{key}"),
            # Always 0, in a form the optimizer keeps as a join key.
            F.expr("pmod(xxhash64(key), 1L)").alias(f"_salt_{key}"),
            F.col("vec").alias(f"_seldom_{key}"),
        )
        rows = rows.join(seldom, [f"_key_{key}", f"_salt_{key}"], "left")
    for key in (a, b):
        rows = rows.join(F.broadcast(frequent.select(F.col("key").alias(key), F.col("vec").alias(f"_vec_{key}"))), key, "left")
    vecs = [F.coalesce(f"_vec_{key}", f"_seldom_{key}") for key in (a, b)]
    return rows.select(*pairs.columns, cosine_function(space.size)(*vecs).alias("similarity"))


def _unit_rows(column: pa.ChunkedArray, size: int) -> np.ndarray:
    matrix = np.zeros((len(column), size))
    at = 0
    for vecs in column.chunks:
        dims = vecs.field("dims")
        row = at + np.repeat(np.arange(len(vecs)), np.diff(dims.offsets.to_numpy()))
        matrix[row, dims.flatten().to_numpy()] = vecs.field("vals").flatten().to_numpy()
        at += len(vecs)
    lengths = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, lengths, out=np.full_like(matrix, np.nan), where=lengths > 0)


def _best(sims: np.ndarray, names: np.ndarray, top: int, ascending: bool) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the ``top`` best similarities of each row, ties by name, NaN last."""
    ranks = np.round(sims if ascending else -sims, RANK_DECIMALS)
    if top < ranks.shape[1]:
        bound = np.partition(ranks, top - 1, axis=1)[:, top - 1 : top]
        # NaN sorts last, so a row that needs some of it has no bound.
        rows, columns = np.nonzero((ranks <= bound) | np.isnan(bound))
    else:
        rows, columns = np.indices(ranks.shape).reshape(2, -1)
    order = np.lexsort((names[columns], ranks[rows, columns], rows))
    rows, columns = rows[order], columns[order]
    first = np.searchsorted(rows, np.arange(ranks.shape[0]))
    kept = np.arange(rows.size) - first[rows] < top
    return rows[kept], columns[kept]


def _block_product(size: int, top: int | None, ascending: bool):
    """Similarities of the rows of two blocks; only the best ``top`` per left row if given."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sims = _unit_rows(left.column("left_vec"), size) @ _unit_rows(right.column("right_vec"), size).T
        shape = sims.shape
        if top is None or top >= shape[1]:
            rows = np.repeat(np.arange(shape[0]), shape[1])
            cols = np.tile(np.arange(shape[1]), shape[0])
        else:
            names = np.argsort(np.argsort(np.array(right.column("right_key").to_pylist(), dtype=object)))
            rows, cols = _best(sims, names, top, ascending)
        values = sims[rows, cols]
        return pa.table(
            {
                "left_key": left.column("left_key").take(pa.array(rows)),
                "right_key": right.column("right_key").take(pa.array(cols)),
                "similarity": pa.array(values, mask=np.isnan(values)),
            }
        )

    return run


def _past_broadcast(size: int, top: int, ascending: bool, block):
    """Similarities of streamed left rows with the best of a block that every worker holds."""

    def run(batches):
        keys, matrix = block.value
        names = np.argsort(np.argsort(np.array(keys.to_pylist(), dtype=object)))
        step = max(1, min(BLOCK_BYTES // (8 * size), BLOCK_BYTES // (8 * max(1, len(keys)))))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                sims = _unit_rows(pa.chunked_array([part.column("left_vec")]), size) @ matrix.T
                rows, cols = _best(sims, names, top, ascending)
                values = sims[rows, cols]
                found = [part.column("left_key").take(pa.array(rows)), keys.take(pa.array(cols)), pa.array(values, mask=np.isnan(values))]
                yield pa.RecordBatch.from_arrays(found, ["left_key", "right_key", "similarity"])

    return run


def _best_past_broadcasts(left, right, space, top, ascending, count):
    """The left rows stay where they are; the right ones come to them in blocks of bounded size."""
    plain = left.select(F.col("key").alias("left_key"), F.col("vec").cast(REAL_VECTOR).alias("left_vec"))
    own = right.select("key", F.col("vec").cast(REAL_VECTOR).alias("vec"))
    kinds = tuple(side.schema["key"].dataType.simpleString() for side in (left, right))
    found = None
    for number in range(count):
        part = own if count == 1 else own.filter(F.expr(f"pmod(xxhash64(key), {count}L) = {number}"))
        rows = part.toArrow()
        block = left.sparkSession.sparkContext.broadcast((rows.column("key").combine_chunks(), _unit_rows(rows.column("vec"), space.size)))
        some = plain.mapInArrow(
            _past_broadcast(space.size, top, ascending, block), "left_key {}, right_key {}, similarity double".format(*kinds)
        )
        found = some if found is None else found.unionByName(some)
    return found


def all_similarities(
    left: DataFrame, right: DataFrame, space: VectorSpace, top: int | None = None, ascending: bool = False
) -> DataFrame:
    """``(left_key, right_key, similarity)`` of every left vector with every right one.

    Both sides are cut into blocks by hash such that rows and product of two blocks are
    bounded, and each task multiplies one pair of blocks, so no task ever holds a whole
    side. The result is quadratic unless ``top`` asks for the best matches only. Then a
    right side of some broadcast blocks is sent past the left rows, which are not
    shuffled; beyond that, a pair of blocks passes on ``top`` per left row. Both inputs are
    counted first; pass written tables.
    """
    if top is not None:
        blocks = max(1, -(-right.count() * 8 * space.size // BROADCAST_BYTES))
        if blocks <= BROADCASTS:
            return _ranked(_best_past_broadcasts(left, right, space, top, ascending, blocks), top, ascending)
    block = max(1, min(BLOCK_BYTES // (8 * space.size), int((BLOCK_BYTES // 8) ** 0.5)))
    blocks_left = max(1, -(-left.count() // block))
    blocks_right = max(1, -(-right.count() // block))

    # Each side gets column names of its own: both may be the same table.
    def cut(rows: DataFrame, side: str, own: int, other: int) -> DataFrame:
        return rows.select(
            F.col("key").alias(f"{side}_key"),
            F.col("vec").cast(REAL_VECTOR).alias(f"{side}_vec"),
            F.expr(f"pmod(xxhash64(key), {own}L)").alias(f"{side}_own"),
            F.explode(F.expr(f"sequence(0L, {other - 1}L)")).alias(f"{side}_other"),
        )

    a = cut(left, "left", blocks_left, blocks_right).groupBy("left_own", "left_other")
    b = cut(right, "right", blocks_right, blocks_left).groupBy("right_other", "right_own")
    key_types = tuple(side.schema["key"].dataType.simpleString() for side in (left, right))
    found = a.cogroup(b).applyInArrow(
        _block_product(space.size, top, ascending),
        "left_key {}, right_key {}, similarity double".format(*key_types),
    )
    return found if top is None else _ranked(found, top, ascending)


def _ranked(found: DataFrame, top: int, ascending: bool) -> DataFrame:
    """The ``top`` best right keys of each left one, with their rank."""
    rank = F.round("similarity", RANK_DECIMALS)
    order = [rank.asc_nulls_last() if ascending else rank.desc_nulls_last(), F.col("right_key")]
    best = F.row_number().over(Window.partitionBy("left_key").orderBy(*order))
    return found.withColumn("rank", best).filter(F.col("rank") <= top)


def _placed(size: int, pivots: np.ndarray):
    """Rows with their angles to every pivot, and their cell: the nearest pivot and the ring about it."""

    def run(batches):
        step = max(1, BLOCK_BYTES // (8 * size))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                cosines = _unit_rows(pa.chunked_array([part.column("vec")]), size) @ pivots.T
                some = np.flatnonzero(~np.isnan(cosines[:, 0]))
                angles = np.arccos(np.clip(cosines[some], -1, 1))
                nearest = angles.argmin(axis=1)
                ring = np.minimum(angles[np.arange(some.size), nearest] * (RINGS / np.pi), RINGS - 1).astype(np.int32)
                edges = pa.array(np.arange(0, angles.size + 1, len(pivots), dtype=np.int32))
                columns = [pa.array(nearest.astype(np.int32) * RINGS + ring), pa.ListArray.from_arrays(edges, pa.array(angles.ravel()))]
                columns += [part.column(c).take(pa.array(some)) for c in ("key", "vec")]
                yield pa.RecordBatch.from_arrays(columns, ["cell", "angles", "key", "vec"])

    return run


def _reach(placed: DataFrame, pivots: int, block: int) -> list[dict]:
    """Cells joined to about a block each: their rows, and the least and largest angle to every pivot.

    At most ``PIVOTS`` x ``RINGS`` cells come to the driver, whatever the data. Only rings of one pivot are joined.
    """
    spans = placed.select("cell", F.posexplode("angles").alias("pivot", "angle"))
    spans = spans.groupBy("cell", "pivot").agg(F.count("*").alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high"))
    cells: dict[int, dict] = {}
    for row in spans.collect():
        cell = cells.setdefault(row.cell, {"cells": [row.cell], "low": np.zeros(pivots), "high": np.zeros(pivots)})
        cell["rows"], cell["low"][row.pivot], cell["high"][row.pivot] = row.rows, row.low, row.high
    joined: list[dict] = []
    for number in sorted(cells):
        cell = cells[number]
        last = joined[-1] if joined else None
        if last and last["cells"][0] // RINGS == number // RINGS and last["rows"] + cell["rows"] <= block:
            last["cells"].append(number)
            last["rows"] += cell["rows"]
            last["low"], last["high"] = np.minimum(last["low"], cell["low"]), np.maximum(last["high"], cell["high"])
        else:
            joined.append(cell)
    return joined


def near_areas(left: list[dict], right: list[dict], least: float) -> list[tuple[int, int]]:
    """Which areas can hold a pair of vectors with a similarity of ``least``.

    Angles obey the triangle inequality: two vectors are no closer than their angles to any pivot differ.
    """
    if not left or not right:
        return []
    widest = np.arccos(np.clip(least, -1, 1)) + ANGLE_SLACK
    low, high = (np.array([area[side] for area in right]) for side in ("low", "high"))
    found = []
    for number, area in enumerate(left):
        gap = np.maximum(area["low"] - high, low - area["high"]).max(axis=1)
        found += [(number, int(other)) for other in np.flatnonzero(gap <= widest)]
    return found


def _above(size: int, least: float):
    """The similarities of two blocks that reach ``least``."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        sims = _unit_rows(left.column("left_vec"), size) @ _unit_rows(right.column("right_vec"), size).T
        rows, cols = np.nonzero(sims >= least)
        keys = [left.column("left_key").take(pa.array(rows)), right.column("right_key").take(pa.array(cols))]
        return pa.Table.from_arrays([*keys, pa.chunked_array([pa.array(sims[rows, cols])])], ["left_key", "right_key", "similarity"])

    return run


def similar_pairs(left: DataFrame, right: DataFrame, space: VectorSpace, least: float, block: int | None = None) -> DataFrame:
    """``(left_key, right_key, similarity)`` of every pair of a left and a right vector that reaches ``least``.

    Equal to filtering :func:`all_similarities`; nothing is missed. Some left vectors, the more
    the larger the table, at most ``PIVOTS``, serve as pivots. A row goes to a cell by the nearest of them and
    its angle to it, and cells whose ranges of angles to some pivot are further apart than the angle of
    ``least`` never meet. Cells are cut into blocks of at most ``block`` rows on average, so a task
    multiplies two bounded blocks, also where most vectors are alike. Zero and missing
    vectors have no similarity and no pairs. Both inputs are read several times; pass written tables.
    """
    block = block or max(1, min(BLOCK_BYTES // (8 * space.size), int((BLOCK_BYTES // 8) ** 0.5)))
    spark, kinds = left.sparkSession, tuple(side.schema["key"].dataType.simpleString() for side in (left, right))
    schema = "left_key {}, right_key {}, similarity double".format(*kinds)
    wanted = min(PIVOTS, -(-left.count() // block))
    chosen = left.filter(F.exists("vec.vals", lambda v: v != 0)).orderBy(F.xxhash64("key"), "key").limit(wanted)
    units = _unit_rows(chosen.select(F.col("vec").cast(REAL_VECTOR).alias("vec")).toArrow().column("vec"), space.size)
    if not len(units):
        return spark.createDataFrame([], schema)

    def place(rows: DataFrame, kind: str) -> tuple[DataFrame, list[dict]]:
        plain = rows.select("key", F.col("vec").cast(REAL_VECTOR).alias("vec"))
        placed = materialize(plain.mapInArrow(_placed(space.size, units), f"cell int, angles array<double>, key {kind}, vec {REAL_VECTOR}"))
        return placed, _reach(placed, len(units), block)

    first = place(left, kinds[0])
    sides = {"left": first, "right": first if right is left else place(right, kinds[1])}
    areas = {side: own for side, (_, own) in sides.items()}
    near = near_areas(areas["left"], areas["right"], least)

    # Each side gets column names of its own: both may be the same table.
    def met(side: str, other: str) -> DataFrame:
        blocks = {name: [-(-area["rows"] // block) for area in areas[name]] for name in (side, other)}
        partners: dict[int, list] = {}
        for pair in near:
            own, its = pair if side == "left" else pair[::-1]
            partners.setdefault(own, []).append((its, blocks[other][its]))
        known = [(cell, own, blocks[side][own], partners[own]) for own in partners for cell in areas[side][own]["cells"]]
        table = spark.createDataFrame(known, "cell int, area int, blocks int, partners array<struct<area int, blocks int>>")
        rows = sides[side][0].join(F.broadcast(table), "cell").select(
            F.col("key").alias(f"{side}_key"), F.col("vec").alias(f"{side}_vec"), F.col("area").alias(f"{side}_area"),
            F.expr("pmod(xxhash64(key), blocks)").cast("int").alias(f"{side}_block"), F.explode("partners").alias("partner"),
        )
        return rows.select(
            f"{side}_key", f"{side}_vec", f"{side}_area", f"{side}_block", F.col("partner.area").alias(f"{side}_other"),
            F.explode(F.expr("sequence(0, partner.blocks - 1)")).alias(f"{side}_other_block"),
        )

    a = met("left", "right").groupBy("left_area", "left_block", "left_other", "left_other_block")
    b = met("right", "left").groupBy("right_other", "right_other_block", "right_area", "right_block")
    return a.cogroup(b).applyInArrow(_above(space.size, least), schema)


def similarity_lists(pairs: DataFrame) -> DataFrame:
    """``(left_key, similarities)``: the similarities of each left key in order of the right."""
    ordered = F.array_sort(F.collect_list(F.struct("right_key", "similarity")))
    return pairs.groupBy("left_key").agg(F.transform(ordered, lambda p: p["similarity"]).alias("similarities"))


def top_by(rows: DataFrame, num: int, by, *ties) -> DataFrame:
    """The ``num`` rows with the highest ``by``, ties in the order of the columns named."""
    by = F.col(by) if isinstance(by, str) else by
    return rows.orderBy(by.desc_nulls_last(), *ties).limit(num)
