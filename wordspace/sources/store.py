"""Corpora and lexicons as versioned parquet tables.

A table is a folder with a ``manifest`` and data folders. Writing puts the rows into a new
data folder and then adds the manifest file of the next version, which names the folders
it consists of, so readers of the earlier version, and retried tasks of the job that
wrote it, never see rows change under them. A manifest file is created only if there is
none of that version: of two writers that began from the same version one fails.

Adding to a corpus writes the new rows only. A version then has several folders, and a row
counts unless a later folder has its ``doc_id``.

A lexicon is dealt to buckets by the hash of its keys, sorted in each, and merging a batch
writes the keys of the batch only: a version is a base and at most one delta, which a read adds up
bucket by bucket, so neither is shuffled. Batches since the last base meet in the delta; once it
has a quarter as many rows as the base, both become the next base. A merge thus writes the
batches since then, not the lexicon, and a row is rewritten into a base seldom. Columns beyond those of the
kind are kept in either.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from wordspace.functions.vectors import plus
from wordspace.operators.sums import merge_by_key, pack
from wordspace.space import DEFAULT_K, DEFAULT_RADIUS, DEFAULT_SIZE, INT_VECTOR, REAL_VECTOR, VectorSpace

SCHEMAS = {
    "corpus": "doc_id string, text string",
    "words": f"key string, vec {INT_VECTOR}",
    "topics": f"key string, weight bigint, vec {REAL_VECTOR}",
}

# Suffixes of the stored names.
SUFFIXES = {"corpus": "", "words": "_WORDS", "topics": "_TOPICS"}

KINDS = {"corpus": "corpus", "word": "words", "words": "words", "topic": "topics", "topics": "topics"}

MANIFEST = "version bigint, folders array<string>, size int, k int, cr int, buckets int, others string"

#: Least buckets of a new lexicon; about 100 MB of vectors in each is a good size.
BUCKETS = 16
#: Bytes of stored texts that a bucket more is for, and the most buckets chosen by them.
BUCKET_BYTES, MOST_BUCKETS = 8 << 20, 1 << 13
#: Once the delta has one in so many rows of the base, both are written as one.
DELTA_SHARE = 4


#: The bucket in the name of a file that Spark wrote.
_BUCKET_OF = re.compile(r"_(\d{5,})\.c\d+[^/]*$")


def _entry(folder: str) -> str:
    """The catalog's name of a data folder of a lexicon."""
    return f"wordspace_{folder}"


def _columns(spark: SparkSession, kind: str) -> dict:
    return {f.name: f for f in spark.createDataFrame([], SCHEMAS[KINDS[kind]]).schema}


def added(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of two lexicons by key: vectors and weights added, of other columns the first that is not null.

    One full outer join by key, which sides dealt alike enter without a shuffle.
    """
    sides = [side.select(*(F.col(f"`{c}`").alias(f"{mark}{c}") for c in side.columns)) for mark, side in (("a_", a), ("b_", b))]
    columns = [F.coalesce("a_key", "b_key").alias("key")]
    for name in [*a.columns, *(c for c in b.columns if c not in a.columns)]:
        own = [F.col(f"`{mark}{name}`") for mark, side in (("a_", a), ("b_", b)) if name in side.columns]
        if name == "vec":
            columns.append(plus(*own).alias("vec"))
        elif name == "weight":
            columns.append((F.coalesce(own[0], F.lit(0)) + F.coalesce(own[1], F.lit(0))).alias("weight"))
        elif name != "key":
            columns.append(F.coalesce(*own).alias(name))
    return sides[0].join(sides[1], F.col("a_key") == F.col("b_key"), "full_outer").select(*columns)


def buckets_for(texts: DataFrame) -> int:
    """Into how many buckets to deal the lexicon of texts, by the size Spark tells of them without reading any."""
    size = int(str(texts._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # Texts that are in no files have no size, which Spark tells as one beyond all files.
    return BUCKETS if size >= 1 << 55 else min(max(BUCKETS, -(-size // BUCKET_BYTES)), MOST_BUCKETS)


class TableMissing(LookupError):
    """The named table was never created."""


class WriteConflict(RuntimeError):
    """Another writer has made the next version of the table first."""


@dataclass(frozen=True)
class Table:
    """One version of a stored table."""

    rows: DataFrame
    space: VectorSpace
    version: int


class Store:
    """Tables under one root folder on any file system Spark can reach.

    ``buckets`` is for lexicons made through this object; :meth:`compact` deals an old one anew.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int | None = None):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def folder(self, kind: str, name: str) -> str:
        if kind not in KINDS:
            raise ValueError(f"not a kind of table: {kind}")
        return f"{self.root}/{name}{SUFFIXES[KINDS[kind]]}"

    def manifest(self, kind: str, name: str) -> DataFrame:
        """``(version, folders, size, k, cr)`` of every version written so far."""
        return self.spark.read.schema(MANIFEST).json(f"{self.folder(kind, name)}/manifest")

    def _files(self, path: str):
        """The file system of a path, and the path as it takes it."""
        there = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return there.getFileSystem(self.spark._jsc.hadoopConfiguration()), there

    def metadata(self, kind: str, name: str) -> DataFrame:
        """``(size, k, cr)`` of the current version, defaults filled in."""
        latest = self.manifest(kind, name).orderBy(F.desc("version")).limit(1)
        return latest.select(
            F.coalesce("size", F.lit(DEFAULT_SIZE)).alias("size"),
            F.coalesce("k", F.lit(DEFAULT_K)).alias("k"),
            F.coalesce("cr", F.lit(DEFAULT_RADIUS)).alias("cr"),
        )

    def _latest(self, kind: str, name: str):
        try:
            return self.manifest(kind, name).orderBy(F.desc("version")).first()
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None

    def exists(self, kind: str, name: str) -> bool:
        return self._latest(kind, name) is not None

    def create(self, kind: str, name: str, space: VectorSpace | None = None, buckets: int | None = None) -> Table:
        """Create an empty table; an existing one is left alone and opened. ``buckets`` counts if the store has no number."""
        if not self.exists(kind, name):
            empty = self.spark.createDataFrame([], SCHEMAS[KINDS[kind]])
            self._append(kind, name, empty, 1, space, buckets=self.buckets or buckets)
        return self.open(kind, name)

    def open(self, kind: str, name: str) -> Table:
        latest = self._latest(kind, name)
        if latest is None:
            raise TableMissing(f"no {KINDS[kind]} table named {name}")
        given = {"size": latest["size"], "k": latest["k"], "radius": latest["cr"]}
        space = VectorSpace(**{item: value for item, value in given.items() if value is not None})
        rows = self._corpus(name, latest) if KINDS[kind] == "corpus" else self._lexicon(kind, name, latest)
        return Table(rows, space, latest.version)

    def _data(self, kind: str, name: str, folder: str) -> str:
        return f"{self.folder(kind, name)}/data/{folder}"

    def _corpus(self, name: str, latest) -> DataFrame:
        rows, later = None, None
        for folder in reversed(latest.folders):
            part = self.spark.read.schema(SCHEMAS["corpus"]).parquet(self._data("corpus", name, folder))
            old = part if later is None else part.join(later, "doc_id", "left_anti")
            rows = old if rows is None else rows.unionByName(old)
            if len(latest.folders) > 1:
                ids = part.select("doc_id")
                later = ids if later is None else later.unionByName(ids)
        return rows

    def _schema(self, kind: str, latest) -> str:
        """The columns of a table: those of its kind, and the others it was written with."""
        return ", ".join(filter(None, (SCHEMAS[KINDS[kind]], latest.others)))

    def _bucketed(self, kind: str, name: str, folder: str, latest) -> DataFrame:
        """A folder of a lexicon, read such that Spark knows how its keys are dealt."""
        files, path = self._files(self._data(kind, name, folder))
        where = str(files.makeQualified(path).toString()).replace("'", "\\'")
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {_entry(folder)} ({self._schema(kind, latest)}) USING parquet "
            f"CLUSTERED BY (key) SORTED BY (key) INTO {latest.buckets} BUCKETS LOCATION '{where}'"
        )
        return self.spark.table(_entry(folder))

    def _lexicon(self, kind: str, name: str, latest) -> DataFrame:
        parts = [self._bucketed(kind, name, folder, latest) for folder in latest.folders]
        return parts[0] if len(parts) == 1 else added(*parts)

    def buckets_of(self, kind: str, name: str) -> int:
        """Into how many buckets a lexicon is dealt."""
        return self._latest(kind, name).buckets

    def lookup(self, kind: str, name: str, keys: DataFrame) -> DataFrame:
        """The rows of the keys, a table with a column ``key``; only files that can hold one of them are read.

        The keys are dealt as the lexicon is, which gives the buckets, at most as many as the
        lexicon has, and so the files.
        """
        latest = self._latest(kind, name)
        if latest is None:
            raise TableMissing(f"no {KINDS[kind]} table named {name}")
        bucket = F.pmod(F.hash("key"), F.lit(latest.buckets))
        wanted = {row.bucket for row in keys.filter("key IS NOT NULL").select(bucket.alias("bucket")).distinct().collect()}
        parts = []
        for folder in latest.folders:
            files, path = self._files(self._data(kind, name, folder))
            names = [str(status.getPath().toString()) for status in files.listStatus(path)]
            some = [n for n in names if (found := _BUCKET_OF.search(n)) and int(found[1]) in wanted]
            reader = self.spark.read.schema(self._schema(kind, latest))
            parts.append(reader.parquet(*some) if some else self.spark.createDataFrame([], self._schema(kind, latest)))
        asked = keys.select("key").distinct()
        parts = [part.join(asked, "key", "left_semi") for part in parts]
        return parts[0] if len(parts) == 1 else added(*parts)

    def merge(self, kind: str, name: str, batch: DataFrame, dealt: bool = False) -> Table:
        """Add the vectors of a batch, one row per key, onto a lexicon; written is what the batch touches.

        Weights add up too; of other columns the first value that is not null stays. Keys are
        not null. ``dealt`` says that the batch comes in the partitions of the lexicon, as from
        a training told so; otherwise it is shuffled to them.
        """
        if KINDS.get(kind) not in ("words", "topics"):
            raise ValueError(f"vectors are merged into a lexicon only, not into {kind}")
        latest = self._latest(kind, name)
        if latest is None:
            raise TableMissing(f"no {KINDS[kind]} table named {name}")
        table = self.open(kind, name)
        others = [f for f in batch.schema if f.name not in _columns(self.spark, kind)]
        known = {f.name for f in self.spark.createDataFrame([], self._schema(kind, latest)).schema}
        more = ", ".join(filter(None, (latest.others, *(f"`{f.name}` {f.dataType.simpleString()}" for f in others if f.name not in known))))
        base, delta = latest.folders[0], latest.folders[1:]
        rows = batch
        if delta:
            rows = self._bucketed(kind, name, delta[0], latest)
            dealt = not (others or latest.others)
            rows = self._summed(kind, rows, batch, table.space, latest.buckets) if dealt else added(rows, batch)
        fresh = self._put(kind, name, rows, latest.buckets, more, dealt)
        count = lambda folder: self.spark.read.schema("key string").parquet(self._data(kind, name, folder)).count()
        folders = [base, fresh]
        if DELTA_SHARE * count(fresh) > (had := count(base)):
            folders = [fresh]
            if had:
                now = latest.asDict() | {"others": more}
                both = (self._bucketed(kind, name, folder, Row(**now)) for folder in (base, fresh))
                folders = [self._put(kind, name, added(*both), latest.buckets, more, dealt=True)]
        self._commit(kind, name, latest.version + 1, folders, table.space, latest.buckets, more)
        return self.open(kind, name)

    def _summed(self, kind: str, rows: DataFrame, batch: DataFrame, space: VectorSpace, buckets: int) -> DataFrame:
        real = KINDS[kind] == "topics"
        sides = []
        for side in (rows, batch):
            weight = F.col("weight") if real else F.lit(0).cast("bigint").alias("weight")
            sides.append(pack(side.select("key", weight, "vec"), space.size))
        return merge_by_key(sides[0].unionByName(sides[1]), space.size, real, partitions=buckets)

    def add(self, kind: str, name: str, rows: DataFrame) -> Table:
        """Put rows into a corpus: earlier rows stay but for those of the same ``doc_id``.

        Rows of one call that share an id all stay.
        """
        if KINDS.get(kind) != "corpus":
            raise ValueError(f"rows are added to a corpus only, not to {kind}")
        latest = self._latest(kind, name)
        self._append(kind, name, rows, (latest.version if latest else 0) + 1, None, latest.folders if latest else [])
        return self.open(kind, name)

    def added(self, kind: str, name: str) -> int:
        """How many rows the last write put into the newest folder of a table, from its file footers."""
        return self.spark.read.schema("doc_id string").parquet(self._data(kind, name, self._latest(kind, name).folders[-1])).count()

    def compact(self, name: str, kind: str = "corpus", buckets: int | None = None) -> Table:
        """Write a table that was added to as one folder; a lexicon in another number of buckets if given."""
        if buckets is not None:
            self.buckets = buckets
        return self.write(kind, name, self.open(kind, name).rows, buckets=buckets)

    def prune(self, kind: str, name: str, keep: int = 1) -> int:
        """Remove the data that none of the last ``keep`` versions consists of; returns the folders removed.

        No job may be reading older versions, or writing the table.
        """
        if keep < 1:
            raise ValueError("the current version has to stay")
        versions = self.manifest(kind, name).orderBy(F.desc("version")).limit(keep).collect()
        kept = {folder for row in versions for folder in row.folders}
        files, path = self._files(f"{self.folder(kind, name)}/data")
        removed = 0
        for status in files.listStatus(path):
            if status.getPath().getName() not in kept:
                if kind != "corpus":
                    self.spark.sql(f"DROP TABLE IF EXISTS {_entry(status.getPath().getName())}")
                removed += bool(files.delete(status.getPath(), True))
        return removed

    def write(
        self, kind: str, name: str, rows: DataFrame, space: VectorSpace | None = None, buckets: int | None = None
    ) -> Table:
        """Make the rows the current version, of the space given or else the one stored."""
        latest = self._latest(kind, name)
        if space is None and latest is not None:
            space = self.open(kind, name).space
        buckets = buckets or (latest.buckets if latest else None)
        self._append(kind, name, rows, (latest.version if latest else 0) + 1, space, buckets=buckets)
        return self.open(kind, name)

    def _append(
        self, kind: str, name: str, rows: DataFrame, version: int, space: VectorSpace | None, before: list[str] | None = None,
        buckets: int | None = None,
    ) -> None:
        buckets, others = (None, None) if kind == "corpus" else (buckets or self.buckets or BUCKETS, self._others(kind, rows))
        folder = self._put(kind, name, rows, buckets, others)
        self._commit(kind, name, version, [*(before or []), folder], space, buckets, others)

    def _others(self, kind: str, rows: DataFrame) -> str:
        """The columns of a lexicon beyond those of its kind, as a schema."""
        known = _columns(self.spark, kind)
        return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name not in known)

    def _put(self, kind: str, name: str, rows: DataFrame, buckets: int | None, others: str | None, dealt: bool = False) -> str:
        """Write rows to a new folder; returns its name. ``dealt`` rows are in the partitions of the buckets already."""
        folder = uuid.uuid4().hex
        path = self._data(kind, name, folder)
        fields = list(_columns(self.spark, kind).values())
        if others:
            fields += list(self.spark.createDataFrame([], others).schema)
        lacking = lambda f: F.lit(None) if f.name not in rows.columns else F.col(f"`{f.name}`")
        data = rows.select(*(lacking(f).cast(f.dataType).alias(f.name) for f in fields))
        if buckets is None:
            data.write.parquet(path)
            return folder
        files, there = self._files(path)
        # Each task holds the keys of one bucket and writes one file; bloom filters let a lookup skip files.
        data = data if dealt else data.repartition(buckets, "key")
        writer = data.write.format("parquet").option("parquet.bloom.filter.enabled#key", "true")
        writer = writer.bucketBy(buckets, "key").sortBy("key").option("path", str(files.makeQualified(there).toString()))
        writer.saveAsTable(_entry(folder))
        return folder

    def _commit(
        self, kind: str, name: str, version: int, folders: list[str], space: VectorSpace | None, buckets: int | None, others: str | None
    ) -> None:
        meta = {"version": version, "folders": folders}
        if buckets is not None:
            meta |= {"buckets": buckets, "others": others or None}
        if space:
            meta |= {"size": space.size, "k": space.k, "cr": space.radius}
        files, path = self._files(f"{self.folder(kind, name)}/manifest/{version:09d}.json")
        try:
            out = files.create(path, False)
        except Py4JJavaError as error:
            if files.exists(path):
                raise WriteConflict(f"version {version} of {name} was written by another") from error
            raise
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()

    def clear(self, kind: str, name: str) -> int:
        """Make an empty version the current one; returns the rows it has."""
        self.open(kind, name)
        empty = self.spark.createDataFrame([], SCHEMAS[KINDS[kind]])
        return self.write(kind, name, empty).rows.count()

    def count(self, kind: str, name: str) -> int:
        return self.open(kind, name).rows.count()
