import pytest

import brute
from test_training import SPACE, docs
from wordspace.operators import lookup, training
from wordspace.operators.documents import text_vectors
from wordspace.plans.commands import TableMissing, Workbench
from wordspace.sources import files, scratch
from wordspace.sources.store import Store, WriteConflict
from wordspace.space import VectorSpace


@pytest.fixture
def bench(spark, tmp_path):
    return Workbench(spark, str(tmp_path / "store"))


def write(folder, **texts):
    folder.mkdir()
    for name, text in texts.items():
        (folder / name.replace("_", ".")).write_text(text)
    return str(folder)


def test_process_dir_prepares_by_type(bench, tmp_path):
    path = write(
        tmp_path / "in", a_txt="one\ntwo\n", b_sgm="<BODY>It grew. Then it fell.&#3;</BODY>", c_sgml="<BODY>A b&#3;</BODY>"
    )
    assert bench.process_dir(path, "set") == 3
    found = {r.doc_id.rsplit("/", 1)[1]: r.text for r in bench.texts("set").collect()}
    assert found == {"a.txt": "one two", "b.sgm": "It grew\nThen it fell", "c.sgml": "A b"}


def test_own_preparation(spark, tmp_path):
    path = write(tmp_path / "in", a_txt="one\ntwo\n")
    rows = files.whole_files(spark, path)
    assert files.prepare_plain(rows).first().text == "one two"
    assert files.prepare_sgml(rows).first().text == ""
    assert [r.value for r in files.lines(spark, path).collect()] == ["one", "two"]


def test_training_twice_adds_up_in_the_same_lexicon(spark, bench):
    texts = ["the cat sat", "solo", "a metadata word"]
    bench.put_texts(docs(spark, texts), "set")
    report = bench.train("words", "lx", "set", create=True, space=SPACE).first()
    assert (report.kind, report.processed, report.rejected, report.added, report.total) == ("words", 3, 0, 7, 7)
    report = bench.train("word", "lx", docs(spark, ["the dog"])).first()
    assert (report.processed, report.added, report.total) == (1, 1, 8)
    table = bench.store.open("words", "lx")
    assert table.space == SPACE and table.version == 3
    assert brute.as_dict(table.rows) == brute.ordered(texts + ["the dog"], SPACE)


def test_topics_from_files(spark, bench, tmp_path):
    bench.train("words", "lx", docs(spark, ["cats like milk", "dogs like bones", "birds like seeds"]), True, SPACE)
    path = write(
        tmp_path / "top",
        a="<topics>\ncats pets\n</topics><body>cats milk</body>", b="<topics>dogs pets</topics><body>dogs bones</body>",
        c="no tags", d="<topics>birds</topics><body>birds seeds",
    )
    report = bench.train("topics", "lx", files.whole_files(spark, path), create=True).first()
    assert (report.kind, report.processed, report.rejected, report.added, report.total) == ("topics", 4, 1, 4, 4)
    again = bench.train("topic", "lx", files.whole_files(spark, path)).first()
    assert (again.added, again.total) == (0, 4)
    text = tmp_path / "text.txt"
    text.write_text("dogs\nand bones")
    best = bench.assign_topics_to_text("lx", str(text))
    assert best[0] == "dogs" and sorted(best) == ["birds", "cats", "dogs", "pets"]
    assert bench.assign_topics_to_text("lx", str(text), ascending=True) == best[::-1]
    assert bench.assign_topics_to_text("lx", str(text), top=1) == ["dogs"]


def test_comparing(spark, bench, tmp_path):
    bench.train("words", "lx", docs(spark, ["cats like milk", "dogs like bones", "cats like bones"]), True, SPACE)
    known = brute.ordered(["cats like milk", "dogs like bones", "cats like bones"], SPACE)

    def vec(word):
        return [known[word].get(d, 0) for d in range(SPACE.size)]

    assert bench.compare_words("lx", "cats", "dogs") == pytest.approx(brute.cosine(vec("cats"), vec("dogs")))
    assert bench.compare_words("lx", "cats", "cats") == pytest.approx(1)
    with pytest.raises(LookupError, match="horses"):
        bench.compare_words("lx", "cats", "horses")
    paths = []
    for name, text in (("a", "cats like"), ("b", "dogs like"), ("c", "nothing known")):
        (tmp_path / name).write_text(text)
        paths.append(str(tmp_path / name))
    expected = [brute.text_vector(brute.tokens(t), known, SPACE.size)[1] for t in ("cats like", "dogs like")]
    assert bench.compare_documents("lx", *paths[:2]) == pytest.approx(brute.cosine(*expected))
    assert bench.compare_documents("lx", paths[0], paths[2]) is None


def test_clear_and_count(spark, bench):
    assert not bench.store.exists("words", "lx")
    with pytest.raises(TableMissing):
        bench.count("words", "lx")
    with pytest.raises(ValueError):
        bench.train("sounds", "lx", docs(spark, ["a"]))
    bench.train("words", "lx", docs(spark, ["a b"]), True, SPACE)
    assert bench.count("words", "lx") == 2
    assert bench.clear("words", "lx") == 0 and bench.count("words", "lx") == 0
    assert bench.store.open("words", "lx").space == SPACE


def test_readers_keep_their_version(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("words", "lx", SPACE)
    store.write("words", "lx", training.train(docs(spark, ["a b"]), SPACE))
    before = store.open("words", "lx").rows
    store.write("words", "lx", training.train(docs(spark, ["c"]), SPACE))
    assert {r.key for r in before.collect()} == {"a", "b"}
    assert {r.key for r in store.open("words", "lx").rows.collect()} == {"c"}
    assert [r.version for r in store.manifest("words", "lx").orderBy("version").collect()] == [1, 2, 3]


def test_metadata_defaults(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    assert store.create("words", "lx").space == VectorSpace()
    assert tuple(store.metadata("words", "lx").first()) == (16000, 48, 3)


def test_lookups(spark):
    lexicon = training.train(docs(spark, ["a b c"]), SPACE)
    keys = spark.createDataFrame([("a",), ("z",), ("a",)], "key string")
    assert lookup.get(lexicon, "a").count() == 1 and lookup.get(lexicon, "z").count() == 0
    assert lookup.get(lexicon, "a").select(lookup.point("vec", "dims").alias("d")).first().d
    assert [r.key for r in lookup.get_keys(lexicon, keys).collect()] == ["a"]
    assert [r.key for r in lookup.missing_keys(lexicon, keys).collect()] == ["z"]
    with pytest.raises(LookupError, match="z"):
        lookup.get_or_error(lexicon, keys)
    found = {r.key: (r.known, dict(zip(r.vec.dims, r.vec.vals))) for r in lookup.get_or_index(lexicon, keys, SPACE).collect()}
    assert found["a"][0] and found["z"] == (False, brute.index_vector("z", SPACE.size, SPACE.k))


def test_point_lookup_is_pushed_down(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("words", "lx", SPACE)
    table = store.write("words", "lx", training.train(docs(spark, ["a b"]), SPACE))
    plan = lookup.get(table.rows, "a")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(key,a)" in plan


def test_rows_as_maps(spark):
    rows = spark.createDataFrame([("a", 1, ([1], [2]))], "key string, weight int, vec struct<dims:array<int>,vals:array<int>>")
    cells = lookup.row_as_map(rows)
    assert cells.first().cells == {"word": "a", "weight": "1", "vec": '{"dims":[1],"vals":[2]}'}
    back = lookup.map_as_row(cells, "key string, weight int, vec struct<dims:array<int>,vals:array<int>>")
    assert back.collect() == rows.collect()


def test_scratch_follows_the_session(spark):
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    path = scratch.scratch_path(spark)
    assert shared is None or path.startswith(shared.rstrip("/"))
    assert scratch.materialize(spark.range(3)).count() == 3


def test_scratch_of_a_cluster_has_to_be_set():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError, match="checkpoint"):
        scratch.scratch_dir(Session)


def test_a_corpus_is_added_to(spark, bench, tmp_path):
    texts = lambda: {r.doc_id: r.text for r in bench.texts("set").collect()}
    first = spark.createDataFrame([("a", "1"), ("b", "2"), (None, "n")], "doc_id string, text string")
    assert bench.put_texts(first, "set") == 3
    assert bench.put_texts(spark.createDataFrame([("b", "3"), ("c", "4"), ("c", "5")], first.schema), "set") == 3
    assert bench.texts("set").count() == 5 and {"a", "b", None} <= set(texts()) and texts()["b"] == "3"
    bench.put_texts(spark.createDataFrame([("c", "6")], first.schema), "set")
    assert texts() == {"a": "1", "b": "3", None: "n", "c": "6"}
    assert len(bench.store.manifest("corpus", "set").orderBy("version").collect()[-1].folders) == 3
    assert bench.store.compact("set").rows.count() == 4
    assert bench.store.prune("corpus", "set") == 3 and texts() == {"a": "1", "b": "3", None: "n", "c": "6"}
    one, two = write(tmp_path / "one", a_txt="x\n", b_txt="y\n"), write(tmp_path / "two", c_txt="z\n")
    bench.process_dir(one, "files")
    bench.process_dir(two, "files")
    assert sorted(r.text for r in bench.texts("files").collect()) == ["x", "y", "z"]
    with pytest.raises(ValueError):
        bench.store.add("words", "lx", first)


def test_of_two_writers_one_fails(spark, tmp_path, monkeypatch):
    store = Store(spark, str(tmp_path))
    store.create("words", "lx", SPACE)
    rows = training.train(docs(spark, ["a b"]), SPACE)
    stale = store._latest("words", "lx")
    store.write("words", "lx", rows)
    monkeypatch.setattr(store, "_latest", lambda kind, name: stale)
    with pytest.raises(WriteConflict):
        store._append("words", "lx", rows, stale.version + 1, SPACE)
    monkeypatch.undo()
    assert store.open("words", "lx").version == 2


def test_null_texts_are_rejected(spark, bench):
    rows = spark.createDataFrame([("a", "x y"), ("b", None)], "doc_id string, text string")
    report = bench.train("words", "lx", rows, create=True, space=SPACE).first()
    assert (report.processed, report.rejected, report.total) == (2, 1, 2)


def test_rows_without_a_key_are_a_group(spark):
    lexicon = training.train(docs(spark, ["a b c"]), SPACE)
    texts = spark.createDataFrame([("t", "a b"), (None, "a"), (None, "c")], "doc_id string, text string")
    assert {r.key: r.weight for r in text_vectors(texts, lexicon, SPACE).collect()} == {"t": 2, None: 2}


def test_missing_keys_are_counted(spark):
    lexicon = training.train(docs(spark, ["a b c"]), SPACE)
    lost = [f"lost{i}" for i in range(25)]
    for keys in (["a", *lost], spark.createDataFrame([(k,) for k in ["a", *lost]], "key string")):
        with pytest.raises(LookupError, match="25 keys, for example: lost0, lost1,"):
            lookup.get_or_error(lexicon, keys)
    assert [r.key for r in lookup.get_or_error(lexicon, ["a", "c"]).orderBy("key").collect()] == ["a", "c"]


def test_literal_keys_reach_the_files(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("words", "lx", SPACE)
    table = store.write("words", "lx", training.train(docs(spark, ["a b"]), SPACE))
    plan = table.rows.filter(table.rows["key"].isin(["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "In(key, [a,b])" in plan


def test_large_files_are_read_by_line(spark, bench, tmp_path):
    bench.train("words", "lx", docs(spark, ["cats like milk", "dogs like bones"]), True, SPACE)
    (tmp_path / "a").write_text("cats\nlike milk\n")
    (tmp_path / "b").write_text("cats like\nmilk")
    words = bench.store.open("words", "lx")
    for unit, same in (("token", True), ("line", False)):
        whole = files.whole_files(spark, str(tmp_path / "a"))
        got = bench._file_vectors(words, [str(tmp_path / "a")], unit).first()
        want = text_vectors(whole, words.rows, words.space, unit=unit).first()
        assert got.weight == want.weight and got.vec.dims == want.vec.dims and got.vec.vals == pytest.approx(want.vec.vals)
    assert bench.compare_documents("lx", str(tmp_path / "a"), str(tmp_path / "b")) == pytest.approx(1)


def test_scratch_is_cleared(spark):
    kept, scratch._made[:] = list(scratch._made), []
    rows = scratch.materialize(spark.range(3))
    path = scratch._made[-1]
    assert rows.count() == 3 and scratch.clear_scratch(spark) == 1 and scratch._made == []
    assert not files_there(spark, path)
    scratch._made[:] = kept


def files_there(spark, path):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange")


def lexicon_rows(rows):
    return {r.key: dict(zip(r.vec.dims, r.vec.vals)) for r in rows.collect()}


def test_batches_are_merged_bucket_by_bucket(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=3)
    store.create("words", "lx", SPACE)
    batches = [[f"w{i} w{i + 1} w{i + 2}" for i in range(60)], ["w1 new one"], ["w1 w2 other", "solo"], ["new w1"]]
    sizes = []
    for batch in batches:
        table = store.merge("words", "lx", training.train(docs(spark, batch), SPACE))
        latest = store._latest("words", "lx")
        sizes.append(spark.read.parquet(store._data("words", "lx", latest.folders[-1])).count())
    # The first batch is the base, of the others the keys they touch are written.
    assert len(latest.folders) == 2 and sizes == [62, 3, 6, 6]
    assert exchanges(table.rows) == 0 and table.rows.rdd.getNumPartitions() == 3
    assert lexicon_rows(table.rows) == brute.ordered(sum(batches, []), SPACE)
    many = [f"x{i} y{i}" for i in range(20)]
    table = store.merge("words", "lx", training.train(docs(spark, many), SPACE))
    assert len(store._latest("words", "lx").folders) == 1
    assert lexicon_rows(table.rows) == brute.ordered(sum(batches, []) + many, SPACE)
    assert lexicon_rows(store.compact("lx", "words", buckets=5).rows) == lexicon_rows(table.rows)
    assert store.buckets_of("words", "lx") == 5
    assert store.prune("words", "lx") >= 5
    with pytest.raises(ValueError):
        store.merge("corpus", "lx", table.rows)
    with pytest.raises(TableMissing):
        store.merge("words", "none", table.rows)


def test_sums_that_cancel_leave_no_cell(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    store.create("words", "lx", VectorSpace(8, 2))
    row = "key string, vec struct<dims:array<int>,vals:array<bigint>>"
    store.merge("words", "lx", spark.createDataFrame([("a", ([1, 5], [2, 3])), ("b", ([], []))] + [(f"z{i}", ([], [])) for i in range(20)], row))
    table = store.merge("words", "lx", spark.createDataFrame([("a", ([0, 5], [7, -3])), ("b", ([1], [1]))], row))
    found = lexicon_rows(table.rows)
    assert len(store._latest("words", "lx").folders) == 2
    assert found["a"] == {0: 7, 1: 2} and found["b"] == {1: 1} and found["z3"] == {}


def test_other_sessions_read_the_buckets(spark, tmp_path):
    store = Store(spark, str(tmp_path / "it's here"), buckets=4)
    store.create("words", "lx", SPACE)
    store.merge("words", "lx", training.train(docs(spark, [f"a{i} b{i}" for i in range(30)]), SPACE))
    store.merge("words", "lx", training.train(docs(spark, ["a1 c"]), SPACE))
    wanted = lexicon_rows(store.open("words", "lx").rows)
    for folder in store._latest("words", "lx").folders:
        spark.sql(f"DROP TABLE wordspace_{folder}")
    table = Store(spark, str(tmp_path / "it's here")).open("words", "lx")
    assert exchanges(table.rows) == 0 and lexicon_rows(table.rows) == wanted


def test_other_columns_stay_in_the_store(spark, tmp_path):
    bench = Workbench(spark, str(tmp_path))
    first = training.train(docs(spark, [f"a{i} b{i}" for i in range(30)] + ["x y"]), SPACE)
    rows = first.selectExpr("*", "upper(key) AS `Name of it`", "length(key) AS letters", "array(key) AS list")
    bench.store.write("words", "lx", rows, SPACE)
    for text in ("x new", "y new"):
        bench.train("words", "lx", docs(spark, [text]))
    more = training.train(docs(spark, ["z x"]), SPACE).selectExpr("*", "'v' AS extra", "-1 AS letters")
    table = bench.store.merge("words", "lx", more)
    found = {r.key: r for r in table.rows.collect()}
    assert table.rows.columns == ["key", "vec", "Name of it", "letters", "list", "extra"]
    assert (found["x"]["Name of it"], found["x"].letters, found["x"].list, found["x"].extra) == ("X", 1, ["x"], "v")
    assert (found["new"]["Name of it"], found["new"].letters, found["z"].letters) == (None, None, -1)
    assert bench.store.compact("lx", "words").rows.columns == table.rows.columns
    assert len(bench.store.lookup("words", "lx", spark.createDataFrame([("x",)], "key string")).columns) == 6


def test_lookup_opens_the_files_of_its_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=40)
    store.create("words", "lx", SPACE)
    store.merge("words", "lx", training.train(docs(spark, [f"a{i} b{i}" for i in range(300)]), SPACE))
    store.merge("words", "lx", training.train(docs(spark, ["a1 c"]), SPACE))
    keys = spark.createDataFrame([("a1",), ("b7",), ("zz",), (None,), ("a1",)], "key string")
    found = store.lookup("words", "lx", keys)
    assert len(found.inputFiles()) <= 6
    rows = lexicon_rows(store.open("words", "lx").rows)
    assert lexicon_rows(found) == {key: rows[key] for key in ("a1", "b7")}
    assert store.lookup("words", "lx", keys.filter("false")).count() == 0


def test_texts_are_read_once(spark, tmp_path):
    bench = Workbench(spark, str(tmp_path))
    reads = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    rows = docs(spark, ["a b", None, "c d", "e"])
    counted = lambda: rows.mapInArrow(seen, "doc_id int, text string")
    assert bench.put_texts(counted(), "set") == 4 and reads.value == 4
    report = bench.train("words", "lx", counted(), True, SPACE).first()
    assert (report.processed, report.rejected, report.total) == (4, 1, 5) and reads.value == 8


def test_a_new_lexicon_has_buckets_by_its_texts(spark, tmp_path, monkeypatch):
    from wordspace.sources import store

    texts = [f"w{i} w{i + 1} w{i * 7 % 90}" for i in range(200)]
    docs(spark, texts).write.parquet(str(tmp_path / "texts"))
    stored = spark.read.parquet(str(tmp_path / "texts"))
    monkeypatch.setattr(store, "BUCKET_BYTES", 300)
    grown, given = Workbench(spark, str(tmp_path / "a")), Workbench(spark, str(tmp_path / "b"), buckets=3)
    for bench, least, most in ((grown, 17, store.MOST_BUCKETS), (given, 3, 3)):
        bench.train("words", "main", stored, create=True, space=SPACE)
        assert least <= bench.store.buckets_of("words", "main") <= most
        assert lexicon_rows(bench.store.open("words", "main").rows) == brute.ordered(texts, SPACE)
    assert store.buckets_for(docs(spark, texts)) == store.BUCKETS
