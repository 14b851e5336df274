"""The pipeline against its operators' plain counterparts on a small table."""

import importlib.util
import os
import random
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_decontaminate import brute as quoted  # noqa: E402
from test_exact_dedup import brute as equal  # noqa: E402
from test_mixing import brute as mixed  # noqa: E402
from test_near_dedup import brute as near  # noqa: E402

from wordspace.llm import mixing, quality, queries  # noqa: E402

ROOT = Path(__file__).resolve().parents[2]


CLASHING = ("path", "id", "mark", "id_of_row", "key", "digest", "row", "label", "score", "items", "edits", "budget", "epoch", "kept")


def words(n):
    return [random.choice("the of and".split()) if random.random() < 0.3 else f"word{random.randrange(900)}" for _ in range(n)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    random.seed(21)
    folder = str(tmp_path_factory.mktemp("tables"))
    items = [" ".join(words(30)) for _ in range(6)]
    texts = []
    for i in range(160):
        own = words(80)
        if i % 4 == 0:
            own = [w + random.choice(["$$$", "%%%"]) for w in own]
        texts.append(" ".join(own))
    for i in range(60):
        source = random.choice(texts[:160]).split()
        if i % 2:
            source[random.randrange(len(source))] = f"new{i}"
        texts.append((" " if i % 3 else "\n").join(source))
    texts += [" ".join(words(20)) + " " + random.choice(items) + " " + " ".join(words(20)) for _ in range(15)] + [None, "", "", "short"]
    rows = [(i, t, random.choice(["en", "de", "fr", None]), random.choice(["src0", "src1", "src5", None]), len(t or "")) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i % 4 != 0), 0) for i in range(160)]
    spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, items


def test_run_against_plain_python(spark, tables):
    folder, rows, items = tables
    docs, labels = queries.table(spark, folder, "documents"), queries.table(spark, folder, "labels")
    model = quality.train(docs, labels, learn=queries.remainder("doc_id", 5) != 0)
    accepted = {r.doc_id for r in quality.score(docs, model).collect() if r.predicted}
    left = [r for r in rows if r[0] in accepted]
    assert len(left) < len(rows)
    kept = {r[0] for r in equal([r[:2] for r in left]) if r[3]}
    left = [r for r in left if r[0] in kept]
    classes = near([r[1] for r in left])
    left = [r for i, r in enumerate(left) if classes.index(classes[i]) == i]
    left = [r for r, (found, _) in zip(left, quoted([r[1] for r in left], items)) if not found]
    number = lambda s: int(s[3:]) % 3 if s else 0
    plain = [(r[0], r[1], (f"domain{number(r[3])}", r[2] or "", r[3] or "")) for r in left]
    want = sorted((w[0], w[4]) for w in mixed(plain, mixing.WEIGHTS, mixing.PERCENT, mixing.EPOCHS, mixing.SEED) if w[4])
    found = corpus_pipeline.run(spark, folder)
    assert found.columns == [*docs.columns, "mix_copies"]
    assert sorted((r.doc_id, r.mix_copies) for r in found.collect()) == want


def test_stages_keep_columns(spark, tables):
    folder = tables[0]
    docs = queries.table(spark, folder, "documents").withColumnsRenamed({"n_chars": "tokens"}).withColumns({c: F.lit(c) for c in CLASHING})
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, folder)
        more = [("mix_copies", "bigint")] if name == "mixing" else []
        assert found.dtypes == docs.dtypes + more, name
        assert stage(spark, docs.limit(0), folder).count() == 0, name


def test_the_rest_stands_without_the_subpackage():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('wordspace.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "assert not [q for q in e.queries() if q.startswith('op') and q[2].isdigit()] and 'pipeline' not in e.queries()\n"
        "assert e.oracle_sql()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, env=os.environ | {"PYTHONPATH": str(ROOT)})
    assert importlib.util.find_spec("wordspace.llm") is not None
