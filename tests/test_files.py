import random
from collections import defaultdict

import pytest

from wordspace.sources import files

PARTS = ["<BODY>", "&#3;</BODY>", "<BODY>", "&#3;</BODY>", "\n", "  ", "\r\n", " The U.S.A. grew. Mr. Smith said \"yes.\" Then", "x", "End\n", "ünï code. It", "<BOD"]


@pytest.fixture
def ranges_of(spark):
    """Sets how long a byte range may be."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, size)
    spark.conf.set(name, before)


def by_file(spark, path):
    found = defaultdict(list)
    for row in sorted(files.newswire_bodies(spark, path).collect()):
        assert row.body == len(found[row.doc_id])
        found[row.doc_id].append(row.text)
    return {name: "\n".join(t for t in texts if t is not None).rstrip("\n") for name, texts in found.items()}


@pytest.mark.parametrize("size", ["37b", "200b", "1m"])
def test_bodies_are_those_of_the_whole_file(spark, tmp_path, ranges_of, size):
    rng = random.Random(5)
    for i in range(12):
        with open(tmp_path / f"{i}.sgm", "w", newline="", encoding="utf-8") as out:
            out.write("".join(rng.choice(PARTS) for _ in range(rng.randrange(60))))
    (tmp_path / "ended.sgm").write_text("<BODY>One two.  Three  &#3;</BODY>")
    (tmp_path / "open.sgm").write_text("&#3;</BODY>One two.  Three  \n")
    (tmp_path / "empty.sgm").write_text("")
    (tmp_path / "outside.sgm").write_text("no body at all\n")
    ranges_of(size)
    found = by_file(spark, str(tmp_path))
    whole = {row.doc_id: row.text.rstrip("\n") for row in files.prepare_sgml(files.whole_files(spark, str(tmp_path))).collect()}
    assert {name: text for name, text in whole.items() if text} == {name: text for name, text in found.items() if text}
    assert found[next(name for name in whole if name.endswith("/open.sgm"))] == "One two"


def test_one_file_is_many_tasks(spark, tmp_path, ranges_of):
    text = "<HEAD>\n" + "".join(f"<BODY>\nItem {i} rose. It fell again.\n&#3;</BODY>\n" for i in range(400))
    (tmp_path / "all.sgm").write_text(text)
    ranges_of("2k")
    found = files.newswire_bodies(spark, str(tmp_path))
    assert [row.text for row in found.orderBy("body").collect()] == [f" Item {i} rose\nIt fell again " for i in range(400)]
    assert spark.read.option("lineSep", "&#3;</BODY>").text(str(tmp_path)).rdd.getNumPartitions() >= len(text) // 2048
