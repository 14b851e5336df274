"""Exact dedup against plain Python."""

import hashlib
from collections import defaultdict

import pytest

from wordspace.llm import exact_dedup

SCHEMA = "doc_id bigint, text string, digest string, row string, kept string, group_size string"


def brute(rows):
    groups = defaultdict(list)
    for number, (doc, text) in enumerate(rows):
        plain = "".join(c for c in text or "" if c not in exact_dedup.BLANKS)
        groups[hashlib.sha256(plain.encode()).hexdigest()].append((-len(text or ""), doc is None, doc or 0, number))
    out = []
    for sha, group in groups.items():
        best = min(group)
        keep = None if best[1] else best[2]
        out += [(None if g[1] else g[2], keep, len(group), g == best, sha) for g in group]
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", "z", "w") for d, t in rows], SCHEMA)


CASES = {
    "empty table": [],
    "nulls and empties": [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r"), (None, None), (None, "a"), (4, "a")],
    "ties": [(3, "a b"), (2, "ab "), (9, "ab"), (1, "a\xa0b"), (5, "a b")],
    "repeated rows": [(1, "same"), (1, "same"), (1, "same"), (2, "same"), (7, "x"), (7, "x")],
    "one id, two texts": [(1, "a"), (1, "b"), (2, "b")],
    "very long": [(1, "é " * 500_000), (2, "é" * 500_000), (3, "é" * 499_999)],
    "hot text": [(i, "hot " + " " * (i % 3)) for i in range(4000)] + [(5000 + i, f"rare {i % 900}") for i in range(2000)],
}


@pytest.mark.parametrize("case", CASES)
def test_assign(spark, case):
    rows = CASES[case]
    found = exact_dedup.assign(frame(spark, rows))
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("case", CASES)
def test_drop_copies(spark, case):
    rows = CASES[case]
    docs = frame(spark, rows)
    found = exact_dedup.drop_copies(docs)
    assert found.columns == docs.columns
    want = sorted((repr(r[0]), r[4]) for r in brute(rows) if r[3])
    got = sorted((repr(r.doc_id), hashlib.sha256("".join(c for c in r.text or "" if c not in exact_dedup.BLANKS).encode()).hexdigest()) for r in found.collect())
    assert got == want


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(i, "a" * (i % 7)) for i in range(300)], "doc_id bigint, text string")
    for df in (exact_dedup.assign(docs), exact_dedup.drop_copies(docs)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
