"""Importance resampling: features, weights and draws against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import pytest
from pyspark.sql import functions as F

from wordspace.llm import importance

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = bytes(range(65, 91))


def plain_features(text, longest=2):
    raw = (text or "").encode()
    words = WORD.findall(raw.translate(bytes.maketrans(UPPER, UPPER.lower())))
    runs = [b" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return len(words), Counter(crc32(run) for run in runs)


def plain_resample(docs, targets, percent=25, least=20, seed=7, buckets=10_000, longest=2):
    def counts(texts):
        out = Counter()
        for text in texts:
            for c, n in plain_features(text, longest)[1].items():
                out[c % buckets] += n
        return out

    s, t = counts(text for _, text in docs), counts(targets)
    s_all, t_all = float(sum(s.values())), float(sum(t.values()))
    rows = []
    for key, text in docs:
        words, found = plain_features(text, longest)
        n = found.total()
        gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets)))) for b in {c % buckets for c in found}}
        weight = sum(gain[c % buckets] * k for c, k in found.items()) // n if n else 0
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        rows.append((key, words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    eligible = sorted((-r[4], r[0] is not None, r[0] or 0) for r in rows if r[1] >= least)
    drawn = eligible[: percent * len(eligible) // 100]
    place = {key: i + 1 for i, key in enumerate((d[2] if d[1] else None) for d in drawn)}
    return sorted(((r[0], r[2], r[3], r[4], place.get(r[0]) if r[1] >= least else None) for r in rows), key=repr)


ODD = [None, "", " \n", "a", "A-b_c", "É é ÀÇ", "日本 x日", "\x00\x7f[]{}", "K İ", "z" * 70, "one two three " * 30]


@pytest.mark.parametrize("longest", [1, 2, 3])
@pytest.mark.parametrize("size", [1, 7, 64, 1 << 20])
def test_features_in_slices(longest, size):
    random.seed(size)
    for text in ODD + ["".join(random.choices("aB é-\n9", k=200)) for _ in range(20)]:
        words, found = 0, Counter()
        for some, sums in importance.run_checksums(text, longest, size):
            words += some
            found.update(sums)
        assert (words, found) == plain_features(text, longest), text


def rows_of(df, key="doc_id"):
    return sorted((tuple(r) for r in df.select(key, "n_features", "weight", "score", "rank").collect()), key=repr)


def test_against_plain_python(spark):
    random.seed(5)
    words = ["alpha", "beta", "Gamma", "délta", "x1", "the", "of", "and"]
    docs = [(i, " ".join(random.choices(words, k=random.randrange(60)))) for i in range(200)] + [(1000 + i, t) for i, t in enumerate(ODD)]
    docs.append((None, "no id " * 20))
    targets = ["alpha beta gamma", "the alpha " * 5, None, ""]
    made = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = importance.resample(made, spark.createDataFrame([(t,) for t in targets], "text string"))
    assert rows_of(got) == plain_resample(docs, targets)


def test_repeated_rows_and_other_columns(spark):
    docs = [(i % 3, "same text of words " * 10) for i in range(90)]
    made = spark.createDataFrame(docs, "doc_id long, text string").select(
        "doc_id", "text", *(F.lit("?").alias(n) for n in ("row", "key", "score", "rank", "place", "part", "weight"))
    )
    got = importance.resample(made, made.limit(1)).collect()
    assert len(got) == 90
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert ranks == list(range(1, 23))
    best = max(r.score for r in got)
    assert {r.score for r in got if r["rank"] is not None} == {best}


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(docs, docs).collect() == []
    one = spark.createDataFrame([(4, "word " * 30)], "doc_id long, text string")
    assert rows_of(importance.resample(one, docs)) == plain_resample([(4, "word " * 30)], [])


def test_ranks_over_partitions(spark):
    rows = spark.range(5000).select((F.col("id") % 7).alias("score"), F.col("id").alias("key"))
    got = importance.with_ranks(rows, F.desc("score"), F.asc("key")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(r.score, r.key) for r in got] == sorted(((i % 7, i) for i in range(5000)), key=lambda r: (-r[0], r[1]))
