"""The language model against a plain Python one."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest

from wordspace.llm import lm

WORDS = re.compile("[^\x20\x09-\x0d]+")


def tokens(text):
    return [w.translate({c: c + 32 for c in range(65, 91)}) for w in WORDS.findall(text or "")] + [None]


def brute(train, texts):
    pairs, words = Counter(), Counter()
    for text in train:
        row = tokens(text)
        words.update(row)
        pairs.update(zip(["<start>"] + [("w", t) for t in row], row))
    of = Counter(pairs.values())
    left, context, kinds = Counter(), Counter(), defaultdict(Counter)
    for (u, w), c in pairs.items():
        left[w] += 1
        context[u] += c
        kinds[u][min(c, 3)] += 1
    of_left = Counter(left.values())
    d = (0, *lm.discounts(*(of[i] for i in range(1, 5))))
    e = (0, *lm.discounts(*(of_left[i] for i in range(1, 5))))
    total = sum(left.values())
    spare = sum(e[min(c, 3)] for c in left.values()) / total if total else 1

    def p1(w):
        return (max(left[w] - e[min(left[w], 3)], 0) / total if total else 0) + spare / (len(words) + 1)

    def p2(u, w):
        if not context[u]:
            return p1(w)
        c = pairs[u, w]
        rest = sum(d[k] * n for k, n in kinds[u].items()) / context[u]
        return (c - d[min(c, 3)]) / context[u] + rest * p1(w)

    n, v, out = sum(words.values()), len(words), []
    for text in texts:
        row = tokens(text)
        score = sum(math.log10(p2(u, w)) for u, w in zip(["<start>"] + [("w", t) for t in row], row))
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in row)
        out.append((len(row), sum(words[w] > 0 for w in row), n, base, score))
    return out, (p2, words)


def same(spark, train, texts):
    schema = "doc_id bigint, text string, score string"
    model = lm.train(spark.createDataFrame([(i, t, "x") for i, t in enumerate(train)], schema))
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], schema)
    got = {r.doc_id: r for r in lm.score(rows, model).collect()}
    want, _ = brute(train, texts)
    assert len(got) == len(texts)
    for i, (n, known, total, base, score) in enumerate(want):
        row = got[i]
        assert (row.n_tokens, row.n_known, row.train_tokens) == (n, known, total)
        assert row.base_score == pytest.approx(base, abs=1e-9) and row.score == pytest.approx(score, rel=1e-6, abs=1e-9)


def test_random_texts(spark):
    random.seed(4)
    some = lambda: " ".join(random.choice("ab Ab c É é \x0b dd e\tf\n\r ggg".split(" ")) for _ in range(random.randrange(60)))
    train = [some() for _ in range(80)] + ["the"] * 300 + ["a b c"] * 300
    same(spark, train, train[:50] + [some() + " zzz yyy" for _ in range(30)])


def test_odd_texts(spark):
    long = "word " * 700_000
    same(spark, [None, "", " \t\n", "x", "X", "x x", long], [None, "", "x", "ʞ  x", "x\x0cx", long, "x" * 3_000_000])


def test_no_training_text(spark):
    same(spark, [], [None, "", "a b"])


def test_probabilities_add_up():
    train = ["a b c", "a b", "b b a", "c", "d a a a"]
    _, (p2, words) = brute(train, [])
    for u in ("<start>", ("w", "a"), ("w", "d"), ("w", "new")):
        assert sum(p2(u, w) for w in words) + p2(u, "unseen") == pytest.approx(1)


def test_frequent_words_are_spread(spark):
    train = [f"the w{i} the w{i + 1} the" for i in range(3000)]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id bigint, text string")
    model = lm.train(rows)
    assert len(model.hot) >= 2 and len(model.hot) <= 8 * (model.pair_buckets // 4) + 1
    same(spark, train, train[:200])
