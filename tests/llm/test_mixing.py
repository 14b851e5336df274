"""Budgets and the documents that fill them against plain Python."""

import hashlib
import random
from collections import defaultdict

import pytest

from wordspace.llm import mixing

SCHEMA = "doc_id bigint, text string, lang string, source string, tokens string, path string"


def fill(given, nodes):
    """Integer shares of siblings ``{name: (weight, most)}``, the nodes short of their part first."""
    out, left = {}, given
    waiting = sorted(nodes, key=lambda n: (nodes[n][1] / nodes[n][0] if nodes[n][0] > 0 else 0, n))
    while waiting:
        name = waiting[0]
        weight, most = nodes[name]
        heavy = sum(max(nodes[n][0], 0) for n in waiting)
        if weight <= 0:
            out[name] = 0
        elif most * heavy <= weight * left:
            out[name] = most
            left -= most
        else:
            return out | {n: nodes[n][0] * left // heavy for n in waiting}
        waiting.pop(0)
    return out


def brute(rows, weights, percent, epochs, seed):
    leaf = defaultdict(int)
    for doc, text, path in rows:
        leaf[path] += len((text or "").split())

    def below(prefix, given):
        depth = len(prefix)
        if depth == 3:
            return {prefix: given}
        most, out = defaultdict(int), {}
        for path, n in leaf.items():
            if path[:depth] == prefix:
                most[path[: depth + 1]] += epochs * n
        parts = fill(given, {p: (weights.get("/".join(p), 1), m) for p, m in most.items()})
        for part, own in parts.items():
            out |= below(part, own)
        return out

    budget = below((), sum(leaf.values()) * percent // 100)
    keys = defaultdict(lambda: defaultdict(int))
    order = {}
    for doc, text, path in rows:
        epoch = budget[path] // leaf[path] if leaf[path] else 0
        name = "" if doc is None else str(doc)
        key = hashlib.md5(f"{seed}#{epoch}#{name}".encode()).hexdigest() + "#" + name
        order[doc, path] = epoch, key
        keys[path][key] += len((text or "").split())
    taken = set()
    for path, own in keys.items():
        rest = budget[path] - (budget[path] // leaf[path] * leaf[path] if leaf[path] else 0)
        run = 0
        for key in sorted(own):
            run += own[key]
            if leaf[path] and run <= rest:
                taken.add((path, key))
    return [
        (doc, "/".join(path), len((text or "").split()), budget[path], order[doc, path][0] + ((path, order[doc, path][1]) in taken))
        for doc, text, path in rows
    ]


def check(spark, rows, weights=mixing.WEIGHTS, percent=mixing.PERCENT, epochs=mixing.EPOCHS):
    docs = spark.createDataFrame([(*r, "t", "p") for r in rows], SCHEMA)
    names = [mixing.domain(docs["source"]), docs["lang"], docs["source"]]
    got = mixing.assign(docs, names, weights=weights, percent=percent, epochs=epochs)
    plain = []
    for doc, text, lang, source in rows:
        number = "".join(c if c.isdigit() else " " for c in source or "").split()
        plain.append((doc, text, (f"domain{int(number[0]) % 3 if number else 0}", lang or "", source or "")))
    want = brute(plain, weights, percent, epochs, mixing.SEED)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    mixed = mixing.mix(docs, names, weights=weights, percent=percent, epochs=epochs)
    assert mixed.columns == [*docs.columns, "mix_copies"]
    assert sorted(((r.doc_id, r.mix_copies) for r in mixed.collect()), key=repr) == sorted(((w[0], w[4]) for w in want if w[4]), key=repr)
    return want


def some(n, seed):
    random.seed(seed)
    rows = []
    for i in range(n):
        source = "src0" if random.random() < 0.4 else f"src{random.randrange(12)}"
        rows.append((i, "w " * random.choice([0, 3, 40, 200]), random.choice(["en", "en", "de", "fr", "es", "xx"]), source))
    return rows


@pytest.mark.parametrize("percent,epochs", [(80, 2), (30, 1), (200, 2), (500, 3), (0, 1)])
def test_budgets_and_prefixes(spark, percent, epochs):
    want = check(spark, some(400, percent), percent=percent, epochs=epochs)
    total = sum(w[2] for w in want)
    assert sum(w[2] * w[4] for w in want) <= min(total * percent // 100, total * epochs)


def test_shortage_goes_to_siblings_first(spark):
    rows = [(i, "w " * 100, lang, "src0") for i, lang in enumerate(["en"] + ["de"] * 20)] + [(100 + i, "w " * 100, "en", "src1") for i in range(40)]
    want = check(spark, rows, percent=50, epochs=1)
    budget = {w[1]: w[3] for w in want}
    # domain0 has 5 of 8 parts of 3,050 tokens; its one English document is used up, German takes the rest.
    assert budget["domain0/en/src0"] == 100 and budget["domain0/de/src0"] == 3050 * 5 // 8 - 100
    assert budget["domain1/en/src1"] == 3050 * 3 // 8


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, "a b", None, None), (1, "a b c", "en", "src1"), (1, "a b c", "en", "src1"), (2, "", "de", "nowhere"),
            (3, " \t\n", "de", "src99999999999"), (4, "x " * 100_000, "en", "src4")]
    check(spark, rows)
    check(spark, rows, weights={"domain0": 0, "domain1": 7})
    check(spark, [])
