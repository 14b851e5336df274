"""Quoted benchmark items against an edit distance in plain Python."""

import random
import re

import pyarrow as pa
import pytest

from wordspace.llm import decontaminate

SCHEMA = "doc_id bigint, text string, items string, edits string, id string"


def normal(text):
    return re.sub(b"[^0-9a-z\x80-\xff]+", b" ", re.sub(b"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))


def least_edits(item, text):
    cost = list(range(len(item) + 1))
    best = cost[-1]
    for c in text:
        before, cost = cost, [0]
        for j, want in enumerate(item, 1):
            cost.append(min(before[j - 1] + (c != want), before[j] + 1, cost[-1] + 1))
        best = min(best, cost[-1])
    return best


def brute(texts, items):
    out = []
    for text in texts:
        found = {}
        for number, item in enumerate(items):
            want = normal(item)
            size = len(want)
            if size >= decontaminate.Q:
                edits = least_edits(want, normal(text))
                if edits <= min(int(size * decontaminate.EDITS), (size - decontaminate.Q) // decontaminate.Q):
                    found[number] = edits
        out.append((sorted(found), min(found.values(), default=None)))
    return out


def check(spark, texts, items, **options):
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in enumerate(texts)], SCHEMA)
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    got = {r.doc_id: r for r in decontaminate.quotations(docs, bench, **options).collect()}
    want = brute(texts, items)
    assert len(got) == len(texts)
    for i, (found, edits) in enumerate(want):
        assert (got[i]["items"], got[i].edits, got[i].contaminated) == (found, edits, bool(found)), (i, texts[i])
    clean = decontaminate.drop_contaminated(docs, bench, **options)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, (found, _) in enumerate(want) if not found]


def words(n):
    return " ".join(random.choice("the of and é anre thing erly onth hand whst édition, Ab. re\n".split(" ")) + random.choice("abcdxyz") for _ in range(n))


def edited(text, edits):
    own = list(text)
    for _ in range(edits):
        at = random.randrange(len(own))
        own[at : at + random.randrange(2)] = random.choice(["", "q", "w", "é"])
    return "".join(own)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_edited_quotations(spark, block_bytes):
    random.seed(6)
    items = [words(random.randrange(8, 40)) for _ in range(12)]
    texts = [words(30) for _ in range(20)]
    for _ in range(90):
        item = random.choice(items)
        texts.append(words(random.randrange(20)) + " " + edited(item, random.randrange(len(item) // 7)) + " " + words(random.randrange(20)))
    texts += [items[0][: len(items[0]) // 2], items[1] + items[2], items[3].upper().replace(" ", " ,;\n ")]
    check(spark, texts, items, block_bytes=block_bytes)


def test_odd_texts(spark):
    items = [None, "", "short", "exactly8", "a longer item, with a few words in it", "A longer item with a few words in it!", "aaaa aaaa aaaa aaaa aaaa"]
    texts = [None, "", "short", "it is exactly8 here", " ...", "a longer item", "so a longer item with, a few words in itt", "a" * 5000, "aaaa " * 40]
    check(spark, texts, items)


def test_no_items_and_no_texts(spark):
    check(spark, ["a text of some words"], [])
    check(spark, [], ["a text of some words"])


def test_long_text_and_long_item(spark, monkeypatch):
    random.seed(7)
    item, long_item = words(40), words(500)
    far = words(300_000)
    docs = spark.createDataFrame([(1, far + " " + item + " " + far), (2, far), (3, words(30) + long_item[900:2200])], "doc_id bigint, text string")
    bench = spark.createDataFrame([(1, item), (2, long_item)], "item_id bigint, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.quotations(docs, bench).collect()}
    assert got == {1: [1], 2: [], 3: [2]}


def test_repeated_rows_stay_apart(spark):
    docs = spark.createDataFrame([(1, "some words that are an item")] * 2 + [(None, "some words that are an item")], "doc_id bigint, text string")
    bench = spark.createDataFrame([(4, "some words that are an item"), (4, "some words that are an item"), (None, "words that are an item")], "item_id bigint, text string")
    assert [r["items"] for r in decontaminate.quotations(docs, bench).collect()] == [[4]] * 3


def test_passages_at_every_offset():
    random.seed(8)
    for size in (1, 60, 200, 900):
        whole = words(50 + size)
        item = normal(whole).decode("utf-8", "replace").replace("\ufffd", "e")
        block = decontaminate.index([5], [item])
        least = decontaminate.PASSAGE
        around = [words(20) + " ", " " + words(20)]
        starts = range(0, len(item.encode()) - least + 1, 1 if size < 900 else 7)
        texts = [around[0] + item.encode()[at : at + least].decode("utf-8", "ignore") + around[1] for at in starts]
        found = decontaminate.find(block, pa.array(texts))
        assert set(found[0].tolist()) == set(range(len(texts)))
        assert decontaminate.find(block, pa.array([words(60) for _ in range(50)]))[0].size == 0


def test_passages_of_fifty_words(spark):
    random.seed(9)
    items = [words(n) for n in (70, 130, 400, 2000)]
    docs, want = [], {}
    for number, item in enumerate(items):
        parts = item.split(" ")
        for at in range(0, len(parts) - 50, 9):
            want[len(docs)] = [number]
            docs.append((len(docs), words(30) + " " + " ".join(parts[at : at + 50]) + " " + words(30)))
    docs = spark.createDataFrame(docs, "doc_id bigint, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    assert {r.doc_id: r["items"] for r in decontaminate.quotations(docs, bench).collect()} == want
    assert decontaminate.drop_contaminated(docs, bench).count() == 0


def test_repetition_takes_no_memory():
    import tracemalloc

    line = "all rights reserved "
    cases = [("a" * 2000, "a" * 200_000), (line * 100, line * 4_000), (line * 16, line * 2_000 + "x" + line * 2_000)]
    for item, text in cases:
        block = decontaminate.index([[1]], [item])
        tracemalloc.start()
        found = decontaminate.find(block, pa.array(["clean text", text]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert set(found[0].tolist()) == {1} and found[2].min() == 0
        assert peak < 400 << 20


def test_slices_of_votes_change_nothing(monkeypatch):
    random.seed(10)
    items = [words(n) for n in (20, 40, 90, 300)] + ["of the and it is so " * 30]
    texts = [words(60) + " " + edited(random.choice(items), 6) + " " + words(60) for _ in range(12)] + [items[4] * 3, words(500)]
    block = decontaminate.index([[i] for i in range(len(items))], items)
    best = lambda found: {(t, o) for t, w in zip(found[0].tolist(), found[1].tolist()) for o in block.owners[w]}
    whole = best(decontaminate.find(block, pa.array(texts)))
    assert len({t for t, _ in whole}) >= 9
    for together, size in ((1 << 20, 700), (0, 2000)):
        monkeypatch.setattr(decontaminate, "TOGETHER", together)
        monkeypatch.setattr(decontaminate, "SLICE", size)
        assert best(decontaminate.find(block, pa.array(texts))) == whole


def test_equal_and_very_long_items(spark, monkeypatch):
    random.seed(11)
    monkeypatch.setattr(decontaminate, "SEGMENT", 20_000)
    far = words(10_000)
    items = [(i, "the same item said by very many rows of the benchmark") for i in range(3000)] + [(9000, far), (None, "the same item said by very many rows of the benchmark")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    at = far.index(" ", len(far) // 2)
    texts = [(1, "so the same item said by very many rows of the benchmark"), (2, far[at : at + 500]), (3, words(50))]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    got = {r.doc_id: r["items"] for r in decontaminate.quotations(docs, bench).collect()}
    assert got == {1: list(range(3000)), 2: [9000], 3: []}
