"""License scan against plain Python."""

import random
import re

import pytest

from wordspace.llm import licenses

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
SCHEMA = "doc_id bigint, text string, row string, template string, n_words string"


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    own, places, labels = words(text), [], set()
    for phrase, label in licenses.PHRASES.items():
        wanted = phrase.split()
        at = [i for i in range(len(own)) if own[i : i + len(wanted)] == wanted]
        places += at
        labels |= {label} if at else set()
    return len(own), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def aligned(wanted, own, limit):
    """The most word pairs of ``wanted`` that follow one another in ``own`` with no more than ``limit`` words' drift."""
    hits = [(j, i) for j in range(len(wanted) - 1) for i in range(len(own) - 1) if own[i : i + 2] == wanted[j : j + 2]]
    best = 0
    for low in sorted({i - j for j, i in hits}):
        # Longest common subsequence of the pairs, one start of drift at a time.
        chain = {}
        for j, i in sorted(h for h in hits if low <= h[1] - h[0] <= low + limit):
            chain[j, i] = 1 + max((n for (a, b), n in chain.items() if a < j and b < i), default=0)
        best = max(best, *chain.values())
    return best


def scores(text, drift=1.0):
    """Share of each wording in one place, with at least or at most the drift that a band covers."""
    own, out = words(text), {}
    for label, wording in licenses.TEXTS.items():
        wanted = wording.split()
        pairs = len(wanted) - 1
        slack = max(licenses.SLACK, int((1 - licenses.SHARE) * pairs + 1e-9))
        share = aligned(wanted, own, int(drift * (slack + 1)) - 1 if drift > 1 else slack) / pairs
        out[label] = share if share >= licenses.SHARE else 0
    return out


def check(spark, texts):
    rows = [(i, t, "r", "t", "n") for i, t in enumerate(texts)]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        row = got[i]
        assert (row.n_words, row.n_base, row.first_word, row.last_word, row.base_labels) == base(text), text
        # What fits half a band is found; what is found fits a band.
        least, most = scores(text), scores(text, 2.0)
        own = set(filter(None, row.base_labels.split(",")))
        labels = set(filter(None, row.labels.split(",")))
        assert own | {l for l, share in least.items() if share} <= labels <= own | {l for l, share in most.items() if share}, text
        assert row.labels == ",".join(sorted(labels))
        if row.n_base:
            assert row.score == 1
        else:
            assert max(least.values()) - 1e-12 <= row.score <= max(most.values()) + 1e-12


def test_odd_texts(spark):
    check(spark, [
        None, "", " . ", "mit", "MIT License", "mit\nlicense mit. License", "CC-BY cc by by cc by", "İmit license K", "mİt license",
        "émit license", "mit licensé", "mit2 license", "gnu general public license", "GNU General\tPublic, License gnu general public",
        "gnu gnu general public license", "apache license apache license", "x " * 400_000 + "mit license",
    ])


def test_wordings_with_changes(spark):
    random.seed(3)
    texts = []
    for wording in licenses.TEXTS.values():
        for changes in range(6):
            own = wording.split()
            for _ in range(changes):
                at = random.randrange(len(own))
                own[at : at + random.randrange(2)] = ["extra"] * random.randrange(3)
            texts.append("of the " * random.randrange(4) + " ".join(own).upper() + random.choice(["", ". MIT license", " and " + wording]))
    check(spark, texts)


def test_random_words(spark):
    random.seed(5)
    some = "gnu general public license apache cc by mit the of software provided is as all rights reserved".split()
    check(spark, [" ".join(random.choices(some, k=random.randrange(60))) for _ in range(150)])


def test_empty_table_and_repeated_rows(spark):
    assert licenses.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = spark.createDataFrame([(1, "mit license", "", "", "")] * 3 + [(None, None, None, None, None)], SCHEMA)
    assert sorted(r.n_base for r in licenses.scan(rows).collect()) == [0, 1, 1, 1]


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    plan = licenses.scan(rows)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan


def test_scattered_words_are_no_quotation(spark):
    bsd = licenses.TEXTS["bsd-notice"].split()
    pairs = [f"{a} {b}" for a, b in zip(bsd, bsd[1:])]
    random.seed(8)
    shuffled = random.sample(pairs, len(pairs))
    texts = [
        " ".join(reversed(pairs)), " x ".join(reversed(pairs)), " ".join(shuffled), " ".join(reversed(bsd)), " ".join(pairs[: len(pairs) // 2]) * 3,
        "The album was released under the label in May", "all rights reserved seats are sold", "The work is licensed and provided as is",
    ]
    rows = [(i, t, "r", "t", "n") for i, t in enumerate(texts)]
    got = licenses.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [(r.labels, r.score) for r in got] == [("", 0)] * len(texts)


def test_a_wording_said_many_times(spark):
    text = " ".join([licenses.TEXTS["isc-notice"]] * 300)
    row = licenses.scan(spark.createDataFrame([(1, text, "r", "t", "n")], SCHEMA)).first()
    assert (row.labels, row.score) == ("isc-notice", 1)
