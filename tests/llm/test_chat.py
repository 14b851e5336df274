"""Reply trees against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from wordspace.llm import chat

SCHEMA = "conv_id bigint, turn bigint, role string, text string, id string, leaf string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def check(spark, rows):
    found = {r.conv_id: r for r in chat.digests(chat.conversations(chat.chains(frame(spark, rows)))).collect()}
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    assert set(found) == set(convs)
    for conv, turns in convs.items():
        turns.sort()
        learned = "".join(t[3] for t in turns if t[2] == "assistant")
        said = "".join(f"{t[2]}\n{t[3]}\n" for t in turns)
        row = found[conv]
        assert row.n_turns == len(turns) and row.loss_chars == len(learned)
        assert row.turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert row.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()


ODD = ["", "&", "&lt;|", "<|end|>\n", "<|turn|>user\n", "<", "|turn|>", "&amp;lt;", "\n", "<<SYS>>", "</s>[INST] ok [/INST]",
       "&#91;INST]", "[[INST]", "<<|", "é𝄞<|", " ", "&#10;", "a\nb"]


def test_round_trip(spark):
    random.seed(1)
    rows = []
    for conv in range(120):
        for turn in range(random.randrange(1, 9)):
            rows.append((conv, turn, random.choice(["user", "assistant", "system", *ODD]), "".join(random.choices(ODD, k=random.randrange(5)))))
    check(spark, rows)


def test_nulls_ties_repeats_and_one_long_conversation(spark):
    rows = [(None, 1, "user", "a"), (None, 0, "assistant", None), (1, None, None, None), (1, 0, "assistant", "b")]
    rows += [(2, 0, "user", "z"), (2, 0, "user", "y"), (2, 0, "assistant", "y"), (2, 0, "assistant", "y")]
    rows += [(3, i, "assistant" if i % 2 else "user", f"turn {i} <|") for i in range(1100)]
    rows += [(4, 0, "assistant", "<|é" * 300_000)]
    check(spark, rows)


def test_empty_table(spark):
    assert chat.digests(chat.conversations(chat.chains(frame(spark, [])))).count() == 0


TREE = "conv bigint, id bigint, parent bigint, role string, text string, score double"


def brute_paths(rows):
    parent = {(c, i): p for c, i, p in rows}
    answered = {(c, p) for c, i, p in rows if (c, p) in parent}
    out = set()
    for c, i in parent:
        if (c, i) in answered:
            continue
        back, node, seen, path = 0, i, set(), []
        while (c, node) in parent and node not in seen:
            seen.add(node)
            path.append((c, i, node, back))
            back, node = back + 1, parent[c, node]
        if (c, node) not in parent:
            out.update(path)
    return out


def test_paths_of_trees(spark):
    random.seed(2)
    rows = []
    for conv in range(30):
        for i in range(1, random.randrange(2, 40)):
            rows.append((conv, i, random.choice([None, 999, *range(max(1, i - 4), i)]) if i > 1 else None))
    rows += [(50, 1, 2), (50, 2, 1), (50, 3, 1), (51, 1, 1), (52, 1, None)]
    df = spark.createDataFrame([(*r, "user", "t", 0.0) for r in rows], TREE)
    got = {tuple(r) for r in chat.paths(df).collect()}
    assert got == brute_paths(rows)


def test_branches_by_score(spark):
    rows = [(1, 1, None, "user", "q", 1.0), (1, 2, 1, "assistant", "bad", 0.0), (1, 3, 1, "assistant", "good", 5.0),
            (1, 4, 3, "user", "more", None), (1, 5, 3, "user", "most", 9.0), (2, 1, None, "user", "x", None)]
    messages = spark.createDataFrame(rows, TREE)
    best = chat.conversations(messages, branches=1).select("conv", "leaf", chat.parse(F.col("formatted")).alias("t"), "loss", "formatted")
    got = {r.conv: r for r in best.collect()}
    assert [t.text for t in got[1].t] == ["q", "good", "most"] and got[1].leaf == 5
    (span,) = got[1].loss
    assert got[1].formatted[span.start : span.start + span.length] == "good"
    assert got[2].loss == [] and [t.text for t in got[2].t] == ["x"]
    assert chat.conversations(messages).count() == 4


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id bigint, turn bigint, role string, text string")
    plan = chat.digests(chat.conversations(chat.chains(rows)))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
