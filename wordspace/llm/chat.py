"""Reply trees as conversations.

Messages point to the one they answer. Self-joins that double the reach of the pointers
list every path from a first message to a last one in as many rounds as the depth has
binary digits; branches are ranked by score, and each chosen path becomes one string in
which turns are marked, control strings in texts are escaped, and the assistant's texts
are marked as the spans that a loss counts. All of it is built-in functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordspace.sources.scratch import materialize

# The marks around a turn, and the strings that no text may hold as they are.
TURN, END = "<|turn|>", "<|end|>\n"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
ENTITIES = {"<": "&lt;", "[": "&#91;"}

LEARNED = "assistant"


def escape(text: Column) -> Column:
    """The text with the first character of each control string, and each ``&``, as an entity."""
    marked = F.replace(text, F.lit("&"), F.lit("&amp;"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(ENTITIES[c[0]] + c[1:])), CONTROLS, marked)


def unescape(text: Column) -> Column:
    plain = reduce(lambda t, e: F.replace(t, F.lit(e[1]), F.lit(e[0])), ENTITIES.items(), text)
    return F.replace(plain, F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


def chains(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Messages of linear conversations: each turn answers the one before it.

    Equal turn numbers go by role, then text; a null number comes first. Null roles and
    texts are empty. Rows of a null conversation are one conversation.
    """
    blank = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), blank(role).alias("role"), blank(text).alias("text"))
    place = F.row_number().over(Window.partitionBy("conv").orderBy("turn", "role", "text")).cast("bigint")
    return rows.withColumn("id", place).select(
        "conv", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def _same(a: str, b: str, left: str, right: str) -> Column:
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def paths(messages: DataFrame) -> DataFrame:
    """``(conv, leaf, id, back)``: the messages on the path to each last message, ``back`` steps from it.

    ``messages`` has ``(conv, id, parent)`` with ids distinct in a conversation. A parent
    that is not there makes its reply a first message. A message whose parents run in a
    circle has no first message, so its path is left out, and a circle has no last one.
    """
    links = messages.select("conv", "id", "parent")
    known = links.select(F.col("conv").alias("c"), F.col("id").alias("p"))
    up = materialize(
        links.join(known, F.col("conv").eqNullSafe(F.col("c")) & (F.col("parent") == F.col("p")))
        .select("conv", "id", F.col("parent").alias("up"))
    )
    answered = up.select(F.col("conv").alias("c"), F.col("up").alias("p")).distinct()
    last = links.join(answered, F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("p")), "left_anti")
    found = last.select("conv", F.col("id").alias("leaf"), "id", F.lit(0).cast("bigint").alias("back"))
    step, nodes = 1, links.count()
    levels = [up]
    while (more := levels[-1].count()) and step <= nodes:
        a, b = levels[-1].alias("a"), levels[-1].alias("b")
        levels.append(materialize(a.join(b, _same("a", "b", "up", "id")).select("a.conv", "a.id", "b.up")))
        step *= 2
    if more:
        # Only circles reach further than there are messages: all paths that lead into one go.
        endless = levels[-1].select(F.col("conv").alias("c"), F.col("id").alias("p"))
        found = found.join(endless, F.col("conv").eqNullSafe(F.col("c")) & (F.col("id") == F.col("p")), "left_anti")
    for number, level in enumerate(levels[:-1]):
        a, b = found.alias("a"), level.alias("b")
        further = a.join(b, _same("a", "b", "id", "id")).select(
            "a.conv", "a.leaf", F.col("b.up").alias("id"), (F.col("a.back") + 2**number).alias("back")
        )
        found = materialize(found.unionByName(further))
    return found


def best_branches(messages: DataFrame, listed: DataFrame, branches: int | None = None) -> DataFrame:
    """Paths with ``(rank, branch_score)``: the mean score of their messages, best first, ties by leaf.

    Null scores count as zero. ``branches`` keeps the best so many of each conversation.
    """
    m, p = messages.alias("m"), listed.alias("p")
    scored = p.join(m, _same("p", "m", "id", "id")).select("p.*", F.coalesce("m.score", F.lit(0.0)).alias("score"))
    order = scored.groupBy("conv", "leaf").agg(F.avg("score").alias("branch_score"))
    by = Window.partitionBy("conv").orderBy(F.desc("branch_score"), "leaf")
    order = order.withColumn("rank", F.row_number().over(by))
    order = order if branches is None else order.filter(F.col("rank") <= branches)
    return listed.alias("p").join(order.alias("o"), _same("p", "o", "leaf", "leaf")).select("p.*", "o.rank", "o.branch_score")


def render(messages: DataFrame, chosen: DataFrame) -> DataFrame:
    """``(conv, leaf, rank, formatted, loss)``: one string per path, and its loss spans.

    A span is ``(start, length)`` in code points of the string, one per assistant turn.
    """
    head = F.concat(F.lit(TURN), escape_role(F.col("m.role")), F.lit("\n"))
    body = escape(F.col("m.text"))
    rows = chosen.alias("c").join(messages.alias("m"), _same("c", "m", "id", "id")).select(
        "c.conv", "c.leaf", "c.rank", (-F.col("c.back")).alias("place"), F.concat(head, body, F.lit(END)).alias("turn"),
        F.length(head).alias("head"), F.length(body).alias("body"), (F.col("m.role") == LEARNED).alias("learned"),
    )
    before = Window.partitionBy("conv", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("turn")).over(before), F.lit(0)) + F.col("head")
    rows = rows.withColumn("start", start.cast("bigint"))
    one = F.struct("place", "turn", "learned", F.struct("start", F.col("body").cast("bigint").alias("length")).alias("span"))
    turns = rows.groupBy("conv", "leaf").agg(F.first("rank").alias("rank"), F.array_sort(F.collect_list(one)).alias("turns"))
    return turns.select(
        "conv", "leaf", "rank",
        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: t["span"]).alias("loss"),
    )


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of ``(role, text)``."""
    parts = F.split(formatted, F.lit(END.replace("|", "\\|")))
    whole = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return F.transform(
        whole,
        lambda part: F.struct(
            unescape_role(F.substring_index(F.substr(part, F.lit(len(TURN) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(part, F.instr(part, "\n") + 1)).alias("text"),
        ),
    )


def learned_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss spans, as it was before escaping."""
    part = lambda s: unescape(F.substr(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")))
    return F.array_join(F.transform(loss, part), "")


def conversations(messages: DataFrame, branches: int | None = None) -> DataFrame:
    """Every reply tree of ``(conv, id, parent, role, text, score)`` formatted, its best branches first."""
    rows = materialize(messages)
    return render(rows, best_branches(rows, paths(rows), branches))


def digests(formatted: DataFrame) -> DataFrame:
    """What a reader gets back from each formatted conversation."""
    turn = lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))
    read = formatted.select(
        F.col("conv").alias("conv_id"), "formatted", parse(F.col("formatted")).alias("turns"),
        learned_text(F.col("formatted"), F.col("loss")).alias("learned"),
    )
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", turn), "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
