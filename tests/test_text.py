import pytest
from pyspark.sql import functions as F

from wordspace.functions import text as T


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    "text, expected",
    [("", []), (" a b ", ["a", "b"]), ("\t\n\x0b a\f\rb", ["a", "b"]), ("a b c", ["a b", "c"])],
)
def test_tokens(spark, text, expected):
    assert one(spark, text, T.token_array) == expected


def test_tokens_keeping_empties(spark):
    assert one(spark, " a b ", lambda t: T.token_array(t, keep_empty=True)) == ["", "a", "b", ""]


@pytest.mark.parametrize("text, expected", [("\n\nx\n", ["x"]), ("a\r\nb\rc", ["a", "b", "c"]), ("", [])])
def test_sentences(spark, text, expected):
    assert one(spark, text, T.sentence_array) == expected


@pytest.mark.parametrize(
    "text, expected", [("a\nb\r\nc\n", "a b c"), ("a\n\nb", "a  b"), ("", ""), ("x\n\n", "x "), ("x", "x")]
)
def test_lines_to_text(spark, text, expected):
    assert one(spark, text, T.lines_to_text) == expected


def test_newswire_body(spark):
    text = '<BODY>The U.S.A. grew. Mr. Smith said "yes." Then it fell...  End\nReuter\n&#3;</BODY>'
    assert one(spark, text, T.sgml_to_sentences) == 'The USA grew\nSmith said "yes"\nThen it fell\nEnd Reuter '


@pytest.mark.parametrize(
    "text, expected",
    [
        ("no body", ""),
        ("head <BODY>One two. Three four</BODY>", "One two\nThree four</BODY>"),
        ("<BODY>A b.&#3;</BODY> skip <BODY>C d.&#3;</BODY> tail", "A b\nC d"),
        ("<BODY>word&#3;</BODY>", ""),
        ("x <BODY>y z&#3;</BODY>q<BODY>", "y z"),
        ("  <BODY>  a b  \n  c  &#3;</BODY>", "  a b c  "),
        ("<BODY>it is 3.5 now. ok then. Yes it is&#3;</BODY>", "it is 35 now ok then\nYes it is"),
    ],
)
def test_newswire_cases(spark, text, expected):
    assert one(spark, text, T.sgml_to_sentences) == expected


@pytest.mark.parametrize(
    "text, expected",
    [
        ("a <t>x</t> <t>y</t>", "x"), ("<t>open end", "open end"), ("none", None), ("<t></t>", ""),
        ("<t>a<t>b</t>", "a<t>b"),
    ],
)
def test_tag_contents(spark, text, expected):
    assert one(spark, text, lambda t: T.tag_contents(t, "t")) == expected


def test_tag_names_are_literal(spark):
    assert one(spark, "<axb>no</axb><a.b>yes</a.b>", lambda t: T.tag_contents(t, "a.b")) == "yes"


def test_topics_and_rejects(spark):
    docs = spark.createDataFrame(
        [(1, "<topics>a b</topics> <body>x y</body>"), (2, "<topics>a</topics>"), (3, "plain")], "doc_id int, text string"
    )
    rows = {r.doc_id: r for r in T.split_topics(docs).collect()}
    assert (rows[1].topics, rows[1].body, rows[1].rejected) == ("a b", "x y", False)
    assert rows[2].rejected and rows[3].rejected


def test_positions(spark):
    docs = spark.createDataFrame([(1, "a b\n\nc"), (2, ""), (3, None)], "doc_id int, text string")
    found = sorted(tuple(r) for r in T.tokens(docs).collect())
    assert found == [(1, 0, 0, "a"), (1, 0, 1, "b"), (1, 1, 0, "c")]


def test_each_tokenises_once(spark):
    """The optimizer must not add a filter that evaluates the token array again."""
    docs = spark.range(1).selectExpr("id AS doc_id", "cast(id AS string) AS text").repartition(2)
    plan = T.document_words(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1
