"""One registered query per operator, over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordspace.llm import (
    chat, decontaminate, exact_dedup, extraction, importance, licenses, lm, mixing, near_dedup, quality, search, toxicity, warc,
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(key: str, divisor: int):
    """crc32 of the id as text, modulo a divisor; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % divisor


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under a model of those whose remainder by 7 is not 2."""
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = lm.train(documents.filter(remainder("doc_id", 7) != 2))
    scores = lm.score(documents, model)
    return scores.withColumn("held_out", remainder("doc_id", 7) == 2)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the labels whose remainder by 5 is not 0."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(documents, labels, learn=remainder("doc_id", 5) != 0)
    return quality.score(documents, model).withColumn("held_out", remainder("doc_id", 5) == 0)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of each document."""
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def tree(docs: DataFrame) -> list:
    """The names of a document's domain, language and source."""
    return [mixing.domain(docs["source"]), docs["lang"], docs["source"]]


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often the mix by target weights holds each document."""
    documents = table(spark, sf_dir, "documents")
    return mixing.assign(documents, tree(documents))


def _weights_sql(names: dict[str, int]) -> str:
    return "CASE path " + " ".join(f"WHEN '{name}' THEN {weight}" for name, weight in names.items()) + " ELSE 1 END"


def _share_sql(level: str, parent: str, given: str, above: str) -> str:
    """Budgets of one level of the tree: ``{level}(path, budget)`` from those of the level above."""
    return f"""
{level}_a AS (
  SELECT *, most / weight AS ratio FROM (
    SELECT {level} AS path, {parent} AS parent, {mixing.EPOCHS} * sum(n) AS most FROM leaf GROUP BY ALL) AS x,
    LATERAL (SELECT {_weights_sql(mixing.WEIGHTS)} AS weight) {above}),
{level}_b AS (
  SELECT path, parent, most, weight, row_number() OVER w AS place,
         {given} - coalesce(sum(most) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spare,
         sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM {level}_a WINDOW w AS (PARTITION BY parent ORDER BY ratio, path)),
{level}_c AS (
  SELECT parent, arg_min(spare, place) FILTER (most * heavy > weight * spare) AS spare_open,
         arg_min(heavy, place) FILTER (most * heavy > weight * spare) AS heavy_open
  FROM {level}_b GROUP BY parent),
{level}_d AS (
  SELECT path, CASE WHEN most * heavy <= weight * spare THEN most ELSE weight * spare_open // heavy_open END::BIGINT AS budget
  FROM {level}_b JOIN {level}_c USING (parent))"""


OP4_SQL = f"""
WITH d AS (
  SELECT doc_id, domain, domain || '/' || lang AS lang, domain || '/' || lang || '/' || source AS source, n_tokens FROM (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           'domain' || coalesce(try_cast(regexp_extract(coalesce(source, ''), '[0-9]{{1,9}}') AS INT) % 3, 0) AS domain,
           len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens
    FROM documents)),
leaf AS (SELECT domain, lang, source, sum(n_tokens) AS n FROM d GROUP BY ALL),
total AS (SELECT sum(n) * {mixing.PERCENT} // 100 AS total FROM leaf),
{_share_sql("domain", "''", "total", ", total")},
{_share_sql("lang", "domain", "budget", "JOIN (SELECT path AS up, budget FROM domain_d) ON up = parent")},
{_share_sql("source", "lang", "budget", "JOIN (SELECT path AS up, budget FROM lang_d) ON up = parent")},
e AS (
  SELECT doc_id, path, n_tokens, budget, n, coalesce(budget // nullif(n, 0), 0)::BIGINT AS epoch
  FROM d JOIN leaf USING (source) JOIN source_d ON path = source),
f AS (
  SELECT *, md5('{mixing.SEED}#' || epoch || '#' || coalesce(doc_id::VARCHAR, '')) || '#' || coalesce(doc_id::VARCHAR, '') AS place FROM e)
SELECT doc_id, path, n_tokens, budget,
       epoch + (n > 0 AND sum(n_tokens) OVER (PARTITION BY path ORDER BY place) <= budget - epoch * n)::BIGINT AS copies
FROM f
"""


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy that stays, for each document."""
    return exact_dedup.assign(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extraction.extract(table(spark, sf_dir, "pages"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       row_number() OVER w = 1 AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY points DESC, doc_id)
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items that each document quotes."""
    return decontaminate.quotations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one whose texts look like control strings, formatted and read back."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    tricky = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], turns.schema)
    return chat.digests(chat.conversations(chat.chains(turns.unionByName(tricky))))


def _escaped_sql(column: str) -> str:
    out = f"replace({column}, '&', '&amp;')"
    for control in chat.CONTROLS:
        out = f"replace({out}, '{control}', '{chat.ENTITIES[control[0]] + control[1:]}')"
    return out


OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS learned,
         sum({len(chat.TURN + chat.END) + 1} + length(replace({_escaped_sql('role')}, chr(10), '&#10;'))
             + length({_escaped_sql('text')})) AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, length(learned) AS loss_chars, sha256(learned) AS loss_sha256,
       formatted_chars::BIGINT AS formatted_chars
FROM c
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back."""
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP9_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS held FROM p),
r AS (SELECT *, payload_bytes >= {warc.REVISITED} AND held IS NOT NULL AND page_id IS DISTINCT FROM held AS revisit FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN revisit THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN revisit THEN held END AS refers_to
FROM r
"""


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and wordings in all documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents of 20 words or more, drawn to resemble the benchmark."""
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH RECURSIVE crc_table AS (
  SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) AS r(i)),
texts AS (
  SELECT true AS own, row_number() OVER () AS id, doc_id, text FROM documents
  UNION ALL SELECT false, row_number() OVER (), NULL, text FROM benchmark),
split AS (
  SELECT own, id, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM texts),
runs AS (
  SELECT own, id, unnest(w) AS f FROM split
  UNION ALL SELECT own, id, unnest(list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1])) FROM split),
counted AS (SELECT own, id, f, count(*) AS n FROM runs GROUP BY ALL),
steps AS (
  SELECT f, hex(encode(f)) AS x, 0 AS p, 4294967295::BIGINT AS c FROM (SELECT DISTINCT f FROM counted)
  UNION ALL
  SELECT f, x, p + 1, xor(c >> 8, v) FROM steps JOIN crc_table ON i = xor(c, ('0x' || substr(x, 2 * p + 1, 2))::BIGINT) & 255
  WHERE 2 * p < length(x)),
hashed AS (SELECT f, xor(c, 4294967295) % 10000 AS b FROM steps WHERE 2 * p = length(x)),
buckets AS (
  SELECT b, coalesce(sum(n) FILTER (own), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (NOT own), 0)::DOUBLE AS t
  FROM counted JOIN hashed USING (f) GROUP BY b),
gains AS (
  SELECT b, floor(1000 * ln((t + 1) * ((SELECT sum(s) FROM buckets) + 10000) / ((s + 1) * ((SELECT sum(t) FROM buckets) + 10000))))::BIGINT AS g
  FROM buckets),
weighed AS (
  SELECT id, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight
  FROM counted JOIN hashed USING (f) JOIN gains USING (b) WHERE own GROUP BY id),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE)
           / 4294967296::DOUBLE)))::BIGINT AS score
  FROM split LEFT JOIN weighed USING (id) WHERE own),
ranked AS (
  SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS FIRST) END AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN place <= 25 * (SELECT count(*) FROM scored WHERE n_words >= 20) // 100 THEN place END AS rank
FROM ranked
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of the toxicity labels whose remainder by 5 is not 0."""
    documents, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(documents, labels, learn=remainder("doc_id", 5) != 0)
    return toxicity.score(documents, model).withColumn("held_out", remainder("doc_id", 5) == 0)


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for every benchmark item."""
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP13_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lengths AS (SELECT id, doc_id, len(w)::BIGINT AS n FROM words WHERE len(w) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS length FROM lengths),
asked AS (
  SELECT DISTINCT number, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT row_number() OVER () AS number, * FROM benchmark)),
tf AS (
  SELECT id, term, count(*)::BIGINT AS tf FROM (SELECT id, unnest(w) AS term FROM words) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w
  FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), totals),
factors AS (SELECT id, doc_id, 10 + (90 * n * docs) // length AS m FROM lengths, totals),
scores AS (
  SELECT number, item_id, id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weights USING (term) JOIN factors USING (id) GROUP BY ALL),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM ranked WHERE rank <= 10
"""


QUERIES = {
    "op1_lm_scoring": op1_lm_scoring,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_near_dedup": op3_near_dedup,
    "op4_mixing": op4_mixing,
    "op5_html_extraction": op5_html_extraction,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_decontamination": op7_decontamination,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_warc": op9_warc,
    "op10_license_scan": op10_license_scan,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_toxicity": op12_toxicity,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op4_mixing": OP4_SQL,
    "op6_exact_dedup": OP6_SQL,
    "op8_chat_formatting": OP8_SQL,
    "op9_warc": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}
