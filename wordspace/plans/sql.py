"""The SQL counterparts of the queries, written the direct way.

They join token pairs, explode every cell and subtract dense means, so they share no
shortcut with the DataFrame code they check.
"""

from __future__ import annotations

SIZE, K, RADIUS, SEED = 1024, 8, 3, 7

# The separators, as in the text functions.
TOKEN_BREAK = r"[ \t\n\x0B\f\r]+"
SENTENCE_BREAK = r"[\n\r]+"
LINE_BREAK = r"\r\n|\n|\r"

CORPORA = {
    "documents": "SELECT doc_id AS doc, text FROM documents",
    "conversations": "SELECT conv_id || ':' || turn AS doc, text FROM conversations",
    "benchmark": "SELECT item_id AS doc, text FROM benchmark",
    "lines": "SELECT conv_id || ':' || turn AS doc, text FROM conversations UNION ALL SELECT 'b' || item_id, text FROM benchmark",
}

DIGEST = """count(dim)::BIGINT AS cells, coalesce(sum(val), 0)::BIGINT AS total,
  coalesce(sum(val * val), 0)::BIGINT AS squares, coalesce(sum((dim + 1) * val), 0)::BIGINT AS moment,
  coalesce(sum((dim + 1) * val * val), 0)::BIGINT AS spread"""


def _split(text: str, pattern: str = TOKEN_BREAK) -> str:
    return f"list_filter(string_split_regex({text}, '{pattern}'), lambda x: x <> '')"


def _tokens(name: str, corpus: str) -> str:
    """``name(doc, pos, word)``: the tokens of a corpus, numbered through each document."""
    return f"""{name} AS (
  SELECT doc, unnest(words) AS word, generate_subscripts(words, 1) AS pos
  FROM (SELECT doc, {_split('text')} AS words FROM ({CORPORA.get(corpus, corpus)})))"""


def _sentence_tokens(name: str, corpus: str) -> str:
    """``name(doc, sent, pos, word)``: the tokens of a corpus, numbered through each sentence."""
    return f"""{name} AS (
  SELECT doc, sent, unnest(words) AS word, generate_subscripts(words, 1) AS pos
  FROM (SELECT doc, sent, {_split('sentence')} AS words
    FROM (SELECT doc, unnest(parts) AS sentence, generate_subscripts(parts, 1) AS sent
      FROM (SELECT doc, {_split('text', SENTENCE_BREAK)} AS parts FROM ({CORPORA[corpus]})))))"""


def _index(name: str, words: str, size: int = SIZE, k: int = K) -> str:
    """``name(word, dim, val)``: index vectors of the distinct words of a relation."""
    def bits(number: str, start: int, digits: int) -> str:
        return f"('0x' || substr(md5(word || '#' || {number}), {start}, {digits}))::BIGINT"

    width = f"((i + 1) * {size} // {k} - i * {size} // {k})"
    return f"""{name} AS (
  SELECT word, (i * {size} // {k} + {bits('i', 1, 8)} % {width})::INTEGER AS dim,
    CASE WHEN ({bits('(i // 2)', 16, 1)} + i) % 2 = 0 THEN 1 ELSE -1 END::BIGINT AS val
  FROM (SELECT DISTINCT word FROM {words}), range(0, {k}) r(i))"""


def _window_lexicon(*corpora: str) -> str:
    """``lexicon(key, dim, val)`` and ``words(key)`` trained on windows."""
    tokens = ",\n".join(_tokens(f"tokens_{corpus}", corpus) for corpus in corpora)
    every = " UNION ALL ".join(f"SELECT '{c}' AS corpus, doc::VARCHAR AS doc, pos, word FROM tokens_{c}" for c in corpora)
    return f"""{tokens},
tokens AS ({every}),
words AS (SELECT DISTINCT word AS key FROM tokens),
{_index('index_cells', 'tokens')},
neighbours AS (
  SELECT a.word AS key, b.word AS seen, count(*)::BIGINT AS n
  FROM tokens a, range(-{RADIUS}, {RADIUS} + 1) r(o), tokens b
  WHERE o <> 0 AND b.corpus = a.corpus AND b.doc = a.doc AND b.pos = a.pos + o
  GROUP BY ALL),
lexicon AS (
  SELECT key, dim, sum(n * val)::BIGINT AS val
  FROM neighbours JOIN index_cells ON word = seen GROUP BY key, dim HAVING sum(n * val) <> 0)"""


def _sentence_lexicon(corpus: str, size: int = SIZE, k: int = K) -> str:
    """``lexicon(key, dim, val)`` and ``words(key)`` trained on ordered sentences, pair by pair."""
    return f"""{_sentence_tokens('tokens', corpus)},
numbered AS (SELECT word, row_number() OVER ()::INTEGER AS id FROM (SELECT DISTINCT word FROM tokens)),
words AS (SELECT word AS key FROM numbered),
{_index('index_cells', 'numbered', size, k)},
index_ids AS (SELECT id, dim, val::INTEGER AS val FROM index_cells JOIN numbered USING (word)),
places AS (SELECT dense_rank() OVER (ORDER BY doc, sent) AS line, pos, id FROM tokens JOIN numbered USING (word)),
sums AS (
  SELECT a.id, ((i.dim + b.pos - a.pos) % {size} + {size}) % {size} AS dim, sum(i.val)::BIGINT AS val
  FROM places a JOIN places b ON b.line = a.line AND b.pos <> a.pos JOIN index_ids i ON i.id = b.id
  GROUP BY ALL HAVING sum(i.val) <> 0),
lexicon AS (SELECT word AS key, dim::INTEGER AS dim, val FROM sums JOIN numbered USING (id))"""


def _sentence_digest(corpus: str, slices: int) -> str:
    """The digest of a lexicon trained on ordered sentences, a slice of the words at a time.

    Each sentence is added up once, turned by the place of every word; a word's context is
    that sum turned back by its place, less the word itself. The SQL for smaller corpora
    adds up the pairs instead, and checks this identity on them.
    """
    def one(number: int) -> str:
        return f"""SELECT key, {DIGEST} FROM (
  SELECT key, dim, sum(val)::BIGINT AS val FROM (
    SELECT t.id AS key, (v.dim - t.pos % {SIZE} + {SIZE}) % {SIZE} AS dim, v.val
    FROM places t JOIN whole v ON v.line = t.line WHERE t.id % {slices} = {number}
    UNION ALL
    SELECT id, dim, -n * val FROM times JOIN index_ids USING (id) WHERE id % {slices} = {number})
  GROUP BY ALL HAVING sum(val) <> 0) GROUP BY key"""

    every = "\nUNION ALL ".join(f"({one(number)})" for number in range(slices))
    return f"""WITH {_sentence_tokens('tokens', corpus)},
numbered AS MATERIALIZED (SELECT word, row_number() OVER ()::INTEGER AS id FROM (SELECT DISTINCT word FROM tokens)),
{_index('index_cells', 'numbered')},
index_ids AS MATERIALIZED (SELECT id, dim, val::INTEGER AS val FROM index_cells JOIN numbered USING (word)),
places AS MATERIALIZED (
  SELECT dense_rank() OVER (ORDER BY doc, sent)::INTEGER AS line, pos::INTEGER AS pos, id FROM tokens JOIN numbered USING (word)),
times AS MATERIALIZED (SELECT id, count(*) AS n FROM places GROUP BY id),
whole AS MATERIALIZED (
  SELECT line, ((dim + pos) % {SIZE})::SMALLINT AS dim, sum(val)::INTEGER AS val FROM places JOIN index_ids USING (id)
  GROUP BY line, (dim + pos) % {SIZE} HAVING sum(val) <> 0),
found AS ({every})
SELECT word AS key, coalesce(cells, 0) AS cells, coalesce(total, 0) AS total, coalesce(squares, 0) AS squares,
  coalesce(moment, 0) AS moment, coalesce(spread, 0) AS spread
FROM numbered LEFT JOIN found ON key = id"""


UNIT = f"""lengths AS (SELECT key, sqrt(sum(val * val)) AS length FROM lexicon GROUP BY key),
unit AS (SELECT key, dim, val / length AS val FROM lexicon JOIN lengths USING (key)),
mean AS (SELECT dim, sum(val) / (SELECT count(*) FROM words) AS val FROM unit GROUP BY dim),
dims AS (SELECT dim::INTEGER AS dim FROM range(0, {SIZE}) r(dim))"""


def _text_vectors(name: str, tokens: str) -> str:
    """``name(doc, weight, dim, val)``: dense centred vectors of the documents of a token relation."""
    return f"""{name}_weights AS (
  SELECT doc, count(*)::BIGINT AS weight FROM {tokens} JOIN words ON key = word GROUP BY doc),
{name}_counts AS (SELECT doc, word, count(*) AS n FROM {tokens} GROUP BY ALL),
{name}_sums AS (SELECT doc, dim, sum(n * val) AS val FROM {name}_counts JOIN unit ON key = word GROUP BY ALL),
{name} AS (
  SELECT doc, weight, dim, coalesce(s.val, 0) - weight * coalesce(mean.val, 0) AS val
  FROM {name}_weights CROSS JOIN dims LEFT JOIN {name}_sums s USING (doc, dim) LEFT JOIN mean USING (dim))"""


def _cosines(name: str, left: str, right: str) -> str:
    """``name(a, b, similarity)``: cosine of every left vector with every right one."""
    return f"""{name} AS (
  SELECT a, b, dot / nullif(la * lb, 0) AS similarity
  FROM (SELECT l.doc AS a, r.doc AS b, sum(l.val * r.val) AS dot FROM {left} l JOIN {right} r USING (dim) GROUP BY ALL)
  JOIN (SELECT doc AS a, sqrt(sum(val * val)) AS la FROM {left} GROUP BY doc) USING (a)
  JOIN (SELECT doc AS b, sqrt(sum(val * val)) AS lb FROM {right} GROUP BY doc) USING (b))"""


def _rounded(value: str, places: int = 6) -> str:
    return f"round({value}, {places}) + 0.0"


def _digest(lexicon: str, keep: str = "", rows: str = "words LEFT JOIN lexicon USING (key)") -> str:
    return f"WITH {lexicon}\nSELECT key, {DIGEST}{keep} FROM {rows} GROUP BY key"


def _lines(text: str) -> str:
    """The lines of a text as a list; a final line end opens no further line."""
    return rf"string_split_regex(regexp_replace({text}, '(\r\n|\n|\r)$', ''), '{LINE_BREAK}')"


def _tag(tag: str, text: str = "html") -> str:
    opened = f"<{tag}>"
    return (
        f"CASE WHEN contains({text}, '{opened}') THEN "
        f"split_part(substr({text}, strpos({text}, '{opened}') + {len(opened)}), '</{tag}>', 1) END"
    )


WRAPPED = r"'<HEAD>' || chr(10) || '<BODY>' || text || chr(10) || '&#3;</BODY></HEAD>'"


def _sgml() -> str:
    """Body sentences without lookaround: periods are judged by their neighbours in a
    list of characters, sentence gaps are marked by replacing twice, since neighbouring
    gaps may share a character."""
    wrapped = WRAPPED
    capital = "regexp_full_match(coalesce({}, ''), '[A-Z]')".format
    tail = f"c = '.' AND i >= 4 AND {capital('cs[i-1]')} AND cs[i-2] = '.' AND {capital('cs[i-3]')}"
    head = f"c = '.' AND i >= 2 AND {capital('cs[i-1]')} AND {capital('cs[i+1]')}"

    def drop(condition: str) -> str:
        return f"array_to_string(list_transform(cs, lambda c, i: CASE WHEN {condition} THEN '' ELSE c END), '')"

    blank = r"[ \t\n\x0B\f\r]"
    gap = rf"regexp_replace({{}}, '([^ \t\n\x0B\f\r]\.{{1,3}}\"?){blank}+(\"?[A-Z])', '\1' || chr(1) || '\2', 'g')".replace(
        '\\"', '"'
    )

    def mark(text: str) -> str:
        return gap.replace("{}", text, 1).replace("{{", "{").replace("}}", "}")

    return rf"""WITH lined AS (
  SELECT doc_id, array_to_string(list_transform({_lines(wrapped)},
    lambda l: regexp_replace(l, '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g')), ' ') AS t FROM documents),
bodies AS (
  SELECT doc_id, unnest(list_filter(ps, lambda p, i: i % 2 = 0)) AS body, generate_subscripts(list_filter(ps, lambda p, i: i % 2 = 0), 1) AS nr
  FROM (SELECT doc_id, string_split_regex(regexp_replace(t, '(<BODY>|&#3;</BODY>)+$', ''), '<BODY>|&#3;</BODY>') AS ps FROM lined)),
tails AS (SELECT doc_id, nr, {drop(tail)} AS body FROM (SELECT doc_id, nr, string_split(body, '') AS cs FROM bodies)),
heads AS (SELECT doc_id, nr, {drop(head)} AS body FROM (SELECT doc_id, nr, string_split(body, '') AS cs FROM tails)),
gaps AS (SELECT doc_id, nr, string_split({mark(mark('body'))}, chr(1)) AS parts FROM heads),
kept AS (
  SELECT doc_id, nr, list_filter(list_transform(parts, lambda s: replace(s, '.', '')),
    lambda s: NOT regexp_matches(s, '^{blank}*[a-zA-Z_0-9]+{blank}*$')) AS parts FROM gaps)
SELECT doc_id, coalesce(array_to_string(flatten(list(parts ORDER BY nr)), chr(10)), '') AS text FROM kept GROUP BY doc_id"""


def _picks(bound: str, num: str) -> str:
    """The first numbers of the seeded order below a bound: each is permuted, and again while it is beyond the bound."""
    step = "SELECT i, walked, x >> h AS l, x & mask AS r, h, mask FROM walk, b WHERE walked = 0 OR x >= n"
    for number in range(4):
        digest = f"('0x' || substr(md5(r || '#{SEED}#{number}'), 1, 8))::BIGINT"
        step = f"SELECT i, walked, r AS l, xor(l, {digest} & mask) AS r, h, mask FROM ({step})"
    return f"""WITH RECURSIVE bound AS ({bound}),
b AS (
  SELECT n, h, (1::BIGINT << h) - 1 AS mask
  FROM (SELECT n, (SELECT min(i) FROM range(1, 32) r(i) WHERE (1::BIGINT << (2 * i)) >= n) AS h FROM bound)),
walk AS (
  SELECT i, i AS x, 0 AS walked FROM range(0, ({num})::BIGINT) r(i)
  UNION ALL
  SELECT i, (l << h) | r, walked + 1 FROM ({step}))
SELECT i AS nth, x AS id FROM walk, b WHERE walked > 0 AND x < n"""


def oracles() -> dict[str, str]:
    conversations = _window_lexicon("conversations")
    items = f"""WITH {conversations},
{UNIT},
{_tokens('item_tokens', 'benchmark')},
{_text_vectors('items', 'item_tokens')}"""
    topic_rows = "SELECT topic AS doc, text FROM (SELECT unnest([coalesce(lang, ''), coalesce(source, '')]) AS topic, text FROM documents{})"
    known = " WHERE topic <> ''"
    topics = f"""{_tokens('topic_tokens', topic_rows.format('') + known)},
{_text_vectors('topics', 'topic_tokens')}"""
    both_rows = " UNION ALL ".join(
        topic_rows.format(f" WHERE lang {side}") + known for side in ("IS DISTINCT FROM 'fr'", "<> 'en'")
    )
    both_topics = f"""{_tokens('topic_tokens', both_rows)},
{_text_vectors('topics', 'topic_tokens')}"""
    benchmark_words = f"{_tokens('item_tokens', 'benchmark')},\nitem_words AS (SELECT DISTINCT word FROM item_tokens)"
    pairs = """pairs AS (SELECT DISTINCT l.word AS a, r.word AS b
  FROM item_tokens l JOIN item_tokens r ON r.doc = l.doc AND r.pos = l.pos + 1)"""
    return {
        "lines_to_text": f"SELECT doc_id, array_to_string({_lines('text')}, ' ') AS text FROM documents",
        "sentences": f"""SELECT doc_id, unnest(parts) AS sentence, (generate_subscripts(parts, 1) - 1)::INTEGER AS sent
FROM (SELECT doc_id, {_split('text', SENTENCE_BREAK)} AS parts FROM documents)""",
        "tokens": f"""WITH {_sentence_tokens('tokens', 'documents')}
SELECT doc AS doc_id, (sent - 1)::INTEGER AS sent, (pos - 1)::INTEGER AS pos, word FROM tokens""",
        "token_counts": f"""SELECT doc_id, len(string_split_regex(text, '{TOKEN_BREAK}'))::BIGINT AS parts,
  len({_split('text')})::BIGINT AS tokens FROM documents""",
        "sgml_sentences": _sgml(),
        "newswire_ranges": f"SELECT coalesce(text, '') AS text, count(*)::BIGINT AS n FROM ({_sgml()}) GROUP BY 1",
        "tag_contents": "SELECT page_id, "
        + ", ".join(f"{_tag(tag)} AS {tag}" for tag in ("title", "h1", "article", "body"))
        + " FROM pages",
        "topic_texts": f"""SELECT *, topics IS NULL OR body IS NULL AS rejected
FROM (SELECT page_id, {_tag('title')} AS topics, {_tag('body')} AS body FROM pages)""",
        "scan_lines": f"""SELECT value, count(*)::BIGINT AS n
FROM (SELECT unnest(string_split_regex(text, '{LINE_BREAK}')) AS value FROM documents) GROUP BY value""",
        "process_dir": f"SELECT item_id, array_to_string({_lines('text || chr(10)')}, ' ') AS text FROM benchmark",
        "stored_corpus": "SELECT doc_id::VARCHAR AS doc_id, md5(text) AS md5 FROM documents",
        "corpus_extended": """SELECT doc_id::VARCHAR AS doc_id, md5(CASE WHEN lang = 'de' THEN text || ' Ende' ELSE text END) AS md5
FROM documents UNION ALL SELECT 'c' || conv_id || ':' || turn, md5(text) FROM conversations""",
        "prepared_plain": f"SELECT doc_id::VARCHAR AS doc_id, array_to_string({_lines('text')}, ' ') AS text FROM documents",
        "prepared_sgml": f"SELECT doc_id::VARCHAR AS doc_id, text FROM ({_sgml()})",
        "prepared_by_type": f"""SELECT doc_id::VARCHAR AS doc_id, CASE WHEN lang = 'de' THEN newswire.text
  ELSE array_to_string({_lines(WRAPPED.replace('text', 'documents.text'))}, ' ') END AS text
FROM documents JOIN ({_sgml()}) newswire USING (doc_id)""",
        "map_as_row": "SELECT doc_id, quality::BIGINT AS quality, toxic::BIGINT AS toxic FROM labels",
        "training_report": f"""WITH {_tokens('old', 'documents')},
{_tokens('new', "SELECT conv_id || ':' || turn AS doc, text FROM conversations WHERE role <> 'system'")}
SELECT 'words' AS kind, (SELECT count(*) FROM conversations)::BIGINT AS processed,
  (SELECT count(*) FROM conversations WHERE role = 'system')::BIGINT AS rejected,
  (SELECT count(DISTINCT word) FROM new WHERE word NOT IN (SELECT word FROM old))::BIGINT AS added,
  (SELECT count(*) FROM (SELECT word FROM old UNION SELECT word FROM new))::BIGINT AS total,
  {SIZE}::INTEGER AS size, {K}::INTEGER AS k, {RADIUS}::INTEGER AS cr""",
        "cleared_lexicon": f"""WITH {_tokens('tokens', 'conversations')}
SELECT false AS existed, true AS exists, count(DISTINCT word)::BIGINT AS before, 0::BIGINT AS after FROM tokens""",
        "row_as_map": """SELECT doc_id, doc_id::VARCHAR AS word, quality::VARCHAR AS quality, toxic::VARCHAR AS toxic
FROM labels""",
        "index_vectors": f"WITH {benchmark_words},\n{_index('cells', 'item_words')}\nSELECT * FROM cells",
        "permuted_vectors": f"""WITH {benchmark_words},
{_index('cells', 'item_words')}
SELECT word, step::INTEGER AS "by", (((dim + step) % {SIZE} + {SIZE}) % {SIZE})::INTEGER AS dim, val
FROM cells, (VALUES (-3), (5)) steps(step)""",
        "vector_sums": f"""WITH {benchmark_words},
{_index('cells', 'item_words')}
SELECT doc AS key, any_value(n)::BIGINT AS weight, dim, sum(val)::BIGINT AS val
FROM item_tokens JOIN cells USING (word) JOIN (SELECT doc, count(*) AS n FROM item_tokens GROUP BY doc) USING (doc)
GROUP BY doc, dim HAVING sum(val) <> 0""",
        "vector_differences": f"""WITH {benchmark_words},
{_index('cells', 'item_words')}
SELECT doc AS key, dim, sum((n - 1) * val)::BIGINT AS val
FROM (SELECT doc, word, count(*) AS n FROM item_tokens GROUP BY ALL) JOIN cells USING (word)
GROUP BY doc, dim HAVING sum((n - 1) * val) <> 0""",
        "normalized_vectors": f"""WITH {_window_lexicon('benchmark')},
{UNIT}
SELECT key, dim, {_rounded('val')} AS val FROM unit""",
        "mean_vector": f"""WITH {_window_lexicon('documents')},
{UNIT}
SELECT (SELECT count(*) FROM words)::BIGINT AS weight, dim, {_rounded('val', 9)} AS val FROM mean WHERE val <> 0""",
        "train_window": _digest(_window_lexicon("documents")),
        "train_sentence": _digest(_sentence_lexicon("conversations")),
        "train_sentence_default": _digest(_sentence_lexicon("conversations", 16000, 48)),
        "range_of_numbers": "SELECT range AS id FROM range(0, (SELECT sum(n_chars) FROM documents)::BIGINT, 97)",
        "seeded_distinct": _picks("SELECT sum(n_chars)::BIGINT * 1000 AS n FROM documents", "SELECT count(*) FROM documents"),
        "train_sentence_documents": _sentence_digest("documents", 16),
        "train_lines": _digest(_sentence_lexicon("conversations")),
        "merge_lexicon": _digest(_window_lexicon("documents", "conversations")),
        "stored_lexicon_extended": _digest(_window_lexicon("documents", "conversations", "benchmark")),
        "stored_lookup": f"""WITH {conversations},
{benchmark_words}
SELECT key, {DIGEST} FROM words JOIN item_words ON word = key LEFT JOIN lexicon USING (key) GROUP BY key""",
        "stored_columns": _digest(
            _window_lexicon("conversations", "benchmark"),
            ", any_value(letters) AS letters, any_value(initial) AS initial",
            "words LEFT JOIN (SELECT DISTINCT word, length(word)::INTEGER AS letters, substr(word, 1, 1) AS initial FROM tokens_conversations) own "
            "ON own.word = key LEFT JOIN lexicon USING (key)",
        ),
        "train_on_empty": _digest(_window_lexicon("conversations")),
        "merge_lines": _digest(_sentence_lexicon("lines")),
        "known_words": _digest(_window_lexicon("conversations")),
        "word_points": f"WITH {conversations}\nSELECT key, count(dim)::BIGINT AS cells FROM words LEFT JOIN lexicon USING (key) GROUP BY key",
        "word_lookup": f"""WITH {conversations},
{benchmark_words}
SELECT key, {DIGEST} FROM words JOIN item_words ON word = key LEFT JOIN lexicon USING (key) GROUP BY key""",
        "missing_words": f"""WITH {_tokens('tokens', 'conversations')},
{benchmark_words}
SELECT word AS key FROM item_words WHERE word NOT IN (SELECT word FROM tokens)""",
        "lookup_or_index": f"""WITH {conversations},
{benchmark_words},
{_index('item_cells', 'item_words')},
found AS (
  SELECT word AS key, true AS known, dim, val FROM item_words JOIN words ON key = word LEFT JOIN lexicon USING (key)
  UNION ALL
  SELECT word, false, dim, val FROM item_cells WHERE word NOT IN (SELECT key FROM words))
SELECT key, {DIGEST}, any_value(known) AS known FROM found GROUP BY key""",
        "compare_words": f"""WITH {conversations},
{UNIT},
{benchmark_words},
{pairs},
dots AS (
  SELECT a, b, sum(l.val * r.val) AS dot FROM pairs
  JOIN unit l ON l.key = a JOIN unit r ON r.key = b AND r.dim = l.dim GROUP BY ALL)
SELECT a, b, CASE WHEN l.key IS NOT NULL AND r.key IS NOT NULL THEN {_rounded('coalesce(dot, 0)')} END AS similarity
FROM pairs LEFT JOIN dots USING (a, b) LEFT JOIN lengths l ON l.key = a LEFT JOIN lengths r ON r.key = b""",
        "document_vectors": f"""{items}
SELECT doc AS item_id, weight, dim, {_rounded('val')} AS val FROM items WHERE val <> 0""",
        "document_vectors_documents": f"""WITH {_window_lexicon('documents')},
{UNIT},
{_text_vectors('docs', 'tokens_documents')}
SELECT doc AS doc_id, any_value(weight) AS weight, {_rounded('sqrt(sum(val * val))', 5)} AS length,
  {_rounded('sum(val)', 5)} AS total, {_rounded('sum((dim + 1) * val)', 3)} AS moment
FROM docs GROUP BY doc""",
        "line_vectors": f"""{items}
SELECT doc AS item_id, weight, dim, {_rounded('val')} AS val FROM items WHERE val <> 0""",
        "compare_documents": f"""{items},
{_cosines('cosines', 'items', 'items')}
SELECT item_id AS a, item_id + 1 AS b, {_rounded('similarity')} AS similarity
FROM benchmark LEFT JOIN cosines ON a = item_id AND b = item_id + 1""",
        "compare_document_batch": f"""{items},
{_cosines('cosines', 'items', 'items')}
SELECT a AS left_key, b AS right_key, {_rounded('similarity')} AS similarity FROM cosines""",
        "similar_pairs": f"""{items},
{_cosines('cosines', 'items', 'items')}
SELECT a AS left_key, b AS right_key, {_rounded('similarity')} AS similarity FROM cosines WHERE similarity >= 0.1""",
        "best_matches": f"""{items},
{_cosines('cosines', 'items', 'items')}
SELECT a AS left_key, b AS right_key, {_rounded('similarity')} AS similarity, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(similarity, 12) DESC NULLS LAST, b) AS rank FROM cosines)
WHERE rank <= 5""",
        "similarity_lists": f"""{items},
{_cosines('cosines', 'items', 'items')}
SELECT a AS left_key, (row_number() OVER (PARTITION BY a ORDER BY b) - 1)::INTEGER AS at,
  {_rounded('similarity')} AS similarity FROM cosines""",
        "train_topics": f"""WITH {conversations},
{UNIT},
{topics}
SELECT doc AS key, weight, dim, {_rounded('val', 4)} AS val FROM topics WHERE val <> 0""",
        "merge_topics": f"""WITH {conversations},
{UNIT},
{both_topics}
SELECT doc AS key, weight, dim, {_rounded('val', 4)} AS val FROM topics WHERE val <> 0""",
        "assign_topics": f"""{items},
{topics},
{_cosines('cosines', 'items', 'topics')},
ranked AS (
  SELECT a, b, similarity, row_number() OVER (PARTITION BY a ORDER BY round(similarity, 12) DESC NULLS LAST, b) AS rank
  FROM cosines)
SELECT a AS item_id, rank::INTEGER AS rank, b AS topic, {_rounded('similarity')} AS similarity FROM ranked WHERE rank <= 10""",
        "context_windows": f"""WITH turns AS (SELECT conv_id, turn, {_split('text')} AS words FROM conversations),
placed AS (SELECT conv_id, turn, words, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM turns)
SELECT conv_id, turn, (place - 1)::INTEGER AS pos, word,
  array_to_string(list_concat(words[greatest(place - {RADIUS}, 1):place - 1], words[place + 1:place + {RADIUS}]), ' ') AS context
FROM placed""",
        "seeded_order": f"SELECT doc_id, lang, source FROM documents ORDER BY md5(doc_id || '#{SEED}'), doc_id",
        "seeded_numbers": f"""WITH turns AS (SELECT conv_id, turn, unnest(range(len({_split('text')}))) AS id FROM conversations)
SELECT conv_id, turn, (nth - 1)::INTEGER AS nth, id::INTEGER AS id FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY md5(id || '#{SEED}'), id) AS nth FROM turns)
WHERE nth <= 5""",
        "shuffled_tokens": f"""WITH turns AS (SELECT conv_id, turn, {_split('text')} AS words FROM conversations),
placed AS (SELECT conv_id, turn, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS place FROM turns)
SELECT conv_id, turn, coalesce(string_agg(word, ' ' ORDER BY md5(place || '#{SEED}'), place), '') AS text
FROM turns LEFT JOIN placed USING (conv_id, turn) GROUP BY conv_id, turn""",
        "number_range": f"""SELECT conv_id, turn, unnest(range(0, len({_split('text')}), 3))::INTEGER AS id FROM conversations""",
        "top_by": "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20",
    }
