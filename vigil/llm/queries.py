"""The operators bound to the given tables, with DuckDB counterparts where SQL has them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vigil.llm import chat, ctw, decontam, exact, html, jaccard, packing, phrases, quality, repair, secrets, tokens, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(function):
    QUERIES[function.__name__] = function
    return function


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@_query
def op1_chat_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one that says the template's marks, read back from their rendering."""
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    marks = spark.createDataFrame(
        [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")],
        "conv_id long, turn long, role string, text string",
    )
    return chat.read_back(chat.format_turns(turns.unionByName(marks)))


_QUOTED = r"<\\*/?s>|\[\\*/?INST\]"
ORACLES["op1_chat_round_trip"] = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(20 + length(role) + length(text) + len(regexp_extract_all(role, '{_QUOTED}'))
    + len(regexp_extract_all(text, '{_QUOTED}'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


@_query
def op5_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with the row of its text that stays."""
    return exact.deduplicate(_table(spark, folder, "documents"))


ORACLES["op5_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), r AS (
  SELECT *, row_number() OVER w AS place, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM r
"""


@_query
def op6_pack(spark: SparkSession, folder: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack_documents(_table(spark, folder, "documents"))


@_query
def op7_warc_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """What the archives of all pages say of them."""
    return warc.archive_round_trip(_table(spark, folder, "pages"))


ORACLES["op7_warc_round_trip"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), g AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS keep FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keep AND keep IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id IS DISTINCT FROM keep THEN keep END AS refers_to
FROM g
"""


@_query
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality score."""
    docs = _table(spark, folder, "documents")
    return quality.score_documents(docs, quality.learn(docs, _table(spark, folder, "labels")))


@_query
def op8_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the alignment's score."""
    return decontam.contaminated(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))


@_query
def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its set's size and the smallest document its links lead to."""
    return jaccard.near_duplicates(_table(spark, folder, "documents"))


@_query
def op4_lm_score(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's log probability under the byte tree and under the unigram base."""
    return ctw.score_documents(_table(spark, folder, "documents"))


@_query
def op2_main_text(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of every page."""
    return html.main_text(_table(spark, folder, "pages"))


@_query
def op9_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in the documents, without what only looks like one."""
    return secrets.scan(_table(spark, folder, "documents"))


@_query
def op13_token_files(spark: SparkSession, folder: str) -> DataFrame:
    """What the files of token ids say of every document."""
    return tokens.round_trip(_table(spark, folder, "documents"))


@_query
def op11_phrases(spark: SparkSession, folder: str) -> DataFrame:
    """The phrases of each language that hold together most."""
    return phrases.collocations(_table(spark, folder, "documents"))


ORACLES["op11_phrases"] = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, part FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS part
    FROM documents) s
), listed AS (
  SELECT lang, regexp_extract_all(part, '[^\x20\x09]+') AS words FROM pieces
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, len(words) - size + 2), lambda i: array_to_string(words[i:i + size - 1], ' '))) AS phrase
  FROM listed CROSS JOIN (SELECT unnest([1, 2, 3]) AS size) z WHERE len(words) >= size
), f AS (
  SELECT lang, size, phrase, count(*) AS n FROM grams GROUP BY ALL
), totals AS (
  SELECT lang, CAST(sum(n) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang
), cand AS (
  SELECT lang, size, phrase, string_split(phrase, ' ') AS w, n AS a FROM f WHERE size > 1 AND n >= 10
), sides AS MATERIALIZED (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:size], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM cand) c
), cuts AS (
  SELECT s.lang, s.phrase, s.a, k, l.n AS l, r.n AS r,
    CAST(1000000::HUGEINT * a * a // (l.n::HUGEINT * r.n) AS BIGINT) AS score
  FROM sides s JOIN f l ON l.lang = s.lang AND l.phrase = s.head JOIN f r ON r.lang = s.lang AND r.phrase = s.tail
), best AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM cand WHERE size = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM cand WHERE size = 3) p GROUP BY ALL
), ranked AS (
  SELECT b.lang, b.phrase, a, l, r, score, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank
  FROM best b LEFT JOIN longer g ON g.lang = b.lang AND g.phrase = b.phrase WHERE NOT coalesce(100 * longer >= 50 * a, false)
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""


@_query
def op12_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    """What is wrong with the damaged conversations, their cheapest edits and what these make of them."""
    turns = _table(spark, folder, "conversations")
    return repair.report(turns, repair.damage(turns))


# Checksums bit by bit, as tables of 256 entries; audits as texts that sort by cost first.
_CRC_TABLE = """(SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i)
  FROM (SELECT unnest(range(256)) AS i) b)"""
_CRC = f"""xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)),
    lambda c, x: xor(c >> 8, table_of[xor(c & 255, x) + 1])), 4294967295)"""


def _more(cell: str, cost: int | str, edit: str) -> str:
    return f"format('{{:09d}}', substr({cell}, 1, 9)::BIGINT + {cost}) || substr({cell}, 10) || '{edit}'"


_AFTER_INSERTS = f"""v0 AS w0, v1 AS w1, least(v2, {_more('v0', 3, 'I')}, {_more('v1', 3, 'I')}, {_more('v3', 3, 'I')}) AS w2,
    least(v3, {_more('v2', 3, 'I')}, {_more('v0', 6, 'II')}, {_more('v1', 6, 'II')}) AS w3"""


def _step(state: int) -> str:
    """The best way into a state by one turn, after inserts."""
    ways = [_more(f"w{state}", 4, "D")]
    if state == 1:
        ways.append(f"CASE WHEN keeps AND initial = 's' THEN {_more('w0', 'extra', 'K')} END")
    for before, role in {2: [(0, "u"), (1, "u"), (3, "u")], 3: [(2, "a")]}.get(state, []):
        ways.append(
            f"CASE WHEN keeps THEN CASE WHEN initial = '{role}' THEN {_more(f'w{before}', 'extra', 'K')}"
            f" ELSE {_more(f'w{before}', '3 + extra', 'R')} END END"
        )
    return f"least({', '.join(ways)})"


ORACLES["op12_conversation_repair"] = rf"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations
), kinds AS (
  SELECT *, {_CRC} % 20 AS kind FROM keyed CROSS JOIN (SELECT {_CRC_TABLE} AS table_of) c
), damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(CASE kind WHEN 3 THEN [0, 1] ELSE [0] END) AS copy
  FROM kinds WHERE kind <> 0
), numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS occurrence
  FROM damaged
), faults AS (
  SELECT *, substr(role, 1, 1) AS initial, CASE
    WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
    WHEN occurrence > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault,
    fault NOT IN ('blank', 'duplicate') AS keeps, CASE fault WHEN 'truncated' THEN 3 ELSE 0 END AS extra
  FROM numbered
), paths(conv_id, i, v0, v1, v2, v3) AS (
  SELECT DISTINCT conv_id, 0::BIGINT, '000000000', NULL::VARCHAR, NULL::VARCHAR, NULL::VARCHAR FROM faults
  UNION ALL
  SELECT conv_id, i, {_step(0)}, {_step(1)}, {_step(2)}, {_step(3)}
  FROM (SELECT p.conv_id, f.i, f.keeps, f.extra, f.initial, {_AFTER_INSERTS}
    FROM paths p JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i + 1) q
), ends AS (
  SELECT conv_id, least(w0, w3) AS best FROM (
    SELECT conv_id, {_AFTER_INSERTS} FROM paths
    QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) = 1) e
), letters AS (
  SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS edit, generate_subscripts(string_split(substr(best, 10), ''), 1) AS place
  FROM ends WHERE length(best) > 9
), placed AS (
  SELECT *, count(*) FILTER (edit <> 'I') OVER w AS i, count(*) FILTER (edit <> 'D') OVER w AS emitted
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY place)
), turned AS (
  SELECT p.*, f.role, f.text, max(CASE WHEN edit = 'K' AND emitted = 1 AND f.initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY p.conv_id) AS led
  FROM placed p LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM p.conv_id AND f.i = p.i AND p.edit <> 'I'
), repaired AS (
  SELECT conv_id, sha256(string_agg(CASE edit WHEN 'K' THEN role
      ELSE CASE WHEN (emitted - led) % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' ||
      CASE edit WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY place)) AS repaired_sha256
  FROM turned WHERE edit <> 'D' GROUP BY conv_id
), counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair FROM faults) f GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(substr(best, 1, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit,
  coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM o.conv_id
"""
