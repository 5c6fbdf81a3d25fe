"""The registered queries of this subpackage, one for each operator, over whole tables and with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from archgraph.llm import boosting, chat, covering, interactions, language, lempelziv, linechain, packing, phrases, piecewise, secretscan, sentencepiece, warc
from archgraph.llm.common import held_out, table

PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.encode_digests(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piecewise.neighbour_fingerprints(table(spark, sf_dir, "documents"))


#: Two turns whose texts hold control strings of the template.
CONTROL_TURNS = r"""SELECT conv_id, turn, role, r'\### Assistant: </turn> ok' AS text
    FROM VALUES (-7L, 0L, 'user'), (-7L, 1L, 'assistant') AS t(conv_id, turn, role)"""


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(CONTROL_TURNS))
    return chat.digests(chat.format_conversations(rows))


OP3_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, length(replace(replace(replace(text, '\', '\b'), '</turn>', '\l/turn>'), '### ', '\h## ')) AS body,
    CASE WHEN role IN ('system', 'user', 'assistant') THEN length(role)
      ELSE 2 + length(replace(replace(replace(replace(role, '\', '\b'), '</turn>', '\l/turn>'), '### ', '\h## '), ':', '\c')) END AS shown,
    lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn, role, text) || '>' || role AS move
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + shown + 2 + body + 8)::BIGINT AS formatted_chars,
  bool_and(move IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AS valid,
  bool_and(move IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user')) AND arg_max(role, struct_pack(a := turn, b := role, c := text)) = 'assistant' AS complete
FROM e GROUP BY conv_id
"""


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = boosting.fitted(docs, table(spark, sf_dir, "labels"))
    scored = boosting.score(docs.select("doc_id", held_out().alias("held_out"), "text"), trees, keep=("doc_id", "held_out"))
    return scored.withColumn("predicted", boosting.predicted())


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("complete")


OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS chosen, unhex(sha1(html)) AS h FROM p),
n AS (SELECT *, list_transform(range(4), lambda k: list_transform(range(8), lambda i: 1 + ((('0x' || substring(hex(h), 10 * k + 1, 10))::BIGINT >> (35 - 5 * i)) & 31))) AS places FROM d)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(flatten(places), lambda x: substring('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', x::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = chosen THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> chosen THEN chosen END AS refers_to
FROM n
"""


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language.identify(docs.select("doc_id", held_out().alias("held_out"), "text"), language.dictionaries(docs), keep=("doc_id", "held_out"))
    return found.select("doc_id", "held_out", "lang_pred", "score", "margin", "rejected")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lempelziv.deduplicate(table(spark, sf_dir, "documents"), digest=True).drop("spans", "factors")


OP8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM d, unnest(range(1, len(w) - 48)) AS t(i)),
least AS (SELECT s, min(doc_id) AS first FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN least USING (s) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM hit, range(50) AS r(k)),
words AS (SELECT doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) AS t(p)),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS s FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id
"""


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covering.near_duplicates(table(spark, sf_dir, "documents"))


def op10_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = linechain.fitted(docs, table(spark, sf_dir, "labels"))
    return linechain.judge(docs.select("doc_id", "text"), field, keep=("doc_id",))


def op11_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretscan.scan(table(spark, sf_dir, "documents"))


def op12_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
f AS (SELECT doc_id, part, [
    len(words) < 200,
    100 * len(list_distinct(words)) < 50 * len(words),
    100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
    regexp_matches(text, '[#$%&*|]'),
    coalesce(first < doc_id, false)] AS fails FROM w),
m AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
g AS (SELECT f.*, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic FROM f LEFT JOIN m USING (doc_id)),
x AS (SELECT unnest(range(1, 6)) AS k),
o AS (SELECT [a.k, b.k, c.k, d.k, e.k] AS p FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.k, b.k, c.k, d.k, e.k])) = 5),
s AS (SELECT array_to_string(list_transform(p, lambda i: substring('ABCDE', i::INT, 1)), '') AS filter_order, p, k AS step, p[k] AS i FROM o, x),
h AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM g GROUP BY part, fails),
r AS (SELECT part, filter_order, step, i,
    coalesce(sum(n) FILTER (NOT list_bool_or(list_transform(p[:step], lambda j: fails[j]))), 0)::BIGINT AS kept,
    coalesce(sum(n) FILTER (fails[i] AND (step = 1 OR NOT list_bool_or(list_transform(p[:step - 1], lambda j: fails[j])))), 0)::BIGINT AS removed,
    coalesce(sum(n) FILTER (fails[i] AND step > 1 AND list_bool_or(list_transform(p[:step - 1], lambda j: fails[j]))), 0)::BIGINT AS redundant,
    coalesce(sum(n) FILTER (fails[i] AND len(list_filter(fails, lambda b: b)) = 1), 0)::BIGINT AS unique_fails,
    coalesce(sum(good) FILTER (fails[i] AND (step = 1 OR NOT list_bool_or(list_transform(p[:step - 1], lambda j: fails[j])))), 0)::BIGINT AS good_lost,
    coalesce(sum(toxic) FILTER (fails[i] AND (step = 1 OR NOT list_bool_or(list_transform(p[:step - 1], lambda j: fails[j])))), 0)::BIGINT AS toxic_lost
  FROM h, s GROUP BY part, filter_order, step, i)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, i))::BIGINT AS shapley FROM r
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, array_to_string(w[i:i + k - 1], ' ') AS phrase, k AS size, count(*) AS f
  FROM w, range(1, 5) AS s(k), unnest(range(1, greatest(len(w) - k + 2, 1))) AS t(i) GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, phrase, f AS a, size, k, string_split(phrase, ' ') AS x FROM g, range(1, 4) AS s(k) WHERE size >= 2 AND k < size),
cut AS (SELECT c.*, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f::HUGEINT + r.f) AS score
  FROM c JOIN g AS l ON l.lang = c.lang AND l.phrase = array_to_string(x[:k], ' ') JOIN g AS r ON r.lang = c.lang AND r.phrase = array_to_string(x[k + 1:], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
free AS (SELECT * FROM best WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.lang = best.lang AND g.size > best.size AND 100::HUGEINT * g.f >= 80::HUGEINT * a AND contains(' ' || g.phrase || ' ', ' ' || best.phrase || ' ')))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM free JOIN n USING (lang) QUALIFY rank <= 2000
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_fingerprints": op2_fingerprints,
    "op3_chat": op3_chat,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_warc": op6_warc,
    "op7_language": op7_language,
    "op8_substrings": op8_substrings,
    "op9_simhash": op9_simhash,
    "op10_rules": op10_rules,
    "op11_secrets": op11_secrets,
    "op12_interactions": op12_interactions,
    "op13_phrases": op13_phrases,
}
ORACLE_SQL: dict[str, str] = {"op3_chat": OP3_SQL, "op6_warc": OP6_SQL, "op8_substrings": OP8_SQL, "op12_interactions": OP12_SQL, "op13_phrases": OP13_SQL}
