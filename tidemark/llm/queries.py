"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    collocations,
    conversation_repair,
    decontamination,
    fingerprints,
    jaccard_join,
    line_dedup,
    packing,
    quality_rules,
    sentencepiece_fst,
    suffix_dedup,
    token_blocks,
    toxicity,
    url_filter,
)
from tidemark.llm.common import NULL_ID, read, scratch
from tidemark.llm.tokens import vocabulary_path


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    token_blocks.write_blocks(read(spark, sf_dir, "documents"), path, vocabulary_path())
    return token_blocks.read_documents(spark, path, with_ids=False)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.classes(read(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    index = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    return toxicity.score(docs, index).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted", "evidence")


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(read(spark, sf_dir, "pages"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare(read(spark, sf_dir, "documents"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.dedup_bytes(read(spark, sf_dir, "documents"))
    return found.select(
        F.when(F.col("k") != NULL_ID, F.col("k")).alias("doc_id"),
        "n_bytes",
        "n_removed",
        "n_spans",
        "kept_sha256",
        (F.col("n_removed") > 0).alias("lost_bytes"),
    )


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(read(spark, sf_dir, "documents")).drop("n_stop_words", "n_text_lines")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read(spark, sf_dir, "documents"), vocabulary_path())


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_fst.encode_summary(read(spark, sf_dir, "documents"), vocabulary_path(sentencepiece_fst.MODEL))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.digests(conversation_repair.damage(read(spark, sf_dir, "conversations")))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(read(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_blocks,
        op2_jaccard_join,
        op3_toxicity,
        op4_url_filters,
        op5_line_dedup,
        op6_fingerprints,
        op7_suffix_dedup,
        op8_quality_rules,
        op9_packing,
        op10_sentencepiece,
        op11_decontamination,
        op12_conversation_repair,
        op13_collocations,
    )
}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _op4_sql() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in url_filter.RULES)
    return rf"""
WITH rules(verdict, rhost, rpath) AS (VALUES {rules}),
p AS (SELECT page_id, row_number() OVER () AS rid,
             CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT page_id, rid, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), {_AZ}) AS host,
             regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM p),
m AS (SELECT s.rid, r.verdict, r.rhost || r.rpath AS rule,
             row_number() OVER (PARTITION BY s.rid ORDER BY length(r.rhost || r.rpath) DESC) AS n
      FROM s JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath))
SELECT s.page_id, s.host, s.path, m.rule, coalesce(m.verdict, '{url_filter.DEFAULT}') AS verdict
FROM s LEFT JOIN m ON s.rid = m.rid AND m.n = 1"""


_OP5_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, i, ls[i] AS line,
             translate(regexp_replace(ls[i], '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_AZ}) AS key
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
f AS (SELECT key, min(doc_id) AS first_doc FROM l WHERE length(key) >= {line_dedup.MIN_CHARS}
      GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT l.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE f.first_doc < l.doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.first_doc IS NULL OR f.first_doc = l.doc_id), '')) AS kept_sha256
FROM l LEFT JOIN f USING (key) GROUP BY l.doc_id"""


def _op8_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
    failed = f"(n_words < {quality_rules.MIN_WORDS} OR 100 * n_repeat_words > {quality_rules.MAX_REPEAT_PERCENT} * n_words)"
    rules = quality_rules.compile_rules().replace("D *", "::DOUBLE *")
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
                  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM documents),
t AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS w3
      FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM d)),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w3) AS c FROM t) WHERE c > 1),
c AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM r, (VALUES (0), (1), (2)) AS v(o) GROUP BY doc_id),
s AS (SELECT doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
             coalesce(c.n, 0) AS n_repeat_words, len(list_filter(ws, lambda w: w IN ({stops}))) AS n_stop_words, len(ls) AS n_text_lines
      FROM d LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       {failed} AS base_failed, NOT {failed} AND {rules} AS kept FROM s"""


_OP11_SQL = rf"""
WITH w AS (SELECT item_id, ws, least(10, len(ws)) AS k FROM (
         SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
         FROM benchmark) WHERE len(ws) > 0),
g AS (SELECT DISTINCT item_id, k, array_to_string(ws[i:i + k - 1], ' ') AS t
      FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w)),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
      FROM documents),
p AS (SELECT doc_id, k, i, array_to_string(ws[i:i + k - 1], ' ') AS t FROM (
         SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g))),
m AS (SELECT doc_id, item_id, k, i FROM p JOIN g USING (k, t)),
h AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM m, LATERAL (SELECT unnest(range(0, k)) AS o) GROUP BY doc_id),
x AS (SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS s
      FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(x.n, 0) AS n_items,
       coalesce(x.s, sha256('')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN x USING (doc_id)"""

_OP13_SQL = rf"""
WITH pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda w: w <> '') AS ws FROM (
         SELECT coalesce(lang, 'und') AS lang,
                unnest(string_split_regex(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
grams AS (SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (
         SELECT lang, k, ws, unnest(range(1, len(ws) - k + 2)) AS i FROM pieces, (VALUES (1), (2), (3), (4)) AS v(k)
         WHERE len(ws) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY ALL HAVING count(*) >= 30),
n AS (SELECT lang, count(*) AS n FROM grams WHERE k = 1 GROUP BY lang),
cut AS (SELECT lang, phrase, k, f AS a, j, array_to_string(string_split(phrase, ' ')[1:j], ' ') AS head,
               array_to_string(string_split(phrase, ' ')[j + 1:], ' ') AS rest
        FROM (SELECT *, unnest(range(1, k)) AS j FROM f WHERE k > 1)),
s AS (SELECT c.lang, c.phrase, c.k, c.a, h.f AS l, t.f AS r, ((2000000::HUGEINT * c.a) // (h.f + t.f))::BIGINT AS score,
             row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (2000000::HUGEINT * c.a) // (h.f + t.f), j) AS at
      FROM cut c JOIN f h ON c.lang = h.lang AND c.head = h.phrase JOIN f t ON c.lang = t.lang AND c.rest = t.phrase),
o AS (SELECT lang, phrase, max(f) AS longer FROM (
         SELECT lang, f, array_to_string(string_split(phrase, ' ')[i:i + m - 1], ' ') AS phrase
         FROM f, (VALUES (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)) AS v(m, i) WHERE m < k AND i + m - 1 <= k) GROUP BY ALL),
kept AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
         FROM s LEFT JOIN o USING (lang, phrase) WHERE s.at = 1 AND NOT coalesce(100 * longer >= 80 * a, false))
SELECT lang, rank, phrase, a, l, r, n, score FROM kept JOIN n USING (lang) WHERE rank <= 2000"""

#: The recursion keeps the cheapest, then least, audit in each state of (s?(ua)+)? behind each row.
_OP12_SQL = r"""
WITH RECURSIVE
convs AS (SELECT conv_id, row_number() OVER () AS g FROM (SELECT DISTINCT conv_id FROM conversations)),
keyed AS (SELECT g, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 coalesce(conversations.conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
          FROM conversations JOIN convs ON conversations.conv_id IS NOT DISTINCT FROM convs.conv_id),
hashed AS (SELECT g, turn, role, text, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(key, ''),
                  lambda x: list_concat([ascii(x)::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1])))),
                  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END),
                  4294967295) % 20 AS how FROM keyed),
damaged AS (SELECT g, turn, CASE WHEN how = 4 THEN 'user' ELSE role END AS role,
                   CASE how WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE how WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM hashed),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS pos,
                  regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS cut FROM damaged),
faults AS (SELECT g, turn, role, text, pos, role[1:1] AS x, lag(role[1:1]) OVER (PARTITION BY g ORDER BY pos) AS before,
                  CASE WHEN cut = '' THEN 'blank'
                       WHEN row_number() OVER (PARTITION BY g, role, text ORDER BY pos) > 1 THEN 'duplicate'
                       WHEN cut[-1:] NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault FROM placed),
steps(q, x, p) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserts(q, p, n) AS (VALUES (0, 0, 0), (1, 1, 0), (2, 2, 0), (3, 3, 0), (0, 2, 1), (1, 2, 1), (2, 3, 1), (3, 2, 1),
                            (0, 3, 2), (1, 3, 2), (2, 2, 2), (3, 3, 2)),
edits AS (SELECT q, p, NULL AS x, 'R' AS letter, 3 AS cost FROM steps WHERE x <> 's'
          UNION ALL SELECT q, p, x, 'K', 0 FROM steps
          UNION ALL SELECT DISTINCT q, q, NULL, 'D', 4 FROM inserts),
moves AS (SELECT i.q, e.p, e.x, e.letter, repeat('I', i.n) || e.letter AS letters, 3 * i.n + e.cost AS cost
          FROM inserts i JOIN edits e ON i.p = e.q),
walk(g, pos, q, best) AS (
    SELECT g, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': ''} FROM convs
    UNION ALL
    SELECT w.g, w.pos + 1, m.p, min({
               'cost': (w.best.cost + m.cost + CASE WHEN r.fault = 'truncated' AND m.letter <> 'D' THEN 3 ELSE 0 END)::BIGINT,
               'audit': w.best.audit || m.letters})
    FROM walk w JOIN faults r ON r.g = w.g AND r.pos = w.pos + 1 JOIN moves m ON m.q = w.q
    WHERE (m.x IS NULL OR m.x = r.x) AND (r.fault NOT IN ('blank', 'duplicate') OR m.letter = 'D')
    GROUP BY w.g, w.pos, m.p),
ends AS (SELECT g, min({'cost': (w.best.cost + 3 * i.n)::BIGINT, 'audit': w.best.audit || repeat('I', i.n)}) AS best
         FROM walk w JOIN inserts i USING (q)
         WHERE i.p IN (0, 3) AND w.pos = (SELECT count(*) FROM faults f WHERE f.g = w.g) GROUP BY g),
letters AS (SELECT g, j, best.audit[j:j] AS letter, len(replace(best.audit[1:j], 'I', '')) AS pos,
                   len(replace(best.audit[1:j], 'D', '')) AS nth FROM (SELECT g, best, unnest(range(1, len(best.audit) + 1)) AS j FROM ends)),
told AS (SELECT l.g, l.j, l.letter, l.nth, r.role, r.text,
                max(CASE WHEN l.nth = 1 AND l.letter = 'K' AND r.x = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY l.g) AS system
         FROM letters l LEFT JOIN faults r ON l.g = r.g AND l.pos = r.pos AND l.letter <> 'I' WHERE l.letter <> 'D'),
lines AS (SELECT g, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - system) % 2 = 1 THEN 'user' ELSE 'assistant' END
                               || ':' || coalesce(text, ''), chr(10) ORDER BY j) AS text FROM told GROUP BY g),
counts AS (SELECT g, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (before IS NOT NULL AND before || x NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY g)
SELECT conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, best.cost AS cost, best.audit AS audit,
       sha256(coalesce(lines.text, '')) AS repaired_sha256
FROM convs JOIN ends USING (g) LEFT JOIN counts USING (g) LEFT JOIN lines USING (g)"""

ORACLE = {
    "op4_url_filters": _op4_sql(),
    "op5_line_dedup": _OP5_SQL,
    "op8_quality_rules": _op8_sql(),
    "op11_decontamination": _OP11_SQL,
    "op12_conversation_repair": _OP12_SQL,
    "op13_collocations": _OP13_SQL,
}
