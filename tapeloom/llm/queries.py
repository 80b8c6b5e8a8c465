"""Registered queries of the corpus operators, one per operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.llm import bestfit, bpe, chat, classifier, language, negatives, packing, quality, search, secrets, simhash, trie, urls
from tapeloom.llm.common import crc_bucket, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]"


def query(name: str, sql: str | None = None):
    def add(make: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = make
        if sql:
            ORACLES[name] = sql
        return make

    return add


ALLOW = [("com", "/"), ("www.example.com", "/en/")]
BLOCK = [("example.com", "/en/"), ("net", "/es/"), ("net", "/fr/")]
BLOCKED_HOSTS = ["spam-farm.example.org", "cheap-pills.example.com", "casino-win.example.com", "free-bets.example.com"]

_rule_rows = ", ".join(f"('{h}', '{p}', '{v}')" for v, rules in (("allow", ALLOW), ("block", BLOCK)) for h, p in rules)
_host_rows = ", ".join(f"('{h}')" for h in BLOCKED_HOSTS)


@query(
    "op1_url_filter",
    rf"""
    WITH p AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
    h AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
    u AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
    rules(rhost, rpath, verdict) AS (VALUES {_rule_rows}),
    hosts(bad) AS (VALUES {_host_rows}),
    fit AS (SELECT page_id, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
            FROM u JOIN rules ON (host = rhost OR host LIKE '%.' || rhost) AND starts_with(path, rpath)),
    bad AS (SELECT DISTINCT page_id FROM u JOIN hosts ON host = bad OR host LIKE '%.' || bad)
    SELECT u.page_id, u.host, u.path, fit.rule,
           coalesce(fit.verdict, CASE WHEN bad.page_id IS NULL THEN 'allow' ELSE 'block' END) AS verdict
    FROM u LEFT JOIN fit ON fit.page_id = u.page_id AND k = 1 LEFT JOIN bad ON bad.page_id = u.page_id
    """,
)
def _url_filter(spark: SparkSession, folder: str) -> DataFrame:
    blocked = spark.range(1).select(F.explode(F.array(*map(F.lit, BLOCKED_HOSTS))).alias("key"))
    pages = table(spark, folder, "pages").select("page_id", "url")
    return urls.filter_urls(pages, ALLOW, BLOCK, blocked).select("page_id", "host", "path", "rule", "verdict")


@query("op2_simhash")
def _simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def tokenizer(spark: SparkSession) -> bpe.Tokenizer:
    return bpe.Tokenizer(spark, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op3_packing")
def _packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents").select("doc_id", "text"), tokenizer(spark).count(F.col("text")))


@query("op4_bpe")
def _bpe(spark: SparkSession, folder: str) -> DataFrame:
    done = table(spark, folder, "documents").select("doc_id", tokenizer(spark).round_trip(F.col("text")).alias("d"))
    return done.select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


SAID = "\\### Assistant: </turn> ok"


def _escaped(column: str) -> str:
    for plain, code in chat.ESCAPES:
        column = f"replace({column}, '{plain}', '{code}')"
    return column


@query(
    "op5_chat_format",
    f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL VALUES (-7, 0, 'user', '{SAID}'), (-7, 1, 'assistant', '{SAID}')),
    n AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n,
                 length({_escaped('role')}) + length({_escaped('text')}) + {len(chat.HEAD) + len(chat.MIDDLE) + len(chat.END)} AS made
          FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
    c AS (SELECT *, sum(made) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM n)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
           CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
           CAST(sum(upto) FILTER (role = 'assistant' OR i = n) AS BIGINT) AS formatted_chars
    FROM c GROUP BY conv_id
    """,
)
def _chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    added = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(SAID).alias("text"),
    )
    return chat.conversation_digest(chat.examples(turns.unionByName(added)))


_L = quality.Limits()


@query(
    "op6_quality_rules",
    rf"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(source, '') AS host FROM documents),
    w AS (SELECT *, regexp_extract_all(t, '{WORD}+') AS ws,
                 list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
    win AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
            FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
    rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    cov AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM rep, (VALUES (0), (1), (2)) v(k) GROUP BY doc_id),
    ln AS (SELECT doc_id, host, t, unnest(list_transform(lines, lambda x: trim(lower(x), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS line FROM w),
    sizes AS (SELECT host, count(DISTINCT t) AS docs FROM d GROUP BY host),
    often AS (SELECT host, line FROM (SELECT host, line, count(DISTINCT t) AS n FROM ln GROUP BY host, line) JOIN sizes USING (host)
              WHERE n > {_L.min_docs} AND n > {_L.share} * docs),
    chars AS (SELECT doc_id, sum(length(ln.line)) AS total, coalesce(sum(length(ln.line)) FILTER (often.line IS NOT NULL), 0) AS lost
              FROM ln LEFT JOIN often ON often.host = ln.host AND often.line = ln.line GROUP BY doc_id),
    s AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
                 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
                 CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                 CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words, coalesce(total, 0) AS total, coalesce(lost, 0) AS lost
          FROM w LEFT JOIN cov USING (doc_id) LEFT JOIN chars USING (doc_id)),
    b AS (SELECT *, n_words < {_L.min_words} OR 100 * n_repeat_words > {_L.repeat_pct} * n_words AS base_failed FROM s)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           NOT base_failed AND total - lost >= {_L.left} * total AS kept FROM b
    """,
)
def _quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"))
    return judged.select("doc.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@query("op7_quality_classifier")
def _quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    model = quality_model(docs, labels)
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    done = classifier.scored(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


ACCEPT = 0.3


def quality_model(docs: DataFrame, labels: DataFrame) -> classifier.RuleModel:
    """Fit on labelled documents outside the held-out fifth."""
    learn = labels.where(crc_bucket(F.col("doc_id"), 5) != 0)
    return classifier.fit(classifier.labelled_sample(docs, learn, "quality"))


@query("op8_secrets")
def _secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_documents(table(spark, folder, "documents").select("doc_id", "text")).drop("text")
    found = found.withColumn("base", F.filter("secrets", lambda s: s["layers"] == ""))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [F.size(F.array_remove(kinds, k)).alias(k) for k in secrets.KINDS]
    counts = [(F.size("base") - c).cast("long").alias(f"n_{k}") for c, k in zip(counts, secrets.KINDS)]
    return found.select("doc_id", *counts, F.sha2(secrets.joined(F.col("base")), 256).alias("base_sha256"), secrets.joined(F.col("secrets")).alias("spans"))


@query("op9_language_id")
def _language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    model = language.LanguageIdentifier.fit(docs.where(crc_bucket(F.col("doc_id"), 4) != 2))
    done = language.identify(docs.select("doc_id", "text"), model)
    return done.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query(
    "op10_top_k",
    """
    WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY rank <= 5
    """,
)
def _top_k(spark: SparkSession, folder: str) -> DataFrame:
    return search.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query(
    "op11_hard_negatives",
    """
    WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                      list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
               WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, a.label = c.label AS same, c.vec_id, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
          FROM v a JOIN v c ON a.vec_id % 50 = 0 AND (a.label <> c.label OR c.vec_id <> a.vec_id)),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
          QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
           vec_id AS negative_id, positive_score, score AS negative_score
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY rank <= 3
    """,
)
def _hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0, shifted)


@query("op12_best_fit_packing")
def _best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return bestfit.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


@query(
    "op13_prefix_trie",
    """
    WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS i
               FROM conversations WHERE conv_id IS NOT NULL),
    own AS (SELECT conv_id, count(*) AS n, conv_id - conv_id % 100 AS base,
                   list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda k: CAST(ord(CAST(conv_id AS VARCHAR)[k]) AS BIGINT))),
                               lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda p, q: xor(p >> 1, (p & 1) * 3988292384))) AS crc
            FROM t GROUP BY conv_id),
    c AS (SELECT own.conv_id, own.n, own.base, (4294967295 - own.crc) % 6 AS h, least((4294967295 - own.crc) % 6, coalesce(b.n, 0)) AS got
          FROM own LEFT JOIN own b ON b.conv_id = own.base),
    r AS (SELECT c.conv_id, t.i + 1 AS depth, role, text FROM c JOIN t ON t.conv_id = c.base AND t.i < c.h
          UNION ALL SELECT c.conv_id, t.i - c.h + c.got + 1, role, text FROM c JOIN t USING (conv_id) WHERE t.i >= c.h),
    k AS (SELECT conv_id, 0 AS depth, '' AS path, 0 AS chars FROM c
          UNION ALL SELECT conv_id, depth, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)), length(text) FROM r),
    s AS (SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends,
                 lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM k),
    n AS (SELECT depth, path, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
                 sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM s GROUP BY depth, path),
    kids AS (SELECT depth - 1 AS depth, above AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
    m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids USING (depth, path)),
    sub AS (SELECT k.depth, k.path, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved_tokens
            FROM m JOIN k ON k.conv_id = m.conv_id AND k.depth <= m.depth GROUP BY k.depth, k.path)
    SELECT m.conv_id, CAST(m.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
    FROM m JOIN sub USING (depth, path) LEFT JOIN m up ON up.depth = m.depth - 1 AND up.path = m.above
    """,
)
def _prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    rebuilt = trie.shared_heads(trie.numbered_turns(table(spark, folder, "conversations")))
    return trie.conversation_trie(trie.prefix_keys(rebuilt))
