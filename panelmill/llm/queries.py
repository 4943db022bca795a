"""Queries of the operators of this subpackage, each over its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.llm import (attention_lm, chosen_path, fingerprint, fuzzy_lines, html_text, merkle, mixing, packing, pii, pivotal_words, quality,
                           rank_language, token_count)

QUERIES: dict = {}
ORACLES: dict = {}
#: Vocabulary files; another place may be named here.
TOKENIZERS = os.environ.get("PANELMILL_TOKENIZERS", "")


def tokenizer(name: str) -> str:
    """The place of a vocabulary file."""
    if TOKENIZERS:
        return os.path.join(TOKENIZERS, name)
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f
    return add


@query()
def op1_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


@query(r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents),
grams AS (SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g
          FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         (length(t) - length(regexp_replace(t, '[0-9]', '', 'g')))::BIGINT AS n_digits,
         len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN covered c ON c.doc_id = w.doc_id),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
                 + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
                 + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
                 + CASE WHEN 100 * n_digits > 50 * word_chars THEN 64 ELSE 0 END)::BIGINT AS rule_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (rule_bits & 3) <> 0 AS base_failed,
       rule_bits = 0 AS kept, rule_bits FROM b""")
def op2_rule_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = quality.ledger(table(spark, sf_dir, "documents"), ["doc_id"])
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                          (~quality.passes("v1")).alias("base_failed"), quality.passes("v2").alias("kept"), "rule_bits")


@query()
def op3_prefix_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


@query()
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query()
def op5_fair_queue_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), ["doc_id"]).select(
        "doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query()
def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuzzy_lines.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


@query()
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query()
def op8_best_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html_text.train(pages, pick=F.xxhash64("page_id"))
    return html_text.extract(pages, model, ["page_id", "url"])


@query()
def op9_rank_order_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    docs = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = rank_language.train(docs.where(~F.col("held_out")), pick=F.xxhash64("doc_id"))
    return rank_language.identify(docs, model, ["doc_id", "held_out"])


@query()
def op10_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class, the rows of the class, and its number of links."""
    rows = chosen_path.jaccard_classes(table(spark, sf_dir, "documents"))
    return rows.select(rows["k"].alias("doc_id"), "class_id", "class_rows", "n_links")


def crc32_sql(text: str) -> str:
    """DuckDB expression for the unsigned crc32 of a text: each byte is taken in, then shifted out bit by bit (-1 marks a shift)."""
    codes = f"flatten(list_transform(range(0, octet_length(encode({text}))::BIGINT), lambda i: list_concat([('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), "
            "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384::BIGINT * (c & 1)) END), 4294967295::BIGINT)")


@query(rf"""
WITH RECURSIVE
runs AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{5,}}')) AS run FROM documents),
lowered AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM runs),
hashed AS (SELECT run, {crc32_sql("(coalesce(doc_id::VARCHAR, '') || ':' || run)")} AS h FROM lowered),
kept AS (SELECT CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word FROM hashed),
v AS MATERIALIZED (SELECT word, count(*)::BIGINT AS n FROM kept WHERE length(word) >= 5 GROUP BY word HAVING count(*) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, left(word, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1))::INT AS i FROM v)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n AS m FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND length(a.word) = length(b.word) AND a.word <> b.word
  UNION SELECT c.word, v.word, v.n FROM cut c JOIN v ON c.rest = v.word
  UNION SELECT v.word, c.word, c.n FROM cut c JOIN v ON c.rest = v.word),
best AS (SELECT word, other, m, count(*) OVER (PARTITION BY word) AS n_near,
                row_number() OVER (PARTITION BY word ORDER BY m DESC, encode(other)) AS r FROM near),
formed AS MATERIALIZED (SELECT v.word, v.n, coalesce(b.n_near, 0)::BIGINT AS n_near, CASE WHEN b.m >= 2 * v.n THEN b.other END AS form,
                               CASE WHEN b.m >= 2 * v.n THEN b.m END::DOUBLE AS form_n FROM v LEFT JOIN best b ON b.word = v.word AND b.r = 1),
up AS (SELECT word, word AS root FROM formed UNION ALL SELECT u.word, f.form FROM up u JOIN formed f ON f.word = u.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, u.root, f.n, f.n_near, f.form_n FROM formed f JOIN up u ON u.word = f.word JOIN formed t ON t.word = u.root WHERE t.form IS NULL""")
def op11_pivotal_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The SQL gives form_n as double, as pandas has longs with nulls.
    return pivotal_words.variants(pivotal_words.vocabulary(table(spark, sf_dir, "documents")))


MERKLE_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _leaf_sql(text: str) -> str:
    one = lambda c: f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')"
    return "sha256(" + " || ".join(one(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"


def _levels_sql(name: str, start: str) -> str:
    """Nodes (g, level, i, d, n) of the trees over (g, i, d, n): a level above is added while a group has more than one."""
    return f"""{name} AS (
  SELECT g, 0 AS level, i, d, n FROM {start}
  UNION ALL
  SELECT g, any_value(level) + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (any_value(n) + 2) // 3 FROM {name} WHERE n > 1 GROUP BY g, i // 3)"""


def _proof_sql(name: str, nodes: str, leaves: str) -> str:
    """Siblings, level by level, of the leaves (g, i)."""
    return f"""{name} AS (
  SELECT l.g, l.i, coalesce(string_agg(s.d, '' ORDER BY s.level, s.i), '') AS path FROM {leaves} l
  LEFT JOIN {nodes} s ON s.g = l.g AND s.n > 1 AND s.i // 3 = l.i // pow(3, s.level + 1)::BIGINT AND s.i <> l.i // pow(3, s.level)::BIGINT
  GROUP BY l.g, l.i)"""


def _fold_sql(name: str, start: str) -> str:
    """(key, d) of (key, d, i, n, path) after all steps."""
    own = "least(3, n - i // 3 * 3)"
    return f"""{name} AS (
  SELECT key, d, i, n, path FROM {start}
  UNION ALL
  SELECT key, sha256(left(path, (64 * (i % 3))::INT) || d || substr(path, (64 * (i % 3) + 1)::INT, (64 * ({own} - 1 - i % 3))::INT)), i // 3, (n + 2) // 3,
         substr(path, (64 * ({own} - 1) + 1)::INT) FROM {name} WHERE n > 1)"""


@query(f"""
WITH RECURSIVE
rows AS MATERIALIZED (
  SELECT doc_id, source, {_leaf_sql("text")} AS leaf,
         CASE WHEN {crc32_sql("doc_id::VARCHAR")} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS shown FROM documents),
named AS MATERIALIZED (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS g, count(*) OVER () AS groups FROM (SELECT DISTINCT source FROM rows)),
placed AS MATERIALIZED (
  SELECT r.doc_id, r.leaf, r.shown, s.g, s.groups, row_number() OVER (PARTITION BY s.g ORDER BY r.doc_id NULLS FIRST, r.leaf) - 1 AS i,
         count(*) OVER (PARTITION BY s.g) AS n, row_number() OVER () AS key
  FROM rows r JOIN named s ON s.source IS NOT DISTINCT FROM r.source),
leaves AS (SELECT g, i, leaf AS d, n FROM placed),
{_levels_sql("nodes", "leaves")},
subroots AS MATERIALIZED (SELECT 0 AS g, g AS i, d, (SELECT any_value(groups) FROM named) AS n FROM nodes WHERE n = 1),
{_levels_sql("tops", "subroots")},
{_proof_sql("below", "nodes", "leaves")},
{_proof_sql("above", "tops", "subroots")},
first AS (SELECT p.key, p.shown AS d, p.i, p.n, b.path FROM placed p JOIN below b ON b.g = p.g AND b.i = p.i),
{_fold_sql("folded", "first")},
second AS (SELECT f.key, f.d, p.g AS i, p.groups AS n, a.path FROM folded f JOIN placed p ON p.key = f.key JOIN above a ON a.i = p.g WHERE f.n = 1),
{_fold_sql("ended", "second")}
SELECT p.doc_id, p.leaf, s.d AS subroot, t.d AS root, sha256(b.path || a.path) AS proof_sha256, e.d AS folded_root, e.d = t.d AS verified
FROM placed p JOIN subroots s ON s.i = p.g JOIN (SELECT d FROM tops WHERE n = 1) t ON true JOIN below b ON b.g = p.g AND b.i = p.i
JOIN above a ON a.i = p.g JOIN ended e ON e.key = p.key AND e.n = 1""")
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    marked = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    tampered = F.when(marked, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return merkle.proofs(docs, MERKLE_FIELDS, "doc_id", "source", merkle.leaf(docs, MERKLE_FIELDS, text=tampered))


@query()
def op13_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    docs = docs.select("doc_id", "text", held.alias("held_out"))
    corpus = attention_lm.learn(docs.where(F.col("doc_id").isNotNull() & ~F.col("held_out")), tokenizer("byte_bpe_50k.tiktoken"))
    return attention_lm.score(docs, corpus, ["doc_id", "held_out"])
