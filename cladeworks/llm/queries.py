"""The contract queries of this subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, filter_audit, language_id, license_scan, mixing, ngram_join, quality_rules, sentence_pieces, token_align, token_planes, url_filter, warc
from .runtime import materialize, shared_dir, table


def tokenizer_path(name: str) -> str:
    """Place of a public tokenizer's file; the package that holds them lies beside Python's own on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"))


#: The added conversation: its texts hold control strings of a common chat format.
ADDED = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    added = spark.createDataFrame(ADDED, "conv_id long, turn long, role string, text string")
    packs = materialize(chat_format.pack(rows.unionByName(added)), "packs")
    return chat_format.read_packs(packs)


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op4_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_planes.write_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return token_planes.read_tokens(manifest)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.digests(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.archive(table(spark, sf_dir, "pages"), "page_id", "url", "html", f"{shared_dir(spark)}/warc")
    return warc.read_archives(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_align.report(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.summary(license_scan.detect(table(spark, sf_dir, "documents")))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


_RULE_ROWS = ", ".join(f"('{r.partition('/')[0]}', '/{r.partition('/')[2]}', '{r}', '{v}')" for r, v in url_filter.RULES)
_BLOCKED_ROWS = ", ".join(f"('{h.removesuffix('/')}')" for h in url_filter.BLOCKED_HOSTS)

OP3_SQL = f"""
WITH u AS (
  SELECT page_id,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
r(h, p, rule, verdict) AS (VALUES {_RULE_ROWS}),
b(h) AS (VALUES {_BLOCKED_ROWS}),
f AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM u LEFT JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  GROUP BY ALL)
SELECT page_id, host, path, rule,
  coalesce(verdict, CASE WHEN EXISTS (SELECT 1 FROM b WHERE host = h OR ends_with(host, '.' || h)) THEN 'block' ELSE 'allow' END) AS verdict
FROM f
"""

OP2_SQL = r"""
WITH rows AS (
  SELECT conv_id, CASE WHEN conv_id IS NULL THEN row_number() OVER () END AS alone, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, NULL, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, NULL, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, length(regexp_replace(role, '(<)(\||s>|/s>|<SYS>>|</SYS>>)|(\[)(/?INST\])|(\\)', '\1\3\5\\\2\4', 'g')) AS role_chars,
    length(regexp_replace(text, '(<)(\||s>|/s>|<SYS>>|</SYS>>)|(\[)(/?INST\])|(\\)', '\1\3\5\\\2\4', 'g')) AS text_chars
  FROM rows),
said AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|turn|><|text|><|end|>') + role_chars + text_chars)::BIGINT AS formatted_chars
  FROM escaped GROUP BY conv_id, alone)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM said
"""

OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages),
d AS (
  SELECT page_id, best, octet_length(encode(html)) AS n, (unhex(sha1(html))::BIT)::VARCHAR AS bits FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + 16 * substr(bits, 5 * i + 1, 1)::INT + 8 * substr(bits, 5 * i + 2, 1)::INT + 4 * substr(bits, 5 * i + 3, 1)::INT
       + 2 * substr(bits, 5 * i + 4, 1)::INT + substr(bits, 5 * i + 5, 1)::INT)::BIGINT, 1)), '') AS payload_digest,
  CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""

OP9_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS text FROM documents),
g AS (
  SELECT doc_id, text, first_value(doc_id) OVER (PARTITION BY text ORDER BY chars DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY text) AS n FROM n)
SELECT doc_id, keep_id, n AS group_size, doc_id = keep_id AS kept, sha256(text) AS text_sha256 FROM g
"""

OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || md5(coalesce(text, ''))), 1, 15))::BIGINT AS position
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, cap / weight AS ratio,
    ((sum(source_size) OVER ()) * 1.5::DOUBLE - coalesce(sum(cap) OVER before, 0)) / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW before AS (ORDER BY cap / weight, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, coalesce(least(cap, weight * (SELECT arg_min(level, ratio) FROM l WHERE ratio > level)), cap) AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole,
    target - (CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END) * source_size AS budget FROM t),
p AS (
  SELECT source, position, sum(size) AS mass, sum(sum(size)) OVER (PARTITION BY source ORDER BY position) AS upto FROM d GROUP BY source, position),
c AS (
  SELECT p.source, p.position, whole + CASE WHEN upto <= budget AND budget > 0 THEN 1
    WHEN upto > budget AND upto - mass <= budget AND 2 * (budget - (upto - mass)) >= mass THEN 1 ELSE 0 END AS times, source_size, target
  FROM p JOIN b ON p.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (times * size)::BIGINT AS taken
FROM d JOIN c ON d.source IS NOT DISTINCT FROM c.source AND d.position = c.position
"""

OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (
  SELECT doc_id, part, [len(w) < 100, 100 * len(list_distinct(w)) < 80 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text),
    regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false)] AS fails FROM d),
m AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY doc_id),
cells AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN m USING (doc_id) GROUP BY part, fails),
x(k) AS (VALUES (1), (2), (3), (4), (5)),
orders AS (
  SELECT [a.k, b.k, c.k, d.k, e.k] AS ks FROM x a, x b, x c, x d, x e
  WHERE a.k NOT IN (b.k, c.k, d.k, e.k) AND b.k NOT IN (c.k, d.k, e.k) AND c.k NOT IN (d.k, e.k) AND d.k <> e.k),
steps AS (SELECT array_to_string(list_transform(ks, lambda k: substr('ABCDE', k, 1)), '') AS filter_order, s.k AS step, ks[s.k] AS own, ks[1:s.k - 1] AS before, ks FROM orders, x s),
hits AS (
  SELECT part, filter_order, step, own, n, good, toxic, fails[own] AS fails, len(list_filter(before, lambda k: fails[k])) > 0 AS gone, len(list_filter([1, 2, 3, 4, 5], lambda k: fails[k])) AS how_many
  FROM cells, steps),
r AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (NOT gone AND NOT fails) AS kept, sum(n) FILTER (NOT gone AND fails) AS removed, sum(n) FILTER (gone AND fails) AS redundant,
    sum(n) FILTER (fails AND how_many = 1) AS unique_fails, sum(good) FILTER (NOT gone AND fails) AS good_lost, sum(toxic) FILTER (NOT gone AND fails) AS toxic_lost
  FROM hits GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, (sum(coalesce(removed, 0)) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r
"""


def queries():
    named = [
        op1_ngram_jaccard_join, op2_chat_formatting, op3_url_filters, op4_token_binary_output, op5_quality_rules,
        op6_sentencepiece, op7_warc, op8_language_id, op9_exact_dedup, op10_source_mixing, op11_filter_audit, op12_token_alignment, op13_license_scan, pipeline,
    ]
    return {f.__name__: f for f in named}


def oracle_sql():
    return {"op2_chat_formatting": OP2_SQL, "op3_url_filters": OP3_SQL, "op7_warc": OP7_SQL, "op9_exact_dedup": OP9_SQL, "op10_source_mixing": OP10_SQL, "op11_filter_audit": OP11_SQL}
