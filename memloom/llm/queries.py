"""One query for each operator of this subpackage, over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memloom.llm.common import scratch, table, tokenizer_path


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import decontamination

    return decontamination.find_contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import chat

    said = r"\### Assistant: </turn> ok"
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    path = tokenizer_path("byte_bpe_50k.json")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    return chat.read_back(chat.format_conversations(turns, path), path)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import token_counts

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import token_files

    return token_files.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import bpe_automaton

    return bpe_automaton.digest_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import quality_rules

    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import sharding

    laid = sharding.shard_documents(table(spark, sf_dir, "documents"), 16)
    text = F.coalesce("text", F.lit(""))
    return laid.select(
        "doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("rows").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import jaccard_join

    return jaccard_join.linked(table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import suffix_dedup

    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import warc

    return warc.archive_pages(table(spark, sf_dir, "pages"), scratch(spark, "warc")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import simhash_dedup

    return simhash_dedup.linked(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from memloom.llm import collocations

    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: Words of each text with their places, lines and windows, as SQL has them.
_OP6_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
win AS (
  SELECT doc_id, i, array_to_string(words[i:i+7], chr(10)) AS win
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
f AS (
  SELECT doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}'))) AS n_lettered
  FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN lines USING (doc_id))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
       CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words
            OR 10 * n_lettered < 4 * n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)) AS kept
FROM f
"""

#: Links by a join on all shared shingles, components by reachability.
_OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 4 THEN list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i+3], ' '))
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_shared FROM s AS a JOIN s AS b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
hit AS (SELECT a, b FROM shared JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * n_shared >= 85 * (x.n + y.n - n_shared)),
links AS (SELECT a, b FROM hit UNION ALL SELECT b, a FROM hit),
reach AS (SELECT doc_id, doc_id AS c FROM n UNION SELECT links.b, reach.c FROM reach JOIN links ON links.a = reach.doc_id),
parts AS (SELECT doc_id, min(c) AS c FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(c, doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN parts USING (doc_id)
"""

#: Every 50-byte string of each text, in hexadecimal digits.
_OP9_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
pieces AS (SELECT doc_id, k, substring(h, 2000 * k + 1, 2098) AS p FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2000 + 1)) AS k FROM d)),
win AS (
  SELECT doc_id, 1000 * k + j AS i, substring(p, 2 * j + 1, 100) AS x
  FROM (SELECT doc_id, k, p, unnest(range(0, length(p) // 2 - 49)) AS j FROM pieces WHERE length(p) >= 100)),
firsts AS (SELECT x, min(doc_id) AS first_id FROM win GROUP BY x),
cut AS (SELECT doc_id, i FROM win JOIN firsts USING (x) WHERE first_id < doc_id),
steps AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 1 ELSE 0 END AS step FROM cut),
numbered AS (SELECT doc_id, i, sum(step) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM steps),
runs AS (SELECT doc_id, run, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, run),
gaps AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM runs),
g AS (
  SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS b, string_agg(substring(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS head
  FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(CASE WHEN n_spans > 0 THEN head || substring(h, 2 * b + 1) ELSE h END)) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

_OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM p LEFT JOIN g USING (digest)
"""

#: Masks of failed filters by document, then every order's steps over the masks.
_OP12_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
least AS (SELECT text, min(doc_id) AS first_id FROM d GROUP BY text),
l AS (SELECT doc_id, bool_or(coalesce(quality = 1, false)) AS good, bool_or(coalesce(toxic = 1, false)) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 65 * len(words) THEN 2 ELSE 0 END
         + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text) THEN 4 ELSE 0 END
         + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN doc_id > first_id THEN 16 ELSE 0 END AS mask
  FROM w JOIN least USING (text) LEFT JOIN l USING (doc_id)),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE (a.bit | b.bit | c.bit | d.bit | e.bit) = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (
  SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (bit | before) = 0 THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
       good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM r
"""

#: All runs of one to four words counted, then cuts, containment and ranks.
_OP13_SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
p AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
n AS (SELECT lang, sum(len(words))::BIGINT AS n FROM w GROUP BY lang),
g AS (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(words) >= k),
f AS (SELECT lang, k, array_to_string(words[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS words, f AS a FROM f WHERE k >= 2),
cut AS (SELECT lang, phrase, a, words, k, unnest(range(1, k)) AS pos FROM c),
s AS (
  SELECT cut.lang, cut.phrase, cut.a, pos, x.f AS l, y.f AS r, (2000000::HUGEINT * cut.a) // (x.f + y.f) AS score
  FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = array_to_string(words[1:pos], ' ')
  JOIN f y ON y.lang = cut.lang AND y.phrase = array_to_string(words[pos + 1:], ' ')),
low AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1),
inner_runs AS (
  SELECT lang, a, array_to_string(words[i:i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, words, k, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE m < k)),
longer AS (SELECT lang, phrase, max(a) AS most FROM inner_runs GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM low LEFT JOIN longer USING (lang, phrase) JOIN n USING (lang) WHERE most IS NULL OR 100 * most < 80 * a
QUALIFY rank <= 2000
"""


def queries() -> dict:
    found = [op1_decontamination, op2_chat_formatting, op3_token_counts, op4_token_files, op5_bpe_automaton, op6_quality_rules, op7_sharding, op8_jaccard_join, op9_suffix_dedup, op10_warc, op11_simhash_dedup, op12_filter_audit, op13_collocations, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_quality_rules": _OP6_SQL, "op8_jaccard_join": _OP8_SQL, "op9_suffix_dedup": _OP9_SQL, "op10_warc": _OP10_SQL, "op12_filter_audit": _OP12_SQL, "op13_collocations": _OP13_SQL}
