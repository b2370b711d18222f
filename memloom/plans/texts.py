"""Text, date, JSON and array functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import text as fn
from memloom.functions import entities
from memloom.operators import compress, lexical, matcher, scan, vector
from memloom.plans.registry import query
from memloom.plans.views import Tables


@query(r"SELECT id, array_to_string(regexp_extract_all(content, '\p{L}+|\p{Nd}+'), ' ') AS tokens FROM mem", "mem")
def fn_tokenize(t: Tables) -> DataFrame:
    return t.mem().select("id", F.array_join(lexical.tokens("content"), " ").alias("tokens"))


_CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '```[\s\S]*?```', '', 'g'), '`[^`]+`', '', 'g'), 'https?://\S+', '', 'g'), '/[\w/.-]+', '', 'g'), '\s+', ' ', 'g'), '[#*_`>|-]+', '', 'g'), ' ')"


@query(f"SELECT id, {_CLEAN} AS cleaned FROM mem", "mem")
def fn_clean_message(t: Tables) -> DataFrame:
    return t.mem().select("id", fn.clean_message("content").alias("cleaned"))


@query(r"SELECT id, substr(trim(regexp_replace(regexp_replace(content, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '\s+', ' ', 'g'), ' '), 1, 500) AS cleaned FROM mem", "mem")
def fn_clean_embed(t: Tables) -> DataFrame:
    return t.mem().select("id", fn.clean_for_embedding("content").alias("cleaned"))


@query(r"SELECT id, CASE WHEN length(c) > 150 THEN substr(c, 1, 150) || '...' ELSE c END AS summary FROM (SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(content, '```[\s\S]*?```', '', 'g'), 'https?://\S+', '', 'g'), '\s+', ' ', 'g'), ' ') AS c FROM mem)", "mem")
def fn_summary(t: Tables) -> DataFrame:
    return t.mem().select("id", fn.summary("content").alias("summary"))


def _signs_sql(patterns: tuple[str, ...]) -> str:
    return " + ".join(f"CASE WHEN regexp_matches(c, '{p}') THEN 0.05e0 ELSE 0e0 END" for p in patterns)


_STRIP = r"(SELECT session_id, turn, role, regexp_replace(regexp_replace(content, '^\s+', ''), '\s+$', '') AS c FROM msg)"


@query(
    "SELECT session_id, turn, score, CASE WHEN score >= 0.7 THEN 'high' WHEN score >= 0.4 THEN 'medium' ELSE 'low' END AS grade FROM (SELECT session_id, turn, CASE WHEN length(c) < 10 THEN 0.1e0 WHEN regexp_matches(c, '^(好的?|明白|收到|可以|没问题|谢谢|嗯|是|对|行|ok)[，。！]?$|^好的，我(现在|马上|这就)', 'i') THEN 0.2e0 "
    r"WHEN (length(c) - length(replace(c, '```', ''))) / 3 > 3 AND length(trim(regexp_replace(c, '```[\s\S]*?```', '', 'g'))) < 50 THEN 0.3e0 "
    "ELSE round(least(greatest(0.5e0 + CASE WHEN length(c) > 100 THEN 0.1e0 ELSE 0e0 END + CASE WHEN length(c) > 300 THEN 0.1e0 ELSE 0e0 END + CASE WHEN length(c) > 500 THEN 0.1e0 ELSE 0e0 END + "
    + _signs_sql(fn.SIGNS)
    + " + CASE WHEN role = 'user' THEN 0.1e0 ELSE 0e0 END, 0.1e0), 1e0), 6) END AS score FROM "
    + _STRIP
    + ")",
    "msg",
)
def fn_quality_a(t: Tables) -> DataFrame:
    m = t.msg().select("session_id", "turn", fn.quality("content", "role").alias("score"))
    return m.withColumn("grade", fn.grade(F.col("score")))


@query(
    "SELECT session_id, turn, CASE WHEN length(c) < 10 THEN 0.1e0 WHEN regexp_matches(c, '^(好的?|明白|收到|可以)[，。！]?$') THEN 0.2e0 ELSE round(least(greatest(0.5e0 + CASE WHEN length(c) > 100 THEN 0.1e0 ELSE 0e0 END + CASE WHEN length(c) > 300 THEN 0.1e0 ELSE 0e0 END + CASE WHEN role = 'user' THEN 0.1e0 ELSE 0e0 END + "
    + _signs_sql(fn.SIGNS_SHORT)
    + ", 0.1e0), 1e0), 6) END AS score FROM "
    + _STRIP,
    "msg",
)
def fn_quality_b(t: Tables) -> DataFrame:
    return t.msg().select("session_id", "turn", fn.quality_short("content", "role").alias("score"))


@query(
    r"WITH p AS (SELECT session_id, turn, list_distinct(list_filter(regexp_split_to_array(lower(content), '\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(lag(content) OVER (PARTITION BY session_id ORDER BY turn)), '\s+'), lambda x: x <> '')) AS b FROM msg) "
    "SELECT session_id, turn, round(CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) ELSE 0e0 END, 6) AS similarity FROM p",
    "msg",
)
def fn_jaccard(t: Tables) -> DataFrame:
    """Each message against the one before it in its session."""
    from pyspark.sql import Window

    m = t.msg().withColumn("before", F.coalesce(F.lag("content").over(Window.partitionBy("session_id").orderBy("turn")), F.lit("")))
    return m.select("session_id", "turn", F.round(fn.jaccard("content", "before"), 6).alias("similarity"))


@query("SELECT id, round(least(0.5e0 + CASE WHEN regexp_matches(content, '[0-9]+') THEN 0.1e0 ELSE 0e0 END + CASE WHEN regexp_matches(content, '公司|项目|版本|姓名|电话|邮箱') THEN 0.2e0 ELSE 0e0 END + CASE WHEN regexp_matches(content, '决定|选择|使用|采用') THEN 0.15e0 ELSE 0e0 END, 1e0), 6) AS importance FROM mem", "mem")
def fn_importance(t: Tables) -> DataFrame:
    return t.mem().select("id", fn.importance("content").alias("importance"))


@query("SELECT id, round(1 - distance, 6) AS similarity FROM dist", "mem", "qvec", "dist")
def fn_cosine(t: Tables) -> DataFrame:
    v = t.vectors().select("id", vector.cosine(F.col("embedding"), vector.literal(t.query_vector())).alias("s"))
    return v.select("id", F.round(1 - F.round(1 - F.col("s"), 6), 6).alias("similarity"))


@query(
    "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST((epoch_us(ts) // 1000) % 1000 AS VARCHAR), 3, '0') || 'Z' AS text, date_trunc('hour', ts)::TIMESTAMP AS hour, date_trunc('day', ts)::TIMESTAMP AS day, date_trunc('week', ts)::TIMESTAMP AS week, date_trunc('month', ts)::TIMESTAMP AS month, date_trunc('year', ts)::TIMESTAMP AS year FROM events"
)
def fn_dates(t: Tables) -> DataFrame:
    e = t.base("events")
    return e.select("event_id", fn.rfc3339("ts").alias("text"), *(F.date_trunc(u, "ts").alias(u) for u in ("hour", "day", "week", "month", "year")))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events")
def fn_json_lenient(t: Tables) -> DataFrame:
    """JSON wrapped as models wrap it: bare, fenced, or within prose."""
    wrapped = F.expr("CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN concat('Sure:\n```json\n', props, '\n```\nDone.') ELSE concat('The answer is ', props, ' as asked') END")
    return t.base("events").select("event_id", fn.lenient_json(wrapped, "k bigint").getField("k").alias("k"))


@query("SELECT event_type, count(*) AS n, sum((props->>'$.k')::BIGINT) AS total, count(DISTINCT props->>'$.k') AS kinds FROM events GROUP BY event_type")
def fn_json_props(t: Tables) -> DataFrame:
    e = t.base("events").select("event_type", F.from_json("props", "k bigint").getField("k").alias("k"))
    return e.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.count_distinct("k").alias("kinds"))


_NER = " + ".join(f"contains(lower(content), '{w.lower()}')::INT" for w in entities.TECHNOLOGY)
_NAMES = ", ".join(f"'{w}'" for w in (*entities.COMMON, *entities.TECHNOLOGY))


@query(
    f"SELECT id, CAST({_NER} AS INT) AS technologies, CAST(len(list_filter(list_distinct(regexp_extract_all(content, '\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)\\b', 1)), lambda x: length(x) > 2 AND x NOT IN ({_NAMES}))) AS INT) AS names FROM (SELECT id, regexp_replace(content, '[^\\x00-\\x7F]', ' ', 'g') AS content FROM mem)",
    "mem",
)
def ner_counts(t: Tables) -> DataFrame:
    """Technologies and English names of each memory; other scripts are blanked, as word edges differ between engines there."""
    m = t.mem().select("id", F.regexp_replace("content", r"[^\x00-\x7F]", " ").alias("content"))
    return m.select("id", F.size(entities.technologies("content")).alias("technologies"), F.size(entities.english_names("content")).alias("names"))


_TERMS = "[" + ", ".join(f"['technology', '{w}', '{w.lower()}']" for w in entities.TECHNOLOGY) + ", " + ", ".join(f"['organization', '{w}', '{w}']" for w in entities.ORGANISATIONS) + ", " + ", ".join(f"['location', '{w}', '{w}']" for w in entities.PLACES) + "]"
_SPAN = "'\\b([A-Z][a-z]+(?:\\s+[A-Z][a-z]+)?)\\b'"


@query(
    f"""WITH m AS (SELECT id, regexp_replace(content, '[^\x00-\x7F]', ' ', 'g') AS c FROM mem), w AS (SELECT unnest({_TERMS}) AS w),
d AS (SELECT id, w[1] AS type, w[2] AS name, w[3] AS term, CASE WHEN w[1] = 'technology' THEN lower(c) ELSE c END AS hay FROM m, w),
s AS (SELECT id, c, regexp_extract_all(c, {_SPAN}, 1) AS hits, regexp_split_to_array(c, {_SPAN}) AS gaps FROM m),
e AS (SELECT id, hits, gaps, unnest(range(1, len(hits) + 1)) AS i FROM s),
p AS (SELECT id, hits[i] AS name, list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:i - 1], lambda x: length(x))), 0) AS a FROM e)
SELECT id, type, name, (strpos(hay, term) - 1)::INT AS "start", (strpos(hay, term) - 1 + length(term))::INT AS "end", ((length(hay) - length(replace(hay, term, ''))) / length(term))::INT AS n FROM d WHERE contains(hay, term)
UNION ALL SELECT id, 'person', name, min(a)::INT, (min(a) + length(name))::INT, count(*)::INT FROM p WHERE length(name) > 2 AND name NOT IN ({_NAMES}) GROUP BY id, name""",
    "mem",
)
def ner_offsets(t: Tables) -> DataFrame:
    """Every entity of each memory by all six rules, with its first place and its count; other scripts are blanked as in ner_counts."""
    return matcher.entities(t.mem().select("id", F.regexp_replace("content", r"[^\x00-\x7F]", " ").alias("content")))


_FACTS = r"""list_filter(list_transform(regexp_split_to_array(content, '[。！？\n.!?]'), lambda s: trim(s)), lambda s: s <> '')"""


@query(f"SELECT id, array_to_string(list_transform(list_slice(x, 1, 3), lambda s: s), ' | ') AS facts FROM (SELECT id, list_filter(x0, lambda s, i: list_position(x0, s) = i) AS x FROM (SELECT id, list_transform({_FACTS}, lambda s: substr(s, 1, 50)) AS x0 FROM mem))", "mem")
def cmp_facts(t: Tables) -> DataFrame:
    """Three facts of each memory, one for each sentence; Latin sentence ends count too."""
    return t.mem().select("id", compress.facts("content", 3, ends=r"[。！？\n.!?]", spo=False).alias("facts"))


@query("SELECT id, CASE WHEN length(content) <= 80 THEN content WHEN 80 - strpos(reverse(substr(content, 1, 80)), '。') > 56 AND strpos(reverse(substr(content, 1, 80)), '。') > 0 THEN substr(content, 1, 81 - strpos(reverse(substr(content, 1, 80)), '。')) ELSE substr(content, 1, 80) || '...' END AS short FROM mem", "mem")
def cmp_truncate(t: Tables) -> DataFrame:
    return t.mem().select("id", compress.truncate("content", 80).alias("short"))


@query(r"SELECT id, array_to_string(list_slice(list_sort(list_distinct(regexp_extract_all(content, '\b(Python|Go|Java|React|Vue|Docker|Redis|PostgreSQL|MongoDB|Kubernetes|OpenAI|LLM|GPT|Claude)\b', 1, 'i'))), 1, 5), ' | ') AS tags FROM mem", "mem")
def cmp_tags(t: Tables) -> DataFrame:
    return t.mem().select("id", compress.tags("content").alias("tags"))


@query(
    """WITH RECURSIVE m AS (SELECT row_number() OVER (PARTITION BY session_id ORDER BY turn) AS i, session_id, turn, length(CASE WHEN length(content) <= 120 THEN content ELSE substr(content, 1, 120) || '...' END) AS a, length(CASE WHEN length(content) <= 60 THEN content ELSE substr(content, 1, 60) || '...' END) AS b FROM msg),
f AS (SELECT session_id, 0::BIGINT AS i, -1::BIGINT AS id, 0::BIGINT AS used, 0::BIGINT AS total, true AS going FROM (SELECT DISTINCT session_id FROM msg)
UNION ALL SELECT m.session_id, m.i, m.turn, CASE WHEN f.total + m.a <= 300 THEN m.a WHEN f.total + m.b <= 300 THEN m.b ELSE 0 END, f.total + CASE WHEN f.total + m.a <= 300 THEN m.a WHEN f.total + m.b <= 300 THEN m.b ELSE 0 END, f.total + m.b <= 300 OR f.total + m.a <= 300 FROM f JOIN m ON m.i = f.i + 1 AND m.session_id = f.session_id WHERE f.going)
SELECT session_id, id AS turn, used, total FROM f WHERE i > 0 AND going""",
    "msg",
)
def cmp_budget(t: Tables) -> DataFrame:
    """The budget's fold over each session's messages: compress, retry harder, stop."""
    page = t.msg().select("session_id", F.col("turn").alias("id"), "content")
    folded = scan.budget(page, 300, F.col("id"), compress.truncate("content", 120), compress.truncate("content", 60), "session_id")
    return folded.select("session_id", F.col("id").alias("turn"), F.length("text").cast("long").alias("used"), "total")
