"""Plans over questions, model answers, session lines and Markdown, put together from the tables' own texts, dates and numbers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import decay, markdown
from memloom.functions import entities as ent
from memloom.functions import text as fn
from memloom.plans import intent, texts
from memloom.plans.registry import query
from memloom.plans.views import REF_TIME, Tables
from memloom.sources import sessions

#: A Wednesday.
NOW = dt.datetime(2024, 1, 31, 10, 30)
_T = f"TIMESTAMP '{REF_TIME}'"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _any(column: str, words) -> str:
    return "(" + " OR ".join(f"contains({column}, {_quoted(w)})" for w in words) + ")"


@query(f"SELECT event_id, round(CASE WHEN d < 1 THEN 1.2e0 ELSE power(0.9e0, d / 7) END, 6) AS boost FROM (SELECT event_id, greatest((epoch_us({_T}) - epoch_us(ts)) / 86400e6, 0e0) AS d FROM events)")
def rnk_boost_table(t: Tables) -> DataFrame:
    """The boost of every event by its age."""
    age = F.greatest(decay.days_between(F.col("ts"), F.lit(REF_TIME).cast("timestamp")), F.lit(0.0))
    return t.base("events").select("event_id", F.round(decay.boost(age), 6).alias("boost"))


#: What stands before and after a message's text, by the place of its turn; {n} is a number of the turn's own.
FORMS = (("昨天说了什么 ", ""), ("{n}天前的会议 ", ""), ("{n} hours ago we met ", ""), ("上周的计划 ", ""), ("", ""), ('"', '" please'), ("记得大概的内容 ", ""), ("去年的旅行 ", ""))
_Q = "CASE (session_id + turn) % 8 " + " ".join("WHEN {} THEN {} || content || {}".format(k, _quoted(a).replace("{n}", "' || (turn % 5 + 1) || '"), _quoted(b)) for k, (a, b) in enumerate(FORMS)) + " END"


def questions(t: Tables) -> DataFrame:
    """(session_id, turn, question): a question from each message, of all sorts by turn."""
    form = (F.col("session_id") + F.col("turn")) % 8
    n = (F.col("turn") % 5 + 1).cast("string")
    out = F.lit(None).cast("string")
    for k, (a, b) in enumerate(FORMS):
        head = [x for p in a.split("{n}") for x in (F.lit(p), n)][:-1]
        out = F.when(form == k, F.concat(*head, "content", F.lit(b))).otherwise(out)
    return t.msg().select("session_id", "turn", out.alias("question"))


def _span(span: tuple[dt.datetime, dt.datetime]) -> tuple[str, str]:
    return tuple(f"TIMESTAMP '{x:%Y-%m-%d %H:%M:%S}'" for x in span)


_NOW = f"TIMESTAMP '{NOW:%Y-%m-%d %H:%M:%S}'"
_KINDS: list[tuple[str, str, str, str, str]] = [(_any("question", intent.QUOTES), "exact", "bm25", "NULL", "NULL"), (_any("low", intent.EXACT), "exact", "bm25", "NULL", "NULL")]
_KINDS += [(_any("low", words), "time", "time", *_span(span(NOW))) for words, span, *_ in intent.NAMED]
_DAYS, _HOURS = r"regexp_extract(question, '(\d+)\s*天前', 1)", r"regexp_extract(low, '(?:^|[^a-z0-9])(\d+)\s+hours? ago', 1)"
_KINDS += [
    (f"{_DAYS} <> ''", "time", "time", f"date_trunc('day', {_NOW} - to_days({_DAYS}::INT))", f"date_trunc('day', {_NOW} - to_days({_DAYS}::INT)) + INTERVAL '23:59:59'"),
    (f"{_HOURS} <> ''", "time", "time", f"date_trunc('hour', {_NOW} - to_hours({_HOURS}::INT))", f"date_trunc('hour', {_NOW} - to_hours({_HOURS}::INT)) + INTERVAL 1 HOUR"),
]
_KINDS += [(_any("low", words), "time", "time", *_span(span(NOW))) for words, span, *_ in intent.LATER]
_KINDS += [(_any("low", intent.FUZZY), "fuzzy", "vector", "NULL", "NULL"), ("true", "general", "hybrid", "NULL", "NULL")]


def _case(place: int) -> str:
    """One column of _KINDS by the first condition that holds; times are worked out only where theirs does."""
    value = lambda k: k[place] if place > 2 else _quoted(k[place])
    return "CASE " + " ".join(f"WHEN {k[0]} THEN {value(k)}" for k in _KINDS) + " END"


@query(f"WITH q AS (SELECT session_id, turn, {_Q} AS question FROM msg), l AS (SELECT *, lower(question) AS low FROM q) SELECT session_id, turn, {_case(1)} AS intent, {_case(2)} AS mode, CAST({_case(3)} AS TIMESTAMP) AS lo, CAST({_case(4)} AS TIMESTAMP) AS hi FROM l", "msg")
def tim_anchors(t: Tables) -> DataFrame:
    """Intents, time anchors and offsets of every message turned into a question."""
    return intent.intents(questions(t), "question", NOW).select("session_id", "turn", "intent", "mode", "lo", "hi")


@query(
    f"""SELECT event_id, CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) ELSE date_trunc('day', {_NOW} - INTERVAL 7 DAY) END::TIMESTAMP AS lo,
CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) + to_days((event_id % 5)::INT) + INTERVAL '23:59:59' ELSE date_trunc('day', {_NOW}) + INTERVAL '23:59:59' END::TIMESTAMP AS hi FROM events"""
)
def tim_model_range(t: Tables) -> DataFrame:
    """Ranges that a model read, from answers with each event's own dates, without any, and with broken ones; the last seven days for these."""
    e, day = t.base("events"), lambda c: F.date_format(c, "yyyy-MM-dd")
    good = F.concat(F.lit('The range is {"start_date": "'), day("ts"), F.lit('", "end_date": "'), day(F.expr("date_add(ts, CAST(event_id % 5 AS INT))")), F.lit('"} as asked'))
    broken = F.concat(F.lit('It is {"start_date": "'), F.col("event_type"), F.lit('"}'))
    answer = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, F.concat(F.lit("no idea of "), "event_type")).otherwise(broken)
    return intent.told_ranges(e.select("event_id", answer.alias("answer")), "answer", NOW).select("event_id", "lo", "hi")


_HIT = {c: _any("question", words) for c, words in intent.TRIGGERS.items()}
_MORE = "length(question) - length(replace(question, '?', '')) > 1 OR length(question) - length(replace(question, '？', '')) > 1"
_LAST = list(reversed(intent.SETTINGS.items()))


@query(
    f"""WITH q AS (SELECT session_id, turn, CASE (session_id + turn) % 3 WHEN 0 THEN '还记得上次的项目吗?' WHEN 1 THEN '' ELSE '谢谢 ' END || content AS question FROM msg),
d AS (SELECT *, NOT {_any("question", intent.NO_RECALL)} AND ({" OR ".join(_HIT.values())}) AS ok, CASE {" ".join(f"WHEN {_HIT[c]} THEN {limit}" for c, (limit, _, _) in _LAST)} ELSE 5 END AS n FROM q),
s AS (SELECT *, CASE WHEN length(question) < 10 THEN least(n, 3) ELSE n END AS m FROM d)
SELECT session_id, turn, ok AS should_recall, CASE WHEN NOT ok THEN 'tags' {" ".join(f"WHEN {_HIT[c]} THEN '{level}'" for c, (_, level, _) in _LAST)} ELSE 'summary' END AS level,
(CASE WHEN NOT ok THEN 0 WHEN {_MORE} THEN least(m + 2, 10) ELSE m END)::INT AS memory_limit FROM s""",
    "msg",
)
def rec_decisions(t: Tables) -> DataFrame:
    """Whether and how much to recall for every message, some led by words that ask for it and some by words that forbid it."""
    form = (F.col("session_id") + F.col("turn")) % 3
    q = t.msg().select("session_id", "turn", F.concat(F.when(form == 0, "还记得上次的项目吗?").when(form == 1, "").otherwise("谢谢 "), "content").alias("question"))
    return intent.decisions(q, "question").select("session_id", "turn", "should_recall", "level", "memory_limit")


def session_lines(t: Tables) -> DataFrame:
    """(value, path): conversations as lines of session files. Every other message is an array of parts; each fifth session is a copy kept at a
    reset, another a deleted file; a broken line and a line of another type stand beside each message."""
    m = t.msg()
    text = F.struct(F.lit("text").alias("type"), F.col("content").alias("text"))
    parts = F.to_json(F.array(text, F.struct(F.lit("image").alias("type"), F.lit(None).cast("string").alias("text"))))
    say = lambda content: F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("m"), "turn").alias("id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.struct("role", content.alias("content")).alias("message")))
    head = F.substring_index(say(F.lit("@PARTS@")), '"@PARTS@"', 1)
    line = F.when(F.col("turn") % 2 == 0, say(F.col("content"))).otherwise(F.concat(head, parts, F.lit("}}")))
    kind = F.col("session_id") % 5
    name = F.concat(F.lit("/x/s"), F.col("session_id").cast("string"), F.when(kind == 1, ".jsonl.reset.2024-01-02T00").when(kind == 2, ".jsonl.deleted.1").otherwise(".jsonl"))
    other = F.concat(F.lit('{"type": "tool", "id": "t'), F.col("turn").cast("string"), F.lit('"}'))
    return m.select(F.explode(F.array(line, F.substring(line, 1, 20), other)).alias("value"), name.alias("path"))


@query(
    f"SELECT 's' || session_id AS session_id, 's' || session_id || CASE session_id % 5 WHEN 1 THEN '_reset_2024-01-02' ELSE '' END AS unique_id, 'm' || turn AS id, role, cleaned AS content FROM (SELECT session_id, turn, role, {texts._CLEAN} AS cleaned FROM msg WHERE role IN ('user', 'assistant') AND session_id % 5 <> 2) WHERE cleaned <> ''",
    "msg",
)
def src_session_lines(t: Tables) -> DataFrame:
    """All conversations read back from session lines."""
    return sessions.parsed(session_lines(t)).select("session_id", "unique_id", "id", "role", "content")


def files(t: Tables) -> DataFrame:
    """(content, filename): a Markdown note on each document."""
    item = F.regexp_replace(F.substring("text", 1, 60), "[^a-z ]", "")
    lines = (F.concat(F.lit("# "), "source", F.lit(" notes")), F.lit(""), F.concat(F.lit("- **origin**: "), "source", F.lit(" archive")), F.lit("- **password**: hunter2"), F.concat(F.lit("- the "), item))
    return t.base("documents").select(F.concat_ws("\n", *lines).alias("content"), F.concat("doc_id", F.lit(".md")).alias("filename"))


@query("SELECT DISTINCT name FROM (SELECT source || ' notes' AS name FROM documents UNION ALL SELECT source || ' archive' FROM documents UNION ALL SELECT substr(x, 1, 50) FROM (SELECT rtrim('the ' || regexp_replace(substr(text, 1, 60), '[^a-z ]', '', 'g'), ' ') AS x FROM documents) WHERE length(x) BETWEEN 6 AND 99)")
def md_entities(t: Tables) -> DataFrame:
    return markdown.extracted(files(t))[0].select("name").distinct()


@query("SELECT doc_id || '.md' AS source, 'has_origin' AS relation, source || ' archive' AS target FROM documents")
def md_relations(t: Tables) -> DataFrame:
    return markdown.extracted(files(t))[1]


@query("SELECT p_name AS name, replace(replace(replace(p_name, ' ', '_'), '-', '_'), '.', '_') AS clean, length(p_name) >= 2 AND NOT regexp_matches(p_name, '^[0-9]+(\\.[0-9]+)?(个|件|条|次|天|小时|分钟|秒)?$') AS valid FROM part")
def fn_names(t: Tables) -> DataFrame:
    return t.base("part").select(F.col("p_name").alias("name"), fn.sanitised("p_name").alias("clean"), ent.valid_entity("p_name").alias("valid"))
