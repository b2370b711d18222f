"""Profile plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memloom.functions import entities as ent
from memloom.functions import text as fn
from memloom.operators import profile
from memloom.plans.registry import query
from memloom.plans.views import Tables


@query("SELECT CASE WHEN hour(ts) >= 9 AND hour(ts) < 18 THEN 'work_hours' WHEN hour(ts) >= 18 AND hour(ts) < 22 THEN 'evening' ELSE 'night' END AS band, count(*) AS n, count(DISTINCT date_trunc('day', ts)) AS total_sessions FROM events GROUP BY 1")
def prof_hour_band(t: Tables) -> DataFrame:
    return t.base("events").groupBy(profile.hour_band("ts").alias("band")).agg(F.count("*").alias("n"), F.count_distinct(F.to_date("ts")).alias("total_sessions"))


@query("SELECT dayname(ts) AS weekday, count(*) AS n FROM events GROUP BY 1")
def prof_weekday(t: Tables) -> DataFrame:
    return t.base("events").groupBy(F.date_format("ts", "EEEE").alias("weekday")).agg(F.count("*").alias("n"))


#: Stand-ins for the topics: the tables hold no CJK text, so these make the plan count something.
LATIN = {"en": ("the", "and"), "fr": ("elle", "eau"), "de": ("ein", "der"), "es": ("ción", "que"), "AI": fn.TOPICS["AI"]}
_TOPICS = " UNION ALL ".join(f"SELECT id, '{k}' AS topic FROM mem WHERE " + " OR ".join(f"contains(content, '{w}')" for w in words) for k, words in {**LATIN, **{k: v for k, v in fn.TOPICS.items() if k != "AI"}}.items())


@query(f"SELECT topic, count(*) AS n FROM ({_TOPICS}) GROUP BY topic", "mem")
def prof_topics(t: Tables) -> DataFrame:
    return profile.counted(t.mem(), fn.topics("content", {**LATIN, **{k: v for k, v in fn.TOPICS.items() if k != "AI"}}), "topic")


_COMMON = ", ".join(f"'{w}'" for w in (*ent.COMMON, *ent.TECHNOLOGY))


@query(
    rf"SELECT memory_type, name, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY memory_type ORDER BY n DESC, name) AS rank FROM (SELECT memory_type, name, count(*) AS n FROM (SELECT memory_type, unnest(list_filter(list_distinct(regexp_extract_all(content, '\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b', 1)), lambda x: length(x) > 2 AND x NOT IN ({_COMMON}))) AS name FROM (SELECT memory_type, regexp_replace(content, '[^\x00-\x7F]', ' ', 'g') AS content FROM mem)) GROUP BY ALL)) WHERE rank <= 20",
    "mem",
)
def prof_entities(t: Tables) -> DataFrame:
    m = t.mem().select("memory_type", F.regexp_replace("content", r"[^\x00-\x7F]", " ").alias("content"))
    return profile.top_per(profile.counted(m, ent.english_names("content"), "name", "memory_type"), 20, "name", "memory_type")


@query("SELECT w AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(content, '(?:the|elle|der|ein|que)')) AS w FROM (SELECT content FROM mem WHERE importance > 0.6 ORDER BY importance DESC, id LIMIT 50)) GROUP BY w ORDER BY n DESC, word LIMIT 10", "mem")
def prof_prefs(t: Tables) -> DataFrame:
    """Words of the fifty most important memories; stand-ins for the technologies, which the tables don't name."""
    top = t.mem("importance").where("importance > 0.6").orderBy(F.desc("importance"), "id").limit(50)
    found = F.regexp_extract_all("content", F.lit("((?:the|elle|der|ein|que))"), F.lit(1))
    return profile.counted(top, found, "word").orderBy(F.desc("n"), "word").limit(10)


_F = ("[0-9]+", r"\|", "the|der|elle")
_E = ("was|ver", r"[#*$]", "ción")
_SUM = lambda ps: " + ".join(f"regexp_matches(content, '{p}')::INT" for p in ps)


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN f > e + 1 THEN 'fact' WHEN e > f + 1 THEN 'experience' WHEN f > 0 AND e > 0 THEN 'mixed' ELSE 'unknown' END AS kind FROM (SELECT {_SUM(_F)} AS f, {_SUM(_E)} AS e FROM mem)) GROUP BY kind", "mem")
def prof_classify(t: Tables) -> DataFrame:
    """Facts and experiences with stand-in signs (the built-in ones are Chinese; unit tests cover them)."""
    return t.mem().groupBy(profile.kind("content", _F, _E).alias("kind")).agg(F.count("*").alias("n"))
