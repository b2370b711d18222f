"""Text functions as column expressions. Patterns are written so that they mean the same in Java's and other engines' dialects."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Acknowledgements that carry nothing (whole message, any case), and signs of content.
ACKS = r"(?iu)^(好的?|明白|收到|可以|没问题|谢谢|嗯|是|对|行|ok)[，。！]?$|^好的，我(现在|马上|这就)"
ACKS_SHORT = r"^(好的?|明白|收到|可以)[，。！]?$"
SIGNS = (r"[0-9]{4}[-/年][0-9]{1,2}[-/月][0-9]{1,2}", r"[0-9]+[%％]", r"[0-9]+[万千百十亿]", r"https?://[^\s]+", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+", r"项目|任务|需求|问题|方案|计划", r"决定|确认|同意|修改|添加|删除", r"因为|所以|但是|如果|那么|首先|然后")
SIGNS_SHORT = (r"[0-9]{4}[-/年]", r"[0-9]+[%％]", r"https?://", r"项目|任务|需求|问题")
#: Keywords of each topic.
TOPICS = {"开发": ("开发", "代码", "编程", "实现", "功能"), "产品": ("产品", "需求", "设计", "用户", "体验"), "运维": ("部署", "运维", "监控", "服务器", "Docker"), "AI": ("AI", "LLM", "大模型", "GPT", "OpenAI", "Ollama"), "数据": ("数据库", "存储", "数据", "Redis", "PostgreSQL"), "团队": ("团队", "协作", "会议", "沟通", "成员")}


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def stripped(text: Column | str) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(_c(text), r"^\s+|\s+$", "")


def clean_message(text: Column | str) -> Column:
    """Code, links, paths and markup taken out, white space to single blanks."""
    t = F.coalesce(_c(text), F.lit(""))
    for pattern, new in ((r"```[\s\S]*?```", ""), (r"`[^`]+`", ""), (r"https?://\S+", ""), (r"/[\w/.-]+", ""), (r"\s+", " "), (r"[#*_`>|-]+", "")):
        t = F.regexp_replace(t, pattern, new)
    return F.trim(t)


def clean_for_embedding(text: Column | str, most: int = 500) -> Column:
    """Control characters out, white space to single blanks, cut."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), r"\s+", " ")
    return F.substring(F.trim(t), 1, most)


def clean_metadata(text: Column | str) -> Column:
    """Without blocks of metadata about a conversation or its sender, a label that is left of one, and bracketed marks at line starts."""
    t = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?s)(?:Conversation info|Sender) \(untrusted metadata\):\s*```json.*?```\s*", "")
    t = F.regexp_replace(t, r"^\s*(?:Conversation info|Sender) \(untrusted metadata\):\s*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^\[[^\]]+\]\s*", ""), r"\n\[[^\]]+\]\s*", "\n"))


def summary(text: Column | str, most: int = 150) -> Column:
    """Code and links out, white space to blanks, cut with an ellipsis."""
    t = F.coalesce(_c(text), F.lit(""))
    for pattern, new in ((r"```[\s\S]*?```", ""), (r"https?://\S+", ""), (r"\s+", " ")):
        t = F.regexp_replace(t, pattern, new)
    t = F.trim(t)
    return F.when(F.length(t) > most, F.concat(F.substring(t, 1, most), F.lit("..."))).otherwise(t)


def _signs(text: Column, patterns: tuple[str, ...]) -> Column:
    return sum((F.when(text.rlike(p), 0.05).otherwise(0.0) for p in patterns[1:]), F.when(text.rlike(patterns[0]), 0.05).otherwise(0.0))


def _clamped(score: Column) -> Column:
    return F.round(F.least(F.greatest(score, F.lit(0.1)), F.lit(1.0)), 6)


def quality(text: Column | str, role: Column | str) -> Column:
    """Score of a message: short .1, acknowledgement .2, mostly code .3, else .5 and what length, signs of content and the role add."""
    t = stripped(F.coalesce(_c(text), F.lit("")))
    plain = stripped(F.regexp_replace(t, r"```[\s\S]*?```", ""))
    fences = F.size(F.regexp_extract_all(t, F.lit("(```)"), F.lit(1)))
    n = F.length(t)
    add = [F.when(n > k, 0.1).otherwise(0.0) for k in (100, 300, 500)]
    score = 0.5 + add[0] + add[1] + add[2] + _signs(t, SIGNS) + F.when(_c(role) == "user", 0.1).otherwise(0.0)
    return F.when(n < 10, 0.1).when(t.rlike(ACKS), 0.2).when((fences > 3) & (F.length(plain) < 50), 0.3).otherwise(_clamped(score))


def quality_short(text: Column | str, role: Column | str) -> Column:
    """The ingester's shorter version of the same score."""
    t = stripped(F.coalesce(_c(text), F.lit("")))
    n = F.length(t)
    score = 0.5 + F.when(n > 100, 0.1).otherwise(0.0) + F.when(n > 300, 0.1).otherwise(0.0) + F.when(_c(role) == "user", 0.1).otherwise(0.0) + _signs(t, SIGNS_SHORT)
    return F.when(n < 10, 0.1).when(t.rlike(ACKS_SHORT), 0.2).otherwise(_clamped(score))


def grade(score: Column) -> Column:
    return F.when(score >= 0.7, "high").when(score >= 0.4, "medium").otherwise("low")


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Overlap of the sets of lower-case words; 0 where either has none."""
    sets = [F.array_distinct(F.filter(F.split(F.lower(_c(x)), r"\s+"), lambda w: w != "")) for x in (a, b)]
    both, any_ = F.size(F.array_intersect(*sets)), F.size(F.array_union(*sets))
    return F.when((F.size(sets[0]) > 0) & (F.size(sets[1]) > 0), both / any_).otherwise(0.0)


def importance(text: Column | str) -> Column:
    """Importance of a fact by digits, key nouns and words of decision."""
    t = _c(text)
    hit = lambda p, w: F.when(t.rlike(p), w).otherwise(0.0)
    return F.round(F.least(0.5 + hit("[0-9]+", 0.1) + hit("公司|项目|版本|姓名|电话|邮箱", 0.2) + hit("决定|选择|使用|采用", 0.15), F.lit(1.0)), 6)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    out = text.contains(words[0])
    for w in words[1:]:
        out = out | text.contains(w)
    return out


def topics(text: Column | str, table: dict[str, tuple[str, ...]] = TOPICS) -> Column:
    """Topics whose keywords stand in the text."""
    t = _c(text)
    return F.array_compact(F.array(*(F.when(any_of(t, words), name) for name, words in table.items())))


def matches(text: Column | str, patterns: tuple[str, ...]) -> Column:
    """How many of the patterns are found."""
    t = _c(text)
    return sum((t.rlike(p).cast("int") for p in patterns[1:]), t.rlike(patterns[0]).cast("int"))


def title(first_message: Column | str, date: Column | None = None) -> Column:
    """A session's title: 50 characters of its first user message, a date before it for kept copies."""
    t = _c(first_message)
    t = F.when(F.length(t) > 50, F.concat(F.substring(t, 1, 50), F.lit("..."))).otherwise(t)
    return t if date is None else F.concat(F.lit("["), date, F.lit("] "), t)


def sanitised(name: Column | str) -> Column:
    return F.translate(_c(name), " -.", "___")


def description_tags(text: Column | str, stop: tuple[str, ...] = ("的", "是", "在", "了", "和", "与"), most: int = 10) -> Column:
    w = F.filter(F.split(_c(text), " "), lambda x: (F.length(x) > 1) & ~x.isin(*stop))
    return F.slice(F.array_distinct(w), 1, most)


def lenient_json(text: Column | str, schema: str) -> Column:
    """JSON as it stands, else from a fenced block, else the first braces; null where none parses."""
    t = _c(text)
    whole = F.when(F.trim(t).startswith("{"), t)
    fenced = F.nullif(F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1), F.lit(""))
    first = F.nullif(F.regexp_extract(t, r"(?s)(\{.*\})", 1), F.lit(""))
    options = {"mode": "FAILFAST"}
    parse = lambda c: F.from_json(F.when(F.try_parse_json(c).isNotNull(), c), schema, options)
    return F.coalesce(parse(whole), parse(fenced), parse(first))


def rfc3339(ts: Column | str) -> Column:
    return F.date_format(_c(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
