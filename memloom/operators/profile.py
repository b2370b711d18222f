"""Profiles of an agent's memories: time of day, topics, entities, preferences, facts and experiences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.functions import text as fn

#: Signs of a fact and of an experience, a point each.
FACTS = (r"是\s*\w+", r"使用\s*\w+", r"用\s*\w+", r"基于\s*\w+", r"版本\s*\d", r"\d+\.\d+", r"配置\s*\w+", r"参数\s*\w+", r"地址\s*\w+", r"端口\s*\d", r" IP ", r"URL", r"公司名|产品名|技术栈", r"数据库|框架|语言")
EXPERIENCES = (r"做过|做过\s*\w+", r"开发过|参与过|负责过", r"工作经验|项目经验", r"曾经|以前|之前", r"学习|研究|探索", r"解决|处理|修复", r"完成|实现|构建", r"遇到|碰到|发现")
#: Styles of work with their signs.
STYLES = {"高效优先": ("快速", "高效"), "简洁风格": ("简洁", "简单"), "自动化": ("自动化",), "重视质量": ("测试",)}
TECH = r"(Python|JavaScript|Go|Rust|React|Vue|Node\.js|PostgreSQL|Redis|Docker)"


def hour_band(ts: Column | str) -> Column:
    h = F.hour(ts)
    return F.when((h >= 9) & (h < 18), "work_hours").when((h >= 18) & (h < 22), "evening").otherwise("night")


def kind(text: Column | str, facts: tuple[str, ...] = FACTS, experiences: tuple[str, ...] = EXPERIENCES) -> Column:
    """fact or experience if one leads by two points, mixed if both score, else unknown. Words are Unicode's."""
    f = fn.matches(text, tuple("(?U)" + p for p in facts))
    e = fn.matches(text, tuple("(?U)" + p for p in experiences))
    return F.when(f > e + 1, "fact").when(e > f + 1, "experience").when((f > 0) & (e > 0), "mixed").otherwise("unknown")


def counted(df: DataFrame, items: Column, name: str, *group: str) -> DataFrame:
    """How many rows hold each item."""
    return df.select(*group, F.explode(items).alias(name)).groupBy(*group, name).agg(F.count("*").alias("n"))


def top_per(counts: DataFrame, k: int, name: str, *group: str) -> DataFrame:
    """The k most frequent items of each group; counts have been aggregated, and the window's limit keeps k a group and task."""
    w = Window.partitionBy(*group).orderBy(F.desc("n"), name)
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def styles(text: Column | str) -> Column:
    return fn.topics(text, STYLES)
