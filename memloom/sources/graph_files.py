"""Graph JSON files, agent exports, and wiki blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

GRAPH = "nodes array<struct<id:string,attrs:map<string,string>>>, edges array<struct<source:string,target:string,attrs:map<string,string>>>"


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of graph files; attributes are maps, and an edge's type and confidence columns."""
    g = spark.read.schema(GRAPH).json(path, multiLine=True)
    nodes = g.select(F.explode("nodes").alias("n")).select("n.id", F.col("n.attrs")["type"].alias("type"), "n.attrs")
    edges = g.select(F.explode("edges").alias("e")).select("e.source", F.coalesce(F.col("e.attrs")["relation"], F.col("e.attrs")["type"]).alias("relation"), "e.target", F.col("e.attrs")["confidence"].try_cast("double").alias("confidence"), "e.attrs")
    return nodes, edges


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """The graph as two tables; one write a batch."""
    nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    edges.write.mode("overwrite").parquet(f"{path}/edges")


def export_agent(memories: DataFrame, kg: DataFrame, path: str, version: str = "1.0") -> None:
    """An agent's tables as JSON lines beside a manifest."""
    memories.write.mode("overwrite").json(f"{path}/memories")
    kg.write.mode("overwrite").json(f"{path}/kg")
    spark = memories.sparkSession
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path}/manifest")


def import_agent(spark: SparkSession, path: str, held: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Memories of an export; merged with held ones, those held win."""
    new = spark.read.json(f"{path}/memories")
    if held is None:
        return new
    return held.unionByName(new.join(held.select(key), key, "left_anti"), allowMissingColumns=True)


def block_markdown(blocks: Column) -> Column:
    """Wiki blocks array<struct<type, text>> as Markdown, blank lines between."""
    head = {"heading1": "## ", "heading2": "### ", "heading3": "#### ", "quote": "> ", "bullet": "- "}

    def one(b: Column) -> Column:
        out = F.when(b["type"] == "code", F.concat(F.lit("```\n"), b["text"], F.lit("\n```")))
        for kind, mark in head.items():
            out = out.when(b["type"] == kind, F.concat(F.lit(mark), b["text"]))
        return out.otherwise(b["text"])

    return F.array_join(F.filter(F.transform(blocks, one), lambda x: x != ""), "\n\n")
