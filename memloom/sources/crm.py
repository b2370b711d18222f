"""CRM rows from CSV, JSON or an API, with field names found by aliases."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The names under which each field may come, the first present wins.
FIELDS = {
    "user_id": ("user_id", "customer_id", "会员ID", "客户ID", "member_id", "id"),
    "age_range": ("age_range", "年龄段", "age", "年龄"),
    "gender": ("gender", "性别", "sex"),
    "region": ("region", "地区", "city", "城市", "province", "省份", "address", "地址"),
    "member_level": ("member_level", "会员等级", "level", "等级", "vip_level"),
    "total_spent": ("total_spent", "总消费", "total_amount", "累计消费", "lifetime_value"),
    "total_orders": ("total_orders", "订单数", "order_count", "购买次数", "total_purchases"),
    "avg_order_value": ("avg_order_value", "客单价", "average_order", "平均消费"),
    "phone": ("phone", "手机", "mobile", "电话", "tel"),
    "email": ("email", "邮箱", "mail"),
    "name": ("name", "姓名", "customer_name", "用户名", "real_name"),
    "register_time": ("register_time", "注册时间", "created_at", "join_date", "注册日期"),
    "last_purchase": ("last_purchase", "最后购买", "last_order", "最近购买"),
}
NUMBERS = {"total_spent": "double", "total_orders": "int", "avg_order_value": "double"}
TEMPLATE = "user_id,name,phone,email,gender,age_range,region,member_level,total_spent,total_orders"


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True)


def csv_text(spark: SparkSession, content: str) -> DataFrame:
    """CSV given as a string."""
    rows = spark.createDataFrame([(x,) for x in content.removeprefix("﻿").strip().splitlines()], "value string")
    head = content.removeprefix("﻿").strip().splitlines()[0].split(",")
    schema = ", ".join(f"`{h.strip()}` string" for h in head)
    return rows.where(F.col("value") != ",".join(head)).select(F.from_csv("value", schema).alias("r")).select("r.*")


def read_json(spark: SparkSession, path: str) -> DataFrame:
    """A file that holds one object or a list of them."""
    return spark.read.json(path, multiLine=True)


def mapped(rows: DataFrame) -> DataFrame:
    """Rows under the canonical names, numbers cast where they can be; null where a field is missing."""
    present = {c: c for c in rows.columns}

    def pick(field: str) -> Column:
        found = next((a for a in FIELDS[field] if a in present), None)
        c = F.lit(None).cast("string") if found is None else F.nullif(F.trim(F.col(f"`{found}`").cast("string")), F.lit(""))
        return (c.try_cast(NUMBERS[field]) if field in NUMBERS else c).alias(field)

    return rows.select(*map(pick, FIELDS))


def profiles(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Profiles as nested structs, and the rows that have no user id."""
    m = mapped(rows)
    p = m.where("user_id IS NOT NULL").select("user_id", F.struct("age_range", "gender", "region", "member_level", "phone", "email", "name").alias("basic"), F.struct("total_spent", "total_orders", "avg_order_value").alias("consumption"))
    return p, m.where("user_id IS NULL")


class _Page(InputPartition):
    def __init__(self, url: str):
        self.url = url


class _ApiReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[_Page]:
        """One for each url of the option `urls`, separated by blanks: pages are fetched by executors."""
        return [_Page(u) for u in self.options["urls"].split()]

    def read(self, partition: _Page):
        from urllib.request import Request, urlopen

        headers = json.loads(self.options.get("headers", "{}"))
        with urlopen(Request(partition.url, headers=headers), timeout=float(self.options.get("timeout", "30"))) as r:
            data = json.load(r)
        for x in walked(data, self.options.get("data_path", "")):
            yield (json.dumps(x, ensure_ascii=False),)


class ApiSource(DataSource):
    """spark.dataSource.register(ApiSource); spark.read.format("crm_api").option("urls", ...).option("data_path", "a.b").load()"""

    @classmethod
    def name(cls) -> str:
        return "crm_api"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> _ApiReader:
        return _ApiReader(self.options)


def walked(data: object, path: str) -> list:
    """What lies at a dotted path, as a list; nothing where the path leads nowhere."""
    for key in filter(None, path.split(".")):
        data = data.get(key, []) if isinstance(data, dict) else []
    return data if isinstance(data, list) else [data]
