"""Train/test splits."""

from __future__ import annotations

from ..operators.split import ordered_split, random_split
from .base import query, table


def ordered_sql(size: str) -> str:
    return f"""SELECT o_orderkey, CASE WHEN r <= {size} THEN 'train' ELSE 'test' END AS part
FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS r, count(*) OVER () AS n FROM orders)"""


@query("t01_ordered_split_floor", ordered_sql("floor(n * 0.7)"))
def t01(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ordered_split(orders, ["o_orderdate", "o_orderkey"], 0.7, "floor").drop("o_orderdate")


@query("t02_ordered_split_ceil", ordered_sql("ceil(n * 0.333)"))
def t02(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    return ordered_split(orders, ["o_orderdate", "o_orderkey"], 0.333, "ceil").drop("o_orderdate")


@query(
    "t03_random_split",
    """SELECT o_orderkey, CASE WHEN r <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS part
FROM (SELECT o_orderkey, count(*) OVER () AS n,
             row_number() OVER (ORDER BY substr(md5('42:' || o_orderkey), 1, 15), o_orderkey) AS r FROM orders)""",
)
def t03(spark, sf):
    return random_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", 0.2, 42)
