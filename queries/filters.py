"""Each filter operator over the slot views of ``part`` and ``orders``."""

from __future__ import annotations

from datetime import datetime, timezone

from lodestone.functions.filters import compile_filter
from lodestone.sources.adapters import ORDER_FIELDS, PART_FIELDS, order_slots, part_slots
from queries.common import Query

PART_SQL = """WITH part_slots AS (
  SELECT p_partkey, p_name AS source_name, 'text/plain' AS mime_type, p_brand AS brand, p_retailprice AS price,
         p_size > 25 AS large, string_split(p_name, ' ') AS words FROM part)
SELECT p_partkey FROM part_slots WHERE """

ORDER_SQL = """WITH order_slots AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority, o_totalprice AS total,
         o_orderstatus = 'O' AS open, CAST(epoch(o_orderdate) AS BIGINT) AS ordered,
         CAST(epoch(o_orderdate) AS BIGINT) AS created_at FROM orders)
SELECT o_orderkey FROM order_slots WHERE """

# Relative dates are resolved against this moment.
NOW = datetime(1998, 3, 31, 15, 0, tzinfo=timezone.utc)


def _part(dsl, where: str) -> Query:
    return Query(
        lambda spark, sf: part_slots(spark, sf).where(compile_filter(dsl, PART_FIELDS)).select("p_partkey"),
        PART_SQL + where,
    )


def _order(dsl, where: str) -> Query:
    return Query(
        lambda spark, sf: order_slots(spark, sf).where(compile_filter(dsl, ORDER_FIELDS, NOW)).select("o_orderkey"),
        ORDER_SQL + where,
    )


QUERIES = {
    "filter_eq": _part({"brand": "Brand#13"}, "brand = 'Brand#13'"),
    "filter_eq_null": _order({"priority": None}, "priority = NULL"),
    "filter_ne": _order({"priority": {"$ne": "1-URGENT"}}, "priority <> '1-URGENT'"),
    "filter_gt": _part({"price": {"$gt": 990}}, "price > 990"),
    "filter_gte": _part({"price": {"$gte": 950.5}}, "price >= 950.5e0"),
    "filter_lt": _order({"total": {"$lt": 50000}}, "total < 50000"),
    "filter_lte": _order({"ordered": {"$lte": "1995-03-15"}}, "ordered <= epoch(TIMESTAMP '1995-03-15')"),
    "filter_in": _part({"brand": {"$in": ["Brand#1", "Brand#2", "Brand#17"]}}, "brand IN ('Brand#1', 'Brand#2', 'Brand#17')"),
    "filter_nin": _order(
        {"priority": {"$nin": ["1-URGENT", "5-LOW"]}}, "priority NOT IN ('1-URGENT', '5-LOW')"
    ),
    "filter_nin_null": _order({"priority": {"$nin": ["1-URGENT", None]}}, "priority NOT IN ('1-URGENT', NULL)"),
    "filter_exists": _order({"priority": {"$exists": True}}, "priority IS NOT NULL"),
    "filter_not_exists": _order({"priority": {"$exists": False}}, "priority IS NULL"),
    "filter_like": _part({"brand": {"$like": "Brand#1%"}}, "brand LIKE 'Brand#1%'"),
    "filter_like_timestamp": _order({"created_at": {"$like": "9%"}}, "CAST(created_at AS VARCHAR) LIKE '9%'"),
    "filter_ilike": _part({"source_name": {"$ilike": "%RING"}}, "source_name ILIKE '%RING'"),
    "filter_contains": _part({"words": {"$contains": "small"}}, "list_contains(words, 'small')"),
    "filter_contains_any": _part(
        {"words": {"$containsAny": ["red", "ring", "absent"]}}, "list_has_any(words, ['red', 'ring', 'absent'])"
    ),
    "filter_contains_all": _part({"words": {"$containsAll": ["red", "widget"]}}, "list_has_all(words, ['red', 'widget'])"),
    "filter_and": _part(
        {"$and": [{"large": True}, {"price": {"$lt": 1000}}]}, "large AND price < 1000"
    ),
    "filter_or": _part(
        {"$or": [{"brand": "Brand#3"}, {"words": {"$contains": "blue"}}]},
        "brand = 'Brand#3' OR list_contains(words, 'blue')",
    ),
    "filter_range": _order(
        {"total": {"$gte": 100000, "$lt": 200000}, "open": True}, "total >= 100000 AND total < 200000 AND open"
    ),
    "filter_bool_word": _part({"large": "no"}, "NOT large"),
    "filter_builtin": _part({"mime_type": "text/plain", "source_name": {"$ne": "small ring"}}, "mime_type = 'text/plain' AND source_name <> 'small ring'"),
    "filter_number_on_date": _order({"ordered": {"$gt": 852076800.9}}, "ordered > 852076800"),
    "filter_relative_date": _order(
        {"ordered": {"$gte": "last month"}}, "ordered >= epoch(TIMESTAMP '1998-03-03')"
    ),
    "filter_nested": _order(
        {"$or": [{"$and": [{"open": True}, {"priority": {"$in": ["1-URGENT"]}}]}, {"total": {"$gt": 400000}}]},
        "(open AND priority IN ('1-URGENT')) OR total > 400000",
    ),
}
