from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from lodestone.functions.dates import parse_any_date, parse_relative_date, unix_seconds_of
from lodestone.functions.filters import FilterError, compile_filter, shortest_number

FIELDS = {
    "title": ("str", 1),
    "score": ("num", 1),
    "active": ("bool", 1),
    "published": ("date", 1),
    "tags": ("arr", 1),
}
NOW = datetime(2024, 3, 31, 12, tzinfo=timezone.utc)
ROWS = [
    (1, "it's", 1.0, True, 1704067200, ["a", None], 5, "u1"),
    (2, None, None, None, None, None, 6, "u2"),
    (3, "2024", 2.5, False, 1709424000, ["b", "c"], 7, None),
    (4, "1.234567e+06", -1.0, True, 0, [], 8, "u4"),
]
SCHEMA = (
    "id int, metadata_str_1 string, metadata_num_1 double, metadata_bool_1 boolean, metadata_date_1 bigint, "
    "metadata_arr_1 array<string>, created_at bigint, file_uri string"
)


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


def ids(rows, dsl):
    return sorted(r.id for r in rows.where(compile_filter(dsl, FIELDS, NOW)).collect())


@pytest.mark.parametrize(
    "dsl,expected",
    [
        ({"title": "it's"}, [1]),
        ({"title": "' OR 1=1 --"}, []),
        ({"title": 2024}, [3]),
        ({"title": 1234567}, [4]),
        ({"title": True}, []),
        ({"title": None}, []),
        ({"title": {"$ne": None}}, []),
        ({"score": {"$ne": 1}}, [3, 4]),
        ({"score": "2.5"}, [3]),
        ({"active": "YES"}, [1, 4]),
        ({"active": False}, [3]),
        ({"published": "2024-01-01"}, [1]),
        ({"published": {"$gte": "28 days ago"}}, [3]),
        ({"published": {"$gte": "last month"}}, [3]),
        ({"published": 0.9}, [4]),
        ({"tags": {"$contains": "z"}}, []),
        ({"tags": {"$contains": "a"}}, [1]),
        ({"tags": {"$containsAny": ["c", "z"]}}, [3]),
        ({"tags": {"$containsAll": ["b", "c"]}}, [3]),
        ({"tags": {"$containsAll": []}}, [1, 3, 4]),
        ({"tags": {"$exists": False}}, [2]),
        ({"created_at": {"$gt": 5, "$lt": 8}}, [2, 3]),
        ({"file_uri": {"$in": ["u1", None]}}, [1]),
        ({"file_uri": {"$nin": ["u1", None]}}, []),
        ({"$or": [{"title": "it's"}, {"score": {"$lt": 0}}]}, [1, 4]),
        ({"$and": [{"active": True}, {"$or": [{"score": 1}, {"score": 2}]}]}, [1]),
        ({"title": {"$ilike": "IT%"}, "active": True}, [1]),
        ('{"title": {"$like": "20__"}}', [3]),
    ],
)
def test_operators(rows, dsl, expected):
    assert ids(rows, dsl) == expected


@pytest.mark.parametrize("empty", [None, "", b"", {}, "{}"])
def test_nothing_to_filter(empty):
    assert compile_filter(empty, FIELDS) is None


@pytest.mark.parametrize(
    "dsl",
    [
        "null", "[1]", "{bad", {"other": 1}, {"title": {"$regex": "x"}}, {"$and": []}, {"$or": {"title": 1}},
        {"title": {"$in": "x"}}, {"title": {"$in": []}}, {"title": {"$exists": 1}}, {"score": {"$like": "x"}},
        {"score": "x"}, {"active": "maybe"}, {"published": "someday"}, {"tags": "a"}, {"title": {"$contains": "a"}},
        {"tags": {"$contains": 1}}, {"tags": {"$containsAny": "a"}}, {"created_at": {"$ilike": "x"}}, {"title": [1]},
        {"score": True}, {"active": 1},
    ],
)
def test_errors(spark, dsl):
    with pytest.raises(FilterError):
        compile_filter(dsl, FIELDS)


def test_filter_reaches_the_scan(spark, rows, tmp_path):
    rows.write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t")).where(compile_filter({"score": {"$gte": 1}}, FIELDS))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(metadata_num_1,1.0)" in plan


@pytest.mark.parametrize(
    "text,expected",
    [
        ("2024-01-02", 1704153600),
        ("2024/01/02", 1704153600),
        ("20240102", 1704153600),
        ("2024-01-02 03:04:05", 1704164645),
        ("2024-01-02T03:04:05Z", 1704164645),
        ("2024-01-02T03:04:05.678+02:00", 1704157445),
        ("1/2/2024", 1704153600),
        ("Tue, 02 Jan 2024 03:04:05 GMT", 1704164645),
        ("1704153600", 1704153600),
        ("1704153600123", 1704153600),
        ("2024-02-30", None),
        ("nonsense", None),
    ],
)
def test_dates_agree(spark, text, expected):
    assert parse_any_date(text) == expected
    assert spark.range(1).select(unix_seconds_of(F.lit(text)).alias("u")).first().u == expected


def test_relative_dates_roll_over():
    day = 86400
    march2 = int(datetime(2024, 3, 2, tzinfo=timezone.utc).timestamp())
    assert parse_relative_date("last month", NOW) == march2
    assert parse_relative_date("1 month ago", NOW) == march2
    assert parse_relative_date("today", NOW) - parse_relative_date("2 weeks ago", NOW) == 14 * day
    assert parse_relative_date("last year", datetime(2024, 2, 29, tzinfo=timezone.utc)) == int(
        datetime(2023, 3, 1, tzinfo=timezone.utc).timestamp()
    )
    assert parse_relative_date("soon", NOW) is None


def test_shortest_number():
    cases = {2024.0: "2024", 1e6: "1e+06", 1234567.0: "1.234567e+06", 0.0001: "0.0001", 0.00001: "1e-05", -0.5: "-0.5"}
    assert {x: shortest_number(x) for x in cases} == cases
