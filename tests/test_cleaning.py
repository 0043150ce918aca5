import datetime as dt

import pytest
from pyspark.sql import functions as F

from ingestkit.functions.cleaning import Cleaner, clean_column
from ingestkit.functions.datetimes import parse_one, strftime
from ingestkit.functions.predicates import Predicates
from ingestkit.functions.regexes import java_pattern, java_replacement
from tests.conftest import plan_of


def cleaned(spark, value, **field):
    df = spark.createDataFrame([(value,)], "v string")
    return df.select(clean_column(F.col("v"), {"name": "v", **field}).alias("v")).first()[0]


CASES = [
    ("  hello  ", {}, "hello"),
    ("  hello  ", {"strip": False}, "  hello  "),
    ("　a\tb ", {}, "a\tb"),
    ("123", {"to_number": True, "type": "INTEGER"}, 123),
    ("12,345", {"to_number": True, "type": "INTEGER"}, 12345),
    ("1，2345", {"to_number": True, "type": "INTEGER"}, 12345),
    ("3.14", {"to_number": True, "type": "REAL"}, 3.14),
    ("3.0", {"to_number": True, "type": "INTEGER"}, 3),
    ("3.5", {"to_number": True, "type": "INTEGER"}, None),
    ("1_000", {"to_number": True, "type": "INTEGER"}, 1000),
    ("_1", {"to_number": True, "type": "INTEGER"}, None),
    ("NaN", {"to_number": True, "type": "REAL"}, None),
    ("1.5d", {"to_number": True, "type": "REAL"}, None),
    ("1,000", {"type": "INTEGER"}, None),
    (" 42 ", {"type": "INTEGER"}, 42),
    ("42.0", {"type": "INTEGER"}, 42),
    ("1e3", {"type": "REAL"}, 1000.0),
    ("1e3", {"to_number": True, "type": "INTEGER"}, 1000),
    ("9,223,372,036,854,775,808", {"to_number": True, "type": "INTEGER"}, None),
    ("1_0.5", {"to_number": True, "type": "REAL"}, 10.5),
    ("１２．", {"to_number": True, "type": "REAL"}, None),
    ("abc", {"to_number": True}, "abc"),
    ("007", {"to_number": True}, "7"),
    ("12,345", {"to_number": False}, "12,345"),
    ("abcdefgh", {"truncate_left": 3}, "abc"),
    ("abcdefgh", {"truncate_right": 2}, "abcdef"),
    ("ab", {"truncate_right": 2}, "ab"),
    ("ab", {"truncate_left": 0}, "ab"),
    ("<p>Hello &amp; World</p>", {"remove_html": True}, "Hello & World"),
    ("&amp;lt; &copy; &#233; AT&T", {"remove_html": True}, "&lt; © é AT&T"),
    ("hello   world", {"trim_whitespace": True}, "hello world"),
    ("a　\n b", {"trim_whitespace": True}, "a b"),
    ("Phone: 13812345678", {"regex_extract": r"(\d{11})"}, "13812345678"),
    ("Phone", {"regex_extract": r"(\d{11})"}, ""),
    ("Phone", {"regex_extract": r"(\d{11})", "default": "none"}, "none"),
    ("ab12", {"regex_extract": r"\d+"}, "12"),
    ("k=v", {"regex_extract": r"(?P<a_key>\w)=(?P<val>\w)", "group": 2}, "v"),
    ("b", {"regex_extract": r"(a)?b"}, ""),
    ("hello WORLD", {"regex_replace": [{"pattern": "WORLD", "replacement": "world"}]}, "hello world"),
    ("ab", {"regex_replace": [{"pattern": "(a)(b)", "replacement": r"\2$\g<1>1"}]}, "b$a1"),
    (None, {"default": "N/A"}, "N/A"),
    (None, {}, None),
    ("1234", {"number_expr_to_int": True, "type": "INTEGER"}, 1234),
    ("1234.56万", {"number_expr_to_int": True, "type": "INTEGER"}, 12345600),
    ("5.67亿", {"number_expr_to_int": True, "type": "INTEGER"}, 567000000),
    ("0.29百", {"number_expr_to_int": True, "type": "INTEGER"}, 28),
    ("1.2万人", {"number_expr_to_int": True, "type": "INTEGER"}, 1),
    ("1,234万", {"number_expr_to_int": True, "type": "INTEGER"}, 1),
    ("-5万", {"number_expr_to_int": True, "type": "INTEGER"}, None),
    ("2026-07-18", {"to_datetime": True}, "2026-07-18 00:00:00"),
    ("2026-7-8 1:2:3", {"to_datetime": True}, "2026-07-08 01:02:03"),
    ("2026-07-18T10:00:00+08:00", {"to_datetime": True}, "2026-07-18 10:00:00"),
    ("July 2026", {"to_datetime": True, "date_output_format": "%Y-%m-%d"}, "2026-07-01"),
    ("2026年8月2日", {"to_datetime": True, "date_format": "%Y年%-m月%-d日", "date_output_format": "%Y-%m-%d"}, "2026-08-02"),
    ("2026-02-30", {"to_datetime": True}, "2026-02-30"),
    ("1664583945000", {"to_number": True, "ts_floor_to_hour": True, "type": "INTEGER"}, 1664582400000),
    ("1664583945000", {"to_number": True, "ts_floor_to_day": True, "type": "INTEGER"}, 1664582400000 // 86400000 * 86400000),
    ("-1", {"to_number": True, "ts_floor_to_day": True, "type": "INTEGER"}, -86400000),
    ("x", {"clean": {"truncate_left": 1}}, "x"),
]


@pytest.mark.parametrize("value,field,expected", CASES)
def test_rule(spark, value, field, expected):
    assert cleaned(spark, value, **field) == expected


def test_rules_run_in_registered_order(spark):
    # strip comes before truncation, whatever the order in the config
    assert cleaned(spark, "  abcd ", truncate_left=2, strip=True) == "ab"


@pytest.mark.parametrize("field", [
    {"to_number": True, "to_datetime": True}, {"ts_floor_to_hour": True}, {"ts_floor_to_day": True, "type": "TEXT"}])
def test_contradicting_rules_are_refused(field):
    with pytest.raises(ValueError):
        Cleaner().validate({"name": "f", **field})


FORMATS = ["%Y-%m-%d %H:%M:%S", "%d/%b/%Y", "%B %d, %Y", "%I:%M %p %d.%m.%y", "%Y%j", "%A %d %B %Y", "%Y-%m-%dT%H:%M:%S.%f", "100%% %Y"]
TEXTS = ["2024-02-29 23:59:59", "2023-02-29 00:00:00", "07/Mar/2021", "march 7, 2021", "12:05 am 01.02.68", "1:05 PM 31.12.69",
         "2024366", "Friday 01 March 2024", "2024-01-02T03:04:05.6", "100% 1999", "", "2024-1-1 1:1:61"]


@pytest.mark.parametrize("fmt", FORMATS)
def test_parse_matches_strptime(spark, fmt):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    got = [r[0] for r in df.select(parse_one(F.col("t"), fmt)).collect()]
    want = []
    for t in TEXTS:
        try:
            want.append(dt.datetime.strptime(t, fmt))
        except ValueError:
            want.append(None)
    assert got == want


@pytest.mark.parametrize("fmt", ["%Y-%m-%d", "it's %H'%M %% %d", "%-m/%-d %y %j", "%u %w %V %e|%a %B", "plain", "年%Y月%m", "%I %p %f %T"])
def test_output_matches_strftime(spark, fmt):
    for moment in (dt.datetime(2024, 2, 29, 0, 5, 9, 120), dt.datetime(2026, 8, 2, 13, 30)):
        got = spark.range(1).select(strftime(F.lit(str(moment)).cast("timestamp_ntz"), fmt)).first()[0]
        assert got == moment.strftime(fmt)


def test_regex_translation():
    assert java_pattern(r"(?P<a_b>x)(?P=a_b)\Z") == r"(?Ud)(?<ab>x)\k<ab>\z"
    assert java_replacement(r"\1-\g<n>\\$", r"(?P<n>x)") == r"$1-$1\\\$"


def test_bad_cells_are_reported(spark):
    df = spark.createDataFrame([("1", "a"), ("x", "b"), (None, "c")], "n string, t string")
    fields = [{"name": "n", "type": "INTEGER", "to_number": True}, {"name": "t"}]
    out = Cleaner().clean(df, fields, "collect").collect()
    assert [(r.n, r._errors) for r in out] == [(1, []), (None, ["n"]), (None, [])]
    with pytest.raises(Exception, match="cannot convert x"):
        Cleaner().clean(df, fields, "fail").collect()


WHERE = [
    (">", 50, [100]), ("<", 50, [10]), (">=", 100, [100]), ("<=", 10, [10]), ("==", 10, [10]), ("!=", 10, [100, None]),
    ("in", [10, 7], [10]), ("in", [None, 10], [10, None]), ("not_in", [10], [100, None]), ("==", None, [None]),
    ("no such", 1, [10, 100, None]), (">", "text", []), (">", None, []),
]


@pytest.mark.parametrize("op,value,expected", WHERE)
def test_predicate(spark, op, value, expected):
    df = spark.createDataFrame([(10,), (100,), (None,)], "v long")
    got = [r.v for r in Predicates().keep(df, [{"name": "v", "where": {"op": op, "value": value}}]).collect()]
    assert got == expected


def test_predicate_default_operator_and_contains(spark):
    df = spark.createDataFrame([("hello world",), ("hello",), (None,)], "v string")
    keep = Predicates().keep
    assert keep(df, [{"name": "v", "where": {"value": "hello"}}]).count() == 1
    assert keep(df, [{"name": "v", "where": {"op": "contains", "value": "world"}}]).count() == 1


def test_batch_with_where(spark):
    df = spark.createDataFrame([("3",), ("8",), ("4",)], "v string")
    fields = [{"name": "v", "type": "INTEGER", "to_number": True, "where": {"op": ">", "value": 5}}]
    assert [r.v for r in Predicates().keep(Cleaner().clean(df, fields), fields).collect()] == [8]


def test_cleaning_stays_in_the_jvm(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    fields = [{"name": "text", "trim_whitespace": True, "regex_replace": [{"pattern": "a", "replacement": "b"}],
               "remove_html": "common"}]
    plan = plan_of(Cleaner().clean(df, fields, keep=["doc_id"]))
    assert "Python" not in plan and "Exchange" not in plan and "lang" not in plan


def test_predicates_decide_by_kind(spark):
    from ingestkit.functions.predicates import Predicates

    df = spark.createDataFrame([("1", 1, True), ("a", 2, False), (None, None, None)], "t string, n int, b boolean")

    def kept(name, op, value):
        return [r[0] for r in Predicates().keep(df, [{"name": name, "where": {"op": op, "value": value}}]).select(name).collect()]

    assert kept("t", "==", 1) == [] and kept("t", "!=", 1) == ["1", "a", None]
    assert kept("n", "==", "1") == [] and kept("n", "!=", "x") == [1, 2, None] and kept("n", "==", 1.0) == [1]
    assert kept("t", "in", [1, "a", None]) == ["a", None] and kept("t", "not_in", [1, "a"]) == ["1", None]
    assert kept("n", "in", ["2", 1]) == [1] and kept("n", "not_in", ["x"]) == [1, 2, None]
    assert kept("n", ">", "0") == [] and kept("b", "==", 1) == [] and kept("b", "==", True) == [True]
