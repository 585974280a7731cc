"""Time expressions."""

from pyspark.sql import functions as F

from loredeck.functions.temporal import issue_dates, only_recent, ranges, without_times

CASES = [
    ("2025년 4분기", [("2025-10-01", "2025-12-31", 1.0)]), ("Q1 2026 결과", [("2026-01-01", "2026-03-31", 1.0)]), ("2026년 Q3", [("2026-07-01", "2026-09-30", 1.0)]),
    ("2분기", [("2026-04-01", "2026-06-30", 0.9)]), ("q4", [("2026-10-01", "2026-12-31", 0.9)]), ("12분기", []), ("3월 둘째 주", [("2026-03-09", "2026-03-15", 0.85)]),
    ("3월 2째 주", [("2026-03-09", "2026-03-15", 0.85)]), ("3월 마지막째 주", [("2026-03-30", "2026-04-05", 0.85)]), ("2월 회의", [("2026-02-01", "2026-02-28", 0.8)]),
    ("최근 7일", [("2026-04-09", "2026-04-15", 0.8)]), ("최근 삼 개월", [("2026-01-16", "2026-04-15", 0.8)]), ("최근 한달", [("2026-03-17", "2026-04-15", 0.8)]),
    ("최근 일 일", [("2026-04-15", "2026-04-15", 0.8)]), ("최근 이주일", [("2026-04-02", "2026-04-15", 0.8)]), ("지난 주", [("2026-04-06", "2026-04-12", 0.9)]), ("지난달", [("2026-03-01", "2026-03-31", 0.9)]),
    ("이번 달", [("2026-04-01", "2026-04-30", 0.9)]), ("어제와 오늘", [("2026-04-14", "2026-04-14", 1.0), ("2026-04-15", "2026-04-15", 1.0)]), ("", []), (None, []), ("3월 5일", []),
    ("2025년 1분기와 3분기", [("2025-01-01", "2025-03-31", 1.0), ("2026-07-01", "2026-09-30", 0.9)]),
]


def test_ranges(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "i int, t string")
    rows = df.select("i", ranges(F.col("t"), F.lit("2026-04-15").cast("date")).alias("r")).collect()
    for r in rows:
        assert [(str(x.start), str(x.end), x.confidence) for x in r.r] == CASES[r.i][1], CASES[r.i]


def test_last_month_of_january_is_december(spark):
    r = spark.sql("select '지난달' t").select(F.explode(ranges(F.col("t"), F.lit("2026-01-31").cast("date"))).alias("r")).first().r
    assert str(r.start) == "2025-12-01" and r.label == "지난달"


def test_recent_alone(spark):
    df = spark.createDataFrame([(1, "지난 주"), (2, "최근 문서"), (3, None), (4, "최근 3일"), (5, "최근 문서 이번 주")], "id int, t string")
    assert [r.o for r in df.select("id", only_recent(F.col("t")).alias("o")).orderBy("id").collect()] == [False, True, None, False, False]


def test_segments_that_name_times_are_put_aside(spark):
    kept, gone = without_times(F.split("p", "/"))
    r = spark.sql("select '패치노트/이번 달/카제나/최근 3일/2월' p").select(kept.alias("k"), gone.alias("g")).first()
    assert r.k == ["패치노트", "카제나"] and r.g == ["이번 달", "최근 3일", "2월"]


def test_issue_dates(spark):
    cases = {
        "2026-4-7 이후 수정된 이슈": 'updated >= "2026-04-07"', "4월 27일 등록": 'created >= "2026-04-27"', "최근 2주 버그": 'created >= "-2w"', "3일 전 변경": 'updated >= "-3d"',
        "최근 2개월": "created >= startOfMonth(-2)", "지난주 이슈": "created >= startOfWeek(-1)", "올해 이슈": "created >= startOfYear()", "이슈": None, "": None,
    }
    df = spark.createDataFrame(list(cases.items()), "q string, want string")
    for r in df.select("q", "want", issue_dates(F.col("q"), F.lit("2026-04-15").cast("date")).alias("got")).collect():
        assert r.got == r.want, r
