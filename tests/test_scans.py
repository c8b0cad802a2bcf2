"""Running values over spread keys against loops, states of jobs in batches and in streams, and small fixed values."""

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilspark.functions import validators as v
from veilspark.operators import detect as d
from veilspark.operators import reports as r
from veilspark.operators.scans import bounds_of, bucket, peaks, running


@pytest.mark.parametrize("buckets", [1, 2, 7, 40])
def test_running(spark, buckets):
    g = random.Random(buckets)
    rows = [(g.choice(["hot"] * 6 + ["a", "b", None]), g.choice([None, *range(40)]), i, g.choice([None, g.randint(-9, 9)]), g.choice([None, "x", "y"])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, at long, i long, n long, s string").repartition(5)
    got = running(df, ["k"], F.col("at"), ["i"], {"sum_n": ("sum", F.col("n")), "before": ("sum_before", F.col("n")), "top": ("max", F.col("n")), "old_top": ("max_before", F.col("n")), "last": ("previous", F.col("s"))}, buckets)
    want, state = [], {}
    for row in sorted(rows, key=lambda x: (x[1] is not None, x[1], x[2])):
        k, _, _, n, s = row
        total, top, last = state.get(k, (None, None, None))
        new_total = total if n is None else n + (total or 0)
        new_top = top if n is None else n if top is None else max(n, top)
        want.append((*row, new_total, total, new_top, top, last))
        state[k] = (new_total, new_top, s)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_a_hot_key_is_many_tasks(spark):
    rows = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 500).alias("k"), F.col("id").alias("at"))
    bounds = bounds_of(rows, F.col("at"), 30)
    sizes = [x["count"] for x in rows.where("k = -1").groupBy(bucket(F.col("at"), bounds)).count().collect()]
    assert len(sizes) == 30 and max(sizes) < 2 * 10_000 / 30
    assert running(rows, ["k"], F.col("at"), [], {"n": ("sum", F.lit(1))}, 30).groupBy("k").agg(F.max("n").alias("n")).where("k = -1").first().n == 10_000


def test_peaks_and_islands_of_nothing(spark):
    df = spark.createDataFrame([], "k string, start_ms long, end_ms long")
    assert peaks(df, ["k"], F.col("start_ms"), [], F.col("end_ms")).collect() == []
    assert r.consolidated(df, ["k"], buckets=4).collect() == []


def test_islands_do_not_depend_on_buckets(spark):
    g = random.Random(5)
    rows = [(g.choice("aab"), s := g.randrange(0, 100_000), s + g.choice([10, 100, 900])) for _ in range(500)]
    df = spark.createDataFrame(rows, "k string, start_ms long, end_ms long")
    one, many = (sorted(map(tuple, r.consolidated(df, ["k"], 100, b).collect())) for b in (1, 13))
    assert one == many and len(one) > 3


def test_edges(spark):
    runs = {"ok": "UPLOADED ANALYZING AWAITING_REVIEW PROCESSING COMPLETED", "retry": "UPLOADED PROCESSING INTERRUPTED UPLOADED INSPECTING AWAITING_CONFIRMATION PROCESSING FAILED", "again": "UPLOADED UPLOADED PROCESSING ANALYZING AWAITING_REVIEW CANCELLED", "skip": "UPLOADED COMPLETED", "late": "UPLOADED PROCESSING COMPLETED CANCELLED", "begin": "PROCESSING COMPLETED", "odd": "UPLOADED LOST", "wait": "UPLOADED ANALYZING AWAITING_REVIEW INTERRUPTED CANCELLED"}
    df = spark.createDataFrame([(j, i, s) for j, x in runs.items() for i, s in enumerate(x.split())], "job string, at long, status string")
    for buckets in (1, 5):
        got = r.illegal_changes(r.status_changes(df, "job", "at", "status", "status", buckets), "status").collect()
        assert sorted((g.job, g.previous, g.status) for g in got) == [("begin", None, "PROCESSING"), ("late", "COMPLETED", "CANCELLED"), ("odd", "UPLOADED", "LOST"), ("skip", "UPLOADED", "COMPLETED"), ("wait", "AWAITING_REVIEW", "INTERRUPTED"), ("wait", "INTERRUPTED", "CANCELLED")]


def test_followed_jobs(spark, tmp_path):
    from veilspark.streaming.jobs import followed

    t = datetime(2024, 1, 1, tzinfo=UTC)
    batches = [
        [("a", 0, 0, "UPLOADED"), ("a", 1, 0, "PROCESSING"), ("b", 0, 0, "UPLOADED"), ("c", 0, 0, "PROCESSING")],
        [("a", 5, 0, "COMPLETED"), ("b", 1, 0, "COMPLETED"), ("d", 60, 0, "UPLOADED")],
        [("c", 61, 1, "UPLOADED"), ("c", 61, 0, "COMPLETED"), ("e", 90, 0, "UPLOADED")],
        [("e", 91, 0, "CANCELLED"), ("a", 3, 0, "FAILED")],
    ]
    shape = "job string, at timestamp, n int, status string"
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for i, batch in enumerate(batches):
        spark.createDataFrame([(j, t + timedelta(minutes=m), n, s) for j, m, n, s in batch], shape).coalesce(1).write.mode("append").parquet(src)
        stream = followed(spark.readStream.schema(shape).parquet(src), silence=600_000, lateness="1 minute")
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(90)  # a restart for each batch
        assert i >= 0
    got = {(x.job, x.previous, x.status, x.problem) for x in spark.read.parquet(out).collect()}
    assert ("b", "UPLOADED", "COMPLETED", "illegal") in got and ("c", None, "PROCESSING", "illegal") in got
    assert ("c", "PROCESSING", "INTERRUPTED", "silent") in got and ("c", "INTERRUPTED", "COMPLETED", "illegal") in got
    assert ("d", "UPLOADED", "INTERRUPTED", "silent") in got and not [x for x in got if x[0] in "ae" and x[3] != "late"]


def test_small_values(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(r.spoken_digits(F.lit("138·0013·8000 一、二 3 , 4"))) == "138001380001、234"
    for text, good in (("30.1\t120.5", True), (" 30.1, 120.5 ", True), ("30.1,120.5,", False), ("91 20", True), ("91 120", False), ("190 91", False)):
        assert one(v.coordinates(F.lit(text))) is good, text
    assert one(v.imei(F.lit("0" * 15))) is False and one(v.imei(F.lit("490154203237518"))) is True
    jobs = spark.createDataFrame([(1, 5), (2, 5), (3, 4)], "id int, at int")
    assert [x.id for x in r.newest(jobs, "at", "id", 2).collect()] == [2, 1] and [x.id for x in r.oldest_first(jobs, "at", "id").collect()] == [3, 1, 2]
    reports = spark.createDataFrame([(1, 2, 3, {"A": 1}, ["late", "z"]), (1, 1, 4, {"A": 2, "B": 1}, ["z", " ", "a"]), (2, 1, 1, {}, [])], "job int, part int, units int, counts map<string,int>, warnings array<string>")
    got = {x.job: x for x in r.merged_counts(reports, "job", order="part").collect()}
    assert (got[1].units, got[1].warnings, got[1].counts, got[2].warnings) == (7, ["z", "a", "late"], {"A": 3, "B": 1}, [])
    assert reports.agg(r.saturated_total(F.lit(2**31 - 1))).first()[0] == 2**31 - 1


def test_words_for_what_is_gone_are_no_residual(spark):
    from veilspark.plans.rules import Rule, RuleSet

    rules = RuleSet(rules=(Rule("W", "custom", 5, r"[\p{IsHan}A-Za-z＊]+"),))
    df = spark.createDataFrame([(1, "已脱敏 Redacted ＊＊ left")], "doc_id int, redacted string")
    assert [x.value for x in d.residual(df, rules).collect()] == ["left"]
