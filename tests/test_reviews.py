from pyspark.sql import functions as F

from codesift.operators import reviews

SCHEMA = "finding_id BIGINT, review_id STRING, agent STRING, file_path STRING, line_number INT, severity STRING, category STRING, description STRING, current_code STRING, suggested_fix STRING, confidence DOUBLE"


def findings(spark, *given):
    return spark.createDataFrame([(i, "r", a, "f", line, s, "c", d, None, None, 0.5) for i, a, line, s, d in given], SCHEMA)


def test_most_severe_per_line_and_ties(spark, rows):
    df = findings(spark, (1, "quality", 3, "LOW", "a"), (2, "security", 3, "high", "b"), (3, "quality", 3, "HIGH", "c"), (4, "quality", None, "LOW", "d"), (5, "quality", 0, "LOW", "e"))
    assert rows(reviews.most_severe_per_line(df, ["review_id", "file_path"], [reviews.rank_of(F.col("agent"), reviews.AGENTS), F.col("finding_id")]), "finding_id") == [(2,)]
    once = reviews.deduplicated(df, ["review_id", "file_path"], [F.col("finding_id")])
    assert rows(once) == [(2,), (4,), (5,)]
    again = reviews.deduplicated(df.join(once, "finding_id", "left_semi"), ["review_id", "file_path"], [F.col("finding_id")])
    assert rows(again) == rows(once)


def test_counts_are_zero_filled_and_add_up(spark):
    df = findings(spark, (1, "a", 1, "odd", "x"), (2, "a", 1, None, "x"), (3, "a", 2, "critical", "y")).withColumn("severity_name", reviews.severity_name(F.col("severity")))
    got = {r.severity: r.n for r in reviews.severity_counts(df, ["review_id"]).collect()}
    assert got == {"CRITICAL": 1, "HIGH": 0, "MEDIUM": 0, "LOW": 0, "INFO": 2}


def test_violations_and_empty(spark):
    df = findings(spark, (1, "a", -1, "HIGH", "long enough text"))
    assert reviews.violations(df).first()["errors"] == ["line_number"]
    assert reviews.violations(df.limit(0)).count() == 0


def test_equal_descriptions_apart_from_case(spark, rows):
    df = findings(spark, (1, "a", 1, "LOW", " Same "), (2, "a", 1, "LOW", "same"), (3, "a", 2, "LOW", "same"))
    assert rows(reviews.one_description_each(df, ["file_path", "line_number"], [F.col("finding_id")]), "finding_id") == [(1,), (3,)]
