"""The whole report reads its table twice, whatever computes the columns."""

from pyspark.sql import functions as F

from plumbline.plans.report import WindowReport
from plumbline.settings import Settings


def test_report_computes_its_columns_at_most_twice(spark):
    """The profile and the settled rows read the table; the passes of the drift checks do not."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def computed(number):
        read.add(1)
        return float(number * 7 % 101)

    n = 12 * 50
    days = spark.range(n).select("id", F.expr("date_add(date'2024-01-01', cast(id div 50 as int))").alias("w"))
    table = days.withColumn("age", computed("id"))
    found = WindowReport(table, "w", ["id"], Settings(numeric=("age",), categorical=(), rules=()))
    assert found.report().count() > 0 and found.candidates.count() >= 0
    assert read.value <= 2 * n


def test_report_takes_columns_without_a_type(spark):
    days = spark.range(60).selectExpr("id", "date_add(date'2024-01-01', cast(id div 5 as int)) AS w", "cast(id as double) AS age", "NULL AS nothing")
    found = WindowReport(days, "w", ["id"], Settings(numeric=("age", "nothing"), categorical=("nothing",), rules=()))
    assert found.counted_values.where("feature = 'age'").count() == 60 and found.counted_values.where("feature = 'nothing'").count() == 0
