"""The annual report as data: summary cards and the monthly breakdown with bar lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from hitledger.functions import labels
from hitledger.plans.traffic import Traffic


def monthly_bars(monthly: DataFrame) -> DataFrame:
    """Scale each month to the busiest one; at most twelve rows."""
    busiest = F.max("n").over(Window.partitionBy())
    scale = F.when(busiest > 0, busiest).otherwise(1)
    return monthly.withColumn("bar_pct", F.bround(F.col("n") / scale * 100).cast("bigint"))


def yearly_report(traffic: Traffic, year: int, category: str) -> DataFrame:
    """``(section, label, value, bar_pct)`` rows: five cards, then one row per month."""
    card = {
        "Total Requests": F.col("total_requests").cast("string"),
        "Unique IPs": F.col("unique_ips").cast("string"),
        "Data Transferred": labels.byte_label(F.col("bytes_total")),
        "Errors": F.col("errors").cast("string"),
        "Avg Response Time": labels.response_time_label(F.col("avg_response_time_us")),
        "Category": labels.category_label(F.col("category")),
    }
    no_bar = F.lit(None).cast("bigint")
    cards = traffic.yearly_totals(year, category).select(F.inline(F.array(*(
        F.struct(F.lit("card").alias("section"), F.lit(label).alias("label"), value.alias("value"),
                 no_bar.alias("bar_pct")) for label, value in card.items()))))
    months = monthly_bars(traffic.monthly(year, category)).select(
        F.lit("month").alias("section"), F.col("month").alias("label"), F.col("n").cast("string").alias("value"), "bar_pct")
    return cards.unionByName(months)
