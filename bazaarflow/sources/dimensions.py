"""Service categories and areas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Category name and icon. The 'All ...' choices are filter parameters, not rows.
CATEGORIES = (
    ("Electrician", "zap"),
    ("Plumber", "wrench"),
    ("AC Repair", "snowflake"),
    ("Appliance", "plug"),
    ("Painting", "palette"),
    ("Carpentry", "hammer"),
    ("Acting Driver", "navigation"),
)

# Areas served.
AREAS = (
    "KK Nagar", "Srirangam", "Thillai Nagar", "Woraiyur", "Cantonment", "Puthur", "Tennur",
    "Crawford", "Karumandapam",
)


def dim_category(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CATEGORIES), "name string, icon string")


def dim_area(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(a,) for a in AREAS], "name string")
