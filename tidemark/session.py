"""Session settings that every operator counts on."""

from pyspark.sql import SparkSession


def builder(app: str = "tidemark") -> SparkSession.Builder:
    """UTC, ANSI SQL, adaptive plans with skew handling; the rest is the cluster's."""
    return (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
