"""A session with the settings the library is tested with; any Spark session will do."""

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **settings: str) -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | settings
    return SparkSession.builder.master(master).config(map=conf).getOrCreate()
