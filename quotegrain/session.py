"""Session settings that the operators rely on."""

from pyspark.sql import SparkSession


def session(name: str = "quotegrain", **conf: str) -> SparkSession:
    """A session with UTC timestamps; ANSI mode stays on. Existing settings of a cluster win over none of ``conf``."""
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
