"""Session for local work. On a cluster the caller's session is used as it is."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(name: str = "placeloom", cpus: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    settings = {
        "spark.sql.shuffle.partitions": str(cpus if cpus != "*" else 8),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": memory,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    session = SparkSession.builder.master(f"local[{cpus}]").appName(name).config(map=settings).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session
