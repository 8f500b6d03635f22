"""Session settings for local runs; on a cluster use its own session."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(
    cpus: int | str = "*", memory: str = "8g", checkpoint_dir: str | None = None
) -> SparkSession:
    """A session on this machine, bound to the loopback address, without UI."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("termscan")
        .config("spark.driver.memory", memory)
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    if checkpoint_dir is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoint_dir)
    return builder.getOrCreate()
