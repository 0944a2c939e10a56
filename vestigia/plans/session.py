"""Session defaults every query of the engine relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results rather than speed, so they are always applied.
SEMANTIC_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
}

#: Arrow batches to and from Python lie beside the heap and in the worker at once; by rows alone 10,000 texts or sets are one batch.
MEMORY_CONF = {"spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


def local_session(cpus: int = 8, memory: str = "8g", partitions: int | None = None) -> SparkSession:
    """A single-machine session for tests and benches; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("vestigia")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions or cpus))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in SEMANTIC_CONF.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def apply_semantics(spark: SparkSession) -> SparkSession:
    """Sets the result-relevant settings on a session that somebody else made."""
    for key, value in SEMANTIC_CONF.items():
        spark.conf.set(key, value)
    return spark


def apply_memory(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches by bytes, unless the session has a bound of its own."""
    for key, value in MEMORY_CONF.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)
    return spark
