"""Session construction and lineage cutting."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "lorefold", **conf: str) -> SparkSession:
    """A session with UTC time, AQE with skew handling and Arrow transfer.

    ``conf`` entries use ``__`` in place of dots, e.g. ``spark__ui__enabled="false"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    base.update({k.replace("__", "."): v for k, v in conf.items()})
    for key, value in base.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Uses the cluster's ``spark.checkpoint.dir``; only a local session without one gets a folder of its own."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    if not named and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that all executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lorefold-checkpoint-"))


def cut(df: DataFrame) -> DataFrame:
    """Writes ``df`` to the shared checkpoint folder and goes on from there.

    A reliable checkpoint: it outlives the loss of any executor and ends the lineage.
    A checkpointed frame keeps the size the optimizer estimated for it, and a
    join's estimate is the product of its sides': in loops it soon has millions
    of digits. So the checkpointed rows are taken up without an estimate.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    rows = spark._jsparkSession.internalCreateDataFrame(kept._jdf.queryExecution().toRdd(), kept._jdf.schema(), False)
    return DataFrame(rows, spark)
