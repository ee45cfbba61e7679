"""Resumable stages: a stage's result is a Parquet folder, and it runs again only when its inputs have changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

STATE_VERSION = 1


def run(spark: SparkSession, root: str, name: str, inputs: list[str], compute: Callable[[], DataFrame]) -> tuple[DataFrame, bool]:
    """(the stage's result, whether it ran). The order of ``inputs`` is of no account.

    The inputs are recorded after the result is written, so a stage that broke off runs again.
    """
    wanted = sorted(set(inputs))
    try:
        known = [(r.version, list(r.inputs)) for r in spark.read.schema("version int, inputs array<string>").json(f"{root}/{name}/state").collect()]
    except Exception as e:  # noqa: BLE001 - the stage has not run yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        known = []
    ran = known != [(STATE_VERSION, wanted)]
    if ran:
        compute().write.mode("overwrite").parquet(f"{root}/{name}/result")
        spark.createDataFrame([(STATE_VERSION, wanted)], "version int, inputs array<string>").coalesce(1).write.mode("overwrite").json(f"{root}/{name}/state")
    return spark.read.parquet(f"{root}/{name}/result"), ran
