"""The last success and the task row of each service, kept up to date from a stream of history rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerline.operators.ledger import SUCCESS, latest, ledger_latest, merged_states, outcome_state

Reducer = Callable[[DataFrame], DataFrame]
STATE_SCHEMA = "f_service_name string, f_version string, f_script_file_name string, f_create_time timestamp_ntz, f_id long"
STATE_COLUMNS = ["f_version", "f_script_file_name", "f_create_time", "f_id"]


def latest_stream(history: DataFrame) -> DataFrame:
    """Running result for update or complete mode; the state holds one row per service.

    It needs no watermark: a late row loses against the later one it meets.
    """
    success = history.filter(F.col("f_status") == SUCCESS)
    last = F.max_by(F.struct(*STATE_COLUMNS), F.struct("f_create_time", "f_id")).alias("last")
    return success.groupBy("f_service_name").agg(last).select("f_service_name", "last.*")


def _batches(spark: SparkSession, state_path: str) -> list[int]:
    """Numbers of the batches that are written to the end, in order."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/batch=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(status.getPath().getParent().getName().removeprefix("batch=")) for status in found)


def _remove_batches(spark: SparkSession, state_path: str, up_to: int) -> None:
    for batch in _batches(spark, state_path):
        if batch <= up_to:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{state_path}/batch={batch}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _latest_of_states(states: DataFrame) -> DataFrame:
    return latest(states, ["f_service_name"], ["f_create_time", "f_id"], STATE_COLUMNS)


def merge_into_state(state_path: str, of_batch: Reducer = ledger_latest, of_both: Reducer = _latest_of_states) -> Callable[[DataFrame, int], None]:
    """Batch function that merges a micro-batch into the state written by the one before.

    ``of_batch`` makes state of rows, ``of_both`` one state of two. Each batch writes
    its own folder, so a batch that runs again after a loss replaces its result with
    the same rows. Its predecessor stays for that case; older ones are removed.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark, state = batch.sparkSession, of_batch(batch)
        earlier = [b for b in _batches(spark, state_path) if b < batch_id]
        if earlier:
            state = of_both(state.unionByName(spark.read.parquet(f"{state_path}/batch={earlier[-1]}")))
        state.write.mode("overwrite").parquet(f"{state_path}/batch={batch_id}")
        if earlier:
            _remove_batches(spark, state_path, earlier[-1] - 1)

    return merge


def _run(rows: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint_path: str) -> StreamingQuery:
    """Take in all rows that have arrived and stop; a later call goes on from there."""
    return rows.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint_path).foreachBatch(merge).start()


def run_to_state(history: DataFrame, state_path: str, checkpoint_path: str) -> StreamingQuery:
    """The last success of each service from all history that has arrived."""
    return _run(history, merge_into_state(state_path), checkpoint_path)


def run_to_task_state(outcomes: DataFrame, state_path: str, checkpoint_path: str) -> StreamingQuery:
    """What task rows need to know of all outcomes that have arrived, late and repeated ones among them.

    The state has one row per service. It is a maximum over its successes by
    event time, not by arrival, so it does not matter which batch brings a row,
    nor how often. Task rows are made of it by :func:`~ledgerline.operators.ledger.task_after`.
    """
    return _run(outcomes, merge_into_state(state_path, outcome_state, merged_states), checkpoint_path)


def read_state(spark: SparkSession, state_path: str, query: StreamingQuery | None = None, schema: str = STATE_SCHEMA) -> DataFrame:
    """State after the last batch, of whichever run it was; ``query`` is waited for."""
    if query is not None:
        query.awaitTermination()
    written = _batches(spark, state_path)
    if not written:
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{state_path}/batch={written[-1]}")
