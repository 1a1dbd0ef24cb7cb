import glob
import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerline.operators import evolve
from ledgerline.sources.partitions import delete_from_partitions, update_partitions, write_partitioned

ROWS = [(1, "a", 10, "x"), (2, "a", 20, None), (3, "b", 10, "x y/z=%"), (4, None, 30, "x"), (5, "b", 30, "x"), (6, "c", None, "x")]
SCHEMA = "k int, s string, n int, part string"


@pytest.fixture
def stored(spark, tmp_path):
    df = spark.createDataFrame(ROWS, SCHEMA).withColumn("y", F.col("k") % 2)
    return df, write_partitioned(df, str(tmp_path / "t"), ["part", "y"])


def files(table):
    return {os.path.relpath(f, table.path) for f in glob.glob(f"{table.path}/*/*/*.parquet")}


def test_update_writes_matching_partitions_only(stored, rows):
    df, table = stored
    before = files(table)
    pred = F.col("n") == 10
    values = {"s": F.concat("s", F.lit("!")), "n": F.col("k") * 100}
    written = update_partitions(table, pred, values)
    assert rows(table.read()) == rows(evolve.apply_update(df, pred, values))
    changed = before - files(table)
    assert len(written) == 2 and {os.path.dirname(f) for f in changed} == {os.path.relpath(w.removeprefix("file:"), table.path) for w in written}
    # Again, without matching rows: nothing is written.
    now = files(table)
    assert update_partitions(table, F.col("n") == -1, values) == [] and files(table) == now
    with pytest.raises(ValueError):
        update_partitions(table, pred, {"PART": F.lit("x")})


def test_delete_removes_emptied_partitions(stored, rows):
    df, table = stored
    before = files(table)
    # Unknown for a null n, which stays; one partition with odd characters and the null one go whole.
    pred = (F.col("n") == 20) | (F.col("part") == "x y/z=%") | ((F.col("n") == 30) & (F.col("k") == 5))
    written = delete_from_partitions(table, pred)
    assert rows(table.read()) == rows(evolve.apply_delete(df, pred))
    assert [r[0] for r in rows(table.read())] == [1, 4, 6] and len(written) == 3
    left = {os.path.dirname(f) for f in files(table)}
    assert left == {"part=x/y=0", "part=x/y=1"}
    assert {f for f in before if "y=0" in f and "part=x/" in f} <= files(table)
    assert delete_from_partitions(table, pred) == []
    delete_from_partitions(table, F.lit(True))
    assert rows(table.read()) == []


def test_batch_steps_by_script(spark, rows):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, s string")

    def shout(batches):
        for batch in batches:
            loud = pa.array([None if v is None else v.upper() for v in batch["t"].to_pylist()])
            yield batch.set_column(batch.schema.get_field_index("t"), "t", loud)

    def count(frames):
        for frame in frames:
            yield frame.assign(size=frame["t"].str.len().astype("Int64")).drop(columns="K")

    item = {"object_type": "COLUMN", "db_name": "d", "table_name": "t", "object_property": "", "new_name": "", "object_comment": ""}
    changes = [
        {**item, "operation_type": "RENAME", "object_name": "s", "new_name": "t"},
        ("d", "t", "1/01-shout.py"),
        {**item, "operation_type": "RENAME", "object_name": "k", "new_name": "K2"},
        {**item, "operation_type": "RENAME", "object_name": "K2", "new_name": "K"},
        ("d", "t", "1/02-count.py"),
    ]
    steps = {"1/01-shout.py": evolve.BatchStep(shout, {"t": "string"}), "1/02-count.py": evolve.BatchStep(count, {"size": "long"}, ["k"], pandas=True)}
    after = evolve.replay_changes({("d", "t"): df}, changes, steps=steps).tables["d", "t"]
    assert after.columns == ["t", "size"] and rows(after) == [("A", 1), ("C", 1), (None, None)]
    empty = evolve.replay_changes({("d", "t"): df.limit(0)}, changes, steps=steps).tables["d", "t"]
    assert rows(empty) == []
    with pytest.raises(KeyError):
        evolve.replay_changes({("d", "t"): df}, [("d", "t", "absent.py")], steps=steps)


def test_errors_of_batch_steps_can_be_tolerated(spark, rows):
    df = spark.createDataFrame([(1,)], "k int")

    def broken(batches):
        raise ValueError("not clean")

    result = evolve.replay_changes({("d", "t"): df}, [("d", "t", evolve.BatchStep(broken))], tolerate_errors=True)
    assert rows(result.tables["d", "t"]) == [(1,)] and len(result.tolerated_errors) == 1
