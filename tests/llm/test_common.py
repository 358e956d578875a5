import os

import numpy as np
import pyarrow as pa
import pytest

from gleaner.llm import common


def test_scratch_tables_are_written_and_released(spark):
    df = spark.createDataFrame([(1, "a")], "id long, Tie string")
    first = common.folders()
    one, two = common.written(df), common.written(df)
    paths = [t.scratch.removeprefix("file://") for t in (one, two)]
    assert one.collect() == two.collect() == df.collect() and all(map(os.path.isdir, paths))
    common.discard(two)
    assert [os.path.isdir(p) for p in paths] == [True, False]
    common.release(spark, first)
    assert not any(map(os.path.isdir, paths))
    assert [common.fresh(df, n) for n in ("tie", "ID", "x")] == ["_tie", "_ID", "x"]


def test_a_cluster_needs_a_shared_folder():
    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint.dir"):
        common.scratch_dir(Session)


def test_ranges_split_frequent_ids(spark):
    rows = [(None, i) for i in range(300)] + [(7, i) for i in range(300)] + [(i, 0) for i in range(100, 200)]
    df = spark.createDataFrame(rows, "id long, k long").selectExpr("id", "xxhash64(k) AS tie")
    ranges = common.Ranges.over(df, "id", 14)
    got = df.toPandas().sort_values(["id", "tie"], na_position="first")
    block = ranges.of(pa.array([None if np.isnan(x) else int(x) for x in got.id], pa.int64()), pa.array(got.tie.to_numpy()))
    assert (np.diff(block) >= 0).all() and np.bincount(block).max() < 120
