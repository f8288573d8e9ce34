"""The store of forecast cells under killed and repeated fills, result tables as CSV, and the audit of two runs."""

import pytest
from panelweft.functions.tables import new_path
from panelweft.operators import fusion
from panelweft.sources import ingest, store
from pyspark.sql import functions as F

KEYS, SHAPE = ["channel", "cell"], "channel string, cell int, yhat double"


@pytest.fixture
def required(spark):
    return spark.createDataFrame([(c, k) for c in ("a", "b") for k in range(20)], "channel string, cell int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_killed_fill_adds_nothing_and_a_repeated_one_no_rows(spark, required):
    path = new_path(spark, "store")
    asked = []

    @F.udf("double")
    def dies(cell):
        if cell > 15:
            raise RuntimeError("lost")
        return float(cell)

    with pytest.raises(Exception, match="lost"):
        store.fill(path, required, KEYS, SHAPE, lambda m: m.withColumn("yhat", dies("cell")))
    assert rows(store.stored(spark, path, SHAPE)) == []

    def compute(missing):
        asked.append(missing.count())
        return missing.where("cell <> 7").withColumn("yhat", F.col("cell") * 1.5)

    want = sorted([(c, k, None if k == 7 else k * 1.5) for c in ("a", "b") for k in range(20)], key=str)
    assert rows(store.fill(path, required, KEYS, SHAPE, compute)) == want
    assert rows(store.fill(path, required, KEYS, SHAPE, compute)) == want
    assert asked == [40]  # the second fill had nothing to do: a stored null is held
    more = required.unionByName(spark.createDataFrame([("a", 99), ("a", 99)], "channel string, cell int"))
    assert len(rows(store.fill(path, more, KEYS, SHAPE, compute))) == 41
    assert asked == [40, 1]
    assert [r["n_rows"] for r in store.batches(spark, path).orderBy("n_rows").collect()] == [1, 40]
    assert ingest.read_cells(store.stored(spark, path, SHAPE), required, KEYS).count() == 40
    with pytest.raises(KeyError):
        ingest.read_cells(store.stored(spark, path, SHAPE), required.withColumn("cell", F.col("cell") + 1), KEYS)


def test_rows_written_but_not_committed_are_not_read(spark, required):
    path = new_path(spark, "store")
    store.fill(path, required.where("cell < 3"), KEYS, SHAPE, lambda m: m.withColumn("yhat", F.lit(1.0)))
    required.withColumn("yhat", F.lit(9.0)).write.parquet(f"{path}/batches/killed-before-its-commit")
    assert store.stored(spark, path, SHAPE).count() == 6
    assert store.fill(path, required, KEYS, SHAPE, lambda m: m.withColumn("yhat", F.lit(2.0))).groupBy("yhat").count().orderBy("yhat").collect() == [(1.0, 6), (2.0, 34)]


def test_csv_results_carry_their_configuration(spark):
    path = new_path(spark, "csv")
    df = spark.createDataFrame([("naive", 4, 1.5), ("a, b", 8, None), ('say "x"', 13, -2.0)], "channel string, h int, mape double").repartition(3)
    store.write_csv(df, path, {"split": "test", "note": "a=b"})
    assert rows(ingest.read_csv(spark, path, "channel string, h int, mape double")) == rows(df)
    assert {r["name"]: r["value"] for r in store.read_config(spark, path).collect()} == {"split": "test", "note": "a=b"}


def test_audit_counts_what_one_run_lacks(spark):
    shape = "fold int, channel string, w double, source string, mode string"
    a = spark.createDataFrame([(1, "x", 0.5, "fold", "fold"), (1, "y", 0.5, "fold", "fold"), (2, "x", 1.0, "fold", "fold"), (3, "x", 1.0, "fold", "fold")], shape)
    b = spark.createDataFrame([(1, "x", 0.5, "fold", "fold"), (1, "y", 0.5, "fold", "fold"), (2, "x", 1.0, "regime", "regime"), (2, "y", 0.2, "regime", "regime")], shape)
    got = {r["fold"]: (round(r["largest_move"], 9), r["moved"], r["source_flipped"], r["mode_flipped"]) for r in fusion.config_audit(a, b, ["fold"]).collect()}
    assert got == {1: (0.0, False, False, False), 2: (0.2, True, True, True), 3: (1.0, True, True, True)}
