"""Windows, sampling, orchestration and the streaming extension."""

from pyspark.sql import functions as F

from orbitframe.functions.constants import TrainConfig
from orbitframe.operators import metrics, registry
from orbitframe.plans import orchestrate
from orbitframe.sources import surrogate
from orbitframe.streaming import windows


def _months(spark, *series):
    return spark.createDataFrame([(i, list(m)) for i, m in enumerate(series)], "pos long, months array<int>")


def test_window_policies(spark):
    rows = registry.eligible(_months(spark, (0, 3, 6, 9, 12, 15), (0, 1, 2, 3, 4), (0, 20), tuple(range(0, 14, 2))))
    assert sorted(r["pos"] for r in rows.collect()) == [0, 3]
    assert registry.sliding_windows(rows).where("pos = 0").count() == 2
    even = {r["pos"]: list(r["window_months"]) for r in registry.even_windows(rows).collect()}
    assert even == {0: [0, 3, 6, 12, 15], 3: [0, 4, 6, 8, 12]}
    assert [list(r["window_months"]) for r in registry.first_windows(_months(spark, range(9))).collect()] == [[0, 1, 2, 3, 4]]


def test_epoch_sample(spark):
    rows = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") < 7).alias("has_change"))
    sample = registry.epoch_sample(rows, ("pos",), size=40).toPandas()
    assert sorted(sample["place"]) == list(range(40))
    assert sample["has_change"].sum() == 28 and sample[sample["has_change"]].groupby("pos").size().tolist() == [4] * 7
    assert registry.batches(spark.createDataFrame(sample[["place"]]), 16).count() == 32
    again = registry.epoch_sample(rows, ("pos",), size=40).toPandas()
    assert sample.sort_values("place")["pos"].tolist() == again.sort_values("place")["pos"].tolist()
    none = registry.epoch_sample(rows.withColumn("has_change", F.lit(False)), ("pos",), size=40)
    assert none.count() == 12


def test_splits():
    parts = registry.city_splits([f"c{i:02d}" for i in range(60)])
    assert [len(parts[k]) for k in ("train", "val", "test")] == [42, 9, 9]


def test_registry_cache(spark, tmp_path):
    rows = _months(spark, range(14))
    made = registry.sliding_windows(registry.eligible(rows))
    first = registry.cached(made, str(tmp_path), F.lit("a"))
    assert registry.cached(made.limit(0), str(tmp_path), F.lit("a")).count() == first.count() == 10
    assert registry.cached(made.limit(1), str(tmp_path), F.lit("b")).count() == 1


def test_scorer_and_history(spark):
    rows = spark.range(3).select(F.col("id").alias("k"))
    out = metrics.predict(rows, lambda pdf: pdf["k"].map(lambda v: [float(v), -float(v)]))
    assert {r["k"]: r["z"] for r in out.collect()} == {0: [0.0, -0.0], 1: [1.0, -1.0], 2: [2.0, -2.0]}
    history = spark.createDataFrame([("r", 1, 0.2), ("r", 2, 0.2), ("r", 3, 0.5)], "run string, epoch int, change_iou double")
    assert [r["is_best"] for r in metrics.best_so_far(history).orderBy("epoch").collect()] == [True, False, True]
    assert metrics.finite(spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (None,)], "loss double")).count() == 1
    assert TrainConfig().model_settings()["base"] == 32


def test_run_resume_and_clean_up(spark, tmp_path):
    calls = []

    def make(spark, city):
        calls.append(city)
        if city == "bad":
            raise ValueError("no scenes")
        return spark.range(3)

    steps = [orchestrate.Step(1, "one", make), orchestrate.Step(2, "two", make)]
    out = f"file://{tmp_path}/out"
    log = orchestrate.run_cities(spark, steps, ["bad", "good"], out)
    assert {(r["city"], r["step"]): r["status"] for r in log.collect()} == {("bad", 1): "failed", ("good", 1): "ok", ("good", 2): "ok"}
    orchestrate.run_cities(spark, steps, ["good"], out)
    assert calls == ["bad", "good", "good"]
    assert orchestrate.remaining_time(log, 4, 2).first()["n_ok"] == 1
    assert orchestrate.clean_up(spark, out, ["one"], ["good", "bad"], keep=("bad",)) > 0
    orchestrate.run_cities(spark, steps, ["good"], out, first=1, last=1)
    assert calls == ["bad", "good", "good", "good"]


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    rows = surrogate.series(spark, sf_dir).where("pos < 12")
    for part in range(3):
        rows.where(F.pmod(F.xxhash64("pos", "month_idx"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("pos long, month_idx int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = windows.streaming_windows(stream).writeStream.outputMode("append").format("memory").queryName("w").option("checkpointLocation", str(tmp_path / "cp")).start()
    query.processAllAvailable()
    query.stop()
    got = {(r["pos"], r["window_idx"]): r["window_months"] for r in windows.latest(spark.table("w")).collect()}
    want = registry.sliding_windows(registry.position_months(rows)).select("pos", "window_idx", F.array_join("window_months", ",").alias("m"))
    assert got == {(r["pos"], r["window_idx"]): r["m"] for r in want.collect()}


def test_parallel_cities_resume_by_counts(spark, tmp_path):
    seen = []

    def make(spark, city):
        seen.append(city)
        return spark.range(2 if city == "short" and seen.count("short") == 1 else 3)

    steps = [orchestrate.Step(1, "one", make)]
    out = f"file://{tmp_path}/out"
    cities = ["a", "b", "c", "short"]
    wanted = spark.createDataFrame([(c, 3) for c in cities], "city string, n_scenes long")
    first = orchestrate.run_cities(spark, steps, cities, out, workers=3, wanted=wanted)
    assert {r["status"] for r in first.collect()} == {"ok"} and sorted(seen) == cities
    again = {r["city"]: r["status"] for r in orchestrate.run_cities(spark, steps, cities, out, workers=3, wanted=wanted).collect()}
    assert again == {"a": "skipped", "b": "skipped", "c": "skipped", "short": "ok"}


STEPS = [orchestrate.Step(1, "one", lambda spark, city: spark.range(1 // (city != "bad"))), orchestrate.Step(2, "two", lambda spark, city: spark.range(2))]


def test_command_line(spark, tmp_path, caplog):
    from orbitframe import cli

    out = ["--out", f"file://{tmp_path}/out"]
    assert cli.main(["tests.test_windows:STEPS", *out, "--cities", "a", "b"], spark) == 0
    assert "[a] step 1 one: ok" in caplog.text or caplog.text == ""
    assert cli.main(["tests.test_windows:STEPS", *out, "--cities", "a", "bad", "--workers", "2"], spark) == 1
    assert cli.main(["tests.test_windows:STEPS", *out, "--cities"], spark) == 1
    assert cli.main(["tests.test_windows:STEPS", *out, "--cities", "a", "--first", "2", "--last", "1"], spark) == 2
    assert cli.main(["tests.test_windows:STEPS", *out, "--cities", "a", "--first", "7"], spark) == 2
    assert cli.main(["tests.test_windows:STEPS", *out, "--cities", "a", "--workers", "0"], spark) == 2
    assert cli.main(["tests.test_windows:STEPS", *out, "--raw", f"file://{tmp_path}/none"], spark) == 1


def test_last_epochs(spark):
    history = spark.createDataFrame([("r", e, 0.1) for e in range(5)] + [("s", 0, 0.2)], "run string, epoch int, loss double")
    got = sorted((r["run"], r["epoch"]) for r in metrics.last_epochs(history, 2).collect())
    assert got == [("r", 3), ("r", 4), ("s", 0)]
