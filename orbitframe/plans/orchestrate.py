"""Steps per city: what is left to do, isolated runs, a log, progress, clean-up.

A pipeline is a list of named functions from (spark, inputs, city filter) to a
frame. Work that is done is found in the output tables by an anti-join, so a
rerun resumes; a city that fails leaves an error row and the others go on.
"""

from __future__ import annotations

import logging
import time
import traceback
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orbitframe.functions import pixel as P

LOG = "city string, step int, step_name string, status string, error string, seconds double, ts timestamp"


@dataclass(frozen=True)
class Step:
    """``run(spark, city)`` makes the step's output for one city."""

    number: int
    name: str
    run: Callable[[SparkSession, str], DataFrame]


def pending(wanted: DataFrame, outputs: DataFrame, steps: int) -> DataFrame:
    """``city, step`` without at least as many outputs as the city has scenes."""
    todo = wanted.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    have = outputs.select(F.col("city").alias("_c"), F.col("step").alias("_s"), "n_out")
    full = (F.col("city") == F.col("_c")) & (F.col("step") == F.col("_s")) & (F.col("n_out") >= F.col("n_scenes"))
    return todo.join(have, full, "left_anti").select("city", "step")


def progress(log: DataFrame) -> DataFrame:
    """Per city: steps run and done, outputs, share done, time taken as ``m:ss``."""
    done = F.count_if(F.col("status") == "ok")
    return log.groupBy("city").agg(
        F.count("*").alias("n_steps"), done.alias("n_done"), F.sum("n_out").alias("n_out"), (100.0 * done / F.count("*")).alias("pct_done"), P.clock(F.sum("seconds")).alias("took")
    )


def remaining_time(log: DataFrame, cities: int, workers: int) -> DataFrame:
    """Mean time of a finished city and what is left at that pace."""
    per_city = log.groupBy("city").agg(F.sum("seconds").alias("seconds"), F.bool_and(F.col("status") == "ok").alias("ok"))
    left = F.greatest(F.lit(cities) - F.count("*"), F.lit(0))
    return per_city.agg(
        F.count("*").alias("n_cities"), F.count_if("ok").alias("n_ok"), F.avg("seconds").alias("mean_seconds"), (F.avg("seconds") * F.ceil(left / float(workers))).alias("eta_seconds")
    )


class CityLog(logging.LoggerAdapter):
    """Messages with the city in front."""

    def __init__(self, city: str, to: str = "orbitframe"):
        super().__init__(logging.getLogger(to), {})
        self._city = city

    def process(self, msg, kwargs):
        return f"[{self._city}] {msg}", kwargs


def outputs_of(spark: SparkSession, steps: list[Step], out_dir: str) -> DataFrame:
    """``city, step, n_out``: rows that each step has written for each city; folders without a finish mark count for nothing."""
    parts = []
    for step in steps:
        at = f"{out_dir}/{step.name}"
        done = [p for p in _children(spark, at) if _stands(spark, p)]
        if done:
            city = F.regexp_extract(F.col("_metadata.file_path"), r"/city=([^/]+)/[^/]*$", 1)
            parts.append(spark.read.parquet(*done).groupBy(city.alias("city")).agg(F.count("*").alias("n_out")).withColumn("step", F.lit(step.number)))
    out = spark.createDataFrame([], "city string, step int, n_out long")
    for part in parts:
        out = out.unionByName(part)
    return out


def run_cities(
    spark: SparkSession, steps: list[Step], cities: list[str], out_dir: str, first: int = 1, last: int | None = None, workers: int = 1, wanted: DataFrame | None = None
) -> DataFrame:
    """Runs the steps of each city into ``out_dir/step/city=...`` and returns the log.

    ``workers`` cities run side by side as jobs of one session; the steps of a
    city follow one another. A step whose output stands is skipped; with
    ``wanted`` (``city, n_scenes``) it must also hold a row for every scene
    (``pending``). A failure ends its city only. Step numbers beyond the range
    and fewer than one worker are refused.
    """
    last = last if last is not None else max(s.number for s in steps)
    if not 1 <= first <= last <= max(s.number for s in steps):
        raise ValueError(f"steps {first} to {last} are not within 1 to {max(s.number for s in steps)}")
    if workers < 1:
        raise ValueError("at least one worker is needed")
    chosen = [s for s in steps if first <= s.number <= last]
    todo = None
    if wanted is not None:
        left = pending(wanted.select("city", "n_scenes"), outputs_of(spark, chosen, out_dir), max(s.number for s in steps))
        todo = {(r["city"], r["step"]) for r in left.collect()}  # one row a city and step

    def run(city: str) -> list[tuple]:
        rows, log = [], CityLog(city)
        for step in chosen:
            began, at = time.time(), f"{out_dir}/{step.name}/city={city}"
            status, error = "ok", None
            try:
                if _stands(spark, at) and (todo is None or (city, step.number) not in todo):
                    status = "skipped"
                else:
                    step.run(spark, city).write.mode("overwrite").parquet(at)
            except Exception:  # the city's own failure; the others go on
                status, error = "failed", traceback.format_exc(limit=1)[-500:]
            rows.append((city, step.number, step.name, status, error, time.time() - began, None))
            log.log(logging.ERROR if error else logging.INFO, "step %d %s: %s in %.1f s", step.number, step.name, status, time.time() - began)
            if status == "failed":
                break
        return rows

    with ThreadPoolExecutor(min(workers, max(1, len(cities)))) as pool:
        rows = [row for part in pool.map(run, cities) for row in part]
    log = spark.createDataFrame(rows, LOG).withColumn("ts", F.current_timestamp())
    log.write.mode("append").parquet(f"{out_dir}/run_log")
    return log


def _children(spark: SparkSession, path: str) -> list[str]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [f.getPath().toString() for f in files.listStatus(at)] if files.exists(at) else []


def _stands(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def clean_up(spark: SparkSession, out_dir: str, steps: list[str], cities: list[str], keep: tuple[str, ...] = ()) -> int:
    """Drops the named steps' partitions of all cities but those to keep; returns the bytes freed."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    freed = 0
    for city in cities:
        for step in steps if city not in keep else ():
            at = jvm.org.apache.hadoop.fs.Path(f"{out_dir}/{step}/city={city}")
            files = at.getFileSystem(conf)
            if files.exists(at):
                freed += files.getContentSummary(at).getLength()
                files.delete(at, True)
    return freed
