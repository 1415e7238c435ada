"""Mixing sources to target weights by entropy balancing.

Each document's copy count follows the binomial law on 0..cap with mean one,
tilted exponentially by the document's length; one multiplier per source makes
the expected words meet the source's target. The convex dual is solved by
Newton steps whose sums are Spark aggregates over a lossless
``(source, size) -> count`` histogram. Expected copies are then rounded with
error feedback, longest documents first, inside small deterministic groups.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orbitframe.llm.common import WORD, materialize, release, small_batches

#: Documents of one source that share an error-feedback group, about.
GROUP_DOCS = 1000
#: Steps before the solution counts as failed; the brackets halve at least every other step.
MAX_STEPS = 120
TOLERANCE = 1e-6


def mix_sources(
    docs: DataFrame,
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """Copies of every document such that each source meets its word target.

    Returns one row per input row: ``doc_id, source, size, source_size, target,
    rate, copies, taken``. Sources ordered by code point (null is a source of
    its own, last) take ``weights`` in turn and share ``share`` times all words;
    no target exceeds ``cap`` times its source's words, the rest is reshared.

    Null or empty texts have size 0 and take nothing; a source of no words has
    target 0; rows with equal ids are separate documents that round in an
    order set by size and id, so equal rows are interchangeable; an empty table
    gives no rows. Columns other than the three named are ignored, but for those
    in ``carry``, which go along; one named like a column of the result gets
    underscores.
    """
    if carry:
        whole = F.struct(*[F.col(f"`{c}`") for c in carry]).alias("mix_carried")
        return _unpacked(_mixed(docs, weights, share, cap, id_col, text_col, source_col, [whole]), carry)
    return _mixed(docs, weights, share, cap, id_col, text_col, source_col, [])


def _unpacked(mixed: DataFrame, carry: tuple[str, ...]) -> DataFrame:
    own = [c for c in mixed.columns if c != "mix_carried"]
    names: list[str] = []
    for c in carry:
        while c.lower() in {x.lower() for x in own + names}:
            c += "_"
        names.append(c)
    return mixed.select(*own, *[F.col("mix_carried").getField(c).alias(n) for c, n in zip(carry, names, strict=True)])


def _mixed(docs: DataFrame, weights: tuple[float, ...], share: float, cap: int, id_col: str, text_col: str, source_col: str, more: list[Column]) -> DataFrame:
    picked = docs.select(
        F.col(id_col).alias("doc_id"),
        F.col(source_col).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        *more,
    )
    sized = picked if more else materialize(picked, "mix-sizes")
    hist = materialize(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "mix-hist")
    state = solve_rates(hist, source_targets(hist, weights, share, cap), cap)
    return round_copies(sized, state, cap)


def source_targets(hist: DataFrame, weights: tuple[float, ...], share: float, cap: int) -> DataFrame:
    """Water-filling over the per-source totals: ``source, docs, source_size, scale, target``.

    ``min(cap * size, theta * weight)`` is what repeated resharing of the excess
    ends at; theta is read off the order of ``cap * size / weight``. The windows
    run over one row per source.
    """
    totals = hist.groupBy("source").agg(
        F.sum("n").alias("docs"),
        F.sum(F.col("n") * F.col("size")).alias("source_size"),
        F.sum(F.col("n") * F.col("size").cast("double") * F.col("size")).alias("squares"),
    )
    turn = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    ring = F.array(*[F.lit(float(w)) for w in weights])
    ranked = totals.withColumn("weight", F.element_at(ring, (turn % len(weights) + 1).cast("int")))
    ratio = (F.col("source_size") * cap).cast("double") / F.col("weight")
    order = Window.orderBy("ratio", F.col("source").isNull(), "source")
    everything = Window.partitionBy()
    levels = (
        ranked.withColumn("ratio", ratio)
        .withColumn("goal", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("before", F.sum(F.col("source_size") * cap).over(order) - F.col("source_size") * cap)
        .withColumn("rest", F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("goal") - F.col("before")) / F.col("rest"))
        .withColumn("theta", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    )
    ceiling = (F.col("source_size") * cap).cast("double")
    return levels.select(
        "source",
        "docs",
        "source_size",
        F.when(F.col("source_size") > 0, F.col("squares") / F.col("source_size")).otherwise(1.0).alias("scale"),
        F.when(F.col("theta").isNull(), ceiling).otherwise(F.least(ceiling, F.col("theta") * F.col("weight"))).alias("target"),
    )


def _rate(lam: Column, size: Column, scale: Column, cap: int) -> Column:
    """Mean of the tilted binomial: ``cap / (1 + (cap - 1) exp(-lam * size / scale))``."""
    tilt = F.exp(F.greatest(F.least(-lam * size / scale, F.lit(700.0)), F.lit(-700.0)))
    return F.lit(float(cap)) / (1.0 + (cap - 1.0) * tilt)


def solve_rates(hist: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """Newton on the dual, one multiplier per source, kept inside its bracket; it ends converged or with an error."""
    big = F.lit(float("inf"))
    state = materialize(targets.withColumns({"lam": F.lit(0.0), "low": -big, "high": big, "gap": big}), "mix-state")
    for _ in range(MAX_STEPS):
        cells = hist.where("size > 0").withColumnRenamed("source", "s")
        joined = cells.join(state, F.col("s").eqNullSafe(F.col("source")))
        size, scale = F.col("size").cast("double"), F.col("scale")
        rate = _rate(F.col("lam"), size, scale, cap)
        sums = joined.groupBy("s").agg(
            F.sum(F.col("n") * size * rate).alias("words"),
            F.sum(F.col("n") * size * (size / scale) * rate * (1.0 - rate / cap)).alias("slope"),
        )
        step = _newton(state.join(sums, F.col("s").eqNullSafe(F.col("source")), "left"), cap)
        after = materialize(step, "mix-state")
        worst = after.agg(F.max("gap")).first()[0]
        release(state)
        state = after
        if worst is None or worst <= TOLERANCE:
            return state
    raise RuntimeError(f"mixing: a source is still off its target by {worst:.3g} of it after {MAX_STEPS} steps")


def _newton(joined: DataFrame, cap: int) -> DataFrame:
    """One step per source, on the logits of both sides: there the dual's gradient is nearly straight."""
    words, ceiling = F.coalesce(F.col("words"), F.lit(0.0)), F.col("source_size") * float(cap)
    edge = (F.col("target") <= 0) | (F.col("target") >= ceiling)
    gap = F.when(edge, 0.0).otherwise(F.abs(words - F.col("target")) / F.col("target"))
    logit = lambda x: F.log(F.try_divide(x, ceiling - x))
    step = F.try_divide((logit(F.col("target")) - logit(words)) * words * (ceiling - words), F.col("slope") * ceiling)
    marked = joined.withColumns(
        {
            "gap_": gap,
            "lo": F.when(words < F.col("target"), F.col("lam")).otherwise(F.col("low")),
            "hi": F.when(words > F.col("target"), F.col("lam")).otherwise(F.col("high")),
            "next": F.when((words > 0) & (words < ceiling), F.col("lam") + step),
        }
    )
    inside = F.coalesce(F.col("next").between(F.col("lo"), F.col("hi")) & ~F.isnan("next"), F.lit(False))
    middle = (
        F.when(F.col("lo") == float("-inf"), F.col("hi") - 4 - F.abs("hi"))
        .when(F.col("hi") == float("inf"), F.col("lo") + 4 + F.abs("lo"))
        .otherwise((F.col("lo") + F.col("hi")) / 2)
    )
    lam = F.when(F.col("gap_") <= TOLERANCE, F.col("lam")).when(inside, F.col("next")).otherwise(middle)
    return marked.select("source", "docs", "source_size", "scale", "target", lam.alias("lam"), F.col("lo").alias("low"), F.col("hi").alias("high"), F.col("gap_").alias("gap"))


def round_copies(sized: DataFrame, state: DataFrame, cap: int) -> DataFrame:
    """Round expected copies so that each group's words follow its expectation.

    A group holds about ``GROUP_DOCS`` documents of one source, chosen by a hash
    of the id, so a source with a third of all rows is spread over many tasks
    and reruns agree. Long documents go first, so what a group misses in the
    end is about half its shortest document. Columns that ``sized`` has beside
    its own three go along.
    """
    small_batches(sized.sparkSession)
    more = [c for c in sized.columns if c not in ("doc_id", "source", "size")]
    rated = sized.withColumnRenamed("source", "s").join(state, F.col("s").eqNullSafe(F.col("source")))
    rate = (
        F.when(F.col("target") <= 0, 0.0)
        .when(F.col("target") >= F.col("source_size") * cap, float(cap))
        .otherwise(_rate(F.col("lam"), F.col("size").cast("double"), F.col("scale"), cap))
    )
    groups = F.greatest(F.lit(1), F.ceil(F.col("docs") / GROUP_DOCS)).cast("long")
    ready = rated.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        rate.alias("rate"),
        F.pmod(F.xxhash64(F.col("doc_id")), groups).alias("grp"),
        F.xxhash64(F.col("doc_id"), F.lit(1)).alias("mixed"),
        *more,
    )
    dealt = ready.repartition("source", "grp").sortWithinPartitions("source", "grp", F.desc("size"), "mixed", "doc_id").drop("mixed")

    def feed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, carry = None, 0.0
        for batch in batches:
            sizes = batch.column("size").to_numpy(zero_copy_only=False)
            out = np.zeros(len(sizes), np.int64)
            rows = zip(batch.column("source").to_pylist(), batch.column("grp").to_pylist(), sizes.tolist(), batch.column("rate").to_pylist(), strict=True)
            for i, (source, grp, size, want) in enumerate(rows):
                if key != (source, grp):
                    key, carry = (source, grp), 0.0
                if size:
                    due = size * want + carry
                    least = min(int(want), cap)
                    out[i] = min(least + 1, cap) if due - least * size >= size / 2 else least
                    carry = due - out[i] * size
            kept = [n for n in batch.schema.names if n != "grp"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in kept), pa.array(out), pa.array(out * sizes)], [*kept, "copies", "taken"])

    fields = [f for f in dealt.schema.fields if f.name != "grp"]
    return dealt.mapInArrow(feed, T.StructType([*fields, T.StructField("copies", T.LongType()), T.StructField("taken", T.LongType())]))


def mixed_rows(docs: DataFrame, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix_sources`` copies it, columns unchanged."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), whole.alias("whole"))
    mixed = mix_sources(named, carry=("whole",), **settings)
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("whole.*")
