"""Spillover graphs, activation gates and forecast bounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F



def package(edges: DataFrame, entities: DataFrame, top_k: int = 3, by: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(edges with strength -log10 p and inbound rank, nodes with in-degree and isolated); all tests are kept, lags are at least 1.

    With `by` (as_of) there is a graph, and so a rank and a node, for each value of it.
    """
    by = by or []
    strength = -F.log10(F.greatest("p_value", F.lit(1e-12)))
    kept = edges.withColumn("lag", F.greatest("best_lag", F.lit(1))).withColumn("strength", strength)
    order = Window.partitionBy(*by, "target").orderBy(F.desc(F.col("significant").cast("int")), F.round("p_value", 12), "source")
    ranked = kept.withColumn("rank", F.row_number().over(order)).withColumn("top", F.col("significant") & (F.col("rank") <= top_k))
    degree = kept.where("significant").groupBy(*by, F.col("target").alias("entity")).agg(F.count("*").alias("in_degree"))
    nodes = entities.select("entity").distinct()
    nodes = nodes.crossJoin(F.broadcast(edges.select(*by).distinct())) if by else nodes  # a row per graph
    nodes = nodes.join(degree, [*by, "entity"], "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    return ranked, nodes.withColumn("isolated", F.col("in_degree") == 0)


def edge_weights(edges: DataFrame) -> DataFrame:
    """(target, source, weight): 1 / p of the significant edges."""
    return edges.where("significant").select("target", "source", (1 / F.greatest("p_value", F.lit(1e-12))).alias("weight"))


def edge_matrix(edges: DataFrame, sources: list[str]) -> DataFrame:
    """One row per target, one column per source; 0 where there is no edge."""
    return edge_weights(edges).groupBy("target").pivot("source", sources).agg(F.sum("weight")).na.fill(0.0)


def spillover_signal(series: DataFrame, edges: DataFrame, targets: DataFrame, top_k: int = 3, span: int = 3, by: list[str] | None = None) -> DataFrame:
    """(entity, origin, n_neighbours, trend, max_shock, contributors): moves of the top neighbours at their lags, weighted by 1 / p.

    targets (entity, origin), with `by` (as_of) also the graph that is known at the origin. Moves are joined by (source, row number).
    """
    by = by or []
    order = Window.partitionBy(*by, "target").orderBy(F.round("p_value", 12), "source")
    top = edges.where("significant").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top_k)
    top = top.select(*by, F.col("target").alias("entity"), "source", F.greatest("best_lag", F.lit(1)).alias("lag"), (1 / F.greatest("p_value", F.lit(1e-12))).alias("w"))
    asked = targets.join(top, ["entity", *by]).select("entity", "origin", "source", "lag", "w")
    rows = series.select(F.col("entity").alias("source"), "date", "widx", "y")
    now = rows.select("source", F.col("date").alias("origin"), F.col("widx").alias("n"))
    at = asked.join(now, ["source", "origin"]).withColumn("e", F.col("n") - F.col("lag")).withColumn("s", F.col("n") - F.col("lag") - span)
    end = rows.select("source", F.col("widx").alias("e"), F.col("y").alias("ye"))
    start = rows.select("source", F.col("widx").alias("s"), F.col("y").alias("ys"))
    moved = at.join(end, ["source", "e"]).join(start, ["source", "s"]).withColumn("move", F.try_divide(F.col("ye") - F.col("ys"), F.col("ys"))).where("move IS NOT NULL")
    return moved.groupBy("entity", "origin").agg(
        F.count("*").alias("n_neighbours"),
        (F.sum(F.col("w") * F.col("move")) / F.sum("w")).alias("trend"),
        F.max_by("move", F.struct(F.round(F.abs("move"), 12), "source")).alias("max_shock"),
        F.max_by("source", F.struct(F.round(F.abs("move"), 12), "source")).alias("shocked"),
        F.array_sort(F.collect_set("source")).alias("contributors"),
    )


def gate(asks: DataFrame, own_z: float = 2.0, neighbour_z: float = 2.5) -> DataFrame:
    """asks (entity, origin, event_live, z, shock_z) with trigger and activate: a live event, then the own z, then the neighbour's, else none."""
    trigger = (
        F.when(F.coalesce("event_live", F.lit(False)), "event").when(F.col("z") > own_z, "own_error").when(F.col("shock_z") > neighbour_z, "neighbour_shock").otherwise("none")
    )
    return asks.withColumn("trigger", trigger).withColumn("activate", F.col("trigger") != "none")


def shock_z(signals: DataFrame, z: DataFrame) -> DataFrame:
    """(entity, origin, shock_z): the move score of the neighbour that moved most, at the origin."""
    scored = z.select(F.col("entity").alias("shocked"), F.col("date").alias("origin"), F.col("z").alias("shock_z"))
    return signals.join(scored, ["shocked", "origin"], "left").select("entity", "origin", "shock_z")


def boundary_check(forecasts: DataFrame, last: DataFrame, bounds: DataFrame, floor: float = 0.0) -> DataFrame:
    """Violating steps (keys, step, yhat, previous, problem): under the floor, or a move over the entity's largest on record."""
    keys = ["channel", "entity", "origin"]
    rows = forecasts.join(last.select("entity", "origin", "y0"), ["entity", "origin"]).join(bounds, "entity")
    previous = F.coalesce(F.lag("yhat").over(Window.partitionBy(*keys).orderBy("step")), F.col("y0"))
    rows = rows.withColumn("previous", previous)
    move = F.abs(F.try_divide(F.col("yhat") - F.col("previous"), F.col("previous")))
    return rows.withColumn("problem", F.when(F.col("yhat") < floor, "floor").when(move > F.col("bound"), "jump")).where("problem IS NOT NULL").select(*keys, "step", "yhat", "previous", "problem")


def _paths(forecasts: DataFrame, last: DataFrame, bounds: DataFrame) -> DataFrame:
    lists = forecasts.groupBy("channel", "entity", "origin").agg(F.array_sort(F.collect_list(F.struct("step", "yhat"))).alias("p"))
    lists = lists.withColumn("path", F.transform("p", lambda x: x["yhat"])).drop("p")
    return lists.join(last.select("entity", "origin", "y0"), ["entity", "origin"]).join(bounds, "entity")


def violations(path: Column, floor: float) -> Column:
    """Problems along a path, each step against the one before."""
    before = F.concat(F.array("y0"), F.slice(path, 1, F.greatest(F.size(path) - 1, F.lit(0))))
    kind = lambda y, b: F.when(y < floor, "floor").when(F.abs(F.try_divide(y - b, b)) > F.col("bound") + 1e-12, "jump")
    return F.filter(F.zip_with(path, before, kind), lambda v: v.isNotNull())


def clamped(path: Column, floor: float) -> Column:
    """The path with every step brought within the bound of the corrected step before, and over the floor."""
    start = F.struct(F.col("y0").alias("prev"), F.array().cast("array<double>").alias("out"))

    def add(s: Column, y: Column) -> Column:
        room = F.abs(s["prev"]) * F.col("bound")
        v = F.greatest(F.least(F.greatest(y, s["prev"] - room), s["prev"] + room), F.lit(floor))
        return F.struct(v.alias("prev"), F.concat(s["out"], F.array(v)).alias("out"))

    return F.aggregate(path, start, add, lambda s: s["out"])


def enforce(forecasts: DataFrame, last: DataFrame, bounds: DataFrame, baseline: DataFrame | None = None, corrector=None, floor: float = 0.0, attempts: int = 2) -> DataFrame:
    """(channel, entity, origin, path, violations, attempts, corrected, fell_back).

    A violating path goes through the corrector (the clamp, if none is given) at most `attempts` times; what still violates is
    replaced by the baseline path and clamped once.
    """
    rows = _paths(forecasts, last, bounds).withColumn("violations", violations(F.col("path"), floor)).withColumn("original", F.col("path")).withColumn("attempts", F.lit(0))
    fix = corrector or (lambda path: clamped(path, floor))
    for _ in range(attempts):
        bad = F.size(violations(F.col("path"), floor)) > 0
        rows = rows.withColumn("_bad", bad).withColumn("path", F.when(F.col("_bad"), fix(F.col("path"))).otherwise(F.col("path"))).withColumn("attempts", F.col("attempts") + F.col("_bad").cast("int")).drop("_bad")
    rows = rows.withColumn("fell_back", F.size(violations(F.col("path"), floor)) > 0)
    if baseline is not None:
        base = baseline.groupBy("entity", "origin").agg(F.array_sort(F.collect_list(F.struct("step", "yhat"))).alias("q"))
        rows = rows.join(base, ["entity", "origin"], "left").withColumn("_b", F.transform("q", lambda x: x["yhat"])).drop("q")
        rows = rows.withColumn("path", F.when(F.col("fell_back") & F.col("_b").isNotNull(), clamped(F.slice("_b", 1, F.size("path")), floor)).otherwise(F.col("path"))).drop("_b")
    corrected = (F.size("violations") > 0) & ~F.col("fell_back")
    return rows.select("channel", "entity", "origin", "path", "violations", "attempts", corrected.alias("corrected"), "fell_back")


def gate_inputs(series: DataFrame, origins: DataFrame, own: DataFrame, live: DataFrame, shocks: DataFrame) -> DataFrame:
    """asks for the gate: own error score (entity, date, z), live events (entity, origin, event_live) and neighbours' shocks."""
    asks = origins.select("entity", "origin").join(own.select("entity", F.col("date").alias("origin"), "z"), ["entity", "origin"], "left")
    return asks.join(live, ["entity", "origin"], "left").join(shocks, ["entity", "origin"], "left")
