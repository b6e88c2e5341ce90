"""What-if route scoring for many scenarios at once.

Semantics follow the reference statement for one scenario, applied per
``scenario_id``:

1. routes ⋈ carriers (inner), ⟕ anomaly events on route_id: one row per
   route × event (a route without events gives one row with risk 0.0);
2. WHERE lane matches, transit <= max days, carrier rule (S8);
3. cost = base + weight × per-kg; risk = mean anomaly score over the route's
   31-row frame (30 preceding + current) ordered by event time;
4. the 10 cheapest rows; then rows with risk > 0.75 are dropped when
   ``avoid_anomaly_routes`` (dropped rows are not back-filled);
5. ``is_recommended`` = risk < 0.5 and cost equals the minimum of the rows kept.

Ties (S10): rows order by (cost, route_id, event_time desc, event_id desc),
so a route's surviving rows carry its newest rolling risk.

Plan (scale): cost is constant per route within a scenario, so at most
``top_k`` routes can contribute rows, and each of them at most its ``top_k``
newest events; each of those needs 30 older events for its frame. So events
are cut to the newest ``top_k + 30`` per route first (``row_number`` limit ->
WindowGroupLimit, combined map-side, safe for a hot route), the rolling mean
runs on that bounded set, and the scenario × route candidates are cut to the
cheapest ``top_k`` routes per scenario before meeting the events. No step
joins a scenario to a route's full event history.

Candidates: scenarios are reduced to the distinct (lane, route group, days,
weight) points they ask for; routes meet stretches of weights, cut finer where
many routes are needed (``candidate_routes``), so a hot lane never pairs all
its scenarios with all its routes, wherever their costs cross.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cargoscope.functions.columns import percent, risk_band, route_label
from cargoscope.session import ensure_checkpoint_dir

TOP_K = 10
FRAME_PRECEDING = 30
RISK_DROP = 0.75
RECOMMEND_BELOW = 0.5
GRAINS = ("event", "route")

# Scenario defaults and bounds of the request model (fixed values).
DEFAULT_MAX_TRANSIT_DAYS = 7
DEFAULT_AVOID_ANOMALY_ROUTES = True
WEIGHT_MIN, WEIGHT_MAX = 0.1, 50000.0
TRANSIT_MIN, TRANSIT_MAX = 1, 30
WEIGHT_LEVELS = (0.5, 4)  # grids of weight stretches per doubling, coarse to fine
CROWDED = 3  # a stretch that keeps more than this times top_k routes is cut again
SPLIT = 8


def _empty() -> F.Column:
    return F.array().cast("array<string>")


def with_scenario_defaults(scenarios: DataFrame) -> DataFrame:
    """Fill the request defaults: no carrier list, 7 days, avoid risky routes."""
    cols = scenarios.columns
    out = scenarios
    out = out.withColumn("carrier_ids", F.coalesce(F.col("carrier_ids"), _empty())
                         if "carrier_ids" in cols else _empty())
    out = out.withColumn("max_transit_days",
                         F.coalesce(F.col("max_transit_days"), F.lit(DEFAULT_MAX_TRANSIT_DAYS))
                         if "max_transit_days" in cols else F.lit(DEFAULT_MAX_TRANSIT_DAYS))
    out = out.withColumn("avoid_anomaly_routes",
                         F.coalesce(F.col("avoid_anomaly_routes"), F.lit(DEFAULT_AVOID_ANOMALY_ROUTES))
                         if "avoid_anomaly_routes" in cols else F.lit(DEFAULT_AVOID_ANOMALY_ROUTES))
    return out


def validate_scenarios(scenarios: DataFrame) -> DataFrame:
    """Bounds check of the request model (B10); adds ``reject_reason`` (null = valid).

    First failing field wins, in field order.
    """
    s = with_scenario_defaults(scenarios)
    w, d = F.col("cargo_weight_kg"), F.col("max_transit_days")
    reason = (F.when(F.col("origin_hub").isNull(), "origin_hub")
              .when(F.col("destination_hub").isNull(), "destination_hub")
              .when(w.isNull() | F.isnan(w) | (w < WEIGHT_MIN) | (w > WEIGHT_MAX), "cargo_weight_kg")
              .when((d < TRANSIT_MIN) | (d > TRANSIT_MAX), "max_transit_days"))
    return s.withColumn("reject_reason", reason)


def carrier_rule(request_ids: F.Column, route_filter: F.Column, carrier: F.Column) -> F.Column:
    """Pass when the request lists no carrier, the route has no (or an
    empty) own filter list, or the route's carrier is in the request list."""
    return ((F.size(request_ids) == 0) | route_filter.isNull() | (F.size(route_filter) == 0)
            | F.array_contains(request_ids, carrier))


def rolling_risk(events: DataFrame, newest: int | None = None,
                 frame: int = FRAME_PRECEDING) -> DataFrame:
    """Rolling mean anomaly score per route over ``frame`` preceding rows + current.

    With ``newest`` set, only the newest ``newest`` events per route are
    returned (with ``recency`` 1 = newest); the frame still sees their 30
    older neighbours because events are cut to ``newest + frame`` first, a
    map-side WindowGroupLimit. Without it every event gets its rolling risk
    through ``plans.ranking.with_rolling_mean``, which splits a hot route
    across tasks. Returns ``route_id, event_id, event_time,
    anomaly_risk_score`` (and ``recency`` with ``newest``).
    """
    ev = events.filter(F.col("route_id").isNotNull()).select(
        "route_id", "event_id", "event_time", "anomaly_score")
    if newest is None:
        from cargoscope.plans.ranking import with_rolling_mean
        out = with_rolling_mean(ev, "route_id", ["event_time", "event_id"], "anomaly_score",
                                "anomaly_risk_score", frame)
        return out.select("route_id", "event_id", "event_time", "anomaly_risk_score")
    newest_first = Window.partitionBy("route_id").orderBy(F.col("event_time").desc(),
                                                         F.col("event_id").desc())
    ev = (ev.withColumn("recency", F.row_number().over(newest_first))
          .filter(F.col("recency") <= newest + frame))
    # Frame "30 preceding .. current" in time order = "current .. 30 following"
    # in newest-first order, so both windows share one sort.
    risk = F.avg("anomaly_score").over(newest_first.rowsBetween(0, frame))
    ev = ev.withColumn("anomaly_risk_score", risk).filter(F.col("recency") <= newest)
    return ev.select("route_id", "event_id", "event_time", "anomaly_risk_score", "recency")


def _scenario_groups(ids: F.Column) -> F.Column:
    """Route groups a scenario may draw from (S8): every route when it lists
    no carrier; else routes without an own filter list plus, per listed
    carrier, the filtered routes of that carrier."""
    ids = F.array_distinct(ids)
    return F.when(F.size(ids) == 0, F.array(F.lit("all"))).otherwise(
        F.concat(F.array(F.lit("open")), F.transform(ids, lambda c: F.concat(F.lit("filt:"), c))))


def _route_groups(route_filter: F.Column, carrier: F.Column) -> F.Column:
    own = F.when(route_filter.isNull() | (F.size(route_filter) == 0), F.lit("open")) \
        .otherwise(F.concat(F.lit("filt:"), carrier))
    return F.array(F.lit("all"), own)


def _routes_with_carriers(routes: DataFrame, carriers: DataFrame) -> DataFrame:
    r = routes.select("route_id", "origin_hub", "destination_hub", "carrier_id",
                      "estimated_transit_days", "base_cost_usd", "cost_per_kg_usd", "waypoints",
                      "carrier_ids_filter")
    return r.join(carriers.select("carrier_id", "carrier_name"), "carrier_id")


def _cost() -> F.Column:
    return F.col("base_cost_usd") + F.col("cargo_weight_kg") * F.col("cost_per_kg_usd")


def split_scenarios(scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) scenarios by ``reject_reason``."""
    checked = validate_scenarios(scenarios)
    return (checked.filter(F.col("reject_reason").isNull()),
            checked.filter(F.col("reject_reason").isNotNull()))


POINT = ["_o", "_d", "_group", "max_transit_days"]
STRETCH = [*POINT, "_stretch"]  # some of a key's weights, from _from to _to


def _needed(rows: DataFrame, top_k: int) -> DataFrame:
    """Routes that can be among the ``top_k`` cheapest for some weight of their
    stretch.

    A cost is a line over the weight. Take the ``top_k`` lines that are
    cheapest at the stretch's middle, and the greatest cost of these at either
    end: a line above both is above all of them throughout, so it is not
    needed. On a stretch of one weight just the ``top_k`` cheapest are.
    """
    base, pk = F.col("base_cost_usd"), F.col("cost_per_kg_usd")
    rows = (rows.withColumn("_lo", base + F.col("_from") * pk)
            .withColumn("_hi", base + F.col("_to") * pk))
    middle = Window.partitionBy(*STRETCH).orderBy(F.col("_lo") + F.col("_hi"), "route_id")
    best = (rows.select(*STRETCH, "_lo", "_hi", "route_id")
            .withColumn("_place", F.row_number().over(middle)).filter(F.col("_place") <= top_k))
    last = best.groupBy(*STRETCH).agg(
        F.count(F.lit(1)).alias("_n"), F.max("_lo").alias("_top_lo"), F.max("_hi").alias("_top_hi"),
        F.max_by("route_id", F.struct(F.col("_lo") + F.col("_hi"), "route_id")).alias("_last_id"))

    def within(cost: str, top: str) -> F.Column:
        """Not above, with room for the rounding of costs in between."""
        return F.col(cost) <= F.col(top) + 1e-9 * (1 + F.abs(top))

    one = (F.col("_lo") < F.col("_top_lo")) | ((F.col("_lo") == F.col("_top_lo"))
                                               & (F.col("route_id") <= F.col("_last_id")))
    some = within("_lo", "_top_lo") | within("_hi", "_top_hi")
    return (rows.join(last, STRETCH)
            .filter((F.col("_n") < top_k) | F.when(F.col("_from") == F.col("_to"), one).otherwise(some))
            .drop("_lo", "_hi", "_n", "_top_lo", "_top_hi", "_last_id"))


def _grid(per_octave: float) -> F.Column:
    return F.floor(F.log2("cargo_weight_kg") * float(per_octave)).cast("string")


def candidate_routes(points: DataFrame, routes: DataFrame, carriers: DataFrame,
                     top_k: int = TOP_K, levels: tuple[float, ...] = WEIGHT_LEVELS) -> DataFrame:
    """Point × route candidates that hold every point's ``top_k`` cheapest routes.

    A point is a (lane, route group, days, weight) that scenarios ask for. A
    key's weights are cut into stretches, and each stretch keeps the lines it
    can need. One that keeps more than ``CROWDED * top_k`` is cut again, first
    by the next grid of ``levels`` (stretches per doubling), then into
    ``SPLIT`` equal parts of the range of its own weights, which always parts
    the least from the greatest; a stretch of one weight keeps ``top_k``. So a
    point ends with at most ``CROWDED * top_k`` routes, however many lines
    cross near it, and lines go on only where stretches are crowded.
    """
    ensure_checkpoint_dir(points.sparkSession)
    rc = _routes_with_carriers(routes, carriers)
    lines = rc.select("*", F.col("origin_hub").alias("_o"), F.col("destination_hub").alias("_d"),
                      F.explode(_route_groups(F.col("carrier_ids_filter"), F.col("carrier_id")))
                      .alias("_group"))
    # Of equal lines only the top_k least route ids can be needed.
    same = Window.partitionBy("_o", "_d", "_group", "estimated_transit_days", "base_cost_usd",
                              "cost_per_kg_usd").orderBy("route_id")
    lines = lines.withColumn("_same", F.row_number().over(same)).filter(
        F.col("_same") <= top_k).drop("_same")
    fits = F.col("estimated_transit_days") <= F.col("max_transit_days")
    on, grids, done = ["_o", "_d", "_group"], list(levels), []
    todo = points.withColumn("_stretch", _grid(grids.pop(0))).checkpoint()
    while True:
        stretches = todo.groupBy(*dict.fromkeys([*STRETCH, *on])).agg(
            F.min("cargo_weight_kg").alias("_from"), F.max("cargo_weight_kg").alias("_to"))
        kept = _needed(lines.join(stretches, on).filter(fits).drop("_parent"), top_k).checkpoint()
        crowded = (kept.groupBy(*STRETCH, "_from", "_to").agg(F.count(F.lit(1)).alias("_n"))
                   .filter((F.col("_n") > CROWDED * top_k) & (F.col("_from") < F.col("_to")))
                   .drop("_n").checkpoint())
        if crowded.isEmpty():
            done.append(todo.join(kept.drop("_from", "_to"), STRETCH))
            break
        done.append(todo.join(kept.drop("_from", "_to").join(
            crowded.select(*STRETCH), STRETCH, "left_anti"), STRETCH))
        lines = (kept.drop("_from", "_to").join(crowded.select(*STRETCH), STRETCH)
                 .withColumnRenamed("_stretch", "_parent"))
        share = (F.col("cargo_weight_kg") - F.col("_from")) / (F.col("_to") - F.col("_from"))
        part = _grid(grids.pop(0)) if grids else F.least(
            F.floor(share * SPLIT), F.lit(SPLIT - 1)).cast("string")
        todo = (todo.join(crowded, STRETCH).withColumn("_parent", F.col("_stretch"))
                .withColumn("_stretch", F.concat_ws("/", "_parent", part)).drop("_from", "_to"))
        on = [*POINT, "_parent"]
    out = reduce(DataFrame.unionByName, [d.drop("_parent") for d in done])
    return out.drop("_stretch").withColumn("estimated_cost_usd", _cost())


def cheapest_routes(scenarios: DataFrame, routes: DataFrame, carriers: DataFrame,
                    top_k: int = TOP_K, levels: tuple[float, ...] = WEIGHT_LEVELS) -> DataFrame:
    """Each valid scenario's ``top_k`` cheapest routes (C3, C6, B11-B13), ties
    by route id. ``scenario_id`` must be unique.

    Scenarios that ask for the same point share its candidates, so the work
    grows with distinct points, and scenario × route pairs of a lane are never
    formed. One plan at every size.
    """
    valid, _ = split_scenarios(scenarios)
    s = valid.select(
        "scenario_id", F.col("origin_hub").alias("_o"), F.col("destination_hub").alias("_d"),
        "cargo_weight_kg", "max_transit_days", "avoid_anomaly_routes",
        F.explode(_scenario_groups(F.col("carrier_ids"))).alias("_group"))
    point = [*POINT, "cargo_weight_kg"]
    ranked = Window.partitionBy(*point).orderBy("estimated_cost_usd", "route_id")
    best = (candidate_routes(s.select(*point).distinct(), routes, carriers, top_k, levels)
            .withColumn("_place", F.row_number().over(ranked)).filter(F.col("_place") <= top_k)
            .drop("_place", "origin_hub", "destination_hub"))
    by_cost = Window.partitionBy("scenario_id").orderBy("estimated_cost_usd", "route_id")
    return (s.join(best, point).withColumn("_place", F.row_number().over(by_cost))
            .filter(F.col("_place") <= top_k).drop("_place", "_group")
            .withColumnRenamed("_o", "origin_hub").withColumnRenamed("_d", "destination_hub"))


def score_routes(scenarios: DataFrame, routes: DataFrame, carriers: DataFrame,
                 events: DataFrame, grain: str = "event", top_k: int = TOP_K) -> DataFrame:
    """Route options per valid scenario (C6 with C3, C4, E1, E2, F2, F3, B11-B15).

    ``grain="event"`` is the reference's route × event grain; ``grain="route"``
    keeps each route's newest row only before the top-k. Scenarios outside the
    request model's bounds have no options: :func:`split_scenarios` returns
    them with their reasons, and :func:`simulate_many` returns both.
    """
    if grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}, got {grain!r}")
    # Only the top_k cheapest routes of a scenario can place a row in its top_k.
    cheapest = cheapest_routes(scenarios, routes, carriers, top_k)
    risk = rolling_risk(events, newest=top_k if grain == "event" else 1)
    rows = (cheapest.join(risk, "route_id", "left")
            .withColumn("anomaly_risk_score", F.coalesce(F.col("anomaly_risk_score"), F.lit(0.0))))

    row_order = Window.partitionBy("scenario_id").orderBy(
        "estimated_cost_usd", "route_id", F.col("event_time").desc(), F.col("event_id").desc())
    top = (rows.withColumn("_row_rank", F.row_number().over(row_order))
           .filter(F.col("_row_rank") <= top_k))
    # The risk drop runs after the limit and is not back-filled.
    kept = top.filter(~(F.col("avoid_anomaly_routes") & (F.col("anomaly_risk_score") > RISK_DROP)))
    min_cost = F.min("estimated_cost_usd").over(Window.partitionBy("scenario_id"))
    recommended = (F.col("anomaly_risk_score") < RECOMMEND_BELOW) & (F.col("estimated_cost_usd") == min_cost)
    return (kept.withColumn("is_recommended", recommended)
            .withColumn("waypoints", F.coalesce(F.col("waypoints"), _empty()))
            .select("scenario_id", "route_id", "carrier_id", "carrier_name",
                    "estimated_transit_days", "estimated_cost_usd", "anomaly_risk_score",
                    "waypoints", "is_recommended", "event_id", "event_time",
                    "origin_hub", "destination_hub"))


def simulate_many(scenarios: DataFrame, routes: DataFrame, carriers: DataFrame, events: DataFrame,
                  grain: str = "event") -> tuple[DataFrame, DataFrame]:
    """(options of the valid scenarios, rejected scenarios with their reason)."""
    return (score_routes(scenarios, routes, carriers, events, grain),
            split_scenarios(scenarios)[1])


def route_options_display(options: DataFrame) -> DataFrame:
    """Display fields of a route option: risk band and percent (B23), label."""
    return (options
            .withColumn("risk_band", risk_band("anomaly_risk_score"))
            .withColumn("risk_pct", percent("anomaly_risk_score"))
            .withColumn("cost_shown", F.round("estimated_cost_usd", 0))
            .withColumn("route_label", route_label("waypoints", "origin_hub", "destination_hub")))


class InvalidScenario(ValueError):
    """A scenario outside the request model's bounds (the endpoint's 422)."""


def simulate(spark, scenario: dict, routes: DataFrame, carriers: DataFrame, events: DataFrame,
             grain: str = "event") -> list[dict]:
    """One what-if request, as the endpoint answers it: at most 10 route
    options ordered by cost, each with its waypoints list (null -> empty).

    Runs the same ``score_routes`` plan on a one-row scenario frame; the
    result is bounded by the top-10, so collecting it is safe.
    """
    row = (0, scenario.get("origin_hub"), scenario.get("destination_hub"),
           None if scenario.get("cargo_weight_kg") is None else float(scenario["cargo_weight_kg"]),
           list(scenario.get("carrier_ids") or []), scenario.get("max_transit_days"),
           scenario.get("avoid_anomaly_routes"))
    frame = spark.createDataFrame([row], "scenario_id long, origin_hub string, destination_hub string, "
                                         "cargo_weight_kg double, carrier_ids array<string>, "
                                         "max_transit_days int, avoid_anomaly_routes boolean")
    [check] = validate_scenarios(frame).select("reject_reason").collect()
    if check.reject_reason is not None:
        raise InvalidScenario(f"invalid {check.reject_reason}")
    options = (score_routes(frame, routes, carriers, events, grain=grain)
               .orderBy("estimated_cost_usd", "route_id", F.col("event_time").desc(),
                        F.col("event_id").desc())
               .select("route_id", "carrier_id", "carrier_name", "estimated_transit_days",
                       "estimated_cost_usd", "anomaly_risk_score", "waypoints", "is_recommended"))
    return [r.asDict() for r in options.collect()]
