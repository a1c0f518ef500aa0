"""Sustained congestion events, matched controls, and the profile of speeds around both.

An event is the start of a congested run of at least ``min_steps`` steps with valid ratios from ``before`` steps ahead of
it to ``after`` steps behind it. Its control is the nearest time of the same sensor, weekend flag and slot whose
surroundings are valid and free of congestion, each taken once as long as unused ones are left; events choose in the
order of time, and of two equally near times the earlier is taken.

``centred`` tests a control's surroundings on equally many steps on both sides, as the figures to match do, so a
control's earliest steps may be missing and then make a profile cell NULL; without it the whole window is tested.

A sensor's events of one slot and day type form a group, which holds at most one cell a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgrid.functions.columns import congested, is_weekend, slot_of_day
from loomgrid.functions.lineage import checkpoint
from loomgrid.operators.patterns import free_flow, with_ratio
from loomgrid.operators.quantiles import many_quantiles
from loomgrid.operators.windows import by_time, owned, runs, with_halo


def surroundings(grid: DataFrame, threshold: float, step_minutes: int, min_steps: int, before: int, after: int, centred: bool) -> DataFrame:
    """Every cell with its window of ratios, and whether it is an event or may be a control."""
    state = with_ratio(grid, free_flow(grid)).withColumn("congested", congested(F.col("ratio"), threshold))
    state = runs(state, "congested").withColumn("fine", F.col("ratio").isNotNull() & ~F.col("congested"))
    reach = (before + after + 1) // 2
    w = by_time()
    window = F.array(*(F.lag("ratio", -k).over(w) for k in range(-before, after + 1)))
    size = before + after + 1
    frame = w.rowsBetween(-reach, reach) if centred else w.rowsBetween(-before, after)
    near = with_halo(state, max(before, reach), max(after, reach)).select(
        "*", window.alias("around"), F.count("*").over(w.rowsBetween(-before, after)).alias("room"), F.count_if("fine").over(frame).alias("fine_around")
    )
    whole, fine_steps = F.col("room") == size, 2 * reach + 1 if centred else size
    event = F.col("congested") & (F.col("t") == F.col("run_start")) & (F.col("run_steps") >= min_steps) & whole & (F.size(F.filter("around", lambda r: r.isNotNull())) == size)
    return owned(near.withColumn("is_event", event).withColumn("is_control", whole & (F.col("fine_around") == fine_steps))).select(
        "sensor_id", "ts", "t", "around", "is_event", "is_control", is_weekend(F.col("ts")).alias("is_weekend"), slot_of_day(F.col("ts"), step_minutes).alias("time_slot")
    )


def matched_controls(cells: DataFrame) -> DataFrame:
    """sensor_id, event_t, control_t (NULL without any control) and whether the control was taken before."""
    key = ["sensor_id", "is_weekend", "time_slot"]
    marked = cells.where("is_event or is_control")
    groups = marked.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("is_event"), F.col("t")))).alias("events"), F.sort_array(F.collect_list(F.when(F.col("is_control"), F.col("t")))).alias("controls"))

    def nearest(times, event):
        return F.array_min(F.transform(times, lambda c: F.struct(F.abs(c - event).alias("gap"), c.alias("t"))))["t"]

    def choose(state, event):
        unused = nearest(F.array_except(F.col("controls"), state["used"]), event)
        picked = F.coalesce(unused, nearest(F.col("controls"), event))
        pick = F.struct(event.alias("event_t"), picked.alias("control_t"), (unused.isNull() & picked.isNotNull()).alias("is_reused"))
        used = F.when(unused.isNull(), state["used"]).otherwise(F.concat(state["used"], F.array(unused)))
        return F.struct(used.alias("used"), F.concat(state["picks"], F.array(pick)).alias("picks"))

    start = F.struct(F.array().cast("array<bigint>").alias("used"), F.array().cast("array<struct<event_t:bigint,control_t:bigint,is_reused:boolean>>").alias("picks"))
    chosen = groups.where(F.size("events") > 0).select("sensor_id", F.explode(F.aggregate("events", start, choose)["picks"]).alias("pick"))
    return chosen.select("sensor_id", "pick.event_t", "pick.control_t", "pick.is_reused")


def event_profile(grid: DataFrame, threshold: float = 0.60, step_minutes: int = 60, min_steps: int = 3, before: int = 12, after: int = 6, centred: bool = True) -> DataFrame:
    """Quartiles of event and control ratios at each offset over the matched events; NULL where a member is missing."""
    cells = checkpoint(surroundings(grid, threshold, step_minutes, min_steps, before, after, centred).where("is_event or is_control"))  # pairs and both their sides read it
    pairs = matched_controls(cells).where("control_t is not null")
    event, control = (cells.select("sensor_id", F.col("t").alias(f"{k}_t"), F.col("around").alias(k)) for k in ("event", "control"))
    both = pairs.join(event, ["sensor_id", "event_t"]).join(control, ["sensor_id", "control_t"])
    rows = both.select(F.posexplode(F.arrays_zip("event", "control")).alias("k", "r")).select((F.col("k") - before).alias("offset_steps"), "r.event", "r.control")
    rows = checkpoint(rows)  # read for the counts and for the quantiles
    q = many_quantiles(rows, ["offset_steps"], {name: (F.col(c), [0.25, 0.5, 0.75]) for name, c in (("q_e", "event"), ("q_c", "control"))})
    out = rows.groupBy("offset_steps").agg(F.count("*").alias("events"), *((F.count(c) == F.count("*")).alias(f"all_{c[0]}") for c in ("event", "control")))
    out = out.join(q, "offset_steps", "left")
    out = out.select("offset_steps", "events", *(F.when(F.col(f"all_{c}"), F.col(f"q_{c}")).alias(c) for c in "ec"))
    r = lambda c, name: F.round(c, 6).alias(name)
    return out.select(
        F.col("offset_steps").cast("bigint").alias("offset_steps"), (F.col("offset_steps") * step_minutes).cast("bigint").alias("offset_minutes"), "events",
        *(r(F.col(s)[i], f"{name}_{p}") for s, name in (("e", "event"), ("c", "control")) for i, p in enumerate(("p25", "median", "p75"))),
    )
