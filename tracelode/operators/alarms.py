"""Rule replay: alarms with a cooldown, and how well they foretell outages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelode.functions.columns import thinned

DAY = 24 * 3_600_000_000


def raised(stream: DataFrame, codes: DataFrame, cooldown: int = DAY) -> DataFrame:
    """(entity_id, us) of alarms: events of the codes at least a cooldown after the last alarm raised."""
    return thinned(stream.join(codes.select("item"), "item", "left_semi"), ["entity_id"], cooldown)


def raised_elsewhere(stream: DataFrame, kind: str, horizon: int, cooldown: int = DAY, least: int = 5, factor: float = 3.0) -> DataFrame:
    """(entity_id, us) of alarms whose codes were learned from all other entities: an item is a code for an entity where
    it fired `least` times elsewhere and its share followed by a failure within (t, t + horizon] is factor times that of
    all firings elsewhere. Counts elsewhere are the totals less the entity's own, so there is no scan per entity."""
    order = Window.partitionBy("entity_id").orderBy("us").rangeBetween(1, horizon)
    marked = stream.withColumn("hit", F.coalesce(F.max((F.col("event_type") == kind).cast("int")).over(order), F.lit(0))).where(F.col("event_type") != kind)
    own = marked.groupBy("entity_id", "item").agg(F.count("*").alias("f"), F.sum("hit").alias("h"))
    items = own.groupBy("item").agg(F.sum("f").alias("tf"), F.sum("h").alias("th"))
    entities = own.groupBy("entity_id").agg(F.sum("f").alias("ef"), F.sum("h").alias("eh"))
    every = own.agg(F.sum("f").alias("af"), F.sum("h").alias("ah"))  # one row
    rate, base = F.try_divide(F.col("th") - F.col("h"), F.col("tf") - F.col("f")), F.try_divide(F.col("ah") - F.col("eh"), F.col("af") - F.col("ef"))
    codes = own.join(items, "item").join(entities, "entity_id").crossJoin(F.broadcast(every)).where((F.col("tf") - F.col("f") >= least) & (rate >= factor * base))
    return thinned(stream.join(codes.select("entity_id", "item"), ["entity_id", "item"], "left_semi"), ["entity_id"], cooldown)


def judged(alarms: DataFrame, outages: DataFrame, horizon: int = DAY) -> tuple[DataFrame, DataFrame]:
    """Alarms with lead (to the next outage within (t, t + horizon]) and outages with detected (an alarm in [o - horizon, o]).

    Both are one pass over the union in time order; at equal times an alarm detects but doesn't foretell."""
    both = alarms.select("entity_id", "us", F.lit(1).alias("alarm")).unionByName(outages.select("entity_id", "us", F.lit(0).alias("alarm")))
    by = Window.partitionBy("entity_id").orderBy("us")
    after = F.min(F.when(F.col("alarm") == 0, F.col("us"))).over(by.rangeBetween(1, horizon))
    before = F.max(F.when(F.col("alarm") == 1, F.col("us"))).over(by.rangeBetween(-horizon, 0))
    told = both.withColumns({"next": after, "prior": before})
    return (
        told.where("alarm = 1").select("entity_id", "us", (F.col("next") - F.col("us")).alias("lead")),
        told.where("alarm = 0").select("entity_id", "us", F.col("prior").isNotNull().alias("detected")),
    )


def metrics(alarms: DataFrame, outages: DataFrame) -> DataFrame:
    """Alarms, precision, outages, recall and the median lead in minutes."""
    a = alarms.agg(F.count("*").alias("alarms"), F.count("lead").alias("true_alarms"), F.percentile(F.col("lead") / 6e7, 0.5).alias("median_lead_min"))
    o = outages.agg(F.count("*").alias("outages"), F.count_if("detected").alias("detected"))
    return a.crossJoin(o).select("*", F.try_divide("true_alarms", "alarms").alias("precision"), F.try_divide("detected", "outages").alias("recall"))


def burden(alarms: DataFrame, outages: DataFrame, stream: DataFrame) -> DataFrame:
    """What alarms cost and give: false ones per entity and month of 30 days, alarms per outage, quartiles of the lead in
    minutes, and the shares of leads of at least ten minutes, an hour, six hours and a day (nulls without leads)."""
    lead = F.col("lead") / 6e7
    long = {"lead_10min": 10, "lead_1h": 60, "lead_6h": 360, "lead_24h": 1440}
    a = alarms.agg(F.count("*").alias("alarms"), F.count_if(F.col("lead").isNull()).alias("false_alarms"), F.percentile(lead, [0.25, 0.5, 0.75]).alias("q"), *[F.avg(F.when(F.col("lead").isNotNull(), (lead >= m).cast("double"))).alias(k) for k, m in long.items()])
    o = outages.agg(F.count("*").alias("outages"))
    months = stream.groupBy("entity_id").agg(((F.max("us") - F.min("us")) / DAY / 30).alias("m")).agg(F.sum("m").alias("months"))
    rates = {"false_per_month": F.try_divide("false_alarms", "months"), "alarms_per_outage": F.try_divide("alarms", "outages"), **{f"lead_p{p}": F.get("q", i) for i, p in enumerate((25, 50, 75))}}
    return a.crossJoin(o).crossJoin(months).select("alarms", "false_alarms", "outages", *[v.alias(k) for k, v in rates.items()], *long)  # one row each
