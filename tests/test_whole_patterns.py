"""Itemsets of every size are tested, with draws counted as by the plain join of hits and labels."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracelode.functions.columns import draw
from tracelode.operators import mining, stats
from tracelode.plans import catalogue as Q

SF = "/root/testdata/sf0.001"


def test_itemsets_of_every_size(spark):
    w = Q.last_windows(spark, SF).cache()
    want = {tuple(r.itemset) for r in mining.itemsets(w).collect()}
    assert max(map(len, want)) > 2
    for p in (stats.within_entity_p(Q.all_hits(w), w, "itemset", draws=3), stats.leave_one_out(Q.all_hits(w), w, "itemset"), stats.min_p(Q.all_hits(w), w, "itemset", draws=3)):
        assert {tuple(r.itemset) for r in p.collect()} == want
    assert {tuple(r.itemset.split("|")) for r in Q.queries()["loeo"](spark, SF).collect()} == want


def test_draws_as_by_the_plain_join(spark):
    w = Q.last_windows(spark, SF).cache()
    hits = Q.all_hits(w).cache()
    labels = w.select("window_id", "entity_id").withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(7))))
    within = labels.join(w.groupBy("entity_id").agg(F.count_if("is_failure").alias("f")), "entity_id").withColumn("place", F.row_number().over(Window.partitionBy("entity_id", "b").orderBy(draw("window_id", "b"), "window_id"))).where("place <= f")
    real = {tuple(r.itemset): r.n for r in hits.groupBy("itemset").agg(F.count_if("is_failure").alias("n")).collect()}
    drawn = {(tuple(r.itemset), r.b): r["count"] for r in hits.select("itemset", "window_id").join(within, "window_id").groupBy("itemset", "b").count().collect()}
    want = {p: (1 + sum(drawn.get((p, b), 0) >= n for b in range(1, 8))) / 8 for p, n in real.items()}
    assert {tuple(r.itemset): r.p_within for r in stats.within_entity_p(hits, w, "itemset", draws=7).collect()} == want
    n = w.where("is_failure").count()
    placed = labels.withColumn("place", F.row_number().over(Window.partitionBy("b").orderBy(draw("window_id", "b"), "window_id"))).select("window_id", "b", (F.col("place") <= n).alias("fails"))
    sizes = w.agg(F.count_if("is_failure").alias("all_failure"), F.count_if(~F.col("is_failure")).alias("all_control"))
    null = hits.select("itemset", "window_id").join(placed, "window_id").groupBy("b", "itemset").agg(F.count_if("fails").alias("n_failure"), F.count_if(~F.col("fails")).alias("n_control"))
    least = [r.p for r in stats.with_p(null.crossJoin(sizes)).groupBy("b").agg(F.min("p").alias("p")).collect()]
    for r in stats.min_p(hits, w, "itemset", draws=7).collect():
        assert abs(r.p_adjusted - sum(x <= r.p + 1e-12 for x in least) / 7) < 1e-9
