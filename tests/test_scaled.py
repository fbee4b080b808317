"""Operators that split hot entities, count instead of copying windows, and read files by their own headers."""

import os

import pytest
from pyspark.sql import functions as F

from tracelode.operators import evaluation, stats, windows
from tracelode.plans import catalogue
from tracelode.sources import formats
from tracelode.sources import tables as T

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("most", [7, 40, 100_000])
def test_segments(spark, most):
    """One entity has 90 % of the events, many of them at one time; ranges, empty ones too, give what the whole does."""
    rows = [(0 if i % 10 else i % 30, (i * 37 % 1000 // 3) if i % 4 else 500, i, f"x{i % 5}") for i in range(400)]
    stream = spark.createDataFrame(rows, "entity_id int, us long, ordinal long, item string")
    anchors = spark.createDataFrame([(e, t, True) for e in (0, 10, 20, 99) for t in (-5, 0, 1, 17, 170, 333, 400, 500, 501, 5000)], "entity_id int, anchor long, is_failure boolean")
    plain = lambda df: sorted((r.entity_id, r.anchor, tuple(x.ordinal for x in r.seq)) for r in df.collect())
    assert plain(windows.last_seqs_in_segments(stream, anchors, 6, most)) == plain(windows.last_seqs(stream, anchors, 6))


def test_segments_are_even(spark):
    stream = spark.range(20_000).select(F.lit(0).alias("entity_id"), (F.col("id") * 13 % 20_011).alias("us"), F.col("id").alias("ordinal"))
    cuts = windows.segments(stream, stream, 1000)
    sizes = [r["count"] for r in stream.join(cuts, "entity_id").withColumn("s", F.size(F.filter("bounds", lambda b: b < F.col("us")))).groupBy("s").count().collect()]
    assert len(sizes) == 20 and max(sizes) <= 2 * sorted(sizes)[10] and sum(sizes) == 20_000


@needs_tables
def test_counts_agree_with_copies(spark):
    """p from counts within the binomial error of p from permuted copies; the same adjusted p."""
    w = catalogue.kept_windows(spark, SF)
    hits = catalogue.all_hits(w)
    hits.cache()
    old = {tuple(r.itemset): r for r in stats.within_entity_p(hits, w, "itemset", 2000).collect()}
    new = {tuple(r.itemset): r for r in stats.within_entity_counts(hits, w, "itemset", 2000).collect()}
    assert old.keys() == new.keys()
    for k, r in old.items():
        assert r.case_hits == new[k].case_hits and abs(r.p_within - new[k].p_within) < 0.003 + 5 * (2 * r.p_within * (1 - r.p_within) / 2000) ** 0.5
    old = {tuple(r.itemset): r for r in stats.min_p(hits, w, "itemset", 500).collect()}
    new = {tuple(r.itemset): r for r in stats.min_p_counts(hits, w, "itemset", 500).collect()}
    assert old.keys() == new.keys()
    for k, r in old.items():
        assert r.p == pytest.approx(new[k].p) and abs(r.p_adjusted - new[k].p_adjusted) < 0.01 + 5 * (2 * r.p_adjusted * (1 - r.p_adjusted) / 500) ** 0.5


def test_counts_of_planted_signal(spark):
    """An item in all failures of every entity is never reached by chance; one in every window always."""
    rows = [(f"{e}/{i}", e, i < 3, ["all", "bad"] if i < 3 else ["all"]) for e in range(8) for i in range(10)] + [("lone", 99, True, [])]
    w = spark.createDataFrame(rows, "window_id string, entity_id int, is_failure boolean, items array<string>")
    hits = w.select("window_id", "entity_id", "is_failure", F.explode("items").alias("item"))
    got = {r["item"]: (r.case_hits, r.p_within) for r in stats.within_entity_counts(hits, w, "item", 200).collect()}
    assert got == {"all": (24, 1.0), "bad": (24, 1 / 201)}
    adjusted = {r["item"]: r.p_adjusted for r in stats.min_p_counts(hits, w, "item", 100).collect()}
    assert adjusted["bad"] == 0 and adjusted["all"] == 1


def test_landmarks(spark):
    rows = [(1, 5, "a"), (1, 25, "a"), (1, 47, "fail"), (1, 90, "a"), (2, 10, "a"), (2, 30, "a"), (3, 7, "fail")]
    stream = spark.createDataFrame([(e, t, i, k) for i, (e, t, k) in enumerate(rows)], "entity_id int, us long, ordinal long, event_type string")
    got = sorted(map(tuple, windows.landmarks(stream, "fail", 10, 15).collect()))
    assert got == [(1, 10, False), (1, 20, False), (1, 30, False), (1, 40, True), (2, 20, False), (2, 30, False)]


def test_unranked():
    from itertools import combinations

    for n, k in ((6, 3), (7, 3), (1, 0), (5, 5), (0, 0)):
        every = [[i in c for i in range(n)] for c in combinations(range(n), k)]
        assert [evaluation.unranked(i, n, k) for i in range(len(every))] == every


def test_balanced_partitions(spark):
    few = spark.createDataFrame([(i,) for i in range(5)], "entity_id int")
    got = evaluation.balanced_partitions(few).groupBy("seed").agg(F.sort_array(F.collect_list(F.when(F.col("discovery"), F.col("entity_id")))).alias("half")).collect()
    assert sorted(tuple(r.half) for r in got) == [(i, j) for i in range(5) for j in range(i + 1, 5)]
    many = spark.range(400).withColumnRenamed("id", "entity_id")
    got = evaluation.balanced_partitions(many, 30).groupBy("seed").agg(F.count_if("discovery").alias("n"), F.sort_array(F.collect_list(F.when(F.col("discovery"), F.col("entity_id")))).alias("half")).collect()
    assert {r.n for r in got} == {200} and len({tuple(r.half) for r in got}) == 30
    spread = [sum(i in set(r.half) for r in got) for i in range(400)]
    assert 4 <= min(spread) and max(spread) <= 26


def test_partition_summary(spark):
    from tracelode.operators import samplers

    tests = spark.createDataFrame([(0, ["a"], 0.01), (0, ["b"], 0.01), (0, ["c"], 0.5), (1, ["a"], 0.01), (1, ["b"], 0.5), (2, ["a"], 0.9), (3, ["a"], 0.9)], "seed int, itemset array<string>, q double")
    got = samplers.partition_summary(tests, tests.select("seed")).first()
    assert (got.n_splits, got["median"], got.p25, got.p75) == (4, 0.25, 0.0, pytest.approx(0.541666666))
    assert got.mean_jaccard == pytest.approx((0.5 + 0 + 0 + 0 + 0 + 1) / 6)


def test_own_headers(spark, tmp_path):
    """Columns in another order, other preambles, quoted fields, a missing column; files without header are named."""
    (tmp_path / "Status_Farm_1_a.csv").write_text('# one\n# two, Status\n\nTimestamp start,Timestamp end,Status,Code,Message,IEC category\n2020-01-01 00:00:00,-,Stop,11,"a, b",Forced\n')
    (tmp_path / "Status_Farm_2_a.csv").write_text("Code,Status,Timestamp start\n7,Warning,2020-01-02 00:00:00\n\n8,Stop,2020-01-03 00:00:00\n")
    got = sorted((r.turbine, str(r.timestamp), r.status, r.code, r.message, r.category) for r in formats.turbine_status(spark, str(tmp_path)).collect())
    assert got == [(1, "2020-01-01 00:00:00", "Stop", "11", "a, b", "Forced"), (2, "2020-01-02 00:00:00", "Warning", "7", None, None), (2, "2020-01-03 00:00:00", "Stop", "8", None, None)]
    (tmp_path / "Status_Farm_3_a.csv").write_text("# nothing\n1,2,3\n")
    (tmp_path / "Status_Farm_4_a.csv").write_text("Status,Code\n")
    with pytest.raises(ValueError, match="Status_Farm_3_a.csv.*Status_Farm_4_a.csv"):
        formats.turbine_status(spark, str(tmp_path))


def test_own_headers_of_patients(spark, tmp_path):
    (tmp_path / "p1.psv").write_text("HR|Temp|ICULOS|SepsisLabel\n101|NaN|1|0\n")
    (tmp_path / "p2.psv").write_text("SepsisLabel|ICULOS|Temp\n1|3|36.5\n")
    (tmp_path / "p3.psv").write_text("broken\n")
    got = sorted((r.patient, r.hour, r.label, r.HR, r.Temp) for r in formats.patient_hours(spark, str(tmp_path), ["HR", "Temp"]).collect())
    assert got == [(1, 1, 0, 101.0, None), (2, 3, 1, None, 36.5)]
    assert [r.file.rsplit("/", 1)[1] for r in formats.headless(spark, str(tmp_path), ["ICULOS"], "|").collect()] == ["p3.psv"]
    with pytest.raises(ValueError, match="aps"):
        (tmp_path / "aps.csv").write_text("a,b\n1,2\n")
        formats.labelled_cross_section(spark, str(tmp_path / "aps.csv"))


@needs_tables
def test_events_of_ranges(spark):
    """The registered query has one entity with most events."""
    s = catalogue.stream(spark, SF)
    assert s.where(F.col("entity_id") % 10 < 9).count() > 0.8 * s.count() and s.where(F.col("event_type") == T.FAILURE).count() > 0
