"""Hand-made cases of the operators' edges."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from tracelode.functions import columns as C
from tracelode.operators import alarms, chains, evaluation, features, mining, stats, windows
from tracelode.sources import formats

H, M = 3_600_000_000, 60_000_000
STREAM = "entity_id long, us long, ordinal long, event_type string, event_subtype string, item string"


def stream(spark, rows):
    """(entity, us, type)"""
    return spark.createDataFrame([(e, t, i, k, "x", f"{k}:x") for i, (e, t, k) in enumerate(rows)], STREAM)


def anchors(spark, rows):
    return spark.createDataFrame(rows, "entity_id long, anchor long, is_failure boolean")


def wins(spark, rows):
    return spark.createDataFrame([(str(i), i % 3, f, x, sorted(set(x))) for i, (f, x) in enumerate(rows)], "window_id string, entity_id long, is_failure boolean, items array<string>, item_set array<string>")


def test_events_tied_with_the_anchor_are_left_out(spark):
    s = stream(spark, [(1, 10 * H, "a"), (1, 10 * H, "fail"), (1, 10 * H - 1_000_000, "b")])
    (w,) = windows.count_windows(s.where("event_type <> 'fail'"), anchors(spark, [(1, 10 * H, True)]), 5).collect()
    assert w["items"] == ["b:x"] and w["n_events"] == 1


def test_empty_windows_stay(spark):
    s, a = stream(spark, [(2, 5 * H, "a")]), anchors(spark, [(1, 9 * H, True)])
    (w,) = windows.count_windows(s, a, 5).collect()
    assert (w["n_events"], w["last_us"], w["window_start"], w["items"]) == (0, None, 9 * H, [])
    (w,) = windows.time_windows(s, a, 6).collect()
    assert (w["n_events"], w["last_us"], w["window_start"]) == (0, None, 3 * H)


def test_time_windows_are_half_open(spark):
    s = stream(spark, [(1, 4 * H, "first"), (1, 10 * H, "last"), (1, 4 * H - 1, "before")])
    (w,) = windows.time_windows(s, anchors(spark, [(1, 10 * H, True)]), 6).collect()
    assert w["items"] == ["first:x"]


def test_ties_have_an_order(spark):
    s = stream(spark, [(1, H, "b"), (1, H, "a"), (1, H, "c")])
    (w,) = windows.count_windows(s, anchors(spark, [(1, 2 * H, True)]), 2).collect()
    assert w["items"] == ["a:x", "c:x"]


def test_controls_are_farther_than_the_margin(spark):
    s = stream(spark, [(1, t * H, "fail" if t in (50, 120) else "a") for t in range(0, 200)])
    fails = windows.failure_anchors(s, "fail")
    got = [r.anchor for r in windows.control_anchors(s, fails, 6 * H).collect()]
    assert len(got) == 6 and all(abs(a - f * H) > 6 * H for a in got for f in (50, 120)) and all(6 * H <= a < 194 * H for a in got)


def test_episodes_merge_gaps_up_to_the_limit(spark):
    got = windows.episodes(stream(spark, [(1, 0, "e"), (1, 60 * M, "e"), (1, 121 * M, "e")]), "e", 60 * M).collect()
    assert sorted((r.anchor, r.n) for r in got) == [(0, 2), (121 * M, 1)]


def test_risk_sets_hold_those_watched_as_long(spark):
    subjects = spark.createDataFrame([(1, 10, 1), (2, 9, 0), (3, 10, 0), (4, 11, 0)], "entity_id long, length long, failed int")
    got = {(r.entity_id, r.is_case) for r in windows.risk_sets(subjects).collect()}
    assert got == {(1, 1), (3, 0), (4, 0)}


@pytest.mark.parametrize(("seq", "pattern", "want"), [("abac", "ac", True), ("abac", "ca", False), ("a", "aa", False), ("", "a", False), ("abc", "", True), ("aab", "aab", True)])
def test_subsequences(spark, seq, pattern, want):
    df = spark.createDataFrame([(list(seq), list(pattern))], "s array<string>, p array<string>")
    assert df.select(C.holds_in_order(F.col("s"), F.col("p"))).first()[0] is want


def test_denominators_of_mining(spark):
    w = wins(spark, [(True, ["a"] if i == 0 else ["b"]) for i in range(10)] + [(True, [])] * 10)
    assert {tuple(r.itemset): r.n_failure for r in mining.itemsets(w, 0.05).collect()} == {("a",): 1, ("b",): 9}
    assert {tuple(r.sequence) for r in mining.sequences(w, 0.1).collect()} == {("a",), ("b",)}
    assert {tuple(r.itemset) for r in mining.itemsets(w, 0.1).collect()} == {("b",)}


def test_hypergeometric_tail(spark):
    cases = [(30, 10, 100, 300, 2.257648513662e-12), (25, 75, 100, 300, 0.548635712417), (0, 5, 100, 300, 1), (100, 300, 100, 300, 1), (12, 20, 100, 300, 0.071869077681)]
    df = spark.createDataFrame([c[:4] for c in cases], "n_failure long, n_control long, all_failure long, all_control long")
    for r, (*_, want) in zip(stats.with_p(df).collect(), cases, strict=True):
        assert math.isclose(r.p, want, rel_tol=1e-9)


def test_q_values_do_not_depend_on_the_order_of_ties(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.04, 0.01, 0.5, 0.01])], "i int, p double")
    got = {r.i: round(r.q, 4) for r in stats.with_q(df).collect()}
    assert got == {1: 0.02, 3: 0.02, 0: 0.0533, 2: 0.5}
    by = {r.i: r.q for r in stats.with_q(df, dependent=True).collect()}
    assert math.isclose(by[1], min(1, 0.02 * (1 + 1 / 2 + 1 / 3 + 1 / 4)))


def test_closed_patterns(spark):
    df = spark.createDataFrame([(["a"], 5), (["a", "b"], 5), (["b"], 6)], "itemset array<string>, n_failure long")
    assert {tuple(r.itemset) for r in mining.closed(df, "itemset").collect()} == {("a", "b"), ("b",)}


def test_refractory_times(spark):
    df = spark.createDataFrame([("a", t) for t in (8, 0, 3, 5, 0)] + [("b", 4), (None, 7)], "k string, us long")
    assert sorted(map(tuple, C.thinned(df, ["k"], 4).collect()), key=repr) == [("a", 0), ("a", 5), ("b", 4), (None, 7)]


def test_alarms_cool_down(spark):
    s = stream(spark, [(1, t * H, "a") for t in (0, 20, 24, 47)])
    got = alarms.raised(s, spark.createDataFrame([("a:x",)], "item string"), 24 * H)
    assert sorted(r.us for r in got.collect()) == [0, 24 * H]


def test_an_alarm_at_the_outage_detects_but_does_not_foretell(spark):
    at = spark.createDataFrame([(1, 5 * H)], "entity_id long, us long")
    a, o = alarms.judged(at, at, 24 * H)
    assert a.first().lead is None and o.first().detected is True
    r = alarms.metrics(a, o).first()
    assert (r.precision, r.recall) == (0.0, 1.0)


def test_surprises(spark):
    rows = [(1, i, i, v) for i, v in enumerate([0.0, 1.0, 2.0, 3.0, 13.0])]
    got = features.surprises(spark.createDataFrame(rows, "entity_id long, us long, ordinal long, f double"), ["f"]).collect()
    assert [(r.us, r.step) for r in got] == [(4, 10.0)]


def test_shuffles_keep_items_and_labels_keep_sizes(spark):
    w = wins(spark, [(i % 4 == 0, list("abcab"[: i % 6])) for i in range(40)])
    mixed = {r.window_id: sorted(r["items"]) for r in mining.shuffled(w, 3).collect()}
    assert mixed == {r.window_id: sorted(r["items"]) for r in w.collect()}
    assert mining.relabelled(w, 3).where("is_failure").count() == 10


def test_many_patterns_match_as_few_do(spark, monkeypatch):
    w = wins(spark, [(i % 2 == 0, list("abcde"[i % 3 :: 1 + i % 2])) for i in range(30)])
    sets, seqs = mining.itemsets(w), mining.sequences(w)
    few = [sorted((r.window_id, tuple(r[p])) for r in f(w, x).collect()) for f, x, p in ((mining.set_hits, sets, "itemset"), (mining.sequence_hits, seqs, "sequence"))]
    monkeypatch.setattr(mining, "BROADCAST_PATTERNS", 1)
    many = [sorted((r.window_id, tuple(r[p])) for r in f(w, x).collect()) for f, x, p in ((mining.set_hits, sets, "itemset"), (mining.sequence_hits, seqs, "sequence"))]
    assert few == many and few[0]


def test_matched_hazard_of_pairs(spark):
    """For pairs that differ, the ratio is that of the discordant counts."""
    rows = [("p", 2, 1, 1)] * 30 + [("p", 2, 1, 0)] * 10 + [("p", 2, 0, 0)] * 5 + [("p", 2, 2, 1)] * 5
    r = stats.matched_hazard(spark.createDataFrame(rows, "pattern string, n int, t int, x int")).first()
    assert math.isclose(r.hazard_ratio, 3.0, rel_tol=1e-9) and r.strata == 40
    se = math.sqrt(1 / 30 + 1 / 10)
    assert math.isclose(r.hr_low, math.exp(math.log(3) - 1.96 * se), rel_tol=1e-9)
    assert math.isclose(r.p, math.erfc(math.log(3) / se / math.sqrt(2)), rel_tol=1e-8)


def test_special_functions(spark):
    df = spark.createDataFrame([(x,) for x in (0.5, 1.0, 2.0, 7.3, 100.0, 1e6)], "x double")
    for r in df.select("x", C.ln_gamma(F.col("x")).alias("g"), C.erfc(F.col("x") / 20).alias("e"), C.erfc(F.lit(3.5)).alias("e2")).collect():
        assert math.isclose(r.g, math.lgamma(r.x), rel_tol=1e-11, abs_tol=1e-11)
        assert r.x > 100 or math.isclose(r.e, math.erfc(r.x / 20), rel_tol=1e-6, abs_tol=1e-12)
        assert math.isclose(r.e2, math.erfc(3.5), rel_tol=1e-9)


def test_auroc_and_average_precision(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1)], "label int, score double")
    assert evaluation.auroc(rows).first().auroc == (1 + 1 + 0.5 + 1) / 4
    assert math.isclose(evaluation.average_precision(rows).first().average_precision, (1 + 2 / 3) / 2)


def test_machine_tables(spark, tmp_path):
    files = {
        "telemetry": "datetime,machineID,volt,rotate,pressure,vibration\n2015-01-01 06:00:00,1,1.5,2,3,4\n",
        "errors": "datetime,machineID,errorID\n2015-01-03 07:00:00,1,error1\n",
        "maint": "datetime,machineID,comp\n2015-01-05 06:00:00,1,comp4\n2015-01-06 06:00:00,1,comp2\n",
        "failures": "datetime,machineID,failure\n2015-01-05 06:00:00,1,comp4\n",
        "machines": "machineID,model,age\n1,model3,18\n",
    }
    for k, v in files.items():
        (tmp_path / f"PdM_{k}.csv").write_text(v)
    got = {(r.event_type, r.event_subtype) for r in formats.machine_events(formats.machine_tables(spark, str(tmp_path))).collect()}
    assert got == {("software_error", "error1"), ("component_replacement", "comp4"), ("maintenance", "comp2"), ("terminal_failure", "comp4")}
    (tmp_path / "PdM_errors.csv").unlink()
    with pytest.raises(Exception):  # noqa: B017
        formats.machine_tables(spark, str(tmp_path))["errors"].count()


def test_batch_tasks(spark, tmp_path):
    (tmp_path / "t.csv").write_text("M1_2,1,j1,A,Failed,50,0,1,1\n123,1,j2,A,Terminated,1,70,1,1\nx,1,j3,A,Odd,1,2,1,1\n")
    got = formats.task_events(formats.batch_tasks(spark, str(tmp_path / "t.csv"))).orderBy("entity_id").collect()
    epoch = dt.datetime(2018, 1, 1)
    assert [tuple(r) for r in got] == [("j1", epoch + dt.timedelta(seconds=50), "task_failure", "M"), ("j2", epoch + dt.timedelta(seconds=70), "task_success", "OTHER")]


def test_system_log(spark, tmp_path):
    lines = [
        "- 1117838570 2005.06.03",
        "KERNMNTF 1117838571 2005.06.03 R02-M1 2005-06-03 R02-M1 RAS KERNEL FATAL some text here",
        "- 1117838572 2005.06.03 R03-M1 2005-06-03 R03-M1 RAS KERNEL INFO instruction cache",
        "- 1117838573 2005.06.03 R03-M1 2005-06-03 R03-M1 RAS KERNEL ODD x",
        "- 1117838574 2005.06.03 bad 2005-06-03 bad RAS KERNEL INFO x",
        "- notatime 2005.06.03 R03-M1 2005-06-03 R03-M1 RAS KERNEL INFO x",
    ]
    (tmp_path / "l.log").write_text("\n".join(lines) + "\n")
    rows = formats.system_log(spark, str(tmp_path / "l.log"))
    got = sorted((r.entity_id, r.event_type, r.event_subtype) for r in formats.log_events(rows).collect())
    assert got == [("R02", "terminal_alert", "KERNMNTF"), ("R03", "system_info", "KERNEL:INFO")] and rows.where("malformed").count() == 3


def test_turbine_status(spark, tmp_path):
    head = "".join(f"# preamble {i}\n" for i in range(9)) + "Timestamp start,Timestamp end,Duration,Status,Code,Message,IEC category\n"
    (tmp_path / "Status_Farm_3_2016.csv").write_text(head + '2016-01-01 00:00:00,2016-01-01 01:00:00,1,Stop,10,"halt, now",Forced outage\n2016-01-02 00:00:00,,,Odd,11,m,Full Performance\n2016-01-03 00:00:00,,,Warning,12,m,\n')
    got = sorted((r.entity_id, r.event_type, r.event_subtype) for r in formats.turbine_events(formats.turbine_status(spark, str(tmp_path))).collect())
    assert got == [("T3", "system_stop", "10"), ("T3", "system_warning", "12"), ("T3", "terminal_failure", "10")]


def test_patient_hours(spark, tmp_path):
    (tmp_path / "p000007.psv").write_text("HR|Temp|ICULOS|SepsisLabel\n101|NaN|1|0\n100|35.9|2|1\nNaN|NaN|3|1\n")
    (tmp_path / "p000009.psv").write_text("HR|Temp|ICULOS|SepsisLabel\n50|37|1|0\n")
    hours = formats.patient_hours(spark, str(tmp_path), ["HR", "Temp"])
    got = sorted((r.entity_id, r.timestamp, r.event_type, r.event_subtype) for r in formats.threshold_events(hours).collect())
    base = dt.datetime(2015, 1, 1) + dt.timedelta(hours=7)
    h = dt.timedelta(hours=1)
    assert got == [(7, base + h, "HR", "high"), (7, base + 2 * h, "Temp", "low"), (7, base + 2 * h, "terminal_failure", "sepsis"), (9, base + 3 * h, "HR", "low")]
    assert formats.patient_hours(spark, str(tmp_path), ["HR"], limit=1).select("patient").distinct().collect()[0][0] == 7


def test_cross_section_and_scada(spark, tmp_path):
    (tmp_path / "aps.csv").write_text("licence text\n" * 20 + "class,aa_000,ab_000\npos,1,na\nneg,2.5,3\n")
    got = sorted(tuple(r) for r in formats.labelled_cross_section(spark, str(tmp_path / "aps.csv")).collect())
    assert got == [(0, 2.5, 3.0), (1, 1.0, 0.0)]
    (tmp_path / "s.csv").write_text("# Date and time,Power (kW),Other\n2016-01-02 00:00:00,5,x\n2016-01-01 00:00:00,,y\n")
    rows = formats.scada(spark, str(tmp_path / "s.csv"), ["Power (kW)"]).collect()
    assert [r["Power (kW)"] for r in rows] == [None, 5.0]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a")], "x int, y string")
    formats.write_parquet(df, f"{tmp_path}/p")
    formats.write_stats({"n": 1, "when": dt.date(2020, 1, 1)}, df, f"{tmp_path}/j")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 1 and spark.read.text(f"{tmp_path}/j").first()[0] == '{"n": 1, "when": "2020-01-01"}'
    assert formats.markdown(df, 5).splitlines()[0] == "| x | y |"


def test_streams(spark, tmp_path):
    from tracelode.streaming import sessions

    t = dt.datetime(2024, 1, 1)
    rows = [(1, t), (1, t + dt.timedelta(minutes=30)), (1, t + dt.timedelta(hours=3)), (1, t + dt.timedelta(days=2)), (2, t + dt.timedelta(days=3))]
    spark.createDataFrame(rows, "entity_id long, time timestamp").write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("entity_id long, time timestamp").parquet(f"{tmp_path}/in")
    for name, df, mode in (("s", sessions.session_counts(source, "time", "entity_id"), "append"), ("a", sessions.cooldown_alarms(source, "time", "entity_id"), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
    assert sorted((r.entity_id, r.n) for r in spark.table("s").collect())[:3] == [(1, 1), (1, 1), (1, 2)]
    assert sorted((r.entity_id, r.time) for r in spark.table("a").collect()) == [(1, t), (1, t + dt.timedelta(days=2)), (2, t + dt.timedelta(days=3))]


def test_readouts_end_in_a_repair(spark, tmp_path):
    steps = [0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 30]
    (tmp_path / "r.csv").write_text("vehicle_id,time_step,a.b,c\n" + "".join(f"1,{i}.5,{v},\n" for i, v in enumerate(steps)) + "2,0.0,1,1\n3,4.0,,\n")
    (tmp_path / "s.csv").write_text("vehicle_id,length_of_study_time_step,in_study_repair\n1,12,1\n2,3,0\n4,1,1\n")
    rows = formats.counter_events(formats.counter_tables(spark, str(tmp_path / "r.csv"), str(tmp_path / "s.csv"))).collect()
    day = dt.datetime(2019, 1, 12, 12)
    assert sorted(map(tuple, rows)) == [(1, day, "counter_surprise", "a.b"), (1, day, "terminal_repair", "repair")]


def seqs(spark, rows):
    """(is_failure, [(minute, item)]) with the anchor at minute 100"""
    return spark.createDataFrame([(str(i), 100 * M, f, [(t * M, x) for t, x in seq]) for i, (f, seq) in enumerate(rows)], "window_id string, anchor long, is_failure boolean, seq array<struct<us: long, item: string>>")


def test_chains_are_scored_against_their_last_item(spark):
    case = (True, [(10, "a"), (20, "a"), (30, "b"), (40, "x"), (60, "c"), (90, "c")])
    rows = chains.merged(seqs(spark, [case] * 4 + [(True, [(1, "c")]), (True, []), (False, [(5, "c"), (6, "b"), (7, "a")]), (False, [(5, "a"), (6, "b")])] + [(False, [(50, "x")])] * 4))
    assert rows.count() == 11
    picked = {tuple(r.chain) for r in chains.candidates(rows).collect()}
    assert {("a", "b", "c"), ("a", "b", "x", "c")} <= picked and ("c", "b", "a") not in picked
    scored = chains.scores(rows, chains.candidates(rows))
    (r,) = scored.where("chain = array('a', 'b', 'c')").collect()
    assert (r.n_failure, r.n_control, r.median_span_min, r.median_lead_min, r.last_controls, r.last_lead_min, r.incremental) == (4, 0, 50.0, 40.0, 1, 40.0, True)
    assert [r.chain for r in chains.best(scored, alpha=1.1).collect()] == [["a", "b", "x", "c"]]
    assert chains.scores(rows, chains.candidates(rows).where("false")).count() == 0
