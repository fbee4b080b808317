"""Queries at size: exact shares and ties, work that grows with the input only, and the same results in parts as in whole."""

from pyspark.sql import functions as F

from tracelode.operators import evaluation, stats


def test_share_of_entities_is_exact(spark):
    """As doubles, 0.7 of 90 is under 63."""
    rows = spark.range(90).withColumnRenamed("id", "entity_id")
    assert evaluation.entity_split(rows).where("train").count() == 63
    assert {r["count"] for r in evaluation.entity_splits(rows, 3).where("train").groupBy("seed").count().collect()} == {63}
    assert stats.split(rows, 1, share=0.7).where("discovery").count() == 63


def test_recency_map_rounds_exactly(spark, tmp_path):
    """Spans of half a millisecond, which no double has exactly, are rounded upwards by query and SQL."""
    import duckdb

    from tracelode.plans import catalogue

    start, users = 1_704_067_200_000_000, []
    con = duckdb.connect()
    con.execute("create table e (event_id bigint, us bigint, user_id bigint, event_type varchar, value double, props varchar)")
    for u, span in enumerate([133_530_153_500, 265_418_645_500, 66_533_481_500, 1_000_500, 2_500_000, 35_500_000]):
        users += [(3 * u, start, u, "view", 1.0, "{1}"), (3 * u + 1, start + span, u, "view", 1.0, "{1}"), (3 * u + 2, start + span + 500_000, u, "error", 1.0, "{1}")]
    con.executemany("insert into e values (?, ?, ?, ?, ?, ?)", users)
    con.execute(f"copy (select * exclude us, make_timestamp(us) as ts from e) to '{tmp_path}/events.parquet'")
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet'")
    got = sorted(map(tuple, catalogue.queries()["recency_map"](spark, str(tmp_path)).collect()))
    assert got == sorted(con.execute(catalogue.oracle_sql()["recency_map"]).fetchall()) and 133530.154 in {r[3] for r in got}


def test_equal_steps_are_no_surprise(spark):
    """Steps of 0.1, which as doubles differ in the last bit: none is above the quantile."""
    from tracelode.operators import features

    rows = [(1, i, i, round(i / 10, 1)) for i in range(40)]
    assert not features.surprises(spark.createDataFrame(rows, "entity_id int, us long, ordinal long, value double"), ["value"]).collect()


def test_permutations_of_tallied_hits(spark):
    """Hits of different sets give what the hits of every window give, and no window's patterns are listed."""
    from tracelode.operators import mining

    rows = [(f"{i % 7}/{i}", i % 7, i % 3 == 0, sorted({"ab"[i % 2], "cde"[i * i % 3]})) for i in range(200)]
    w = spark.createDataFrame(rows, "window_id string, entity_id int, is_failure boolean, item_set array<string>")
    sets = spark.createDataFrame([(["a"],), (["c"],), (["a", "d"],)], "itemset array<string>")
    every, tallied = mining.set_hits(w, sets), mining.set_hits(mining.tallied(w, "item_set"), sets)
    for test in (stats.within_entity_p, stats.min_p):
        assert sorted(map(tuple, test(tallied, w, "itemset", 20).collect())) == sorted(map(tuple, test(every, w, "itemset", 20).collect()))


def test_residuals_are_not_gathered_by_group(spark):
    """The rows of a group stay in many tasks, also where the planner wouldn't broadcast by itself."""
    from tracelode.operators import features

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(100).select(F.lit("g").alias("g"), F.col("id").cast("double").alias("x"), (2.0 * F.col("id") + 1).alias("y"))
        found = features.residuals(rows, "y", ["x"], "g")
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert all(abs(r.residual) < 1e-6 for r in found.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def drawn_plainly(times, wanted, clean, salt, tries=50, per=3):
    """Controls of one entity by trying every draw against every failure."""
    from hashlib import md5

    us, fails = [u for u, _ in times], [u for u, bad in times if bad]
    low, width, out = min(us) + clean, max(us) - min(us) - 2 * clean, []
    for i in range(len(fails) * tries if width > 0 else 0):
        name = "|".join(["1", str(i), *([salt] if salt else [])])
        at = low + int(md5(name.encode()).hexdigest()[:8], 16) * 1_000_000 % width
        if all(abs(at - f) > clean for f in fails):
            out.append(at)
    return sorted(set(out[: len(fails) * per]))


def test_controls_need_few_draws(spark):
    """Where failures leave little room, an entity makes about as many draws as that room asks for, and not all of its
    tries; the anchors are those of all tries. Several margins go through one pass."""
    from tracelode.operators import windows

    hour = windows.HOUR
    for n, gap in ((40, 3), (12, 40)):
        times = [(i * gap * hour + (i * 7_919) % 1_000_000, i % 2 == 0 and 0 < i) for i in range(2 * n)]
        s = spark.createDataFrame([(1, u, i, "fail" if bad else "a") for i, (u, bad) in enumerate(times)], "entity_id int, us long, ordinal long, event_type string")
        fails = windows.failure_anchors(s, "fail")
        cleans = {"x": hour, "y": 2 * hour, "z": 6 * hour, None: hour // 2}
        rows = windows.controls_by_salt(s, fails, cleans).collect()
        for salt, clean in cleans.items():
            want = drawn_plainly(times, len(fails.collect()), clean, salt)
            assert sorted(r.anchor for r in rows if r.salt == salt) == want
            assert sorted(r.anchor for r in windows.control_anchors(s, fails, clean, salt=salt).collect()) == want
        near = fails.select("entity_id", F.col("anchor").alias("us"))
        for r in windows.needed_draws(s, fails, near, cleans, 3, 50).collect():
            clear = sum(all(abs(r.low + k * r.width // 5_000 - u) > r.clean for u, bad in times if bad) for k in range(5_000)) / 5_000
            assert r["first"] == r["limit"] or abs((r["wanted"] + 3 * (r["wanted"] * (1 - clear)) ** 0.5 + 3) / clear - r["first"]) <= 0.05 * r["first"] + 2


def test_short_entities_draw_on(spark):
    """Draws that fall badly: entities that are short after the first ones go on where those ended, and no time comes twice."""
    from tracelode.operators import windows

    hour = windows.HOUR
    times = [(i * hour * 5, i % 3 == 1) for i in range(60)]
    s = spark.createDataFrame([(1, u, i, "fail" if bad else "a") for i, (u, bad) in enumerate(times)], "entity_id int, us long, ordinal long, event_type string")
    fails = windows.failure_anchors(s, "fail")
    whole, needed = windows.needed_draws, []

    def stingy(*given):
        needed.append(whole(*given).withColumn("first", F.lit(7)))
        return needed[0]

    windows.needed_draws = stingy
    try:
        got = sorted(r.anchor for r in windows.control_anchors(s, fails, 2 * hour, salt="x").collect())
    finally:
        windows.needed_draws = whole
    assert needed and got == drawn_plainly(times, 20, 2 * hour, "x")


def test_time_windows_are_one_shuffle(spark):
    """An anchor is one row, found in one shuffle, with events at both ends of its span and of a bucket; nothing is joined."""
    from tracelode.operators import windows

    hour = windows.HOUR
    events = [(u, i, us, i * 10 + u) for u in (1, 2) for i, us in enumerate([-1, 0, 1, hour - 1, hour, hour, hour + 1, 5 * hour, 6 * hour - 1])]
    s = spark.createDataFrame([(u, us, o, "a", str(i), f"a:{i}") for u, i, us, o in events], "entity_id int, us long, ordinal long, event_type string, event_subtype string, item string")
    anchors = [(u, us, y) for u in (1, 2, 3) for us in (0, 1, hour, hour + 1, 2 * hour, 6 * hour, 9 * hour) for y in (True, False)]
    w = windows.time_windows(s, spark.createDataFrame(anchors, "entity_id int, anchor long, is_failure boolean"), 1)
    plan = w._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    got = {(r.entity_id, r.anchor, r.is_failure): (list(r["items"]), r.n_events) for r in w.collect()}
    want = {}
    for u, a, y in anchors:
        own = [f"a:{i}" for v, i, us, o in sorted(events, key=lambda e: (e[2], e[3])) if v == u and a - hour <= us < a]
        want[u, a, y] = (own, len(own))
    assert got == want and w.count() == len(anchors)


def test_chains_are_tried_once_per_sequence(spark):
    """Windows with the same items are tried as one, and each gets what a loop over its own events gives."""
    import random
    from itertools import combinations

    from tracelode.operators import chains, mining

    rng, rows = random.Random(5), []
    for i in range(120):
        seq = [(10 * k + rng.randrange(10), x) for k, x in enumerate(rng.choices("abcd", k=rng.randrange(1, 7)))]
        rows.append((str(i), 1_000 + i, i % 3 == 0, seq))
    w = chains.merged(spark.createDataFrame(rows, "window_id string, anchor long, is_failure boolean, seq array<struct<us: long, item: string>>"))
    held, last, counts = {}, [], {}
    for i, anchor, bad, seq in rows:
        own = [s for k, s in enumerate(seq) if k == 0 or seq[k - 1][1] != s[1]]
        for size in (3, 4):
            for spot in combinations(range(len(own)), size):
                chain = tuple(own[k][1] for k in spot)
                if len(set(chain)) == size:
                    held.setdefault((chain, i), (anchor, bad, own[spot[0]][0], own[spot[-1]][0]))  # the earliest, as spots ascend
        last += [(anchor, bad, x, max(us for us, y in own if y == x)) for x in {x for _, x in own}]
    for (chain, _), (_, bad, *_) in held.items():
        counts[chain] = tuple(n + y for n, y in zip(counts.get(chain, (0, 0)), (bad, not bad), strict=True))
    got = mining.chains(w).collect()
    assert {tuple(r.chain): (r.n_failure, r.n_control) for r in got} == counts and len(got) == len(counts)
    some = spark.createDataFrame([(list(c),) for c in sorted(counts)[::2]], "chain array<string>")
    wanted = {(c, i, *v) for (c, i), v in held.items() if c in set(sorted(counts)[::2])}
    many = chains.found(w, some).collect()
    assert {(tuple(r.chain), r.window_id, r.anchor, r.is_failure, r.first_us, r.last_us) for r in many} == wanted and len(many) == len(wanted)
    assert sorted(map(tuple, chains.last_ones(w).collect())) == sorted(last)
    same = w.where("window_id = '2'").crossJoin(spark.range(50)).withColumn("window_id", F.col("id").cast("string"))
    assert chains.places(same.select("items").distinct(), some).groupBy("items", "chain").count().where("count > 1").isEmpty()


def test_events_without_time_or_entity(spark):
    """A failure without a time keeps nothing away, and events without an entity are no one's history."""
    from tracelode.operators import windows

    hour = windows.HOUR
    rows = [(1, i * 5 * hour, i, "fail" if i == 3 else "a") for i in range(12)] + [(1, None, 20, "fail"), (None, hour, 21, "fail"), (None, 0, 22, "a"), (1, None, 23, "a")]
    s = spark.createDataFrame(rows, "entity_id int, us long, ordinal long, event_type string").withColumns({"event_subtype": F.lit("x"), "item": F.col("event_type")})
    fails = windows.failure_anchors(s, "fail")
    got = [r.anchor for r in windows.control_anchors(s, fails, 2 * hour).collect()]
    assert len(got) == 6 and all(abs(a - 15 * hour) > 2 * hour for a in got)
    w = {(r.entity_id, r.anchor): r["items"] for r in windows.time_windows(s.where("event_type = 'a'"), fails, 6).collect()}
    assert w == {(1, 15 * hour): ["a"], (1, None): [], (None, hour): []}
