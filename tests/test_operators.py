"""Operators against brute force and on awkward input."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lumenpipe.functions import ranks
from lumenpipe.operators import dedup, grid, hierarchy, late, wide

SPAN = (
    "trace_id string, span_id string, parent_span_id string, start_time_unix_nano bigint, duration_ns bigint, "
    "resource_id bigint, wal_seq bigint, received_unix_nano bigint, _overflow_attrs map<string,string>"
)
NODES = "tree string, node string, parent string, ord bigint, weight bigint, end_state string"


def span(t, s, p=None, start=10**9, d=5, r=1, w=1, rec=2 * 10**9, attrs=None):
    return (t, s, p, start, d, r, w, rec, attrs or {})


def solve_links(links):
    """(end_state, root, depth, path) of every node by walking its parents."""
    out = {}
    for node in links:
        path, seen, cur = [node], {node}, node
        while True:
            p = links[cur]
            if p is None or p not in links:
                path.reverse()
                out[node] = ("root" if p is None else "orphan", path[0], len(path) - 1, path)
                break
            if p == node:
                out[node] = ("circle", None, None, None)
                break
            if p in seen:
                out[node] = ("trapped", None, None, None)
                break
            path.append(p)
            seen.add(p)
            cur = p
    return out


@pytest.mark.parametrize("seed", range(4))
def test_hierarchy_across_fragments(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    n = 300
    names = [f"n{i:04d}" for i in range(n)]
    links = {}
    for i, name in enumerate(names):
        x = rnd.random()
        links[name] = None if x < 0.02 else "gone" if x < 0.04 else names[rnd.randrange(n)] if x < 0.1 else names[max(0, i - rnd.randint(1, 4))]
    links[names[0]] = None if seed % 2 else names[-1]
    rows = [("t", k, v, rnd.randrange(1000), 1, "root") for k, v in links.items()]
    monkeypatch.setattr(hierarchy, "ONE_TASK", 40)
    monkeypatch.setattr(hierarchy, "_solve", _many_fragments(hierarchy._solve))
    solved = hierarchy.resolve(spark.createDataFrame(rows, NODES)).collect()
    want = solve_links(links)
    got = {r["node"]: (r["end_state"], r["root"], r["depth"], r["chain"]) for r in solved}
    assert len(solved) == n and got == want
    circles = hierarchy.resolve(spark.createDataFrame(rows, NODES), chains=False).where("circle").collect()
    assert {r["node"] for r in circles} == {k for k, v in want.items() if v[0] == "circle"}


def _many_fragments(real):
    return lambda nodes, keep, partitions, *size: real(nodes, keep, 7 if partitions is None else partitions, *size)


@pytest.mark.parametrize("seed", range(2))
def test_quotients_that_do_not_shrink(spark, seed, monkeypatch):
    """Links that jump between fragments at every step: solved by doubling, with the same answers."""
    rnd = random.Random(seed)
    n = 240
    names = [f"n{i:04d}" for i in range(n)]
    order = names[:]
    rnd.shuffle(order)
    links = {a: b for a, b in zip(order, order[1:])} | {order[-1]: None}
    links[order[59]] = None
    links[order[119]] = order[100]  # a circle with a tail
    links[order[179]] = "gone"
    rows = [("t", k, v, i, 1, "root") for i, (k, v) in enumerate(sorted(links.items()))]
    monkeypatch.setattr(hierarchy, "ONE_TASK", 20)
    monkeypatch.setattr(hierarchy, "_solve", _many_fragments(hierarchy._solve))
    used = []
    real = hierarchy._doubled
    monkeypatch.setattr(hierarchy, "_doubled", lambda *a: used.append(1) or real(*a))
    got = {r["node"]: (r["end_state"], r["root"], r["depth"], r["chain"]) for r in hierarchy.resolve(spark.createDataFrame(rows, NODES)).collect()}
    assert got == solve_links(links) and used


def test_hierarchy_of_spans_with_dirty_ids(spark):
    rows = [
        span("AA-aa", "01", ""), span("aaaa", "02", " 01"), span("aaaa", "02", "01", w=2), span("aaaa", "03", "03"),
        span(None, "04", "01"), span("bbbb", "02", "01"), span("bbbb", "05", "0000"),
    ]
    df = spark.createDataFrame(rows, SPAN)
    got = {(r["trace_id"], r["span_id"]): (r["end_state"], r["path"]) for r in hierarchy.span_hierarchy(df).collect()}
    assert got == {
        ("aaaa", "01"): ("root", "01"), ("aaaa", "02"): ("root", "01/02"), ("aaaa", "03"): ("circle", None),
        ("bbbb", "02"): ("orphan", "02"), ("bbbb", "05"): ("root", "05"),
    }
    assert hierarchy.span_hierarchy(df.limit(0)).count() == 0
    pairs = hierarchy.span_descendants(df).collect()
    assert [tuple(r) for r in pairs] == [("aaaa", "01", "02", 1)]


def test_grid_fills_gaps_over_shards(spark, monkeypatch):
    monkeypatch.setattr(grid, "SHARD", 4)
    rnd = random.Random(1)
    points, want = [], {}
    for s, step in ((1, 10), (2, 7), (3, 1)):
        periods = sorted(rnd.sample(range(-60, 400), 25))
        for p in periods:
            points.append((s, "m", (p * step) * 10**9 + rnd.randrange(step * 10**9), float(p)))
        have = set(periods)
        want.update({(s, p * step): p not in have for p in range(periods[0], periods[-1] + 1)})
        last = None
        for p in range(periods[0], periods[-1] + 1):
            last = p if p in have else last
            want[s, p * step] = (p not in have, float(last))
    points += [(1, "m", 5, None), (1, "m", 5, float("nan")), (9, "m", 5, 1.0), (None, "m", 5, 1.0), (4, "m", None, 1.0), (5, "m", 1, 1.0)]
    df = spark.createDataFrame(points, "series_id bigint, metric_id string, time_unix_nano bigint, value double")
    series = spark.createDataFrame(
        [(1, 10), (2, 7), (3, 1), (4, 1), (5, 0), (6, None)], "series_id bigint, interval_s bigint"
    )
    got = {(r["series_id"], r["period_unix_s"]): (r["is_missing"], r["locf_value"]) for r in grid.regular_grid(df, series).collect()}
    assert got == want
    assert grid.regular_grid(df.limit(0), series).count() == 0


def test_grid_values(spark):
    df = spark.createDataFrame(
        [(1, 0, 1.0), (1, 5 * 10**8, 2.0), (1, 5 * 10**8, 3.0), (1, 4 * 10**9, 7.0)],
        "series_id bigint, time_unix_nano bigint, value double",
    )
    series = spark.createDataFrame([(1, 1)], "series_id bigint, interval_s bigint")
    rows = sorted(grid.regular_grid(df, series).collect(), key=lambda r: r["period_unix_s"])
    assert [r["value"] for r in rows] == [3.0, None, None, None, 7.0]
    assert [r["linear_value"] for r in rows] == [3.0, 4.0, 5.0, 6.0, 7.0]
    assert [r["n_readings"] for r in rows] == [3, 0, 0, 0, 1]


def test_dedup_in_batches(spark, monkeypatch):
    monkeypatch.setattr(dedup, "BLOCK_BITS", 4)
    rnd = random.Random(2)
    seen_df, accepted, delivered = None, [], []
    for batch in range(3):
        rows = [(rnd.choice("ab"), rnd.randrange(-40, 90), batch) for _ in range(60)]
        delivered += rows
        df = spark.createDataFrame(rows, "producer string, number bigint, wal_seq bigint")
        ranges_df = dedup.coverage(df, seen_df).cache()
        found = ranges_df.where("copies > 0").collect()
        times = Counter((p, n) for p, n, _ in rows)
        assert {(r["producer"], n): r["copies"] for r in found for n in range(r["first"], r["last"] + 1)} == times
        accepted += [(r["producer"], n) for r in found if not r["seen"] for n in range(r["first"], r["last"] + 1)]
        ranges = [tuple(r) for r in dedup.merged_ranges(ranges_df).collect()]
        seen_df = spark.createDataFrame(ranges, "producer string, first bigint, last bigint")
    want = {(p, n) for p, n, _ in delivered}
    assert len(accepted) == len(set(accepted)) and set(accepted) == want
    covered = [(p, n) for p, a, b in ranges for n in range(a, b + 1)]
    assert len(covered) == len(set(covered)) and set(covered) == want


def test_dedup_of_spans(spark):
    full, sid = "0" * 31 + "a", "00000000000000ff"
    rows = [
        span(full.upper(), sid, w=3), span(full, "0000-0000-0000-00FF", w=1, d=9), span(full, "f" * 16), span("short", "x"),
        span("SHORT", " x", w=0, d=1), span(None, sid), span(None, sid), span(full, None),
    ]
    df = spark.createDataFrame(rows, SPAN).withColumns(dict.fromkeys(["row", "number", "producer", "odd", "first", "n_copies_"], F.lit("clash")))
    once = {(r["trace_id"], r["span_id"]): (r["n_copies"], r["duration_ns"]) for r in dedup.deduplicate_spans(df).collect()}
    assert once == {(full, sid): (2, 9), (full, "f" * 16): (1, 5), ("short", "x"): (2, 1), (None, sid): (2, 5), (full, None): (1, 5)}
    assert dedup.deduplicate_spans(df.limit(0)).count() == 0
    seen = spark.createDataFrame([(full, -(2**63) + 250, -(2**63) + 260)], "producer string, first bigint, last bigint")
    keys = spark.createDataFrame([("short", "x")], "trace_id string, span_id string")
    rest = {(r["trace_id"], r["span_id"]) for r in dedup.deduplicate_spans(df, seen, keys).collect()}
    assert rest == {(full, "f" * 16), (None, sid), (full, None)}


def test_late_records_correct_periods(spark, monkeypatch):
    rnd = random.Random(3)
    s = 10**9
    rows = []
    for i in range(400):
        start = rnd.randrange(-120, 600) * s
        rows.append(span("t", f"{i:04d}", start=start, d=rnd.choice([None, rnd.randrange(20)]), r=rnd.choice([1, 2, None]), rec=start + rnd.choice([1, 100, 500, 2000]) * s))
    rows += [rows[5][:6] + (9,) + (10**15,) + ({},), span("t", "z", start=0), span("t", "y", start=None)]
    df = spark.createDataFrame(rows, SPAN)
    want = {}
    for r in rows[:400]:
        if r[3] == 0:
            continue
        minute = r[3] // (60 * s)
        late_by = r[7] - (minute + 1) * 60 * s
        kind = 0 if late_by <= 60 * s else 1 if late_by <= 900 * s else 2
        want.setdefault((r[5], minute * 60), ([], [], []))[kind].append(r[4])
    low = lambda v: sorted(v)[(len(v) + 1) // 2 - 1] if v else None
    expected = {}
    for k, (a, b, c) in want.items():
        both = [x for x in a + b if x is not None]
        expected[k] = (len(a), len(b), len(c), len(set(both)), low([x for x in a if x is not None]), low(both))
    for limit in (1 << 16, 2):  # the second also sends periods down the way for many values
        monkeypatch.setattr(ranks, "WIDE", limit)
        monkeypatch.setattr(ranks, "BUCKET_BITS", 2)
        got = {
            (r["resource_id"], r["minute_unix_s"]): tuple(
                r[c] for c in ("n_on_time", "n_late", "n_dropped", "n_distinct", "median_on_time", "median_value")
            )
            for r in late.corrected_periods(df).collect()
        }
        assert got == expected
    halves = [df.where("span_id < '0200'"), df.where("span_id >= '0200'")]
    merged = late.merge_states(*[late.multiset(late.first_deliveries(h)) for h in halves])
    assert sorted(map(str, merged.collect())) == sorted(map(str, late.multiset(late.first_deliveries(df)).collect()))


CATALOG = [("a.i", "a_i", "int64"), ("b.d", "b_d", "double"), ("c.b", "c_b", "bool"), ("d.s", "d_s", "string")]


def test_wide_table(spark):
    catalog = spark.createDataFrame(CATALOG, "key string, column_name string, value_type string")
    spans = spark.createDataFrame(
        [span("t1", "s1", attrs={"A.I": '" 7 "', "zz": "1"}), span("t1", "s2"), span("T1", "s3", attrs={"c_b": "TRUE"})], SPAN
    )
    attrs = spark.createDataFrame(
        [
            ("t1", "S1", "b.d", "1e3", 1), ("t1", "s1", " B_D ", ".5", 2), ("t1", "s1", "b.d", "inf", 3), ("t1", "s1", "a.i", "", 9),
            ("t1", "s3", "a.i", "9223372036854775808", 1), ("t1", "s3", "d.s", '"x"', 1), ("t1", "s3", "b.d", "1e999", 1),
            ("t9", "s9", "c.b", "yes", 1), ("t1", "s3", None, "x", 1), ("t1", "s3", "d.s", None, 5),
        ],
        "trace_id string, span_id string, key string, value string, wal_seq bigint",
    )
    out = {(r[0], r[1]): tuple(r)[2:] for r in wide.wide_table(spans, attrs, catalog).collect()}
    assert out == {
        ("t1", "s1"): (7, 0.5, None, None, ["b.d"]), ("t1", "s2"): (None, None, None, None, None),
        ("t1", "s3"): (None, None, True, "x", ["a.i", "b.d"]), ("t9", "s9"): (None, None, None, None, ["c.b"]),
    }
    assert wide.wide_table(spans.limit(0), attrs.limit(0), catalog).count() == 0


@pytest.mark.parametrize(
    "value,kind,fits",
    [
        ("+5", "int64", True), ("-9223372036854775808", "int64", True), ("1.0", "int64", False), ("", "int64", None),
        ("5.", "double", True), (".", "double", False), ("-.5E-3", "double", True), ("NaN", "double", False), ("1d", "double", False),
        ('"true"', "bool", True), ("1", "bool", False), ('"', "string", True), ("١", "int64", False),
    ],
)
def test_reads_as(spark, value, kind, fits):
    df = spark.createDataFrame([(value, kind)], "v string, k string").select(wide.bare_value("v").alias("v"), "k")
    got = df.select(F.when(F.col("v").isNotNull(), wide.reads_as(F.col("v"), F.col("k"))).alias("f")).first()["f"]
    assert got == fits


def test_exactly_once_returns_the_attributes_of_the_kept_copy(spark, tmp_path):
    from lumenpipe.plans import core_queries

    rows = [("AB" * 16, "0" * 15 + "1", None, 7, {"b": "2", "a": None}), ("ab" * 16, "0" * 15 + "1", None, 8, {"c": "3"}), ("cd" * 16, "0" * 15 + "2", None, 8, None)]
    cols = "trace_id string, span_id string, parent_span_id string, wal_seq bigint, _overflow_attrs map<string,string>"
    spark.createDataFrame(rows, cols).write.parquet(f"{tmp_path}/spans.parquet")
    got = {r["span_id"][-1]: (r["n_copies"], r["_overflow_attrs"]) for r in core_queries.QUERIES["p2_exactly_once_attrs"](spark, str(tmp_path)).collect()}
    assert got == {"1": (2, [["a", None], ["b", "2"]]), "2": (1, None)}


def test_grid_spreads_a_long_gap(spark, monkeypatch):
    """Two readings millions of periods apart: the cells are made in all tasks, and whole blocks without readings are there."""
    monkeypatch.setattr(grid, "SHARD", 64)
    n = 600_000
    df = spark.createDataFrame([(1, 3 * 10**9, 1.0), (1, (n + 3) * 10**9, 5.0)], "series_id bigint, time_unix_nano bigint, value double")
    out = grid.regular_grid(df, spark.createDataFrame([(1, 1)], "series_id bigint, interval_s bigint"))
    per_task = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(per_task) == n + 1 and len(per_task) == 4 and max(per_task) < 0.4 * n
    ends = out.agg(F.min("period_unix_s"), F.max("period_unix_s"), F.count_distinct("period_unix_s"), F.sum(F.col("is_missing").cast("int"))).first()
    assert tuple(ends) == (3, n + 3, n + 1, n - 1)
    middle = out.where(F.col("period_unix_s") == 3 + n // 2).first()
    assert middle["locf_value"] == 1.0 and abs(middle["linear_value"] - 3.0) < 1e-9


def test_ranges_decide_what_is_repeated(spark):
    """A run of numbers delivered twice is one range: without the sweep only its ends would be known."""
    run = [(f"{'0' * 31}b", f"{n:016x}") for n in range(5_000, 7_000)]
    rows = run + run[500:1500] + [(f"{'0' * 31}b", "f" * 16)] * 2 + [("b", "odd")] * 3 + [("b", "once")]
    df = spark.createDataFrame(rows, "trace_id string, span_id string")
    ranges = dedup.span_ranges(df).orderBy("first").collect()
    assert [r["last"] - r["first"] + 1 for r in ranges] == [500, 1000, 500, 1] and [r["copies"] for r in ranges] == [1, 2, 1, 2]
    got = {tuple(r) for r in dedup.repeated_spans(df).collect()}
    assert got == {*run[500:1500], (f"{'0' * 31}b", "f" * 16), ("b", "odd")}
    once = dedup.deduplicate_spans(df).collect()
    assert len(once) == 2003 and Counter(r["n_copies"] for r in once) == {1: 1001, 2: 1001, 3: 1}
