import random
import uuid

import pytest

from pyspark.sql import functions as F

from lumenpipe.functions import hashing, ranks


def test_hashes(spark):
    texts = ["", "a", "service.name\0api\n", "Ünïcødé \u20ac \U0001f600", "x" * 300, None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", hashing.fnv32(F.col("t")).alias("a"), hashing.fnv64(F.col("t")).alias("b"), hashing.uuid5_dns(F.col("t")).alias("u")).collect()
    for r in rows:
        if r["t"] is None:
            assert r["a"] is None and r["b"] is None
            continue
        data = r["t"].encode()
        assert (r["a"], r["b"]) == (hashing.fnv1a_32(data), hashing.fnv1a_64(data))
        assert r["u"] == str(uuid.uuid5(uuid.NAMESPACE_DNS, r["t"]))


def test_long_bytes(spark):
    import struct

    for n in (0, -1, 2**63 - 1, -(2**63), 258):
        got = spark.range(1).select(hashing.long_bytes(F.lit(n).cast("bigint"))).first()[0]
        assert bytes(got) == struct.pack("<q", n)


@pytest.mark.parametrize("kind", ["bigint", "double"])
def test_ranks_of_wide_groups(spark, kind, monkeypatch):
    monkeypatch.setattr(ranks, "WIDE", 5)
    monkeypatch.setattr(ranks, "BUCKET_BITS", 4)
    rnd = random.Random(3)
    rows = [(rnd.choice(["a", "b", None]), rnd.randrange(-300, 300) if kind == "bigint" else rnd.gauss(0, 100)) for _ in range(900)]
    df = spark.createDataFrame(rows, f"g string, v {kind}")
    picks = {f"p{p}": (lambda n, p=p: ranks.rollup_index(n, p)) for p in (0, 37, 50, 99, 100)}
    got = {r["g"]: tuple(r)[1:] for r in ranks.ranked_values(df, ["g"], "v", picks).collect()}
    want = {}
    for g in ("a", "b", None):
        v = sorted(x for k, x in rows if k == g)
        want[g] = tuple(v[(len(v) - 1) * p // 100] for p in (0, 37, 50, 99, 100))
    assert got == want
    v = sorted(x for _, x in rows)
    assert tuple(ranks.ranked_values(df, [], "v", picks).first()) == tuple(v[(len(v) - 1) * p // 100] for p in (0, 37, 50, 99, 100))


def test_rank_rules(spark):
    df = spark.createDataFrame([("g", v * 100) for v in range(1, 11)] + [("one", 7), ("none", None)], "g string, v bigint")
    picks = {"r50": lambda n: ranks.rollup_index(n, 50), "r90": lambda n: ranks.rollup_index(n, 90), "h95": lambda n: ranks.health_index(n, 95), "e": ranks.exemplar_index}
    got = {r["g"]: tuple(r)[1:] for r in ranks.ranked_values(df, ["g"], "v", picks).collect()}
    assert got == {"g": (500, 900, 1000, 1000), "one": (7, 7, 7, 7)}
