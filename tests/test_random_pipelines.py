"""Random pipelines of the language against the same query as SQL in another engine."""

import random

import duckdb
import pandas as pd
import pytest

from lumenpipe.engine import Engine

N = 400
NUMBERS = ["duration_ns", "wal", "start_time_unix_nano"]
TEXTS = ["name", "db_system"]


@pytest.fixture(scope="module")
def both(spark):
    rnd = random.Random(0)
    rows = [
        (
            f"s{i}", rnd.choice(["GET /a", "get /B_x", "db%", None, ""]), rnd.choice([0, 1, 2, None]), rnd.choice([1, 2, 3]), rnd.randrange(10_000),
            rnd.choice([None, 0, rnd.randrange(-50, 1000)]), rnd.choice([None, "pg", "kv"]), rnd.randrange(20),
        )
        for i in range(N)
    ]
    cols = ["span_id", "name", "status", "kind", "start_time_unix_nano", "duration_ns", "db_system", "wal"]
    df = spark.createDataFrame(rows, "span_id string, name string, status smallint, kind smallint, start_time_unix_nano bigint, duration_ns bigint, db_system string, wal bigint").cache()
    con = duckdb.connect()
    frame = pd.DataFrame(rows, columns=cols).astype({"status": "Int16", "kind": "Int16", "duration_ns": "Int64"})
    con.register("frame", frame)
    con.sql("CREATE TABLE spans AS SELECT * FROM frame")
    return Engine(spark, {"spans": df}, now_ns=10_000), con


def atom(rnd):
    k = rnd.randrange(9)
    n, t = rnd.choice(NUMBERS), rnd.choice(TEXTS)
    if k == 0:
        v = rnd.randrange(-10, 900)
        op = rnd.choice(["==", "!=", ">", ">=", "<", "<=", "="])
        return f"{n} {op} {v}", f"{n} {'<>' if op == '!=' else '=' if op == '==' else op} {v}"
    if k == 1:
        return (f"exists {t}", f"{t} IS NOT NULL") if rnd.random() < 0.5 else (f"not_exists {t}", f"{t} IS NULL")
    if k == 2:
        text = rnd.choice(["a", "_", "%", "GET", "/b"])
        return f"{t} contains '{text}'", f"contains(lower({t}), lower('{text}'))"
    if k == 3:
        text = rnd.choice(["g", "DB", ""])
        return f"{t} starts_with \"{text}\"", f"starts_with(lower({t}), lower('{text}'))"
    if k == 4:
        return f"{t} matches '^[a-z]'", f"regexp_matches({t}, '^[a-z]')"
    if k == 5:
        name, code = rnd.choice([("OK", 1), ("ERROR", 2), ("UNSET", 0)])
        return f"status == {name}", f"status = {code}"
    if k == 6:
        return "kind in [SERVER, 3]", "kind IN (2, 3)"
    if k == 7:
        return f"{n} * 2 + 1 > wal", f"{n} * 2 + 1 > wal"
    return f"{n} / 7 == wal % 5", f"{n} // 7 = wal % 5"


def pred(rnd, depth=0):
    if depth > 2 or rnd.random() < 0.4:
        return atom(rnd)
    k = rnd.random()
    a, b = pred(rnd, depth + 1), pred(rnd, depth + 1)
    if k < 0.25:
        return f"not ({a[0]})", f"NOT ({a[1]})"
    word = "and" if k < 0.6 else "or"
    sign = rnd.choice([word, "&&" if word == "and" else "||"])
    return f"({a[0]}) {sign} ({b[0]})", f"({a[1]}) {word} ({b[1]})"


def pipeline(rnd):
    p = pred(rnd)
    text, where = f"spans last 1h | where {p[0]}", p[1]
    if rnd.random() < 0.5:
        f = pred(rnd)
        key = rnd.choice([("name", "name"), ("ts() bin 1s as name", "start_time_unix_nano // 1000000000 * 1000000000"), ("kind + 0 as name", "CAST(kind AS BIGINT)")])
        text += f" | group by {{ {key[0]} }} {{ count() as n, count() where {f[0]} as f, sum(duration_ns) as s, min(wal) as lo, distinct(db_system) as d, p50(duration_ns) as p }}"
        sql = (
            f"SELECT {key[1]} AS name, count(*) AS n, count(*) FILTER (WHERE {f[1]}) AS f, CAST(sum(duration_ns) AS BIGINT) AS s, min(wal) AS lo, "
            f"count(DISTINCT db_system) AS d, quantile_cont(duration_ns, 0.5) AS p FROM spans WHERE {where} GROUP BY 1"
        )
        return text, sql
    down = rnd.random() < 0.5
    text += f" | select span_id, duration_ns | sort duration_ns {'desc' if down else 'asc'}, span_id | take 17 offset 3"
    sql = f"SELECT span_id, duration_ns FROM spans WHERE {where} ORDER BY duration_ns {'DESC' if down else 'ASC'} NULLS FIRST, span_id LIMIT 17 OFFSET 3"
    return text, sql


@pytest.mark.parametrize("seed", range(24))
def test_pipeline(both, seed):
    engine, con = both
    text, sql = pipeline(random.Random(seed))
    plain = lambda rows: sorted(str([round(v, 6) if isinstance(v, float) else v for v in r]) for r in rows)
    got = plain(tuple(r) for r in engine.query(text).primary.collect())
    assert got == plain(con.sql(sql).fetchall()), text
