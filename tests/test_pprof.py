import gzip

from lumenpipe.functions.hashing import fnv1a_64
from lumenpipe.operators.flamegraph import flamegraph
from lumenpipe.sources import pprof


def varint(n):
    out = b""
    n &= (1 << 64) - 1
    while True:
        out += bytes([n & 0x7F | (0x80 if n > 0x7F else 0)])
        n >>= 7
        if not n:
            return out


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def profile():
    strings = ["", "cpu", "ns", "main", "work", "inlined", "main.rs"]
    out = field(1, field(1, 1) + field(2, 2))
    out += field(2, field(1, varint(2) + varint(1)) + field(2, varint(70) + varint(1)))  # packed
    out += field(2, field(1, 1) + field(2, -5))
    out += field(4, field(1, 1) + field(4, field(1, 1) + field(2, 10)))
    out += field(4, field(1, 2) + field(4, field(1, 3) + field(2, 30)) + field(4, field(1, 2) + field(2, 20)))
    out += field(5, field(1, 1) + field(2, 3) + field(4, 6)) + field(5, field(1, 2) + field(2, 4)) + field(5, field(1, 3) + field(2, 5))
    for s in strings:
        out += field(6, s.encode())
    return out + field(9, 1234)


def test_pprof(spark, tmp_path):
    (tmp_path / "a.pb.gz").write_bytes(gzip.compress(profile()))
    (tmp_path / "b.pb").write_bytes(profile())
    (tmp_path / "c.txt").write_bytes(b"\x07\x07 not a profile")
    r = pprof.read_pprof(spark, str(tmp_path))
    rows = sorted(r.collect(), key=lambda x: (x["path"], x["value"]))
    assert [x["value"] for x in rows] == [-5, 70, -5, 70] and {x["time_unix_nano"] for x in rows} == {1234}
    assert [(f["function_name"], f["line"], f["inline"]) for f in rows[1]["frames"]] == [("inlined", 30, True), ("work", 20, False), ("main", 10, False)]
    ids = {x["function_name"]: x["frame_id"] for x in pprof.frames(r).collect()}
    assert ids["main"] == fnv1a_64(b"main\0main.rs\00010") and len(ids) == 3
    assert pprof.stacks(r).count() == 4
    positive = pprof.samples(r).where("value > 0")
    tops = flamegraph(positive, pprof.stacks(r)).where("depth = 0").collect()
    assert [(x["frame_id"], x["total_value"]) for x in tops] == [(ids["main"], 140)]
