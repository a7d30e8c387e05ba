"""Distinct counts by registers of minimum exponential hash values.

An identifier gives each of M registers an exponential hash value, always the same ones; a register keeps
the minimum over all identifiers. With n distinct identifiers every register is exponential with rate n, so
the sum of the registers is gamma distributed: (M - 1) / sum is unbiased for n with relative standard error
1 / sqrt(M - 2), and gamma quantiles give an exact confidence interval. Sketches merge by elementwise minimum.

The values of one identifier are drawn in ascending order as arrivals of a Poisson process of rate M whose
marks are the registers; as soon as an arrival exceeds the group's largest register, the identifier cannot
change it any more. So a large group costs about one draw per identifier, not M.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

M = 1024

_G = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def _mix(x: np.ndarray) -> np.ndarray:
    """A public 64-bit finaliser (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


class Sketches:
    """Registers of many groups, updated by arrays of (group, identifier hash)."""

    def __init__(self, m: int = M) -> None:
        self.m, self.rows, self.limit = m, np.full((0, m), np.inf), np.zeros(0)

    def grow(self, groups: int) -> None:
        more = groups - len(self.rows)
        if more > 0:
            self.rows = np.vstack([self.rows, np.full((more, self.m), np.inf)])
            self.limit = np.concatenate([self.limit, np.full(more, np.inf)])

    def add(self, group: np.ndarray, hashes: np.ndarray) -> None:
        if not len(group):
            return
        self.grow(int(group.max()) + 1)
        flat = self.rows.reshape(-1)
        state = _mix(hashes.astype(np.uint64))
        time = np.zeros(len(group))
        k = 0
        while True:
            live = time < self.limit[group]
            if not live.all():
                group, time, state = group[live], time[live], state[live]
            if not len(group):
                break
            # one arrival of many identifiers, or many arrivals of the few that are left (small groups)
            n = max(1, min(256, 8192 // len(group)))
            steps = state[:, None] + _G * np.arange(1, n + 1, dtype=np.uint64)
            bits = _mix(steps)
            waits = -np.log1p(-(bits >> np.uint64(11)).astype(np.float64) * 2.0**-53) / self.m
            times = np.cumsum(np.concatenate([time[:, None], waits], axis=1), axis=1)[:, 1:]
            register = (_mix(bits ^ _G) % np.uint64(self.m)).astype(np.int64)
            np.minimum.at(flat, (group[:, None] * self.m + register).reshape(-1), times.reshape(-1))
            time, state = times[:, -1], steps[:, -1]
            k += 1
            if k <= 16 or k % 16 == 0 or n > 16:
                self.limit = self.rows.max(axis=1)


#: Groups whose registers a task holds at a time (8 kB each at 1024 registers); then they are handed on and begun anew.
HELD = 2048


def _rows(names: list[tuple], registers: np.ndarray, types: list[pa.DataType], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (keys, registers)."""
    m = registers.shape[1]
    for a in range(0, len(names), 64):
        part, block = names[a : a + 64], registers[a : a + 64]
        arrays = [pa.array([n[i] for n in part], type=types[i]) for i in range(len(keys))]
        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * m)
        arrays.append(pa.ListArray.from_arrays(offsets, pa.array(block.reshape(-1))))
        yield pa.RecordBatch.from_arrays(arrays, names=[*keys, "registers"])


def _sketch_partition(keys: list[str], m: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: dict[tuple, int] = {}
        sketches, types = Sketches(m), []
        for batch in batches:
            types = [f.type for f in batch.schema][: len(keys)]
            # no more new groups than fit at a time, however many a batch has
            for start in range(0, batch.num_rows, HELD):
                part = batch.slice(start, HELD)
                hashes = part.column(len(keys)).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                code = np.zeros(part.num_rows, dtype=np.int64)
                columns = []
                for i in range(len(keys)):
                    d = part.column(i).dictionary_encode(null_encoding="encode")
                    columns.append(d.dictionary.to_pylist())
                    code = code * len(columns[-1]) + d.indices.to_numpy(zero_copy_only=False)
                seen, inverse = np.unique(code, return_inverse=True)
                if len(index) + len(seen) > 2 * HELD:
                    yield from _rows(list(index), sketches.rows, types, keys)
                    index, sketches = {}, Sketches(m)
                ids = np.empty(len(seen), dtype=np.int64)
                for j, c in enumerate(seen.tolist()):
                    key = []
                    for values in reversed(columns):
                        c, r = divmod(c, len(values))
                        key.append(values[r])
                    ids[j] = index.setdefault(tuple(reversed(key)), len(index))
                sketches.add(ids[inverse], hashes)
        yield from _rows(list(index), sketches.rows, types, keys)

    return run


def _merge_sorted(keys: list[str]):
    """Elementwise minimum over the rows of equal keys, which follow each other; one row of registers is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, registers, types = None, None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            types = [f.type for f in batch.schema][: len(keys)]
            column = batch.column(len(keys))
            block = column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            names = list(zip(*[batch.column(i).to_pylist() for i in range(len(keys))])) if keys else [()] * batch.num_rows
            starts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            least = np.minimum.reduceat(block, starts, axis=0)
            firsts = [names[i] for i in starts]
            if held is not None and held == firsts[0]:
                least[0] = np.minimum(least[0], registers)
            elif held is not None:
                yield from _rows([held], registers[None, :], types, keys)
            yield from _rows(firsts[:-1], least[:-1], types, keys)
            held, registers = firsts[-1], least[-1].copy()
        if held is not None:
            yield from _rows([held], registers[None, :], types, keys)

    return run


def _fields(rows: DataFrame, keys: list[str]) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema), "registers array<double>"])


def sketch(rows: DataFrame, keys: list[str], identifier: str, m: int = M) -> DataFrame:
    """Mergeable partial result (keys, registers): the merged registers per key. Null identifiers do not count.

    Every input partition keeps registers of at most ``2 * HELD`` keys at a time and sends one array per key, which are merged by key.
    """
    hashed = rows.where(F.col(identifier).isNotNull()).select(*keys, F.xxhash64(identifier).alias("__hash"))
    return merge(hashed.mapInArrow(_sketch_partition(keys, m), _fields(hashed, keys)), keys)


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches over the keys, or fewer of them: the elementwise minimum, within the partitions first and then by key."""
    fields, rows = _fields(sketches, keys), sketches.select(*keys, "registers")
    if not keys:  # one array per partition is left
        return rows.mapInArrow(_merge_sorted(keys), fields).repartition(1).mapInArrow(_merge_sorted(keys), fields)
    local = rows.sortWithinPartitions(*keys).mapInArrow(_merge_sorted(keys), fields)
    return local.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_merge_sorted(keys), fields)


def _gamma_p(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1.0 / a
        n = a
        while abs(term) > abs(total) * 1e-14:
            n += 1
            term *= x / n
            total += term
        return total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = an * d + b
        c = b + an / c
        d = 1 / (d if abs(d) > tiny else tiny)
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return 1 - scale * h


def gamma_quantile(a: float, p: float) -> float:
    low, high = 0.0, a + 20 * math.sqrt(a) + 20
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _gamma_p(a, mid) < p else (low, mid)
    return (low + high) / 2


def estimates(sketches: DataFrame, keys: list[str], m: int = M, confidence: float = 0.95) -> DataFrame:
    """(keys, estimate, low, high, std_error) of merged sketches: unbiased count and confidence interval from the sum of the registers."""
    lo, hi = gamma_quantile(m, (1 - confidence) / 2), gamma_quantile(m, (1 + confidence) / 2)
    sums = sketches.select(*keys, F.aggregate("registers", F.lit(0.0), lambda a, x: a + x).alias("__sum"))
    return sums.select(
        *keys,
        (F.lit(m - 1.0) / F.col("__sum")).alias("estimate"),
        (F.lit(lo) / F.col("__sum")).alias("low"),
        (F.lit(hi) / F.col("__sum")).alias("high"),
        F.lit(1 / math.sqrt(m - 2)).alias("std_error"),
    )
