"""Folds a parsed query over DataFrames. Lazy: nothing is computed here."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.attributes import overflow_text
from ..functions.ranks import joined, values_at_ranks
from ..operators.patterns import log_patterns
from ..operators.shared import fresh, int_div
from . import ast as A
from . import catalog as C
from .errors import InvalidQuery, UnknownField
from .shape import ColumnDef, columns_of, infer_shape

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


@dataclass
class QueryResult:
    primary: DataFrame
    aux: dict[str, DataFrame] = field(default_factory=dict)
    shape: str = "table"
    columns: list[ColumnDef] = field(default_factory=list)


@dataclass(frozen=True)
class Typed:
    """A column expression with its type; literals keep their value so that the other side can decide on it."""

    col: Column
    kind: T.DataType
    literal: A.Literal | None = None
    field_name: str = ""


class Planner:
    """``table`` gives the DataFrame of a table by name; ``now_ns`` is the clock.

    ``approx`` makes percentiles approximate (one pass, bounded memory); ``compat`` makes ``uniq``
    remove whole repeated rows instead of rows with a repeated field.
    """

    def __init__(self, table: Callable[[str], DataFrame], now_ns: int, approx: bool = False, compat: bool = False) -> None:
        self.table, self.now, self.approx, self.compat = table, now_ns, approx, compat

    # scans
    def bounds(self, time: A.Span | A.Last) -> tuple[int, int]:
        if isinstance(time, A.Last):
            return max(0, self.now - time.ns), self.now
        return time.start, time.end

    def scan(self, signal: str, time: A.Span | A.Last | None, upper: bool = True) -> DataFrame:
        """The signal's table within the range, both ends included; signals without a time ignore it."""
        df = self.table(C.table_of(signal))
        if time is None or signal not in C.TIME_COLUMN:
            return df
        a, b = self.bounds(time)
        t = F.col(C.TIME_COLUMN[signal])
        cond = (t >= F.lit(a)) & (t <= F.lit(b)) if upper else t >= F.lit(a)
        parts = [c for c in ("year", "month", "day") if c in df.columns]
        if len(parts) == 3 and upper and b < 253402300799 * 10**9:  # prune the date folders of stored tables
            day = F.make_date("year", "month", "day")
            lo, hi = (F.date_add(F.lit("1970-01-01").cast("date"), x // C_DAY) for x in (a, b))
            cond = cond & (day >= lo) & (day <= hi)
        return df.where(cond)

    def run(self, query: A.Query) -> QueryResult:
        s = query.scan
        if s.lookup is not None:
            df = self.scan(s.signal, s.time)
            wanted = F.lit(s.lookup).cast(df.schema[C.ID_COLUMN[s.signal]].dataType)
            df = df.where(F.col(C.ID_COLUMN[s.signal]) == wanted).limit(1)
        else:
            df = self.scan(s.signal, s.time)
        state = _State(df, s.signal, s.time)
        for stage in query.stages:
            state = self.apply(state, stage)
        return QueryResult(state.df, state.aux, infer_shape(query), columns_of(query, state.df))

    # stages
    def apply(self, st: _State, stage: A.Stage) -> _State:
        if isinstance(stage, A.Where):
            df, pred = self.with_scopes(st, stage.pred)
            return replace(st, df=df.where(self.pred(replace(st, df=df), pred)).select(*st.df.columns))
        if isinstance(stage, A.Select):
            df, items = self.with_scopes(st, stage.items)
            inner = replace(st, df=df)
            return replace(st, df=df.select(*[self.field(inner, f).col.alias(a) for f, a in items]))
        if isinstance(stage, A.Compute):
            df, items = self.with_scopes(st, stage.items)
            extra = [c for c in df.columns if c not in st.df.columns]
            for e, alias in items:
                df = df.withColumn(alias, self.expr(replace(st, df=df), e).col)
            return replace(st, df=df.drop(*extra))
        if isinstance(stage, A.Group):
            df, group = self.with_scopes(st, stage)
            return replace(st, df=self.group(replace(st, df=df), group))
        if isinstance(stage, A.Sort):
            df, items = self.with_scopes(st, stage.items)
            inner = replace(st, df=df)
            keys = [self.expr(inner, e).col for e, _ in items]
            order = [k.desc_nulls_first() if d else k.asc_nulls_first() for k, (_, d) in zip(keys, items)]
            return replace(st, df=df.orderBy(*order).select(*st.df.columns))
        if isinstance(stage, A.Take):
            df = st.df.offset(stage.offset) if stage.offset else st.df
            return replace(st, df=df.limit(stage.n))
        if isinstance(stage, A.Uniq):
            return replace(st, df=self.uniq(st, stage.field))
        if isinstance(stage, A.Patterns):
            name = self.column_name(st, stage.field)
            time = C.TIME_COLUMN.get(st.signal)
            return replace(st, df=log_patterns(st.df, name, time if time in st.df.columns else None))
        if isinstance(stage, A.Within):
            t = self.time(st).col
            a, b = self.bounds(stage.time)
            return replace(st, df=st.df.where((t >= a) & (t <= b)))
        if isinstance(stage, A.Navigate):
            key = C.NAVIGATE_KEY.get((st.signal, stage.signal))
            if key is None:
                raise InvalidQuery(f"there is no way from {st.signal} to {stage.signal}")
            target = self.scan(stage.signal, None)
            return replace(st, df=self.semi(target, st.df, key), signal=stage.signal)
        aux = dict(st.aux)
        self.merge(st, stage, aux)
        return replace(st, aux=aux)

    def semi(self, target: DataFrame, source: DataFrame, key: str) -> DataFrame:
        if key not in source.columns:
            raise InvalidQuery(f"the key column {key} is not there any more")
        keys = source.select(F.col(key).alias(fresh(target, key))).where(F.col(fresh(target, key)).isNotNull()).distinct()
        return target.join(keys, target[key] == keys[keys.columns[0]], "left_semi")

    def merge(self, st: _State, stage: A.Merge, aux: dict[str, DataFrame]) -> None:
        """Adds the side table, then those nested in it; names are flat, in the order of the text."""
        key = C.MERGE_KEY.get((st.signal, stage.signal))
        if key is None:
            raise InvalidQuery(f"{stage.signal} cannot be merged into {st.signal}")
        target = self.scan(stage.signal, st.time)
        inner_df = self.related(st, target, key)
        state = _State(inner_df, stage.signal, st.time)
        nested: dict[str, DataFrame] = {}
        for s in stage.stages:
            if isinstance(s, A.Merge):
                self.merge(state, s, nested)
            else:
                state = self.apply(state, s)
        if stage.alias in aux or stage.alias in nested:
            raise InvalidQuery(f"the merge alias {stage.alias!r} is used twice")
        aux[stage.alias] = state.df
        aux.update(nested)

    def related(self, st: _State, target: DataFrame, key: str) -> DataFrame:
        """Semi-join by the key; points and histograms, which lack the owner's id, go through their metric."""
        if key in target.columns and key in st.df.columns:
            return self.semi(target, st.df, key)
        if key not in ("resource_id", "scope_id"):
            raise InvalidQuery(f"the key column {key} is not there any more")
        owner = self.table("metrics").select("metric_id", F.col(key).alias("__owner"))
        if key not in target.columns and key in st.df.columns:
            ids = self.semi(owner.withColumnRenamed("__owner", key), st.df, key)
            return self.semi(target, ids, "metric_id")
        if "metric_id" in st.df.columns:
            owned = self.semi(owner, st.df, "metric_id").withColumnRenamed("__owner", key)
            return self.semi(target, owned, key)
        raise InvalidQuery(f"the key column {key} is not there any more")

    def uniq(self, st: _State, f: A.Field) -> DataFrame:
        if self.compat:
            return st.df.distinct()
        df, (f,) = self.with_scopes(st, (f,))
        key = self.field(replace(st, df=df), f).col
        time = C.TIME_COLUMN.get(st.signal)
        ident = C.ID_COLUMN.get(st.signal)
        order = [F.col(c) for c in (time, ident) if c in df.columns]
        order.append(F.xxhash64(*[F.to_json(c) if isinstance(df.schema[c].dataType, (T.MapType,)) else F.col(c) for c in df.columns]))
        first = df.groupBy(key.alias("__key")).agg(F.min_by(F.struct(*st.df.columns), F.struct(*order)).alias("__row"))
        return first.select("__row.*")

    # fields
    def time(self, st: _State) -> Typed:
        name = C.TIME_COLUMN.get(st.signal)
        if name is None:
            raise InvalidQuery(f"{st.signal} have no time")
        if name not in st.df.columns:
            raise UnknownField(name)
        return Typed(F.col(name), T.LongType(), field_name=name)

    def column_name(self, st: _State, f: A.Field) -> str:
        if f.scope == "" and f.name in st.df.columns:
            return f.name
        raise UnknownField(f.name)

    def field(self, st: _State, f: A.Field) -> Typed:
        df = st.df
        names = df.columns
        plain = lambda n: Typed(F.col(f"`{n}`"), df.schema[n].dataType, field_name=n)
        if f.scope == "" and f.name in names:
            return plain(f.name)
        if f.scope in ("", "attr"):
            promoted = C.promoted_column(f.name)
            if promoted in names:
                return plain(promoted)
            if "_overflow_attrs" in names and (f.scope == "attr" or "." in f.name or promoted):
                value = F.element_at("_overflow_attrs", F.lit(f.name))
                if promoted and f.name != promoted:
                    value = F.coalesce(value, F.element_at("_overflow_attrs", F.lit(promoted)))
                text = overflow_text(value)
                if promoted and isinstance(C.PROMOTED[C.PROMOTED_COLUMNS[promoted]], T.LongType):
                    return Typed(text.try_cast("bigint"), T.LongType(), field_name=f.name)
                return Typed(text, T.StringType(), field_name=f.name)
        raise UnknownField(f"{f.scope}.{f.name}" if f.scope else f.name)

    def with_scopes(self, st: _State, node):
        """Joins what resource.X, scope.X and a span's service name need; returns the new frame and the rewritten node."""
        wanted: dict[A.Field, str] = {}

        def rewrite(x):
            if isinstance(x, A.Field):
                own = x.name in st.df.columns or C.promoted_column(x.name) in st.df.columns
                remote = x.scope in ("resource", "scope") or (
                    x.scope == "" and x.name == "service_name" and not own and "resource_id" in st.df.columns
                )
                if not remote:
                    return x
                side = "scope" if x.scope == "scope" else "resource"
                if f"{side}_id" not in st.df.columns:
                    return A.Field("", x.name)
                wanted.setdefault(x, f"__{side}_{len(wanted)}")
                return A.Field("", wanted[x])
            if isinstance(x, tuple):
                return tuple(rewrite(y) for y in x)
            if hasattr(x, "__dataclass_fields__"):
                return replace(x, **{k: rewrite(getattr(x, k)) for k in x.__dataclass_fields__})
            return x

        node = rewrite(node)
        df = st.df
        for side in ("resource", "scope"):
            mine = {f: n for f, n in wanted.items() if ("scope" if f.scope == "scope" else "resource") == side}
            if not mine:
                continue
            table = self.table(f"{side}s")
            cols = []
            for f, n in mine.items():
                stored = F.get_json_object("attributes", "$['" + f.name.replace("'", "") + "']")
                cols.append((F.col(f.name) if f.name in table.columns and f.name != "attributes" else stored).alias(n))
            ident = fresh(df, f"{side}_id")
            right = table.select(F.col(f"{side}_id").alias(ident), *cols).dropDuplicates([ident])
            df = df.join(right, df[f"{side}_id"] == right[ident], "left").drop(ident)
        return df, node

    # expressions
    def expr(self, st: _State, e: A.Expr) -> Typed:
        if isinstance(e, A.Literal):
            return self.literal(e)
        if isinstance(e, A.Field):
            return self.field(st, e)
        if isinstance(e, A.Call):
            return self.call(st, e)
        left, right = self.number(self.expr(st, e.left)), self.number(self.expr(st, e.right))
        whole = isinstance(left.kind, WHOLE) and isinstance(right.kind, WHOLE)
        kind = T.LongType() if whole else T.DoubleType()
        a, b = (x.col.cast(kind) for x in (left, right))
        if e.op in "/%":
            b = F.when(b != 0, b)  # division by zero gives null
            value = int_div(a, b) if e.op == "/" and whole else a / b if e.op == "/" else a % b
        else:
            value = {"+": a + b, "-": a - b, "*": a * b}[e.op]
        return Typed(value, kind)

    @staticmethod
    def literal(x: A.Literal) -> Typed:
        kinds = {"null": T.NullType(), "bool": T.BooleanType(), "int": T.LongType(), "float": T.DoubleType()}
        kind = kinds.get(x.kind, T.StringType())
        return Typed(F.lit(None) if x.kind == "null" else F.lit(x.value).cast(kind), kind, x)

    @staticmethod
    def number(x: Typed) -> Typed:
        if isinstance(x.kind, NUMERIC):
            return x
        if x.literal is not None and x.literal.kind == "name":
            return Typed(F.lit(C.STATUS.get(x.literal.value, C.KIND.get(x.literal.value, 0))).cast("bigint"), T.LongType())
        if isinstance(x.kind, T.NullType):
            return Typed(F.lit(None).cast("double"), T.DoubleType())
        if isinstance(x.kind, T.BooleanType):
            return Typed(x.col.cast("bigint"), T.LongType())
        if isinstance(x.kind, T.StringType):
            return Typed(x.col.try_cast("double"), T.DoubleType())
        raise InvalidQuery(f"{x.kind.simpleString()} is not a number")

    def call(self, st: _State, e: A.Call) -> Typed:
        if e.name == "ts":
            return self.time(st)
        x = self.expr(st, e.args[0])
        if e.name in ("lower", "upper", "len", "to_string"):
            text = x.col.cast("string")
            if e.name == "len":
                return Typed(F.length(text).cast("bigint"), T.LongType())
            return Typed({"lower": F.lower, "upper": F.upper}.get(e.name, lambda c: c)(text), T.StringType())
        n = self.number(x)
        whole = isinstance(n.kind, WHOLE)
        if e.name in ("to_millis", "to_seconds"):
            unit = 10**6 if e.name == "to_millis" else 10**9
            if whole:
                return Typed(int_div(n.col.cast("bigint"), F.lit(unit)), T.LongType())
            return Typed(n.col / float(unit), T.DoubleType())
        if e.name == "abs" or whole:
            return Typed(F.abs(n.col) if e.name == "abs" else n.col, n.kind)
        value = {"round": lambda c: F.round(c, 0), "ceil": F.ceil, "floor": F.floor}[e.name](n.col)
        whole_already = F.isnan(n.col) | (F.abs(n.col) >= float(1 << 52))
        return Typed(F.when(whole_already, n.col.cast("double")).otherwise(value.cast("double")), T.DoubleType())

    # predicates
    def pred(self, st: _State, p: A.Pred) -> Column:
        if isinstance(p, (A.And, A.Or)):
            out = self.pred(st, p.parts[0])
            for x in p.parts[1:]:
                out = out & self.pred(st, x) if isinstance(p, A.And) else out | self.pred(st, x)
            return out
        if isinstance(p, A.Not):
            return ~self.pred(st, p.part)
        if isinstance(p, A.Exists):
            c = self.field(st, p.field).col
            return c.isNull() if p.negated else c.isNotNull()
        if isinstance(p, A.Match):
            c = self.field(st, p.field).col.cast("string")
            if p.kind == "matches":
                return c.rlike(p.text)
            plain = p.text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
            wild = {"contains": f"%{plain}%", "starts_with": f"{plain}%", "ends_with": f"%{plain}"}[p.kind]
            return c.ilike(wild)
        if isinstance(p, A.In):
            f = self.field(st, p.field)
            if not p.values:
                return F.lit(False)
            return f.col.isin(*[self.align(f, self.literal(v))[1] for v in p.values])
        a, b = self.expr(st, p.left), self.expr(st, p.right)
        left, right = self.align(a, b)
        return {
            "==": left == right, "!=": left != right, ">": left > right, ">=": left >= right, "<": left < right, "<=": left <= right,
        }[p.op]

    def align(self, a: Typed, b: Typed) -> tuple[Column, Column]:
        """Both sides of a comparison in one type; names of enums are resolved by the other side's column."""
        if a.literal is not None and b.literal is None:
            right, left = self.align(b, a)
            return left, right
        if b.literal is not None and b.literal.kind in ("name", "string"):
            if isinstance(a.kind, NUMERIC):
                return a.col, self.code(a, b.literal)
            if isinstance(a.kind, T.StringType):
                return a.col, F.lit(b.literal.value)
        if isinstance(a.kind, T.NullType) or isinstance(b.kind, T.NullType) or a.kind == b.kind:
            return a.col, b.col
        if isinstance(a.kind, T.BooleanType) and isinstance(b.kind, T.StringType):
            return a.col.cast("string"), b.col
        if isinstance(b.kind, T.BooleanType) and isinstance(a.kind, T.StringType):
            return F.lower(a.col), b.col.cast("string")
        if isinstance(a.kind, WHOLE) and isinstance(b.kind, WHOLE):
            if b.literal is not None and -(2**15) <= b.literal.value < 2**15 and not isinstance(a.kind, T.LongType):
                return a.col, F.lit(b.literal.value).cast(a.kind)  # no cast on the column: it can be pushed down
            return a.col, b.col
        x, y = self.number(a), self.number(b)
        return x.col, y.col

    @staticmethod
    def code(a: Typed, x: A.Literal) -> Column:
        name = str(x.value).upper()
        table = {"status": C.STATUS, "kind": C.KIND, "severity_number": C.SEVERITY}.get(a.field_name)
        if table is None and x.kind == "name":
            table = C.STATUS if name in C.STATUS else C.KIND if name in C.KIND else C.SEVERITY
        if table is not None and name in table:
            return F.lit(table[name]).cast(a.kind)
        if x.kind == "string":
            try:
                return F.lit(float(x.value))
            except ValueError:
                pass
        raise InvalidQuery(f"{a.field_name or 'the number'} cannot be compared with {x.value!r}")

    # aggregation
    def group(self, st: _State, g: A.Group) -> DataFrame:
        keys = []
        for k in g.keys:
            c = self.expr(st, k.expr)
            if k.bin_ns is not None:
                n = self.number(c).col.cast("bigint")
                c = Typed(int_div(n, F.lit(k.bin_ns)) * F.lit(k.bin_ns), T.LongType())
            keys.append(c.col.alias(k.alias))
        names = [k.alias for k in g.keys]
        apart = {"heatmap", "sample"} | (set() if self.approx else set(SHARES))
        simple = [a for a in g.aggs if a.name not in apart]
        spread = [a for a in g.aggs if a.name in ("heatmap", "sample")]
        ranked: dict[tuple, list[A.Agg]] = {}
        for a in g.aggs:
            if a.name in apart and a.name in SHARES:
                ranked.setdefault((a.arg, a.pred), []).append(a)
        cols = [self.aggregate(st, a).alias(a.alias) for a in simple]
        if not cols:
            cols = [F.count(F.lit(1)).alias("__rows")]
        out = st.df.groupBy(*keys).agg(*cols) if keys else st.df.agg(*cols)
        sides = [self.spread(st, a, keys, names) for a in spread] + [self.percentiles(st, x, keys, names) for x in ranked.values()]
        for side in sides:
            renamed = side.withColumnsRenamed({n: f"__k_{n}" for n in names})
            on = F.lit(True)
            for n in names:
                on = on & out[n].eqNullSafe(renamed[f"__k_{n}"])
            if names:
                out = out.join(renamed, on, "left").drop(*[f"__k_{n}" for n in names])
            else:  # both sides have one row at most
                both = out.unionByName(renamed, allowMissingColumns=True)
                out = both.agg(*[F.first(F.col(c), ignorenulls=True).alias(c) for c in both.columns])
        return out.select(*names, *[a.alias for a in g.aggs])

    def aggregate(self, st: _State, a: A.Agg) -> Column:
        cond = self.pred(st, a.pred) if a.pred is not None else None
        kept = lambda c: c if cond is None else F.when(cond, c)
        if a.name == "count":
            return F.count(kept(F.lit(1)))
        if a.name == "error_rate":
            status = self.field(st, A.Field("", "status")).col
            return F.avg(kept(F.when(status == 2, 1.0).otherwise(0.0)))
        if a.name == "throughput":
            lo, hi = self.bounds(st.time)
            return F.count(kept(F.lit(1))) / F.lit(max(hi - lo, 1) / 1e9)
        x = self.expr(st, a.arg)
        if a.name in ("min", "max"):
            return getattr(F, a.name)(kept(x.col))
        if a.name == "distinct":
            return F.count_distinct(kept(x.col))
        if a.name in ("first", "last"):
            time, ident = C.TIME_COLUMN.get(st.signal), C.ID_COLUMN.get(st.signal)
            order = [c for c in (time, ident) if c in st.df.columns]
            if not order:  # no time and no id: the order of the rows' own hash
                order = [F.xxhash64(*[F.map_entries(c) if isinstance(st.df.schema[c].dataType, T.MapType) else F.col(c) for c in st.df.columns])]
            pick = F.min_by if a.name == "first" else F.max_by
            return pick(x.col, kept(F.struct(*order)))
        n = self.number(x)
        value = kept(n.col)
        if a.name == "sum":
            return F.sum(value.cast("bigint") if isinstance(n.kind, WHOLE) else value)
        if a.name == "avg":
            return F.avg(value)
        return F.percentile_approx(value, SHARES[a.name], 10_000)

    def percentiles(self, st: _State, aggs: list[A.Agg], keys: list[Column], names: list[str]) -> DataFrame:
        """Exact percentiles of one expression, between the values at the two ranks around (n - 1) * share.

        By cumulative counts, so that no task holds the values of a large group.
        """
        df = st.df if aggs[0].pred is None else st.df.where(self.pred(st, aggs[0].pred))
        rows = df.select(*keys, self.number(self.expr(st, aggs[0].arg)).col.alias("__x")).where("__x IS NOT NULL")
        counts = rows.groupBy(*names, "__x").agg(F.count(F.lit(1)).alias("__m"))
        picks = {}
        for a in aggs:
            spot = lambda n, a=a: (n - 1) * F.lit(SHARES[a.name])
            picks[f"__lo_{a.alias}"] = lambda n, spot=spot: F.floor(spot(n))
            picks[f"__hi_{a.alias}"] = lambda n, spot=spot: F.ceil(spot(n))
        at = values_at_ranks(counts, names, "__x", "__m", picks)
        total = counts.groupBy(*names).agg(F.sum("__m").alias("__n"))
        if names:
            both = joined(at, total, names)
        else:
            both = at.unionByName(total, allowMissingColumns=True)
            both = both.agg(*[F.first(F.col(c), ignorenulls=True).alias(c) for c in both.columns])
        out = []
        for a in aggs:
            lo, hi = F.col(f"__lo_{a.alias}").cast("double"), F.col(f"__hi_{a.alias}").cast("double")
            part = (F.col("__n") - 1) * F.lit(SHARES[a.name])
            out.append((lo + (hi - lo) * (part - F.floor(part))).alias(a.alias))
        return both.select(*names, *out)

    def spread(self, st: _State, a: A.Agg, keys: list[Column], names: list[str]) -> DataFrame:
        """heatmap(e): counts by power-of-two bucket; sample(n): n rows as JSON, by the least md5 of their id (of the row if there is none)."""
        df = st.df if a.pred is None else st.df.where(self.pred(st, a.pred))
        if a.name == "heatmap":
            n = self.number(self.expr(st, a.arg)).col.cast("double")
            level = F.when(n > 0, F.pow(F.lit(2.0), F.ceil(F.log2(n)))).otherwise(F.when(n.isNotNull(), 0.0))
            cells = df.groupBy(*keys, level.alias("__le")).agg(F.count(F.lit(1)).alias("__n")).where("__le IS NOT NULL")
            cell = F.struct(F.col("__le").alias("le"), F.col("__n").alias("count"))
            return cells.groupBy(*names).agg(F.sort_array(F.collect_list(cell)).alias(a.alias))
        ident = C.ID_COLUMN.get(st.signal)
        rows = df.select(*keys, F.to_json(F.struct(*st.df.columns)).alias("__row"), *([F.col(ident).cast("string").alias("__id")] if ident in df.columns else []))
        rows = rows.withColumn("__hash", F.md5(F.coalesce(F.col("__id"), F.lit("")) if ident in df.columns else F.col("__row")))
        # the n least hashes of every hash class first, so that no task ranks a whole group
        some = rows.withColumn("__class", F.substring("__hash", -2, 2))
        for part in (["__class"], []):
            rank = Window.partitionBy(*names, *part).orderBy("__hash", "__row")
            some = some.withColumn("__rank", F.row_number().over(rank)).where(F.col("__rank") <= a.arg.value)
        return some.groupBy(*names).agg(F.sort_array(F.collect_list("__row")).alias(a.alias))


C_DAY = 86400 * 10**9
SHARES = {"p50": 0.5, "p95": 0.95, "p99": 0.99}


@dataclass(frozen=True)
class _State:
    df: DataFrame
    signal: str
    time: A.Span | A.Last
    aux: dict[str, DataFrame] = field(default_factory=dict)
