"""Entry point: run texts of the pipe language over registered signals."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .plans import catalog as C
from .plans.ast import Query
from .plans.errors import InvalidQuery
from .plans.parser import parse
from .plans.planner import Planner, QueryResult

SCOPES = ("all", "hot", "cold")


class Engine:
    """Signals are DataFrames by table name, in a hot (recent) and a cold (stored) tier.

    A table may be given as a function, which is called when a query first needs it. Signals that are not
    registered are empty. ``now_ns`` fixes the clock (default: the system's).
    """

    def __init__(
        self,
        spark: SparkSession,
        cold: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None,
        hot: Mapping[str, DataFrame | Callable[[], DataFrame]] | None = None,
        now_ns: int | None = None,
        approx: bool = False,
        compat: bool = False,
    ) -> None:
        self.spark, self.cold, self.hot = spark, dict(cold or {}), dict(hot or {})
        self.fixed_now, self.approx, self.compat = now_ns, approx, compat

    def now(self) -> int:
        return time.time_ns() if self.fixed_now is None else self.fixed_now

    def table(self, name: str, scope: str = "all") -> DataFrame:
        """The union by name of the tiers in scope; the limit of a query is not pushed into either."""
        if scope not in SCOPES:
            raise InvalidQuery(f"the scope must be one of {', '.join(SCOPES)}")
        parts = []
        for tier, tables in (("hot", self.hot), ("cold", self.cold)):
            if scope in ("all", tier) and name in tables:
                t = tables[name]
                parts.append(t() if callable(t) and not isinstance(t, DataFrame) else t)
        if not parts:
            return self.spark.createDataFrame([], C.schema(name))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1], allowMissingColumns=True)

    def parse(self, text: str) -> Query:
        return parse(text, self.now())

    def planner(self, scope: str = "all") -> Planner:
        return Planner(lambda name: self.table(name, scope), self.now(), self.approx, self.compat)

    def query(self, text: str, scope: str = "all") -> QueryResult:
        return self.planner(scope).run(self.parse(text))

    def query_over(self, text: str, tables: Mapping[str, DataFrame]) -> QueryResult:
        """Run over the given tables only; missing ones are empty."""
        return Engine(self.spark, tables, None, self.now(), self.approx, self.compat).query(text)

    def show(self, text: str, form: str = "table", limit: int = 100) -> str:
        """Result as text for a terminal: table, json or jsonl; at most ``limit`` rows are fetched."""
        rows = self.query(text).primary.limit(limit)
        if form in ("json", "jsonl"):
            lines = [r[0] for r in rows.selectExpr("to_json(struct(*))").collect()]
            return "\n".join(lines) if form == "jsonl" else "[" + ",\n".join(lines) + "]"
        return rows._show_string(limit, False)

    def stats(self) -> dict[str, int]:
        """Rows per registered table."""
        return {n: self.table(n).count() for n in sorted({*self.cold, *self.hot})}
