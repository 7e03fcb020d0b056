"""The lazy frame: filter, map, aggregate, rank, check; collect, explain, evaluate."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame as SparkFrame
from pyspark.sql import functions as F

from veracord.functions.intervals import Interval
from veracord.functions.provenance import Explanations, Prov, Token
from veracord.models.language import Metrics
from veracord.operators.quality import FilterQuality, filter_quality, map_quality
from veracord.plans import waves
from veracord.plans.expr import Expr
from veracord.plans.lower import Context, Lowered, evaluate, lower, value_of
from veracord.plans.nodes import Aggregate, Check, Filter, Log, Node, Project, Rank
from veracord.plans.rules import optimise
from veracord.plans.schema import Row, Schema, refs
from veracord.sources.tables import materialise

if TYPE_CHECKING:
    from veracord.session import Session


@dataclass
class QueryResult:
    rows: list[Row]
    metrics: Metrics = field(default_factory=Metrics)
    planning_seconds: float = 0.0
    execution_seconds: float = 0.0

    @property
    def verdict(self) -> bool:
        """Value of the only row's last column."""
        (row,) = self.rows
        return bool(row.values[-1])

    def provenance(self, column: str, row: int = 0) -> Prov:
        return self.rows[row].provenance[column]


class SemanticFrame:
    """A query in the making. Frames are immutable; nothing runs before ``collect`` or ``to_spark``."""

    def __init__(self, session: Session, plan: Node):
        self.session, self.plan = session, plan

    def _then(self, plan: Node) -> SemanticFrame:
        return SemanticFrame(self.session, plan)

    def filter(self, predicate: Expr) -> SemanticFrame:
        return self._then(Filter(self.plan, predicate))

    def map(self, expr: Expr) -> SemanticFrame:
        return self._then(Project(self.plan, expr))

    def aggregate(self, aggs: Sequence[Expr], group_by: Sequence[Expr] = ()) -> SemanticFrame:
        return self._then(Aggregate(self.plan, tuple(aggs), tuple(group_by)))

    def with_rank(self, expr: Expr, descending: bool = True) -> SemanticFrame:
        return self._then(Rank(self.plan, expr, descending))

    def check(self, predicate: Expr) -> SemanticFrame:
        return self._then(Check(self.plan, predicate))

    def log(self, path: str) -> SemanticFrame:
        """Write the rows that pass here to ``path`` when the query runs."""
        return self._then(Log(self.plan, path))

    # looking at it

    def schema(self) -> Schema:
        return self.plan.schema

    def logical_plan(self) -> Node:
        return self.plan

    def optimized_logical_plan(self) -> Node:
        return optimise(self.plan, self.session.options)

    def explain(self) -> str:
        text = f"Plan\n{self.plan.display()}\n\nOptimised\n{self.optimized_logical_plan().display()}"
        print(text)
        return text

    # running it

    def _context(self, metrics: bool = True) -> Context:
        s, o = self.session, self.session.options
        acc = (lambda: s.spark.sparkContext.accumulator(0)) if metrics else lambda: None
        return Context(s.model, s.explain, o.minimal, o.strict_nulls, s.response_cache, acc(), acc(), acc())

    def to_spark(self) -> SparkFrame:
        """The exact query as one Spark DataFrame, without explanations."""
        ctx = self._context(metrics=False)
        ctx.explain = False
        low = lower(optimise(self.plan, self.session.options), ctx)
        return low.df.select(*refs(low.schema.names))

    def _lowered(self, ctx: Context, metrics: Metrics) -> Lowered:
        plan = optimise(self.plan, self.session.options)
        if self.session.options.early_stop and (agg := waves.inner_aggregate(plan)) is not None:
            done = waves.run(agg, ctx, self.session.options)
            if done is not None:
                metrics.waves, metrics.rows_seen = done.waves, done.rows
                return lower(plan, ctx, {id(agg): done.table})
        return lower(plan, ctx)

    def collect(self) -> QueryResult:
        """Rows in key order (score order behind a rank), with explanations if the session has them on."""
        ctx, metrics = self._context(), Metrics()
        begun = time.time()
        low = self._lowered(ctx, metrics)
        planned = time.time()
        ranked = next((n for n in self.plan.walk() if isinstance(n, (Rank, Aggregate))), None)
        order = ["rank"] if isinstance(ranked, Rank) and "rank" in low.df.columns else []
        whys = [f"__p_{c}" for c, kind in low.prov.items() if kind == "p"]
        got = low.df.select(*refs(low.schema.names), *refs(whys)).collect()
        # sorted here, since all rows are: Spark's sort would run what lies below it twice, prompts too, to sample ranges
        got.sort(key=lambda r: [(r[c] is not None, r[c]) for c in (*order, *low.schema.key)])
        rows = []
        for r in got:
            values = tuple(_out(r[f.name], f.dtype) for f in low.schema.fields)
            rows.append(Row(values, Explanations({c: r[f"__p_{c}"] for c, kind in low.prov.items() if kind == "p"}, ctx.minimal)))
        metrics.requests = ctx.counter.value if ctx.counter is not None else 0
        metrics.characters = ctx.characters.value if ctx.characters is not None else 0
        metrics.cache_hits = ctx.hits.value if ctx.hits is not None else 0
        return QueryResult(rows, metrics, planned - begun, time.time() - planned)

    # comparing it with a reference

    def evaluate_tokens(self, tokens: Sequence[Token], predicates: dict[str, Expr]) -> list[bool]:
        """Whether each token holds on this frame's rows: its row exists and its predicate has its sign.

        ``predicates`` gives the expression for each predicate's text.
        """
        ctx = self._context()
        ctx.explain = False
        low = lower(self.plan, ctx)
        spark, key = self.session.spark, low.schema.key
        out = [False] * len(tokens)
        for text in dict.fromkeys(t.predicate for t in tokens):
            mine = [(i, t) for i, t in enumerate(tokens) if t.predicate == text]
            asked = spark.createDataFrame([(i, *t.row_id, t.sign) for i, t in mine], "__i long, " + ", ".join(f"`{k}` {low.df.schema[k].dataType.simpleString()}" for k in key) + ", __sign boolean")
            held = low.df.select(*refs(key), evaluate(predicates[text], low, ctx).column.alias("__value"))
            for i, ok in asked.join(held, list(key), "left").select("__i", F.coalesce(F.col("__value") == F.col("__sign"), F.lit(False))).collect():
                out[i] = ok
        return out

    def judge_tokens(self, tokens: SparkFrame, predicate: Expr) -> SparkFrame:
        """``tokens`` (this frame's key columns, ``sign``, any others) with ``valid``, by a join: nothing is collected."""
        ctx = self._context(metrics=False)
        ctx.explain = False
        low = lower(self.plan, ctx)
        key = list(low.schema.key)
        held = low.df.select(*refs(key), evaluate(predicate, low, ctx).column.alias("__value"))
        valid = F.coalesce(F.col("__value") == F.col("sign"), F.lit(False))
        return tokens.join(held, key, "left").withColumn("valid", valid).drop("__value")

    def count_valid_tokens(self, tokens: Sequence[Token], predicates: dict[str, Expr]) -> int:
        return sum(self.evaluate_tokens(tokens, predicates))

    def evaluate_filter(self, before: SemanticFrame, after: SemanticFrame) -> FilterQuality:
        """This frame holds the rows that the filter should keep."""
        key = list(self.schema().key)
        return FilterQuality(*filter_quality(self.to_spark(), before.to_spark(), after.to_spark(), key).head())

    def evaluate_map(self, after: SemanticFrame, columns: Sequence[str]) -> dict[str, float]:
        """Share of rows on which each column equals this frame's."""
        row = map_quality(self.to_spark(), after.to_spark(), list(self.schema().key), list(columns)).head()
        return {c: row[c] for c in columns}

    def persist_rows(self) -> SemanticFrame:
        """The same rows from a written copy, so that later queries start there."""
        return self.session.read_frame(materialise(self.to_spark()), self.schema().key, self.schema())


def _out(x: object, dtype: object) -> object:
    if x is not None and hasattr(x, "asDict") and set(x.asDict()) == {"lower", "upper", "confidence_level", "relative_error"}:
        return Interval(**x.asDict())
    return value_of(x, dtype)
