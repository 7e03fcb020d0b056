"""Sequential evaluation: prompts are asked in waves until the claim is decided.

Used when early stopping is on, an aggregate that can stop lies above a prompt, and
the number of groups is small enough to keep an accumulator for each on the driver
(``MAX_GROUPS``; beyond, the exact path runs). The rows below the first prompt are put
in order (by relevance, by seeded hash, or by key), numbered within their group, and
written once without unneeded columns. A wave takes the next rows of the groups that
are still open and asks the prompts in one Spark job. Without explanations and intervals it
brings back counts, a row per group; with them (group, place, answer, explanation), at
most ``MAX_WAVE`` rows or ``batch`` a group, and accumulators take the answers in order and
stop at the first row that decides.
What is left above runs on the small table of group results.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veracord.functions import confseq
from veracord.functions.intervals import CountInterval, Interval, ProportionInterval
from veracord.models.embedding import EMBEDDING
from veracord.operators.retrieval import rrf_score
from veracord.plans.expr import has_prompt, unalias
from veracord.plans.lower import Context, Lowered, checked, evaluate, lower, settle, with_prompts
from veracord.plans.nodes import Aggregate, CountScan, Filter, Log, Node, RelevanceSort, Scan, Shuffle, Sort
from veracord.plans.rules import Options, is_semantic
from veracord.plans.schema import AGG_KEY, AGG_ROW, refs, spark_type
from veracord.sources.tables import numbered

MAX_GROUPS = 10_000
#: How much each wave grows, and the rows of all groups at which it no longer does.
GROWTH, MAX_WAVE = 2, 200_000


@dataclass
class Accumulator:
    """One aggregate of one group: what it has seen, and whether that decides it."""

    kind: str
    stop: tuple[str, object] | None = None  # operator, threshold
    total: int | None = None
    level: float | None = None
    relative_error: float = 0.0
    seen: int = 0
    true: int = 0
    pos: list = field(default_factory=list)
    neg: list = field(default_factory=list)
    cs: confseq.BettingSequence | None = None

    def __post_init__(self):
        if self.level is not None and self.level < 1:
            self.cs = confseq.BettingSequence(self.level, self.total)

    def update(self, value: bool, why: str | None = None) -> None:
        self.seen += 1
        self.true += value
        if why is not None:
            (self.pos if value else self.neg).append(why)
        if self.cs is not None:
            self.cs.update(float(value))

    def interval(self) -> Interval | None:
        if self.cs is None or not self.seen:
            return None
        return ProportionInterval(*self.cs.interval(), self.level, self.relative_error)

    def decided(self) -> bool:
        """All rows seen, or no further row can change the comparison, or the interval is certain."""
        if self.total is not None and self.seen >= self.total:
            return True
        if self.kind == "bool_or":
            return self.true > 0 or self._certain(">=", 1)
        if self.kind == "bool_and":
            mean = self.interval()
            return self.true < self.seen or mean is not None and mean.satisfies("==", 1.0)
        if self.stop is None:
            return False
        op, bound = self.stop
        if self.kind == "count_if":
            most = self.true + self.total - self.seen if self.total is not None else float("inf")
            return settled(op, bound, self.true, most) or self._certain(op, bound)
        if self.total is not None and self.total:
            low, high = self.true / self.total, (self.true + self.total - self.seen) / self.total
            if settled(op, bound, low, high):
                return True
        mean = self.interval()
        return mean is not None and mean.decides(op, bound)

    def _certain(self, op: str, bound: float) -> bool:
        mean = self.interval()
        return mean is not None and self.total is not None and (mean * self.total).decides(op, bound)

    def value(self) -> object:
        """The exact value when everything was seen, else the bound that decided, or an interval."""
        mean = self.interval()
        open_ = self.total is None or self.seen < self.total
        if self.kind == "bool_or":
            return self.true > 0
        if self.kind == "bool_and":
            return self.true == self.seen
        exact = self.true if self.kind == "count_if" else self.true / (self.total or self.seen or 1)
        if mean is None or not open_ or self.stop is None or self._without_interval():
            return exact
        scaled = mean * self.total if self.kind == "count_if" and self.total else mean
        return CountInterval(scaled.lower, scaled.upper, self.level, self.relative_error) if self.kind == "count_if" else scaled

    def _without_interval(self) -> bool:
        op, bound = self.stop
        if self.total is None:
            return self.kind == "count_if" and settled(op, bound, self.true, float("inf"))
        most = self.true + self.total - self.seen
        low, high = (self.true, most) if self.kind == "count_if" else (self.true / self.total, most / self.total)
        return settled(op, bound, low, high)


def settled(op: str, t: float, low: float, high: float) -> bool:
    """Whether ``value op t`` is the same for all values from ``low`` to ``high``."""
    if op in (">", "<="):
        return low > t or high <= t
    if op in (">=", "<"):
        return low >= t or high < t
    return low > t or high < t or low == high


# --- the plan's shape -------------------------------------------------------------------


def inner_aggregate(plan: Node) -> Aggregate | None:
    """The lowest aggregate, if prompts lie below it and it can be decided early."""
    aggs = [n for n in plan.walk() if isinstance(n, Aggregate)]
    if not aggs:
        return None
    lowest = aggs[-1]
    semantic = any(is_semantic(n) for n in lowest.input.walk()) or any(has_prompt(a) for a in lowest.aggs)
    stops = {s[0] for s in lowest.stops}
    able = all(str(a) in stops or unalias(a).kind in ("bool_or", "bool_and") for a in lowest.aggs)
    return lowest if semantic and able else None


def first_prompt(agg: Aggregate) -> tuple[list[Node], Node]:
    """(nodes from the aggregate's input down to the lowest prompt, what lies below them)."""
    nodes = list(agg.input.walk())
    at = max((i for i, n in enumerate(nodes) if is_semantic(n)), default=-1)
    return nodes[: at + 1], nodes[at + 1]


def ordered(base: Lowered, below: Node, above: list[Node], options: Options) -> tuple[DataFrame, list[Column]]:
    """The base rows and the order in which they are asked."""
    nodes = [*above, *below.walk()]
    relevance = next((n for n in nodes if isinstance(n, RelevanceSort)), None)
    shuffle = next((n for n in nodes if isinstance(n, Shuffle)), None)
    keys = refs(base.schema.key)
    if relevance is not None:
        by: list = [Down(F.col("__relevance")), *keys]
        column = EMBEDDING.format(relevance.column)
        df = rrf_score(base.df, relevance.column, column if column in base.df.columns else None, options.embedder.embed(relevance.query), relevance.include, relevance.exclude, "__relevance")
    elif shuffle is not None and shuffle.rows:
        df, by = base.df, [F.md5(F.concat(F.lit(f"{shuffle.seed}|"), *(F.coalesce(k.cast("string"), F.lit("")) for k in keys))), *keys]
    else:
        df, by = base.df, keys
    return df, by


@dataclass(frozen=True)
class Down:
    """A column in descending order."""

    column: Column


@dataclass
class WaveResult:
    table: Lowered
    waves: int
    rows: int


def run(agg: Aggregate, ctx: Context, options: Options) -> WaveResult | None:
    """Evaluate the lowest aggregate in waves; None if the exact path has to be taken."""
    above, below = first_prompt(agg)
    base = lower(below, replace(ctx, explain=False))
    spark = base.df.sparkSession
    known = set(base.df.columns)
    group_names = [str(g) for g in agg.group_by]
    if not set(group_names) <= known:
        return None  # groups come from prompts
    counts = {tuple(r[:-1]): r[-1] for r in base.df.groupBy(*refs(group_names)).count().limit(MAX_GROUPS + 1).collect()} if group_names else {(): base.df.count()}
    if len(counts) > MAX_GROUPS:
        return None
    df, by = ordered(base, below, above, options)
    keep = [c for c in base.df.columns if not c.endswith(("_embedding", "_sentence_embeddings"))]
    order = [f"__by{i}" for i in range(len(by))]
    down = {i for i, c in enumerate(by) if isinstance(c, Down)}
    df = df.select(*refs(keep), *((c.column if isinstance(c, Down) else c).alias(n) for n, c in zip(order, by, strict=True)))
    df = numbered(df, [F.desc(n) if i in down else F.col(n) for i, n in enumerate(order)], group_names, "__group_at").drop(*order)
    filtered = any(is_semantic(n) and (isinstance(n, Filter) or getattr(n, "filters", ())) for n in above)
    supports = any(isinstance(n, Shuffle) for n in [*above, *below.walk()]) and not any(isinstance(n, RelevanceSort) for n in [*above, *below.walk()])
    level = None
    if options.estimation and supports:
        level = confseq.split_budget(options.estimation[0], len(agg.aggs) * max(len(counts), 1))
    stops = {s[0]: (s[1], s[2]) for s in agg.stops}
    state = {
        g: [Accumulator(unalias(a).kind, stops.get(str(a)), None if filtered else n, level, options.estimation[1] if options.estimation else 0.0) for a in agg.aggs] for g, n in counts.items()
    }
    open_groups = {g for g in state if any(not a.decided() for a in state[g])}
    at, size, waves, rows = 0, max(options.batch, 8), 0, 0
    while open_groups:
        open_groups = {g for g in open_groups if counts[g] > at}
        if not open_groups:
            break
        todo = frozenset(open_groups)
        part = df.where((F.col("__group_at") > at) & (F.col("__group_at") <= at + size))
        if group_names and len(todo) < len(counts):
            done = spark.createDataFrame([g for g in counts if g not in todo], T.StructType([T.StructField(n, spark_type(agg.schema.field(n).dtype)) for n in group_names]))
            same = [part[n].eqNullSafe(done[n]) for n in group_names]
            part = part.join(F.broadcast(done), same, "left_anti")  # at most MAX_GROUPS rows
        if level is None and not ctx.explain:
            for g, seen, trues in _count_wave(part, above, agg, base, ctx):
                for acc, true in zip(state[g], trues, strict=True):
                    acc.seen, acc.true = acc.seen + seen, acc.true + true
                if all(a.decided() for a in state[g]):
                    open_groups.discard(g)
        else:
            for g, values, whys in _ask_wave(part, above, agg, base, ctx):
                if g not in open_groups:
                    continue  # answered, but no longer needed
                for acc, v, w in zip(state[g], values, whys, strict=True):
                    acc.update(v, w)
                if all(a.decided() for a in state[g]):
                    open_groups.discard(g)
        rows += sum(min(size, counts[g] - at) for g in todo)
        at, size, waves = at + size, min(size * GROWTH, max(size, MAX_WAVE // max(len(open_groups), 1))), waves + 1
    return WaveResult(_table(agg, state, ctx, spark), waves, rows)


def _asked(part: DataFrame, above: list[Node], agg: Aggregate, base: Lowered, ctx: Context):
    """(the rows of a wave with their answers, the values of the aggregates' arguments)."""
    scan = Scan(part, base.schema)
    node: Node = scan
    for n in reversed([n for n in above if not isinstance(n, (Log, Sort, Shuffle, RelevanceSort, CountScan))]):
        node = n.over(node)
    low = lower(node, ctx, {id(scan): Lowered(part, base.schema)})
    asked, args = with_prompts([unalias(a).arg for a in agg.aggs], low, ctx)
    return asked.df, [evaluate(e, asked, ctx) for e in args]


def _count_wave(part: DataFrame, above: list[Node], agg: Aggregate, base: Lowered, ctx: Context):
    """(group, rows, true arguments) of a wave, a row for each group."""
    df, values = _asked(part, above, agg, base, ctx)
    groups = [str(g) for g in agg.group_by]
    flags = df.select(*refs(groups), *(checked(v.column, unalias(a).arg, ctx).alias(f"__v{i}") for i, (a, v) in enumerate(zip(agg.aggs, values, strict=True))))
    n = len(groups)
    for r in flags.groupBy(*refs(groups)).agg(F.count("*"), *(F.count_if(f"__v{i}") for i in range(len(values)))).collect():
        yield tuple(r[:n]), r[n], list(r[n + 1 :])


def _ask_wave(part: DataFrame, above: list[Node], agg: Aggregate, base: Lowered, ctx: Context):
    """(group, argument values, explanations) of the rows of a wave, in their order."""
    df, values = _asked(part, above, agg, base, ctx)
    out = df.select(
        *refs(str(g) for g in agg.group_by), "__group_at", *(v.column.alias(f"__v{i}") for i, v in enumerate(values)), *((v.prov if v.prov is not None else F.lit(None).cast("string")).alias(f"__w{i}") for i, v in enumerate(values))
    )
    n, k = len(agg.group_by), len(values)
    got = sorted(out.collect(), key=lambda r: r[n])
    for r in got:
        if ctx.strict_nulls and any(v is None for v in r[n + 1 : n + 1 + k]):
            raise ValueError("an aggregate's argument is null")
        yield tuple(r[:n]), [bool(v) for v in r[n + 1 : n + 1 + k]], list(r[n + 1 + k :])


def _table(agg: Aggregate, state: dict, ctx: Context, spark) -> Lowered:
    """The groups' results as a DataFrame; intervals as structs of their bounds."""
    interval = T.StructType([T.StructField(n, T.DoubleType()) for n in ("lower", "upper", "confidence_level", "relative_error")])
    fields = [T.StructField(str(g), spark_type(agg.schema.field(str(g)).dtype)) for g in agg.group_by] or [T.StructField(AGG_KEY, T.StringType())]
    prov, estimated = {}, {}
    for i, a in enumerate(agg.aggs):
        estimated[i] = any(isinstance(s[i].value(), Interval) for s in state.values())
        fields.append(T.StructField(str(a), interval if estimated[i] else spark_type(agg.schema.field(str(a)).dtype)))
        if ctx.explain:
            prov[str(a)] = "c"
            fields += [T.StructField(f"__{side}_{a}", T.ArrayType(T.StringType())) for side in ("pos", "neg")]
    rows = []
    for g in state:
        row = list(g) or [AGG_ROW]
        for i, acc in enumerate(state[g]):
            v = acc.value()
            if estimated[i]:
                v = v if isinstance(v, Interval) else Interval(float(v), float(v))
                v = (v.lower, v.upper, v.confidence_level, v.relative_error)
            row.append(v)
            if ctx.explain:
                row += [acc.pos, acc.neg]
        rows.append(tuple(row))
    errors = {str(a): next((s[i].relative_error for s in state.values()), 0.0) for i, a in enumerate(agg.aggs) if estimated[i]}
    low = Lowered(spark.createDataFrame(rows, T.StructType(fields)), agg.schema, prov, errors)
    return settle(low, agg, ctx)


