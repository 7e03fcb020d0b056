"""Exact evaluation: the whole plan as one Spark DataFrame.

Structured nodes become DataFrame operations and stay in the JVM. Prompts become one
Arrow-batched UDF call each, materialised as a column before anything uses it. With
explanations on, a column that has provenance is accompanied by ``__p_<name>`` (a
factorised polynomial) or, for counts and proportions, ``__pos_<name>`` and
``__neg_<name>`` (the polynomials of the true and false arguments).
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from enum import Enum
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from veracord.functions import provenance as P
from veracord.functions.intervals import satisfies
from veracord.functions.memory import give_back
from veracord.functions.vectors import max_dot, vector
from veracord.models.language import LanguageModel, Request
from veracord.plans.expr import FLIP, Agg, Alias, Binary, Col, Expr, Lit, MaxDot, Native, Not, Prompt, dtype_of, unalias
from veracord.plans.nodes import ORDERING, Aggregate, Check, Filter, Fused, Log, Node, Project, Rank, Scan
from veracord.plans.schema import AGG_KEY, AGG_ROW, Field, Schema, ref, refs, spark_type
from veracord.sources.cache import ResponseCache
from veracord.sources.tables import materialise, write_log

#: Requests of a batch that are Python objects at a time.
PART = 256


@dataclass
class Context:
    """What lowering needs besides the plan."""

    model: LanguageModel | None = None
    explain: bool = False
    minimal: bool = False
    strict_nulls: bool = True
    cache: ResponseCache | None = None
    counter: object = None  # accumulator of answered requests
    hits: object = None  # accumulator of requests found in the cache
    characters: object = None  # accumulator of the characters that were sent


@dataclass
class Lowered:
    df: DataFrame
    schema: Schema
    prov: dict[str, str] = field(default_factory=dict)  # column -> "p" or "c"
    intervals: dict[str, float] = field(default_factory=dict)  # estimated column -> relative error

    @property
    def key(self) -> list[Column]:
        return refs(self.schema.key)

    def carried(self) -> list[str]:
        names = {"p": ["__p_{}"], "c": ["__pos_{}", "__neg_{}"]}
        return [n.format(c) for c, kind in self.prov.items() for n in names[kind]]


@dataclass
class Value:
    column: Column
    prov: Column | None = None
    pos: Column | None = None
    neg: Column | None = None
    share: bool = False
    relative_error: float | None = None  # of an interval

    @property
    def kind(self) -> str | None:
        return "c" if self.pos is not None else "p" if self.prov is not None else None


def plain(value: object) -> object:
    return value.value if isinstance(value, Enum) else value


# --- expressions ---------------------------------------------------------------------


def evaluate(e: Expr, low: Lowered, ctx: Context) -> Value:
    """Value and provenance of an expression without prompts."""
    if isinstance(e, Alias):
        return evaluate(e.expr, low, ctx)
    if isinstance(e, Lit):
        return Value(F.lit(plain(e.value)))
    if isinstance(e, Native):
        return Value(e.column)
    if isinstance(e, MaxDot):
        return Value(max_dot(evaluate(e.vectors, low, ctx).column, vector(e.query)))
    if isinstance(e, Col):
        return _column(e, low, ctx)
    if isinstance(e, Not):
        inner = evaluate(e.expr, low, ctx)
        return Value(~inner.column, P.token(low.key, str(e.expr), inner.column) if ctx.explain else None)
    if isinstance(e, Binary):
        left, right = evaluate(e.left, low, ctx), evaluate(e.right, low, ctx)
        return _logic(e, left, right, ctx) if e.op in "&|" else _comparison(e, left, right, low, ctx)
    raise TypeError(f"cannot evaluate {e}")


def _column(e: Col, low: Lowered, ctx: Context) -> Value:
    c = ref(e.name)
    kind = low.prov.get(e.name)
    if kind == "p":
        return Value(c, ref(f"__p_{e.name}"))
    dtype = low.schema.field(e.name).dtype
    if e.name in low.intervals:
        both = {"c": (ref(f"__pos_{e.name}"), ref(f"__neg_{e.name}"))}.get(kind, (None, None))
        return Value(c, None, *both, dtype is float, low.intervals[e.name])
    if kind == "c":
        return Value(c, None, ref(f"__pos_{e.name}"), ref(f"__neg_{e.name}"), dtype is float)
    return Value(c, P.token(low.key, e.name, c) if ctx.explain and dtype is bool else None)


def _logic(e: Binary, left: Value, right: Value, ctx: Context) -> Value:
    lv, rv = left.column, right.column
    value = lv & rv if e.op == "&" else lv | rv
    if not ctx.explain:
        return Value(value)
    lp, rp = (v.prov if v.prov is not None else F.lit('{"1":0}') for v in (left, right))
    both = P.joined("*", F.array(lp, rp))
    either = lp if ctx.minimal else P.joined("+", F.array(lp, rp))
    if e.op == "&":
        prov = F.when(lv & rv, both).when(~lv & ~rv, either).when(~lv, lp).otherwise(rp)
    else:
        prov = F.when(lv & rv, either).when(~lv & ~rv, both).when(lv, lp).otherwise(rp)
    return Value(value, prov)


def compare(op: str, a: Column, b: Column) -> Column:
    """``==`` and ``!=`` treat null as a value, as Python does None."""
    return {"==": lambda: a.eqNullSafe(b), "!=": lambda: ~a.eqNullSafe(b), "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def _comparison(e: Binary, left: Value, right: Value, low: Lowered, ctx: Context) -> Value:
    value = _interval_comparison(e, left, right) if left.relative_error is not None or right.relative_error is not None else compare(e.op, left.column, right.column)
    if not ctx.explain:
        return Value(value)
    kinds = (left.kind, right.kind)
    if kinds == ("c", "c"):
        if left.share != right.share:
            raise ValueError(f"{e}: a count is compared with a proportion")
        prov = P.joined("*", F.array(_threshold(e.op, value, left, right.column, ctx), _threshold(FLIP[e.op], value, right, left.column, ctx)))
    elif kinds == ("c", None):
        prov = _threshold(e.op, value, left, right.column, ctx)
    elif kinds == (None, "c"):
        prov = _threshold(FLIP[e.op], value, right, left.column, ctx)
    elif kinds == (None, None):
        prov = P.token(low.key, str(e), value)
    elif "c" in kinds or kinds == ("p", "p"):
        raise ValueError(f"{e}: two explained values cannot be compared")
    else:
        prov = left.prov if left.prov is not None else right.prov
    return Value(value, prov)


def _interval_comparison(e: Binary, left: Value, right: Value) -> Column:
    """A comparison of an interval with a literal holds when it is certain."""
    side, other, op = (left, e.right, e.op) if left.relative_error is not None else (right, e.left, FLIP[e.op])
    if not isinstance(other, Lit):
        raise ValueError(f"{e}: an estimated value can only be compared with a literal")
    return satisfies(op, side.column["lower"], side.column["upper"], float(other.plain), side.relative_error)


def _threshold(op: str, holds: Column, side: Value, bound: Column, ctx: Context) -> Column:
    why = (P.witnessed if ctx.minimal else P.compared)(op, holds, bound, side.share, side.pos, side.neg)
    if side.relative_error is not None and op in (">", ">="):  # what was sampled stands for the rest: all of it that is true
        return F.when(holds, P.joined("*", side.pos)).otherwise(why)
    return why


# --- prompts --------------------------------------------------------------------------


def ask(low: Lowered, prompts: list[Prompt], names: list[str], ctx: Context) -> DataFrame:
    """``low.df`` with the answers to ``prompts`` about the same row in columns ``names``."""
    if ctx.model is None:
        raise ValueError("a prompt needs a language model; register one with the session")
    fields = list(dict.fromkeys(f for p in prompts for f in p.fields))
    said = tuple((f, d) for f in fields if (d := low.schema.field(f).description))
    request = F.struct(*(ref(f).cast("string").alias(f) for f in fields)) if fields else F.struct(F.lit("").alias("_"))
    kinds = [spark_type(p.dtype) for p in prompts]
    if ctx.cache is not None:
        return _ask_cached(low, prompts, names, kinds, fields, said, request, ctx)
    schema = ", ".join(f"a{i} {k.simpleString()}" for i, k in enumerate(kinds))
    answer = answering(ctx.model, [(p.text, p.dtype) for p in prompts], fields, said, (ctx.counter, ctx.characters), schema)
    out = low.df.withColumn("__answers", answer(request))
    return out.select(*refs(low.df.columns), *(F.col(f"__answers.a{i}").alias(n) for i, n in enumerate(names)))


def answering(model: LanguageModel, prompts: list[tuple[str, object]], fields: list[str], said: tuple, counters: tuple, schema: str):
    """Struct-valued UDF; each distinct request of a batch is answered once. About ``PART`` requests
    at a time are Python objects; of those that are answered a digest is kept."""

    kinds = to_arrow_type(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield answers(batch)
            del batch
            give_back()

    def answers(batch: pa.Array) -> pa.Array:
        keys, known, waiting = [], {}, {}
        for at in range(0, len(batch), PART):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, PART).flatten()), strict=True):
                key = hashlib.blake2b(repr(row).encode("utf-8", "surrogatepass"), digest_size=16).digest()
                keys.append(key)
                if key not in known:
                    waiting[key] = row
            if len(waiting) >= PART or at + PART >= len(batch):
                known.update(zip(waiting, answer(list(waiting.values())), strict=True))
                waiting = {}
        return pa.StructArray.from_arrays([pa.array([known[k][i] for k in keys], f.type) for i, f in enumerate(kinds)], fields=list(kinds))

    def answer(distinct: list[tuple]) -> list[tuple]:
        requests = [Request(prompts[0][0], tuple(zip(fields, r, strict=False)), said) for r in distinct]
        if not requests:
            return []
        got = model.answer_fused(requests, prompts) if len(prompts) > 1 else [(a,) for a in model.answer(requests, prompts[0][1])]
        counter, characters = counters
        if counter is not None:
            counter.add(len(distinct))
            characters.add(sum(len(replace(r, prompt=p).text(d)) for r in requests for p, d in prompts))
        return got

    return F.arrow_udf(run, schema).asNondeterministic()


def _ask_cached(low: Lowered, prompts, names, kinds, fields, said, request, ctx: Context) -> DataFrame:
    """Answers through the response cache: only requests that it lacks reach the model."""
    spark = low.df.sparkSession
    df = low.df
    for p, name, kind in zip(prompts, names, kinds, strict=True):
        text = F.concat_ws("\x1f", F.lit(ctx.model.name), F.lit(p.text), F.lit(str(p.dtype)), F.to_json(request))
        keyed = materialise(df.withColumn("__key", F.md5(text)), "asked")
        wanted = keyed.select("__key", request.alias("request")).dropDuplicates(["__key"])
        known = ctx.cache.read(spark)
        new = wanted.join(known, wanted["__key"] == known["key"], "left_anti")
        schema = f"a0 {kind.simpleString()}"
        answer = answering(ctx.model, [(p.text, p.dtype)], fields, said, (ctx.counter, ctx.characters), schema)
        fresh = materialise(new.withColumn("a", answer(F.col("request"))).select(F.col("__key").alias("key"), F.col("a.a0").cast("string").alias("answer")), "answers")
        if ctx.hits is not None:
            ctx.hits.add(wanted.count() - fresh.count())
        ctx.cache.append(fresh)
        answers = ctx.cache.read(spark).dropDuplicates(["key"]).select(F.col("key").alias("__key"), F.col("answer").cast(kind).alias(name))
        df = keyed.join(answers, "__key").drop("__key")
    return df


def _replace_prompts(e: Expr, names: dict[Prompt, str]) -> Expr:
    if isinstance(e, Prompt):
        return Col(names[e])
    if isinstance(e, (Alias, Not)):
        return replace(e, expr=_replace_prompts(e.expr, names))
    if isinstance(e, Binary):
        return replace(e, left=_replace_prompts(e.left, names), right=_replace_prompts(e.right, names))
    if isinstance(e, Agg):
        return replace(e, arg=_replace_prompts(e.arg, names))
    return e


def with_prompts(exprs: list[Expr], low: Lowered, ctx: Context) -> tuple[Lowered, list[Expr]]:
    """Ask every prompt in ``exprs`` (one call for all), and refer to the answers' columns."""
    prompts = list(dict.fromkeys(x for e in exprs for x in e.walk() if isinstance(x, Prompt)))
    if not prompts:
        return low, exprs
    names = {p: f"__answer_{i}" for i, p in enumerate(prompts)}
    df = ask(low, prompts, list(names.values()), ctx)
    out = Lowered(df, low.schema.with_fields(*(Field(names[p], p.dtype) for p in prompts)), dict(low.prov))
    if ctx.explain:
        for p in prompts:
            if p.dtype is bool:
                out.df = out.df.withColumn(f"__p_{names[p]}", P.token(low.key, str(p), ref(names[p])))
                out.prov[names[p]] = "p"
    return out, [_replace_prompts(e, names) for e in exprs]


# --- nodes ----------------------------------------------------------------------------


def lower(node: Node, ctx: Context, given: dict[int, Lowered] | None = None) -> Lowered:
    """``given`` maps ``id(node)`` to what stands for a node that is evaluated already."""
    if given and id(node) in given:
        return given[id(node)]
    if isinstance(node, Scan):
        return Lowered(node.df, node.schema)
    low = lower(node.input, ctx, given)
    if isinstance(node, ORDERING):
        return low
    if isinstance(node, Log):
        base = materialise(low.df, "log")
        write_log(base.select(*refs(low.schema.names)), low.schema, node.path)
        return replace_df(low, base)
    if isinstance(node, Filter):
        asked, (e,) = with_prompts([node.predicate], low, ctx)
        kept = asked.df.where(evaluate(e, asked, replace(ctx, explain=False)).column)
        return replace_df(low, kept.select(*refs(low.df.columns)))
    if isinstance(node, Project):
        return _project(low, [node.expr], ctx)
    if isinstance(node, Fused):
        asked, exprs = with_prompts([*node.filters, *node.exprs], low, ctx)
        quiet = replace(ctx, explain=False)
        for e in exprs[: len(node.filters)]:
            asked.df = asked.df.where(evaluate(e, asked, quiet).column)
        return _assign(low, asked, exprs[len(node.filters) :], list(node.exprs), ctx)
    if isinstance(node, Aggregate):
        return _aggregate(node, low, ctx)
    if isinstance(node, Rank):
        return _rank(node, low, ctx)
    if isinstance(node, Check):
        v = evaluate(node.predicate, low, ctx)
        name = str(node.predicate)
        out = Lowered(low.df.select(*refs(node.schema.key), v.column.alias(name), *([v.prov.alias(f"__p_{name}")] if v.prov is not None else [])), node.schema)
        if v.prov is not None:
            out.prov[name] = "p"
        return out
    raise TypeError(f"unknown node {node.label()}")


def replace_df(low: Lowered, df: DataFrame) -> Lowered:
    return Lowered(df, low.schema, dict(low.prov), dict(low.intervals))


def _project(low: Lowered, exprs: list[Expr], ctx: Context) -> Lowered:
    asked, new = with_prompts(exprs, low, ctx)
    return _assign(low, asked, new, exprs, ctx)


def _assign(low: Lowered, asked: Lowered, exprs: list[Expr], named: list[Expr], ctx: Context) -> Lowered:
    """The input columns and one column for each expression, under its name."""
    prov, cols, fields = dict(low.prov), {}, []
    for e, original in zip(exprs, named, strict=True):
        name, v = str(original), evaluate(e, asked, ctx)
        cols[name] = v.column
        fields.append(Field(name, dtype_of(original, low.schema)))
        prov.pop(name, None)
        if v.kind == "p":
            prov[name], cols[f"__p_{name}"] = "p", v.prov
        elif v.kind == "c":
            prov[name], cols[f"__pos_{name}"], cols[f"__neg_{name}"] = "c", v.pos, v.neg
    old = [c for c in low.df.columns if c not in cols]
    out = Lowered(asked.df.select(*refs(old), *(c.alias(n) for n, c in cols.items())), low.schema.with_fields(*fields), prov)
    return out


def checked(v: Column, e: Expr, ctx: Context) -> Column:
    """The argument of an aggregate; a null is an error in strict mode."""
    return F.when(v.isNull(), F.raise_error(F.lit(f"{e} is null")).cast("boolean")).otherwise(v) if ctx.strict_nulls else v


def exact(kind: str, v: Column) -> Column:
    """The four quantifiers with their values for no rows: 0, 0.0, true, false."""
    if kind == "count_if":
        return F.count_if(v)
    if kind == "proportion":
        return F.coalesce(F.avg(v.cast("double")), F.lit(0.0))
    return F.coalesce(F.bool_and(v), F.lit(True)) if kind == "bool_and" else F.coalesce(F.bool_or(v), F.lit(False))


def _aggregate(node: Aggregate, low: Lowered, ctx: Context) -> Lowered:
    asked, exprs = with_prompts([unalias(a).arg for a in node.aggs] + list(node.group_by), low, ctx)
    args, groups = exprs[: len(node.aggs)], exprs[len(node.aggs) :]
    columns, values = {}, []
    for i, (a, e) in enumerate(zip(node.aggs, args, strict=True)):
        v = evaluate(e, asked, ctx)
        columns[f"__v{i}"] = checked(v.column, unalias(a).arg, ctx)
        if v.prov is not None:
            columns[f"__w{i}"] = v.prov
        values.append(v)
    keys = [evaluate(g, asked, replace(ctx, explain=False)).column.alias(str(n)) for g, n in zip(groups, node.group_by, strict=True)]
    order = [ref(k).alias(f"__o{i}") for i, k in enumerate(low.schema.key)] if ctx.explain else []
    flat = asked.df.select(*keys, *order, *(c.alias(n) for n, c in columns.items()))
    names = [str(g) for g in node.group_by]
    limits = {i: limit for i, a in enumerate(node.aggs) if values[i].prov is not None and (limit := _limit(a, node, ctx)) is not None}
    if limits and not flat._jdf.queryExecution().analyzed().deterministic():
        flat = materialise(flat, "arguments")  # read more than once: prompts are asked once
    out, prov = [], {}
    for i, a in enumerate(node.aggs):
        name, kind = str(a), unalias(a).kind
        out.append(exact(kind, F.col(f"__v{i}")).alias(name))
        if values[i].prov is not None:
            prov[name] = "c"
            if i not in limits:
                out += _sides(i, name, len(order))
    df = flat.groupBy(*refs(names)).agg(*out) if names else flat.agg(*out)
    for i, limit in limits.items():
        df = _with_witnesses(df, flat, names, i, str(node.aggs[i]), limit, len(order))
    done = Lowered(df if names else df.withColumn(AGG_KEY, F.lit(AGG_ROW)), node.schema, prov)
    return settle(done, node, ctx)


def _sides(i: int, name: str, n_order: int) -> list[Column]:
    """The explanations of the true and of the false arguments of aggregate ``i``, in row order."""
    rank = [F.col(f"__o{j}") for j in range(n_order)]
    take = lambda truth: F.transform(F.array_sort(F.collect_list(F.when(F.col(f"__v{i}") == truth, F.struct(*rank, F.col(f"__w{i}").alias("w"))))), lambda x: x["w"])
    return [take(True).alias(f"__pos_{name}"), take(False).alias(f"__neg_{name}")]


@dataclass(frozen=True)
class Limit:
    """What a minimal explanation of an aggregate reads: all rows of a group that meets ``whole``,
    of others the first ``most`` whose argument is ``truth``."""

    truth: bool
    most: int
    whole: Column


def _limit(a: Expr, node: Aggregate, ctx: Context) -> Limit | None:
    """None if the explanation may read every row."""
    name, kind = str(a), unalias(a).kind
    if not ctx.minimal:
        return None
    if kind in ("bool_or", "bool_and"):
        return Limit(kind == "bool_or", 1, ~ref(name) if kind == "bool_or" else ref(name))
    bounds = [(op, v) for n, op, v in node.bounds if n == name]
    if kind != "count_if" or not bounds:
        return None
    at_least = [P.at_least(op, compare(op, ref(name), F.lit(v))) for op, v in bounds]
    most = max(0, *(math.floor(v + 1e-9) + 1 if op in (">", "<=") else math.ceil(v - 1e-9) for op, v in bounds))
    return Limit(True, most, ~reduce(Column.__and__, at_least))


def _with_witnesses(df: DataFrame, flat: DataFrame, names: list[str], i: int, name: str, limit: Limit, n_order: int) -> DataFrame:
    """``df``, a row for each group, with the sides of aggregate ``i`` as far as ``limit`` needs them.

    Each task passes on the first rows of its groups only, so that the rows of a group meet in
    one task just where all of them are the explanation.
    """
    rows = flat.select(*refs(names), *(f"__o{j}" for j in range(n_order)), f"__v{i}", f"__w{i}")
    groups = df.where(limit.whole).select(*(ref(n).alias(f"__g{j}") for j, n in enumerate(names)), F.lit(True).alias("__whole"))
    same = reduce(Column.__and__, (ref(n).eqNullSafe(F.col(f"__g{j}")) for j, n in enumerate(names)), F.lit(True))
    first = rows.where(F.col(f"__v{i}") == limit.truth)
    first = first.withColumn("__at", F.row_number().over(Window.partitionBy(*refs(names)).orderBy(*(f"__o{j}" for j in range(n_order)), f"__w{i}"))).where(F.col("__at") <= limit.most)
    kept = first.join(groups, same, "left_anti").select(*rows.columns).union(rows.join(groups, same, "left_semi"))
    sides = kept.groupBy(*(ref(n).alias(f"__g{j}") for j, n in enumerate(names))).agg(*_sides(i, name, n_order))
    out = df.join(sides, same, "left")
    held = [F.coalesce(ref(c), F.array().cast("array<string>")).alias(c) for c in (f"__pos_{name}", f"__neg_{name}")]
    return out.select(*refs(df.columns), *held)


def settle(done: Lowered, node: Aggregate, ctx: Context) -> Lowered:
    """Boolean quantifiers have a provenance of their own; counts keep their collections."""
    for a in node.aggs:
        name, kind = str(a), unalias(a).kind
        if done.prov.get(name) != "c" or kind not in ("bool_and", "bool_or"):
            continue
        pos, neg = ref(f"__pos_{name}"), ref(f"__neg_{name}")
        one = lambda parts: P.joined("+", F.slice(parts, 1, 1) if ctx.minimal else parts)
        why = F.when(ref(name), P.joined("*", pos)).otherwise(one(neg)) if kind == "bool_and" else F.when(ref(name), one(pos)).otherwise(P.joined("*", neg))
        done.df = done.df.withColumn(f"__p_{name}", why).drop(f"__pos_{name}", f"__neg_{name}")
        done.prov[name] = "p"
    done.df = done.df.select(*refs(done.schema.names), *refs(done.carried()))
    return done


def _rank(node: Rank, low: Lowered, ctx: Context) -> Lowered:
    """Dense rank. Distinct scores are ranked and joined back, so rows never meet in one task."""
    v = evaluate(node.expr, low, ctx)
    df = low.df.withColumn("__score", v.column)
    scores = df.select("__score").distinct()
    by = F.desc("__score") if node.descending else F.asc("__score")
    ranked = scores.withColumn("rank", F.dense_rank().over(Window.orderBy(by)).cast("long")).withColumnRenamed("__score", "__s")
    out = df.drop("rank").join(ranked, F.col("__score").eqNullSafe(F.col("__s"))).drop("__s")
    prov = dict(low.prov)
    if ctx.explain and v.kind == "p":
        raise ValueError(f"{node.expr}: rows cannot be ranked by a boolean")
    if ctx.explain and v.kind == "c":
        out = _rank_provenance(out, low, v, ctx)
        prov["rank"] = "p"
    done = Lowered(out, node.schema, prov)
    done.df = done.df.select(*refs(done.schema.names), *refs(done.carried()))
    return done


def _rank_provenance(df: DataFrame, low: Lowered, v: Value, ctx: Context) -> DataFrame:
    """Why a group ranks where it does: the product of its comparisons with all other groups."""
    side = df.select(F.struct(*low.key).alias("k"), F.col("__score").alias("s"), v.pos.alias("pos"), v.neg.alias("neg"))
    a, b = side.alias("a"), side.alias("b")
    pairs = a.join(b, ~F.col("a.k").eqNullSafe(F.col("b.k")))
    why = F.when(F.col("a.s") > F.col("b.s"), _versus(">", v, ctx)).when(F.col("a.s") < F.col("b.s"), _versus("<", v, ctx)).otherwise(_versus("==", v, ctx))
    each = pairs.select(F.col("a.k").alias("__k"), F.col("b.k").alias("o"), why.alias("w")).groupBy("__k").agg(P.joined("*", F.transform(F.array_sort(F.collect_list(F.struct("o", "w"))), lambda x: x["w"])).alias("__p_rank"))
    return df.withColumn("__k", F.struct(*low.key)).join(each, "__k", "left").withColumn("__p_rank", F.coalesce("__p_rank", F.lit('{"1":0}'))).drop("__k")


def _versus(op: str, v: Value, ctx: Context) -> Column:
    yes, compared = F.lit(True), P.witnessed if ctx.minimal else P.compared
    mine = compared(op, yes, F.col("b.s"), v.share, F.col("a.pos"), F.col("a.neg"))
    theirs = compared(FLIP[op], yes, F.col("a.s"), v.share, F.col("b.pos"), F.col("b.neg"))
    return P.joined("*", F.array(mine, theirs))


def value_of(x: object, dtype: object) -> object:
    """A collected value in the declared Python type."""
    return dtype(x) if isinstance(dtype, type) and issubclass(dtype, Enum) and x is not None else x
