"""Registered queries of the claim engine, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veracord.functions import confseq, intervals
from veracord.functions.vectors import dot, vector
from veracord.models.language import Ensemble, LookupModel, NoisyModel, RuleModel
from veracord.operators import claims, dialogs, prepare, quality, reporting, retrieval
from veracord.plans.expr import Alias, Col, MaxDot, bool_and, bool_or, col, count_if, lit, native, prompt, proportion
from veracord.session import Session
from veracord.sources.tables import read_jsonl, shared_path, write_jsonl
from veracord.streaming import monitor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def registered(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quiet(spark: SparkSession) -> Session:
    return Session(spark).disable_provenance()


def frame(spark: SparkSession, sf_dir: str, name: str, *key: str):
    return quiet(spark).read_frame(table(spark, sf_dir, name), key)


scratch = shared_path


# --- flagship ---------------------------------------------------------------------------


def returned_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with the nation of the customer who ordered them."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))


LINES = "FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey"


@registered(f"""SELECT '_agg' AS _id, count(*) FILTER (share > 1.0 / 3) >= 5 AS verdict
    FROM (SELECT c_nationkey, avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS share {LINES} GROUP BY 1)""")
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At least five nations have more than a third of their line items returned."""
    lines = quiet(spark).read_frame(returned_lines(spark, sf_dir), ("l_orderkey", "l_linenumber"))
    shares = lines.map(col("l_returnflag").eq("R").alias("returned")).aggregate([proportion(col("returned")).alias("share")], [col("c_nationkey")])
    return shares.aggregate([count_if(col("share") > 1 / 3).alias("nations")]).check(Alias(col("nations") >= 5, "verdict")).to_spark()


# --- projection, filter, check -------------------------------------------------------------


@registered("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer WHERE c_acctbal > 5000 AND c_mktsegment <> 'BUILDING'")
def filter_structured(spark, sf_dir):
    return frame(spark, sf_dir, "customer", "c_custkey").filter((col("c_acctbal") > 5000) & col("c_mktsegment").ne("BUILDING")).to_spark()


@registered("SELECT *, NOT (c_acctbal < 0 OR c_nationkey = 3) AS fine FROM customer")
def map_bool(spark, sf_dir):
    return frame(spark, sf_dir, "customer", "c_custkey").map((~((col("c_acctbal") < 0) | col("c_nationkey").eq(3))).alias("fine")).to_spark()


@registered('SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority, o_totalprice >= 150000 AS "o_totalprice >= 150000" FROM orders')
def map_default_name(spark, sf_dir):
    return frame(spark, sf_dir, "orders", "o_orderkey").map(col("o_totalprice") >= 150000).to_spark()


@registered("SELECT c_custkey, 1000 < c_acctbal AS rich FROM customer")
def check_row(spark, sf_dir):
    return frame(spark, sf_dir, "customer", "c_custkey").check(Alias(lit(1000) < col("c_acctbal"), "rich")).to_spark()


@registered("SELECT o_orderkey, o_totalprice / 2 AS half FROM orders WHERE year(o_orderdate) = 1995")
def native_expression(spark, sf_dir):
    """Any Spark column serves as an expression."""
    f = frame(spark, sf_dir, "orders", "o_orderkey").filter(native(F.year("o_orderdate") == 1995, "in_1995")).map(native(F.col("o_totalprice") / 2, "half"))
    return f.to_spark().select("o_orderkey", "half")


# --- quantifiers ----------------------------------------------------------------------------


@registered("SELECT '_agg' AS _id, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem")
def count_if_global(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").aggregate([count_if(col("l_returnflag").eq("R")).alias("n")]).to_spark()


@registered("SELECT '_agg' AS _id, avg(CASE WHEN l_quantity > 25 THEN 1.0 ELSE 0.0 END) AS p FROM lineitem")
def proportion_global(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").aggregate([proportion(col("l_quantity") > 25).alias("p")]).to_spark()


@registered("SELECT '_agg' AS _id, bool_and(l_discount <= 0.1) AS every FROM lineitem")
def bool_and_global(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").aggregate([bool_and(col("l_discount") <= 0.1).alias("every")]).to_spark()


@registered("SELECT '_agg' AS _id, bool_or(l_tax > 0.079) AS some FROM lineitem")
def bool_or_global(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").aggregate([bool_or(col("l_tax") > 0.079).alias("some")]).to_spark()


def _all_four(arg):
    return [count_if(arg).alias("n"), proportion(arg).alias("p"), bool_and(arg).alias("every"), bool_or(arg).alias("some")]


@registered("SELECT '_agg' AS _id, 0::BIGINT AS n, 0.0::DOUBLE AS p, true AS every, false AS some")
def empty_input_identities(spark, sf_dir):
    return frame(spark, sf_dir, "orders", "o_orderkey").filter(col("o_orderkey") < -1).aggregate(_all_four(col("o_totalprice") > 0)).to_spark()


@registered("""SELECT o_orderstatus, count(*) FILTER (o_totalprice > 200000) AS n, avg(CASE WHEN o_totalprice > 200000 THEN 1.0 ELSE 0.0 END) AS p,
    bool_and(o_totalprice > 200000) AS every, bool_or(o_totalprice > 200000) AS some FROM orders GROUP BY 1""")
def grouped_quantifiers(spark, sf_dir):
    return frame(spark, sf_dir, "orders", "o_orderkey").aggregate(_all_four(col("o_totalprice") > 200000), [col("o_orderstatus")]).to_spark()


@registered("SELECT value > 50 AS high, event_type, count(*) FILTER (user_id < 100) AS n FROM events GROUP BY 1, 2")
def group_by_expression(spark, sf_dir):
    return frame(spark, sf_dir, "events", "event_id").aggregate([count_if(col("user_id") < 100).alias("n")], [(col("value") > 50).alias("high"), col("event_type")]).to_spark()


def _nested(spark, sf_dir, inner, outer, inner_by=("c_nationkey", "o_orderstatus"), outer_by=("c_nationkey",)):
    lines = quiet(spark).read_frame(returned_lines(spark, sf_dir), ("l_orderkey", "l_linenumber"))
    return lines.aggregate([inner.alias("i")], [col(k) for k in inner_by]).aggregate([outer.alias("o")], [col(k) for k in outer_by]).to_spark()


def _nested_sql(inner: str, outer: str, inner_by: str = "c_nationkey, o_orderstatus", outer_by: str = "c_nationkey") -> str:
    by, keys = (f"GROUP BY {outer_by}", f"{outer_by}, ") if outer_by else ("", "'_agg' AS _id, ")
    return f"SELECT {keys}{outer} AS o FROM (SELECT {inner_by}, {inner} AS i {LINES} GROUP BY {inner_by}) {by}"


@registered(_nested_sql("bool_or(l_quantity > 49)", "bool_and(i)"))
def nested_forall_exists(spark, sf_dir):
    return _nested(spark, sf_dir, bool_or(col("l_quantity") > 49), bool_and(col("i")))


@registered(_nested_sql("bool_and(l_quantity > 1)", "bool_or(i)"))
def nested_exists_forall(spark, sf_dir):
    return _nested(spark, sf_dir, bool_and(col("l_quantity") > 1), bool_or(col("i")))


@registered(_nested_sql("count(*) FILTER (l_returnflag = 'R')", "avg(CASE WHEN i >= 20 THEN 1.0 ELSE 0.0 END)"))
def nested_prop_card(spark, sf_dir):
    return _nested(spark, sf_dir, count_if(col("l_returnflag").eq("R")), proportion(col("i") >= 20))


@registered(_nested_sql("avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END)", "count(*) FILTER (i > 0.33)", outer_by=""))
def nested_card_prop(spark, sf_dir):
    return _nested(spark, sf_dir, proportion(col("l_returnflag").eq("R")), count_if(col("i") > 0.33), outer_by=())


@registered(_nested_sql("count(*) FILTER (l_quantity > 25)", "bool_and(i >= 10)", outer_by="o_orderstatus"))
def nested_forall_card(spark, sf_dir):
    """The outer key is not a prefix of the inner ones; hashing groups them all the same."""
    return _nested(spark, sf_dir, count_if(col("l_quantity") > 25), bool_and(col("i") >= 10), outer_by=("o_orderstatus",))


@registered(f"""SELECT '_agg' AS _id, bool_and(e) AS verdict FROM (SELECT c_mktsegment, bool_or(n > 2) AS e FROM (
    SELECT c_mktsegment, c_nationkey, count(*) FILTER (l_returnflag = 'R') AS n {LINES} GROUP BY 1, 2) GROUP BY 1)""")
def three_level(spark, sf_dir):
    lines = quiet(spark).read_frame(returned_lines(spark, sf_dir), ("l_orderkey", "l_linenumber"))
    f = lines.aggregate([count_if(col("l_returnflag").eq("R")).alias("n")], [col("c_mktsegment"), col("c_nationkey")])
    return f.aggregate([bool_or(col("n") > 2).alias("e")], [col("c_mktsegment")]).aggregate([bool_and(col("e")).alias("a")]).check(Alias(col("a"), "verdict")).to_spark()


class EventType(Enum):
    CLICK = "click"
    PURCHASE = "purchase"


@registered("""SELECT '_agg' AS _id, bool_or(p >= 0.1 AND q >= 0.1) AS verdict FROM (SELECT user_id, avg(CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END) AS p,
    avg(CASE WHEN event_type = 'purchase' THEN 1.0 ELSE 0.0 END) AS q FROM events GROUP BY 1)""")
def enum_mixed_compound(spark, sf_dir):
    f = frame(spark, sf_dir, "events", "event_id").aggregate([proportion(col("event_type").eq(EventType.CLICK)).alias("p"), proportion(col("event_type").eq(EventType.PURCHASE)).alias("q")], [col("user_id")])
    return f.aggregate([bool_or((col("p") >= 0.1) & (col("q") >= 0.1)).alias("mixed")]).check(Alias(col("mixed"), "verdict")).to_spark()


# --- rank -----------------------------------------------------------------------------------


@registered("SELECT *, dense_rank() OVER (ORDER BY s_acctbal DESC) AS rank FROM supplier")
def rank_desc(spark, sf_dir):
    return frame(spark, sf_dir, "supplier", "s_suppkey").with_rank(col("s_acctbal")).to_spark()


@registered("SELECT p_partkey, p_size, dense_rank() OVER (ORDER BY p_size) AS rank FROM part")
def rank_asc_ties(spark, sf_dir):
    return frame(spark, sf_dir, "part", "p_partkey").with_rank(col("p_size"), descending=False).to_spark().select("p_partkey", "p_size", "rank")


@registered(f"""SELECT c_nationkey, rank <= 3 AS among_top FROM (SELECT c_nationkey, dense_rank() OVER (ORDER BY n DESC) AS rank FROM (
    SELECT c_nationkey, count(*) FILTER (l_returnflag = 'R') AS n {LINES} GROUP BY 1)) WHERE c_nationkey = 7""")
def ordinal_claim(spark, sf_dir):
    lines = quiet(spark).read_frame(returned_lines(spark, sf_dir), ("l_orderkey", "l_linenumber"))
    f = lines.aggregate([count_if(col("l_returnflag").eq("R")).alias("n")], [col("c_nationkey")]).with_rank(col("n"))
    return f.filter(col("c_nationkey").eq(7)).check(Alias(col("rank") <= 3, "among_top")).to_spark()


# --- prompts --------------------------------------------------------------------------------

LICENSED, PERSONAL = "does {text} mention a license", "does {text} have an address or number of a person"
TONE = "what is the tone of {text}"
MODEL = RuleModel({
    LICENSED: ("contains", "text", ("licens", "copyright")), PERSONAL: ("contains", "text", ("@", "+1 (")),
    TONE: ("class", "text", {"loud": "!!", "tabular": " | "}, "plain"),
}, "rules")
SQL_LICENSED = "(contains(lower(coalesce(text, '')), 'licens') OR contains(lower(coalesce(text, '')), 'copyright'))"
SQL_PERSONAL = "(contains(lower(coalesce(text, '')), '@') OR contains(lower(coalesce(text, '')), '+1 ('))"
SQL_TONE = "CASE WHEN contains(lower(coalesce(text, '')), '!!') THEN 'loud' WHEN contains(lower(coalesce(text, '')), ' | ') THEN 'tabular' ELSE 'plain' END"


class Tone(Enum):
    LOUD = "loud"
    TABULAR = "tabular"
    PLAIN = "plain"


def documents(spark, sf_dir, session: Session | None = None, *columns: str):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", *(columns or ("lang", "source")))
    return (session or quiet(spark)).register_model(MODEL).read_frame(docs, ("doc_id",))


@registered(f"SELECT doc_id, lang, {SQL_PERSONAL} AS personal FROM documents WHERE {SQL_LICENSED}")
def semantic_filter_map(spark, sf_dir):
    return documents(spark, sf_dir).filter(prompt(LICENSED)).map(prompt(PERSONAL).alias("personal")).to_spark().select("doc_id", "lang", "personal")


@registered(f"SELECT doc_id, {SQL_PERSONAL} AS personal, {SQL_TONE} AS tone FROM documents WHERE {SQL_LICENSED}")
def fused_filter_map(spark, sf_dir):
    f = documents(spark, sf_dir, quiet(spark).enable_fusion()).filter(prompt(LICENSED)).map(prompt(PERSONAL).alias("personal")).map(prompt(TONE, Tone).alias("tone"))
    return f.to_spark().select("doc_id", "personal", "tone")


@registered(f"SELECT source, count(*) FILTER ({SQL_TONE} = 'loud') AS loud, avg(CASE WHEN {SQL_TONE} = 'plain' THEN 1.0 ELSE 0.0 END) AS plain FROM documents GROUP BY 1")
def enum_prompt(spark, sf_dir):
    f = documents(spark, sf_dir).map(prompt(TONE, Tone).alias("tone"))
    return f.aggregate([count_if(col("tone").eq(Tone.LOUD)).alias("loud"), proportion(col("tone").eq(Tone.PLAIN)).alias("plain")], [col("source")]).to_spark()


@registered("SELECT doc_id, quality = 1 AS good FROM labels")
def lookup_model(spark, sf_dir):
    """A model that answers from a table of known answers."""
    ask = "is quality {quality} good"
    s = quiet(spark).register_model(LookupModel({ask: {"1": True, "0": False}}, "quality"))
    return s.read_frame(table(spark, sf_dir, "labels"), ("doc_id",)).map(prompt(ask).alias("good")).to_spark().select("doc_id", "good")


@registered(f"SELECT doc_id, {SQL_LICENSED} AS licensed FROM documents")
def ensemble_vote(spark, sf_dir):
    """Two sound models outvote one that always errs."""
    s = quiet(spark)
    f = documents(spark, sf_dir, s).map(prompt(LICENSED).alias("licensed"))
    s.register_model(Ensemble((NoisyModel(MODEL, 1.0), MODEL, MODEL)))
    return f.to_spark().select("doc_id", "licensed")


@registered("""SELECT doc_id, CASE WHEN a = b OR a = c THEN a WHEN b = c THEN b ELSE a END AS vote FROM (SELECT doc_id, lang AS a, CASE WHEN doc_id % 2 = 0 THEN 'en' ELSE 'fr' END AS b,
    CASE WHEN doc_id % 3 = 0 THEN 'fr' ELSE 'de' END AS c FROM documents)""")
def vote_columns(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("a"), F.when(F.col("doc_id") % 2 == 0, "en").otherwise("fr").alias("b"), F.when(F.col("doc_id") % 3 == 0, "fr").otherwise("de").alias("c"))
    return quality.majority(d, ["a", "b", "c"]).select("doc_id", "vote")


@registered(f"SELECT doc_id, {SQL_PERSONAL} AS personal FROM documents")
def cached_prompt(spark, sf_dir):
    """The second run finds every answer in the cache."""
    path = scratch(spark, "answers")
    run = lambda: documents(spark, sf_dir, quiet(spark).enable_cache(path)).map(prompt(PERSONAL).alias("personal")).to_spark().select("doc_id", "personal")
    run()
    return run()


@registered(f"SELECT '_agg' AS _id, count(*) FILTER ({SQL_PERSONAL}) >= 10 AS verdict FROM documents")
def early_stop_verdict(spark, sf_dir):
    """Prompts are asked in waves until ten documents are found; only the verdict is comparable."""
    f = documents(spark, sf_dir, quiet(spark).enable_batching(256).enable_early_stop()).map(prompt(PERSONAL).alias("personal")).aggregate([count_if(col("personal")).alias("n")]).check(Alias(col("n") >= 10, "verdict"))
    return spark.createDataFrame([r.values for r in f.collect().rows], "_id string, verdict boolean")


@registered(f"SELECT source, count(*) FILTER ({SQL_LICENSED}) > 2 AS verdict FROM documents GROUP BY 1")
def group_skip_verdict(spark, sf_dir):
    f = documents(spark, sf_dir, quiet(spark).enable_batching(64).enable_early_stop()).map(prompt(LICENSED).alias("l")).aggregate([count_if(col("l")).alias("n")], [col("source")]).check(Alias(col("n") > 2, "verdict"))
    return spark.createDataFrame([r.values for r in f.collect().rows], "source string, verdict boolean")


@registered(f"SELECT '_agg' AS _id, avg(CASE WHEN {SQL_LICENSED} THEN 1.0 ELSE 0.0 END) >= 0.5 AS verdict FROM documents")
def estimated_verdict(spark, sf_dir):
    """Decided from a random part of the rows by a confidence sequence."""
    s = quiet(spark).enable_batching(64).enable_estimation(seed=7)
    f = documents(spark, sf_dir, s).map(prompt(LICENSED).alias("l")).aggregate([proportion(col("l")).alias("p")]).check(Alias(col("p") >= 0.5, "verdict"))
    return spark.createDataFrame([r.values for r in f.collect().rows], "_id string, verdict boolean")


@registered(f"SELECT '_agg' AS _id, bool_or({SQL_LICENSED}) AS verdict FROM documents")
def relevance_sorted_verdict(spark, sf_dir):
    """Likely documents first: the words of the prompt rank them."""
    s = quiet(spark).enable_batching(64).enable_relevance_sort()
    f = documents(spark, sf_dir, s).map(prompt(LICENSED).alias("l")).aggregate([bool_or(col("l")).alias("a")]).check(Alias(col("a"), "verdict"))
    return spark.createDataFrame([r.values for r in f.collect().rows], "_id string, verdict boolean")


# --- retrieval ---------------------------------------------------------------------------------

QUERY = [1.0 if i % 4 == 0 else -0.5 if i % 4 == 1 else 0.0 for i in range(64)]
SQL_QUERY = "[" + ", ".join(map(str, QUERY)) + "]::DOUBLE[]"
SQL_DOT = f"round(list_inner_product(embedding::DOUBLE[], {SQL_QUERY}), 6)"


@registered(f"SELECT vec_id, label FROM embeddings WHERE {SQL_DOT} >= 0.5")
def max_dot_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "label", F.array("embedding").alias("v"))
    f = quiet(spark).read_frame(rows, ("vec_id",)).map(Alias(MaxDot(Col("v"), tuple(QUERY)), "best"))
    return f.to_spark().where(F.round("best", 6) >= 0.5).select("vec_id", "label")


def _corpus(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return docs.join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding"), "doc_id")


_HITS = lambda words: " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in words)
_RRF = f"""SELECT doc_id, lang, round(1.0 / (60 + dense_rank() OVER (ORDER BY a DESC)) + 1.0 / (60 + dense_rank() OVER (ORDER BY b)) + 1.0 / (60 + dense_rank() OVER (ORDER BY s DESC)), 9) AS score
    FROM (SELECT doc_id, lang, {_HITS(('licens', 'the'))} AS a, {_HITS(('!!',))} AS b, {SQL_DOT} AS s FROM documents JOIN embeddings ON doc_id = vec_id {{where}})"""


_ENGLISH = _RRF.format(where="WHERE lang = 'en'")


@registered(_RRF.format(where=""))
def rrf_rank(spark, sf_dir):
    scored = retrieval.rrf_score(_corpus(spark, sf_dir), "text", "embedding", QUERY, ["licens", "the"], ["!!"], digits=6)
    return scored.select("doc_id", "lang", F.round("score", 9).alias("score"))


@registered(f"SELECT doc_id, score FROM ({_ENGLISH}) ORDER BY score DESC, doc_id LIMIT 20 OFFSET 10")
def rrf_topk(spark, sf_dir):
    d = _corpus(spark, sf_dir).where("lang = 'en'")
    scored = retrieval.rrf_score(d, "text", "embedding", QUERY, ["licens", "the"], ["!!"], digits=6).withColumn("score", F.round("score", 9))
    return scored.orderBy(F.desc("score"), "doc_id").offset(10).limit(20).select("doc_id", "score")


@registered(f"""SELECT t AS threshold, count(*) FILTER (s >= t) AS selected, count(*) FILTER (s >= t AND label < 3) AS true_positives
    FROM (SELECT {SQL_DOT} AS s, label FROM embeddings), (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5]::DOUBLE[]) AS t) GROUP BY 1""")
def threshold_sweep(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return retrieval.threshold_sweep(e, F.round(dot(F.col("embedding"), vector(QUERY)), 6), F.col("label") < 3, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5])


@registered(r"""SELECT doc_id, (i - 1)::INT AS at, l[i] AS sentence FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id,
    list_filter(string_split(regexp_replace(coalesce(text, ''), '([.!?])\s+|\n+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x) <> '') AS l FROM documents))""")
def sentence_explode(spark, sf_dir):
    return retrieval.explode_sentences(table(spark, sf_dir, "documents"), "text", "doc_id")


@registered("SELECT doc_id, source FROM (SELECT doc_id, source, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id) AS s FROM documents) WHERE s <= 50000")
def token_budget_prefix(spark, sf_dir):
    return retrieval.within_budget(table(spark, sf_dir, "documents"), ["doc_id"], F.col("n_chars"), 50000, ["source"]).select("doc_id", "source")


# --- provenance ------------------------------------------------------------------------------------


@registered("""SELECT o_orderstatus AS grp, o_orderkey AS witness, 'o_totalprice > 200000' AS predicate, true AS sign FROM (
    SELECT o_orderstatus, o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS n FROM orders WHERE o_totalprice > 200000) WHERE n <= 3""")
def provenance_witnesses_minimal(spark, sf_dir):
    """The first three orders that show that a status has at least three large ones."""
    s = Session(spark).enable_minimal_provenance()
    f = s.read_frame(table(spark, sf_dir, "orders"), ("o_orderkey",))
    r = f.aggregate([count_if(col("o_totalprice") > 200000).alias("n")], [col("o_orderstatus")]).check(Alias(col("n") >= 3, "many")).collect()
    return spark.createDataFrame([(g, w, p, sign) for g, _, w, p, sign in _tokens(r, "many")], "grp string, witness long, predicate string, sign boolean")


def _tokens(result, column: str) -> list[tuple]:
    return [(row.values[0], a, t.row_id[0], t.predicate, t.sign) for row in result.rows for a, m in enumerate(row.provenance[column].monomials) for t in m]


@registered("""SELECT x.n_nationkey AS a, y.n_nationkey AS b FROM nation x JOIN nation y ON x.n_nationkey < y.n_nationkey WHERE x.n_regionkey = 2 AND y.n_regionkey = 2""")
def provenance_full_small(spark, sf_dir):
    """All pairs of nations that show that region 2 has at least two: the alternatives of a full explanation."""
    f = Session(spark).read_frame(table(spark, sf_dir, "nation"), ("n_nationkey",))
    r = f.aggregate([count_if(col("n_regionkey").eq(2)).alias("n")]).check(Alias(col("n") >= 2, "two")).collect()
    pairs = [tuple(sorted(t.row_id[0] for t in m)) for m in r.provenance("two").monomials]
    return spark.createDataFrame(pairs, "a int, b int")


@registered()
def rank_provenance(spark, sf_dir):
    f = Session(spark).enable_minimal_provenance().read_frame(table(spark, sf_dir, "nation"), ("n_nationkey",))
    r = f.aggregate([count_if(col("n_nationkey") < 12).alias("n")], [col("n_regionkey")]).with_rank(col("n")).filter(col("n_regionkey").eq(1)).check(Alias(col("rank") <= 2, "top")).collect()
    return spark.createDataFrame([(a, w, s) for _, a, w, _, s in _tokens(r, "top")], "alternative int, n_nationkey int, sign boolean")


# --- statistics ----------------------------------------------------------------------------------------


@registered("""SELECT event_type, round(c / n, 9) AS lower, round(1 - (s - c) / n, 9) AS upper FROM (SELECT event_type, count(*) FILTER (event_id % 3 = 0 AND value > 50)::DOUBLE AS c,
    count(*) FILTER (event_id % 3 = 0)::DOUBLE AS s, count(*)::DOUBLE AS n FROM events GROUP BY 1)""")
def confseq_logical_bounds(spark, sf_dir):
    seen = F.col("event_id") % 3 == 0
    n = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(seen & (F.col("value") > 50)).alias("c"), F.count_if(seen).alias("s"), F.count("*").alias("n"))
    low, high = intervals.logical_bounds(F.col("c"), F.col("s"), F.col("n"))
    return n.select("event_type", F.round(low, 9).alias("lower"), F.round(high, 9).alias("upper"))


@registered("""SELECT event_id, round(sum(l * x) OVER w / sum(l) OVER w, 6) AS centre, round((ln(2 / 0.05) + sum(l * l) OVER w / 8) / sum(l) OVER w, 6) AS half FROM (
    SELECT event_id, event_type, (value > 50)::INT AS x, least(1.0, sqrt(8 * ln(2 / 0.05) / (t * ln(t + 1)))) AS l FROM (
    SELECT *, (row_number() OVER (PARTITION BY event_type ORDER BY event_id))::DOUBLE AS t FROM events)) WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def hoeffding_predmix_cs(spark, sf_dir):
    stake, sums = confseq.hoeffding_predmix(F.col("x"), ["event_id"], ["event_type"])
    e = table(spark, sf_dir, "events").select("event_id", "event_type", (F.col("value") > 50).cast("int").alias("x")).withColumn("l", stake)
    centre, half = sums("l")
    return e.select("event_id", F.round(centre, 6).alias("centre"), F.round(half, 6).alias("half"))


@registered("""SELECT user_id, round(avg((value > 50)::INT), 9) AS lower, round(avg((value > 50)::INT), 9) AS upper FROM events GROUP BY 1""")
def betting_cs_exhausted(spark, sf_dir):
    """With all of a user's events seen, the interval is their mean."""
    return _user_bounds(table(spark, sf_dir, "events"), 1).drop("n")


@registered()
def betting_cs_bounds(spark, sf_dir):
    """Interval of the share of high values of each user after all events so far, of a population twice as large.

    A sequence is a user's events in order; the tests hold it against the plain class.
    """
    return _user_bounds(table(spark, sf_dir, "events"), 2)


def _user_bounds(events: DataFrame, times: int) -> DataFrame:
    e = events.select("user_id", "event_id", (F.col("value") > 50).alias("x"))

    def bounds(pdf):
        import pandas as pd

        x = pdf.sort_values("event_id").x.tolist()
        low, high = confseq.estimate_mean(x, 0.95, times * len(x))
        return pd.DataFrame({"user_id": [pdf.user_id.iloc[0]], "n": [len(x)], "lower": [round(low, 9)], "upper": [round(high, 9)]})

    return e.groupBy("user_id").applyInPandas(bounds, "user_id long, n long, lower double, upper double")


@registered("""SELECT lower, upper, lower > 0.3 AS gt, upper < 0.5 AS lt, lower >= 0.4 - 0.4 * 0.05 AND upper <= 0.4 + 0.4 * 0.05 AS eq, upper < 0.4 - 0.4 * 0.05 OR lower > 0.4 + 0.4 * 0.05 AS ne
    FROM (SELECT value / 200 AS lower, value / 200 + 0.01 AS upper FROM events)""")
def interval_compare(spark, sf_dir):
    e = table(spark, sf_dir, "events").select((F.col("value") / 200).alias("lower"), (F.col("value") / 200 + 0.01).alias("upper"))
    said = lambda op, c: intervals.satisfies(op, F.col("lower"), F.col("upper"), c, 0.05)
    return e.select("lower", "upper", said(">", 0.3).alias("gt"), said("<", 0.5).alias("lt"), said("==", 0.4).alias("eq"), said("!=", 0.4).alias("ne"))


# --- quality ------------------------------------------------------------------------------------------------


@registered(f"""SELECT count(*) FILTER (kept AND want) AS true_positives, count(*) FILTER (kept AND NOT want) AS false_positives, count(*) FILTER (NOT kept AND want) AS false_negatives
    FROM (SELECT {SQL_LICENSED} AS kept, quality = 1 AS want FROM documents JOIN labels USING (doc_id))""")
def evaluate_filter(spark, sf_dir):
    both = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").select("doc_id", "text", "quality")
    f = quiet(spark).register_model(MODEL).read_frame(both, ("doc_id",))
    q = f.filter(col("quality").eq(1)).evaluate_filter(f, f.filter(prompt(LICENSED)))
    return spark.createDataFrame([(q.true_positives, q.false_positives, q.false_negatives)], "true_positives long, false_positives long, false_negatives long")


@registered("SELECT count(*) AS rows, avg((lang IS NOT DISTINCT FROM l)::INT) AS lang FROM (SELECT lang, CASE WHEN doc_id % 4 = 0 THEN 'en' ELSE lang END AS l FROM documents)")
def evaluate_map(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return quality.map_quality(d, d.withColumn("lang", F.when(F.col("doc_id") % 4 == 0, "en").otherwise(F.col("lang"))), ["doc_id"], ["lang"])


@registered("""SELECT o_orderkey, o_totalprice > 100000 AS holds, coalesce((o_totalprice > 100000) = true, false) AS valid FROM orders""")
def evaluate_tokens(spark, sf_dir):
    return judged_orders(spark, table(spark, sf_dir, "orders"))


def judged_orders(spark, orders):
    """Tokens of all orders, judged by a join."""
    f, p = quiet(spark).read_frame(orders, ("o_orderkey",)), col("o_totalprice") > 100000
    tokens = f.check(Alias(p, "holds")).to_spark().withColumn("sign", F.lit(True))
    return f.judge_tokens(tokens, p).select("o_orderkey", "holds", "valid")


@registered("""SELECT doc_id, quality FROM (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY md5('42|' || doc_id), doc_id) AS n FROM labels) ORDER BY n, quality LIMIT 60""")
def stratified_sample_md5(spark, sf_dir):
    return quality.stratified_sample(table(spark, sf_dir, "labels"), "quality", "doc_id", "42", 60).select("doc_id", "quality")


@registered("""SELECT doc_id, row_number() OVER (ORDER BY md5('7|' || source), source, md5('7|' || doc_id), doc_id) AS place FROM documents""")
def seeded_shuffle_md5(spark, sf_dir):
    from pyspark.sql import Window

    d = quality.seeded_shuffle(table(spark, sf_dir, "documents").select("doc_id", "source"), ["source"], "doc_id", "7")
    place = F.row_number().over(Window.orderBy(F.md5(F.concat(F.lit("7|"), "source")), "source", F.md5(F.concat(F.lit("7|"), F.col("doc_id").cast("string"))), "doc_id"))
    return d.select("doc_id", place.alias("place"))


@registered("""SELECT lang, n, round(k / n, 9) AS agreement, round(greatest((k / n + z * z / (2 * n) - z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n), 0.0), 9) AS lower,
    round((k / n - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 9) AS kappa
    FROM (SELECT lang, count(*) AS n, count(*) FILTER ((quality = 1) = (toxic = 0))::DOUBLE AS k, avg((quality = 1)::INT) AS pa, avg((toxic = 0)::INT) AS pb, 1.959963984540054 AS z FROM documents JOIN labels USING (doc_id) GROUP BY 1)""")
def cohen_kappa_wilson(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    out = quality.agreement(d, F.col("quality") == 1, F.col("toxic") == 0, "lang")
    return out.select("lang", "n", F.round("agreement", 9).alias("agreement"), F.round("lower", 9).alias("lower"), F.round("kappa", 9).alias("kappa"))


# --- dialogs and reports -----------------------------------------------------------------------------------------


@registered("""SELECT conv_id, count(*) AS turns, string_agg(role || ': ' || coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS dialog FROM conversations GROUP BY 1 HAVING count(*) BETWEEN 3 AND 20""")
def dialog_reconstruct(spark, sf_dir):
    return dialogs.concat_turns(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text", 3, 20)


@registered("SELECT l_orderkey, l_linenumber, l_partkey AS partkey, l_quantity, p_name, p_type FROM lineitem JOIN part ON l_partkey = p_partkey WHERE contains(p_type, 'STEEL')")
def owner_join(spark, sf_dir):
    """Line items of the parts whose type names a material."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("partkey"), "l_quantity")
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("partkey"), "p_name", "p_type")
    return prepare.with_owner(items, parts, "partkey", "p_type", "STEEL").select("l_orderkey", "l_linenumber", "partkey", "l_quantity", "p_name", "p_type")


@registered("""SELECT event_id, event_id - event_id % 16 AS root, (bit_count(event_id % 16))::INT AS depth FROM events""")
def thread_roots(spark, sf_dir):
    """Each event answers the one whose id lacks its lowest bit of four; every sixteenth starts a thread."""
    bit = F.col("event_id").bitwiseAND(-F.col("event_id"))
    m = table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_id") % 16 == 0, F.lit(-1)).otherwise(F.col("event_id") - bit).alias("parent"))
    return dialogs.thread_roots(m, "event_id", "parent")


RUNS = "(SELECT event_id, user_id % 20 AS claim, event_type AS variant, (event_id % 3)::INT AS trial, value + 1 AS latency, (event_id * 7) % 1000 AS tin, (event_id * 3) % 500 AS tout, value > 30 AS said, user_id % 2 = 0 AS truth FROM events)"


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id", (F.col("user_id") % 20).alias("claim"), F.col("event_type").alias("variant"), (F.col("event_id") % 3).cast("int").alias("trial"), (F.col("value") + 1).alias("latency"),
        (F.col("event_id") * 7 % 1000).alias("tin"), (F.col("event_id") * 3 % 500).alias("tout"), (F.col("value") > 30).alias("said"), (F.col("user_id") % 2 == 0).alias("truth"),
    )


@registered(f"SELECT claim, round(sum((tin * 5.0 + tout * 25.0) / 1e6), 6) AS cost FROM {RUNS} GROUP BY 1")
def cost_model(spark, sf_dir):
    runs = _runs(spark, sf_dir)
    prices = runs.select("variant").distinct().select("variant", F.lit(5.0).alias("price_in"), F.lit(25.0).alias("price_out"))
    priced = reporting.cost(runs, prices, "variant", "tin", "tout")
    return priced.groupBy("claim").agg(F.round(F.sum("cost"), 6).alias("cost"))


@registered(f"SELECT claim, variant, round(avg(latency), 6) AS mean, min(latency) AS least, max(latency) AS greatest, count(latency) AS trials FROM {RUNS} GROUP BY 1, 2")
def claim_summary(spark, sf_dir):
    return reporting.trial_summary(_runs(spark, sf_dir), ["claim", "variant"], "latency").withColumn("mean", F.round("mean", 6))


VARIANTS = ("click", "error", "purchase", "signup", "view")


@registered("SELECT claim, " + ", ".join(f"round(avg(latency) FILTER (variant = '{v}') - avg(latency) FILTER (variant = 'click'), 6) AS delta_{v}" for v in VARIANTS[1:]) + f" FROM {RUNS} GROUP BY 1")
def ablation_pivot(spark, sf_dir):
    out = reporting.ablation(_runs(spark, sf_dir), "claim", "variant", "click", "latency", list(VARIANTS[1:]))
    return out.select("claim", *(F.round(f"delta_{v}", 6).alias(f"delta_{v}") for v in VARIANTS[1:]))


@registered(f"SELECT variant, round(exp(avg(ln((tin + 1.0) / (tout + 1.0)))), 6) AS multiplier FROM {RUNS} GROUP BY 1")
def geomean_multiplier(spark, sf_dir):
    return reporting.geometric_mean_ratio(_runs(spark, sf_dir), ["variant"], F.col("tin") + 1.0, F.col("tout") + 1.0).withColumn("multiplier", F.round("multiplier", 6))


@registered(f"SELECT variant, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS deviation FROM (SELECT variant, claim, avg(latency) AS m FROM {RUNS} GROUP BY 1, 2) GROUP BY 1")
def two_level_mean(spark, sf_dir):
    out = reporting.two_level_mean(_runs(spark, sf_dir), ["variant"], "claim", "latency")
    return out.select("variant", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"))


@registered(f"""SELECT claim, tin, tout FROM {RUNS} r WHERE NOT EXISTS (SELECT 1 FROM {RUNS} s WHERE (s.tin < r.tin AND s.tout >= r.tout) OR (s.tin <= r.tin AND s.tout > r.tout))""")
def frontier(spark, sf_dir):
    return reporting.frontier(_runs(spark, sf_dir), "tin", "tout").select("claim", "tin", "tout")


@registered(f"""SELECT trial, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round((n - fp - fn) / n, 9) AS accuracy
    FROM (SELECT trial, count(*) FILTER (NOT truth AND NOT said)::DOUBLE AS tp, count(*) FILTER (truth AND NOT said)::DOUBLE AS fp, count(*) FILTER (NOT truth AND said)::DOUBLE AS fn, count(*)::DOUBLE AS n FROM {RUNS} GROUP BY 1)""")
def verdict_quality(spark, sf_dir):
    out = quality.classification_quality(_runs(spark, sf_dir), F.col("truth"), F.col("said"), "trial")
    return out.select("trial", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy")))


@registered(f"""SELECT trial, round(tp / (tp + fp), 9) AS precision, round(tp / (tp + fn), 9) AS recall FROM (SELECT trial, sum(a)::DOUBLE AS tp, sum(b)::DOUBLE AS fp, sum(c)::DOUBLE AS fn FROM (
    SELECT DISTINCT trial, claim AS op, claim + 1 AS a, claim % 3 AS b, claim % 5 AS c FROM {RUNS}) GROUP BY 1)""")
def micro_average(spark, sf_dir):
    r = _runs(spark, sf_dir).select("trial", F.col("claim").alias("op"), (F.col("claim") + 1).alias("tp"), (F.col("claim") % 3).alias("fp"), (F.col("claim") % 5).alias("fn"))
    return reporting.micro_average(r, "op", ["trial"]).select("trial", F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


@registered("SELECT claim, " + ", ".join(f"round(avg((said = truth)::INT) FILTER (variant = '{v}'), 9) AS {v}_share, sum((said = truth)::INT) FILTER (variant = '{v}')::DOUBLE AS {v}_correct" for v in VARIANTS) + f" FROM {RUNS} GROUP BY 1")
def correctness_matrix(spark, sf_dir):
    out = reporting.correctness_matrix(_runs(spark, sf_dir), "claim", "variant", F.col("said") == F.col("truth"), list(VARIANTS))
    return out.select("claim", *(c for v in VARIANTS for c in (F.round(f"{v}_share", 9).alias(f"{v}_share"), f"{v}_correct")))


# --- sources, claims, streams ---------------------------------------------------------------------------------------


@registered("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_totalprice > 150000")
def jsonl_roundtrip(spark, sf_dir):
    path = scratch(spark, "jsonl")
    write_jsonl(table(spark, sf_dir, "orders").where("o_totalprice > 150000").select("o_orderkey", "o_orderstatus", "o_totalprice"), path)
    return read_jsonl(spark, path)


@registered("SELECT c_custkey, c_acctbal > 0 AS solvent FROM customer")
def log_checkpoint(spark, sf_dir):
    path = scratch(spark, "log")
    s = quiet(spark)
    s.read_frame(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ("c_custkey",)).map((col("c_acctbal") > 0).alias("solvent")).log(path).to_spark()
    return s.read_log(path).check(Alias(col("solvent"), "solvent")).to_spark()


@registered("SELECT o_orderstatus, count(*) FILTER (o_totalprice > 200000) > 10 AS verdict FROM orders GROUP BY 1")
def compiled_query(spark, sf_dir):
    """Claim text to query text to verdict, without executing code."""
    ask = claims.template_model([(r"more than (?P<k>\d+) orders over (?P<v>\d+)", "df.aggregate([count_if(col('o_totalprice') > {v}).alias('n')], group_by=[col('o_orderstatus')]).check((col('n') > {k}).alias('verdict'))")])
    f = frame(spark, sf_dir, "orders", "o_orderkey")
    source = claims.ClaimCompiler(ask).compile("orders by status", f, "every status has more than 10 orders over 200000")
    return claims.build_query(f, source).to_spark()


@registered()
def decompose_claims(spark, sf_dir):
    return claims.decompose(table(spark, sf_dir, "benchmark"), "text", "item_id")


@registered("""SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS rows, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) AS value, avg(CASE WHEN value > 50 THEN 1.0 ELSE 0.0 END) >= 0.25 AS verdict FROM events GROUP BY 1, 2""")
def windowed_verdict(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return monitor.windowed_verdict(e, "ts", F.col("value") > 50, "proportion", lambda v: v >= 0.25, "1 day", by=("event_type",))


@registered()
def session_verdict(spark, sf_dir):
    return monitor.session_verdict(table(spark, sf_dir, "events"), "ts", "user_id", F.col("value") > 50, "bool_or", lambda v: v, "30 minutes")


@registered(f"SELECT o_orderstatus, l_returnflag, count(*) AS n, grouping(o_orderstatus)::INT AS total {LINES} GROUP BY ROLLUP (o_orderstatus, l_returnflag)")
def native_rollup(spark, sf_dir):
    """What the frame does not wrap is there in Spark: rollup, joins, set operations, windows."""
    out = returned_lines(spark, sf_dir).rollup("o_orderstatus", "l_returnflag").agg(F.count("*").alias("n"), F.grouping("o_orderstatus").cast("int").alias("total"))
    return out
