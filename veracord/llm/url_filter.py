"""URL filter: explicit rules first, then an empirical-Bayes host reputation.

Method (DataFrame functions only)
---------------------------------
Labelled page outcomes (bad or not) are counted per host. The bad rate of a
host is shrunk through a chain of beta-binomial priors::

    all pages -> suffix -> registered domain -> host

At each level a unit with ``n`` labelled pages of which ``k`` are bad gets the
posterior ``Beta(s * m + k, s * (1 - m) + n - k)``, where ``m`` is the posterior
mean of its parent and ``s`` the prior strength of the level. ``s`` is estimated
by the method of moments from all units of the level, from sums of integers that
do not depend on the order of rows. The uncertainty of ``m`` is carried down: the
variance of a unit is that of its Beta posterior plus ``(s / (s + n))**2`` times its
parent's, so a host without own evidence is as uncertain as its domain, and a corpus with
few labels blocks nothing. A host is blocked when the lower ``z``-sigma bound of its
posterior bad rate lies above ``max_bad_rate``; by default that comes from the labelled
outcomes: ``lift`` times the bad rate of the whole corpus, at most one half.

Labels name pages by ``doc_id``: the label of document i is taken as that of page i.

Scale: the url and id columns are the only ones read. Labels meet pages in one
equi-join on the page id; counts are aggregated per host before any shuffle by
host (map-side combine), so a hot host costs one row per task. The reputation
table joins back by host; that join may split a hot host's rows (AQE skew join,
the pages side is a plain scan). Nothing is broadcast by hint.

Defined results: null urls and urls without ``://`` have host and path ``''``;
they, and hosts without labelled pages, get the verdict of their parent levels
(the whole corpus for an empty host). Null labels are no evidence. Repeated page
ids are judged row by row; repeated labels of a page count once, a bad one
wins. Empty tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veracord.llm.common import ascii_lower, cut

#: (verdict, host, path prefix); the longest host + path that fits wins.
RULES: tuple[tuple[str, str, str], ...] = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: Second-level labels that make a two-part suffix below a two-letter country code (fixed values).
#: They stand for a table of public suffixes; others can be passed in.
SECOND_LEVEL = ("ac", "co", "com", "edu", "gov", "net", "or", "org")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; ``''`` where there is none."""
    rest = F.substring_index(F.substring_index(F.substring_index(_rest(url), "/", 1), "?", 1), "#", 1)
    return ascii_lower(rest)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    bare = F.substring_index(F.substring_index(_rest(url), "?", 1), "#", 1)
    at = F.locate("/", bare)
    return F.when(at > 0, F.substr(bare, at)).otherwise("")


def _rest(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def suffix_of(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    """Public suffix by rule: the last label, or two below country codes such as ``co.uk``."""
    parts = F.split(host, r"\.")
    two = (F.size(parts) >= 3) & (F.length(F.element_at(parts, -1)) == 2) & F.try_element_at(parts, F.lit(-2)).isin(*second_level)
    return F.when(two, F.substring_index(host, ".", -2)).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, second_level: Sequence[str] = SECOND_LEVEL) -> Column:
    """Registered domain: one label more than the suffix."""
    n = F.size(F.split(suffix_of(host, second_level), r"\.")) + 1
    return F.when(n == 3, F.substring_index(host, ".", -3)).otherwise(F.substring_index(host, ".", -2))


def rule_columns(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, both null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for word, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(word)).otherwise(verdict)
    return rule, verdict


def _strength(units: DataFrame) -> float:
    """Prior strength ``s`` by moments: with p the pooled rate, the excess of the
    between-unit variance over the binomial one gives the intra-class correlation rho,
    and s = 1 / rho - 1, held within [2, 1000]. ``units`` has n > 0 and k."""
    n, k, j, nn, q = units.agg(F.sum("n"), F.sum("k"), F.count("*"), F.sum(F.col("n") * F.col("n")), F.sum(F.floor(1e6 * F.col("k") * F.col("k") / F.col("n")).cast("long"))).head()
    if not (j > 1 and n > j and 0 < k < n):
        return 1000.0
    p = k / n
    n0 = (n - nn / n) / (j - 1)
    between = (q / 1e6 - n * p * p) / (j - 1)
    within = (k - q / 1e6) / (n - j)
    spread = between + (n0 - 1) * within
    rho = (between - within) / spread if spread else 0.0
    return min(max(1 / rho - 1, 2.0), 1000.0) if rho > 0 else 1000.0


def host_reputation(outcomes: DataFrame, second_level: Sequence[str] = SECOND_LEVEL) -> tuple[DataFrame, float]:
    """(one row per host: posterior mean and standard deviation of its bad rate; that rate of the whole corpus).

    ``outcomes`` has host, labelled, bad: one row per host. Every host appears, labelled
    or not. The three prior strengths and the two totals come to the driver as numbers.
    """
    base = cut(outcomes.withColumns({"domain": domain_of(F.col("host"), second_level), "suffix": suffix_of(F.col("host"), second_level)}), "hosts")
    domains = base.groupBy("domain", "suffix").agg(F.sum("labelled").alias("dn"), F.sum("bad").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    tn, tk = (x or 0 for x in base.agg(F.sum("labelled"), F.sum("bad")).head())
    m0 = (tk + 0.5) / (tn + 1.0)

    def shrunk(df: DataFrame, n: str, k: str, parent: str, out: str) -> DataFrame:
        """Posterior mean m_out and variance v_out, from the parent's m_parent and v_parent."""
        s = _strength(df.where(F.col(n) > 0).select(F.col(n).alias("n"), F.col(k).alias("k")))
        m = (s * F.col(f"m_{parent}") + F.col(k)) / (s + F.col(n))
        own = F.col(f"m_{out}") * (1 - F.col(f"m_{out}")) / (s + F.col(n) + 1)
        keep = s / (s + F.col(n))
        return df.withColumn(f"m_{out}", m).withColumn(f"v_{out}", own + keep * keep * F.col(f"v_{parent}"))

    top = suffixes.withColumns({"m_all": F.lit(m0), "v_all": F.lit(m0 * (1 - m0) / (tn + 2.0))})
    by_suffix = shrunk(top, "sn", "sk", "all", "suffix").select("suffix", "m_suffix", "v_suffix")
    by_domain = shrunk(domains.join(by_suffix, "suffix"), "dn", "dk", "suffix", "domain").select("domain", "m_domain", "v_domain")
    by_host = shrunk(base.join(by_domain, "domain"), "labelled", "bad", "domain", "host")
    return by_host.select("host", "labelled", "bad", F.col("m_host").alias("mean"), F.sqrt("v_host").alias("sd")), m0


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, max_bad_rate: float | None = None, z: float = 1.645, lift: float = 1.5, second_level: Sequence[str] = SECOND_LEVEL) -> DataFrame:
    """Judge every row of ``pages(page_id, url)`` with the evidence in ``labels(doc_id, quality, toxic)``.

    A labelled page (``doc_id`` is its page id) is bad when its quality is 0 or it is
    toxic. Returns page_id, host, path, rule, verdict, reputation, bound: the last two
    are the posterior mean of the host's bad rate and its lower bound.
    """
    at = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    bad = F.coalesce(F.col("quality") == 0, F.lit(False)) | F.coalesce(F.col("toxic") == 1, F.lit(False))
    known = (
        labels.where(F.col("doc_id").isNotNull() & (F.col("quality").isNotNull() | F.col("toxic").isNotNull()))
        .groupBy(F.col("doc_id").alias("page_id"))
        .agg(F.max(bad.cast("int")).alias("is_bad"))
    )
    seen = at.select("page_id", "host").join(known, "page_id", "left")
    outcomes = seen.groupBy("host").agg(F.count("is_bad").alias("labelled"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("bad"))
    reputation, overall = host_reputation(outcomes, second_level)
    limit = min(0.5, lift * overall) if max_bad_rate is None else max_bad_rate
    reputation = reputation.select("host", "mean", (F.col("mean") - z * F.col("sd")).alias("bound"))
    rule, by_rule = rule_columns(F.col("host"), F.col("path"), rules)
    by_host = F.when(F.col("bound") > limit, "block").otherwise("allow")
    return at.join(reputation, "host", "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(by_rule, by_host).alias("verdict"), F.round("mean", 6).alias("reputation"), F.round("bound", 6).alias("bound")
    )


def oracle(z: float = 1.645, lift: float = 1.5) -> str:
    """The same in DuckDB SQL."""
    second = ", ".join(f"'{x}'" for x in SECOND_LEVEL)
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    by_length = sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{h + p}'" for _, h, p in by_length) + " END"
    verdict = "CASE " + " ".join(f"WHEN {fits(h, p)} THEN '{w}'" for w, h, p in by_length) + f" WHEN mean - {z} * sd > (SELECT least(0.5, {lift} * m0) FROM total) THEN 'block' ELSE 'allow' END"

    def strength(table: str, n: str, k: str) -> str:
        return f"""SELECT CASE WHEN J > 1 AND N > J AND K > 0 AND K < N AND coalesce(rho > 0, false) THEN least(greatest(1 / rho - 1, 2.0), 1000.0) ELSE 1000.0 END AS s FROM (
            SELECT *, (b - w) / nullif(b + (n0 - 1) * w, 0) AS rho FROM (
            SELECT *, (N - NN / N) / nullif(J - 1, 0) AS n0, (Q / 1e6 - N * (K / N) * (K / N)) / nullif(J - 1, 0) AS b, (K - Q / 1e6) / nullif(N - J, 0) AS w FROM (
            SELECT sum({n})::DOUBLE AS N, sum({k})::DOUBLE AS K, count(*) AS J, sum({n} * {n})::DOUBLE AS NN, sum(floor(1e6 * {k} * {k} / {n})::BIGINT)::DOUBLE AS Q FROM {table} WHERE {n} > 0)))"""

    return f"""
    WITH urls AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             CASE WHEN instr(bare, '/') > 0 THEN substr(bare, instr(bare, '/')) ELSE '' END AS path
        FROM (SELECT page_id, rest, regexp_extract(rest, '^[^?#]*', 0) AS bare
        FROM (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages))),
    known AS (SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS is_bad FROM labels
        WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
    hosts AS (SELECT host, count(is_bad) AS labelled, coalesce(sum(is_bad), 0) AS bad FROM urls LEFT JOIN known USING (page_id) GROUP BY 1),
    named AS (SELECT *, string_split(host, '.') AS l FROM hosts),
    base0 AS (SELECT host, labelled, bad, l, CASE WHEN len(l) >= 3 AND length(l[-1]) = 2 AND l[-2] IN ({second}) THEN 2 ELSE 1 END AS m FROM named),
    base AS (SELECT host, labelled, bad, array_to_string(l[-m:], '.') AS suffix, array_to_string(l[-(m + 1):], '.') AS domain FROM base0),
    domains AS (SELECT domain, suffix, sum(labelled) AS dn, sum(bad) AS dk FROM base GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(dn) AS sn, sum(dk) AS sk FROM domains GROUP BY ALL),
    total AS (SELECT *, m0 * (1 - m0) / (tn + 2.0) AS v0 FROM (SELECT coalesce(sum(sn), 0) AS tn, (coalesce(sum(sk), 0) + 0.5) / (coalesce(sum(sn), 0) + 1.0) AS m0 FROM suffixes)),
    ss AS ({strength('suffixes', 'sn', 'sk')}), sd AS ({strength('domains', 'dn', 'dk')}), sh AS ({strength('base', 'labelled', 'bad')}),
    m1 AS (SELECT suffix, m1, m1 * (1 - m1) / (s + sn + 1) + (s / (s + sn)) * (s / (s + sn)) * v0 AS v1
        FROM (SELECT suffix, sn, s, v0, (s * m0 + sk) / (s + sn) AS m1 FROM suffixes, ss, total)),
    m2 AS (SELECT domain, m2, m2 * (1 - m2) / (s + dn + 1) + (s / (s + dn)) * (s / (s + dn)) * v1 AS v2
        FROM (SELECT domain, dn, s, v1, (s * m1 + dk) / (s + dn) AS m2 FROM domains JOIN m1 USING (suffix), sd)),
    m3 AS (SELECT host, mean, mean * (1 - mean) / (s + labelled + 1) + (s / (s + labelled)) * (s / (s + labelled)) * v2 AS v3
        FROM (SELECT host, labelled, s, v2, (s * m2 + bad) / (s + labelled) AS mean FROM base JOIN m2 USING (domain), sh)),
    rep AS (SELECT host, mean, sqrt(v3) AS sd FROM m3)
    SELECT page_id, host, path, {rule} AS rule, {verdict} AS verdict, round(mean, 6) AS reputation, round(mean - {z} * sd, 6) AS bound FROM urls JOIN rep USING (host)"""
