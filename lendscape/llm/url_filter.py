"""URL verdicts: a rule's where one fits, else that of the host's reputation.

Reputation is empirical Bayes on labelled outcomes of pages. A suffix's rate of bad pages is shrunk towards the
overall rate, a registered domain's towards its suffix, a host's towards its domain, each by a beta-binomial prior. The
strength of the prior at each level is estimated by moments: the spread of the groups' rates about their parents beyond
what binomial chance would give. A host is blocked where the lower bound of its posterior rate exceeds a threshold,
so few outcomes block nothing on their own, and a host without any speaks through its domain.

Everything but the last join works on hosts; pages are counted before the first shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lendscape.llm import common
from lendscape.session import Workspace

# (host, path prefix, verdict) of the registered query: fixed values.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
# Names below a country's domain under which names are registered.
SECOND_LEVEL = ("ac", "co", "com", "edu", "go", "gov", "mil", "ne", "net", "or", "org")
# Blocked where the rate of bad pages is above this with a chance of about 19 in 20.
MOST_BAD = 0.5
DEVIATIONS = 1.645
# A prior counts as no fewer and no more pages than these.
WEAKEST, STRONGEST = 2.0, 1000.0
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    """From the first :// to the next /, ?, # or the end, A-Z lower-cased; empty without one."""
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def suffix_of(host: Column) -> Column:
    """The last label, or the last two of a name registered below a country's second level; an address is its own."""
    name = F.regexp_replace(host, r"^.*@|:[0-9]*$", "")
    labels = F.split(name, r"\.")
    last, second = F.element_at(labels, -1), F.try_element_at(labels, F.lit(-2))
    nested = (F.size(labels) > 2) & (F.length(last) == 2) & second.isin(*SECOND_LEVEL)
    number = name.rlike(r"^[0-9.]*$|^\[")
    return F.when(number, name).when(nested, F.concat(second, F.lit("."), last)).otherwise(last)


def domain_of(host: Column) -> Column:
    """The registered domain: the suffix and one label more, if there is one."""
    name, suffix = F.regexp_replace(host, r"^.*@|:[0-9]*$", ""), suffix_of(host)
    rest = F.substr(name, F.lit(1), F.length(name) - F.length(suffix) - 1)
    above = F.element_at(F.split(rest, r"\."), -1)
    return F.when(name == suffix, name).otherwise(F.concat(above, F.lit("."), suffix))


def outcomes(labels: DataFrame) -> DataFrame:
    """page_id and ``bad``, 1 for toxic pages and those of low quality. Repeated labels count once, at their worst."""
    bad = (F.coalesce(F.col("toxic"), F.lit(0)) == 1) | (F.coalesce(F.col("quality"), F.lit(1)) == 0)
    known = labels.filter("doc_id is not null and (toxic is not null or quality is not null)")
    return known.groupBy(F.col("doc_id").alias("page_id")).agg(F.max(bad.cast("int")).alias("bad"))


def strength(groups: DataFrame, mean: str = "mean") -> float:
    """How many pages a prior counts for: columns ``n``, ``bad`` and the parent's rate. One number reaches the driver."""
    p, n, k = F.col(mean), F.col("n").cast("double"), F.col("bad").cast("double")
    chance = p * (1 - p)
    beyond = F.sum((k - n * p) * (k - n * p)) - F.sum(n * chance)
    rho = groups.agg(F.try_divide(beyond, F.sum(n * (n - 1) * chance)).alias("rho")).first().rho
    if rho is None or rho <= 0:
        return STRONGEST
    return min(max(1 / rho - 1, WEAKEST), STRONGEST)


def _shrunk(groups: DataFrame, key: str, parents: DataFrame | None, parent: str, overall: float) -> tuple[DataFrame, float]:
    """Adds the parent's rate as ``mean``, and gives the prior's strength."""
    if parents is None:
        aimed = groups.withColumn("mean", F.lit(overall))
    else:
        aimed = groups.join(parents.select(F.col(parent), F.col("rate").alias("mean")), parent)
    return aimed, strength(aimed)


def reputations(hosts: DataFrame, ws: Workspace) -> DataFrame:
    """Adds to hosts (columns ``host``, ``n`` labelled pages, ``bad`` ones) the posterior ``rate`` and its bound ``low``."""
    named = hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = ws.store(named.groupBy("suffix", "domain").agg(*sums), "domains")
    suffixes = ws.store(domains.groupBy("suffix").agg(*sums), "suffixes")
    whole = suffixes.agg(*sums).first()
    overall = ((whole.bad or 0) + 0.5) / ((whole.n or 0) + 1)

    def posterior(aimed: DataFrame, weight: float) -> DataFrame:
        return aimed.withColumn("rate", (F.col("mean") * weight + F.col("bad")) / (F.col("n") + weight))

    suffixes = posterior(*_shrunk(suffixes, "suffix", None, "", overall))
    domains = posterior(*_shrunk(domains, "domain", suffixes, "suffix", overall)).drop("mean")
    domains = ws.store(domains.select("domain", "rate"), "domain-rates")
    aimed, weight = _shrunk(named, "host", domains, "domain", overall)
    judged = posterior(aimed, weight)
    deviation = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + weight + 1))
    return judged.select("host", "n", "rate", (F.col("rate") - DEVIATIONS * deviation).alias("low"))


def fitting(spark: SparkSession, hosts: DataFrame, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Per host the rules of itself and of the names above it, longest first: an array of rule, path and verdict."""
    listed = spark.createDataFrame(list(rules), "of string, path string, verdict string")
    labels = F.split("host", r"\.")
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))
    rule = F.concat("of", "path")
    met = hosts.select("host", F.explode(above).alias("of")).join(listed, "of")
    found = F.struct(F.length(rule).alias("length"), rule.alias("rule"), F.col("path"), F.col("verdict"))
    return met.groupBy("host").agg(F.sort_array(F.collect_list(found), asc=False).alias("rules"))


def judge(
    spark: SparkSession, pages: DataFrame, labelled: DataFrame, ws: Workspace,
    rules: Sequence[tuple[str, str, str]] = RULES, most_bad: float = MOST_BAD,
) -> DataFrame:
    """Every row's page_id with host, path, the ``rule`` that decides (null if none), ``verdict``, and the host's
    number of labelled pages and ``low``, the bound on its rate of bad pages.

    ``labelled`` has page_id and ``bad`` (0 or 1), one row per page. Rules are a list by hand, (host, path prefix,
    verdict): one fits its host and all names below it; of several the longest wins. A null or odd url has
    an empty host, which is a host like any other. Repeated rows each count and each get a row; rows
    without a page_id are judged but never labelled. Without any outcome nothing is blocked but by rule. Other
    columns are ignored.
    """
    rows = pages.select("page_id", host_of("url").alias("host"), path_of("url").alias("path"))
    rows = ws.store(rows, "rows")
    # Pages shrink to counts per host; labels meet narrow rows on ids, which are all but unique.
    known = rows.select("page_id", "host").join(labelled.select("page_id", "bad"), "page_id", "left")
    counts = known.groupBy("host").agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    hosts = ws.store(counts, "hosts")
    judged = reputations(hosts, ws).join(fitting(spark, hosts, rules), "host", "left")
    # Stored, so that the planner sees its size: broadcast if small, else a join whose hot hosts can be split.
    judged = ws.store(judged, "judged")
    fits = F.filter("rules", lambda r: F.startswith(F.col("path"), r["path"]))
    decided = rows.join(judged, "host").withColumn("_rule", F.get(fits, F.lit(0)))
    by_host = F.when(F.col("low") > most_bad, "block").otherwise("allow")
    return decided.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce(F.col("_rule.verdict"), by_host).alias("verdict"), F.col("n").alias("n_labelled"), "low",
    )


def allowed(spark: SparkSession, pages: DataFrame, labelled: DataFrame, ws: Workspace, **how) -> DataFrame:
    """The pages that pass, columns as they are. A page_id names a page: rows that repeat it go together if all are blocked."""
    passed = judge(spark, pages, labelled, ws, **how).filter("verdict = 'allow'")
    key, url = common.fresh(pages, "_host"), common.fresh(pages, "_path")
    kept = passed.select(F.col("host").alias(key), F.col("path").alias(url)).distinct()
    named = pages.withColumns({key: host_of("url"), url: path_of("url")})
    return named.join(kept, [key, url], "left_semi").select(*pages.columns)
