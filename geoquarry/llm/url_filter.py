"""URL filter: fixed rules first, then an empirical-Bayes reputation of the host."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquarry.llm.common import lower_ascii, prepared

# (verdict, host and path) of the production rules.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
Z = 1.64
BLOCK_ABOVE = 0.25
LEAST_SPREAD = 1e-4
MOST_SPREAD = 0.99


def url_host(url: Column) -> Column:
    """Return the host of a URL with A to Z lowered; empty without ``://``."""
    return lower_ascii(F.regexp_extract(_rest(url), r"^[^/?#]*", 0))


def url_path(url: Column) -> Column:
    """Return what follows the host up to a query or fragment."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")


def _last_labels(host: Column, count: int) -> Column:
    labels = F.split(host, r"\.", -1)
    return F.array_join(F.slice(labels, F.greatest(F.size(labels) - (count - 1), F.lit(1)), count), ".")


def spread(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """Estimate by moments how far children lie from their parent's mean, as one row ``weight``.

    The weight is the pseudo-count of the beta prior that a parent gives.
    """
    both = children.join(parents.select(key, F.col("n").alias("_n"), F.col("bad").alias("_bad")), key).filter("n > 0")
    mean = F.col("_bad") / F.col("_n")
    part = mean * (1 - mean) * (1 - F.col("n") / F.col("_n"))
    far = F.col("n") * F.pow(F.col("bad") / F.col("n") - mean, F.lit(2.0))
    rho = (F.sum(far) - F.sum(part)) / F.sum(part * (F.col("n") - 1))
    seen = F.when(F.sum(part * (F.col("n") - 1)) > 0, rho).otherwise(F.lit(LEAST_SPREAD))
    held = F.least(F.greatest(seen, F.lit(LEAST_SPREAD)), F.lit(MOST_SPREAD))
    return both.agg(((1 - held) / held).alias("weight"))


def reputations(hosts: DataFrame, *, z: float = Z) -> DataFrame:
    """Return per host the posterior mean and lower bound of its share of bad pages.

    ``hosts`` has ``host``, ``n`` labelled pages and ``bad`` ones of them. A
    host is drawn towards its registered domain, that towards its suffix,
    that towards all pages; a host without labels keeps its domain's mean.
    """
    named = hosts.select(
        "host", "n", "bad", _last_labels(F.col("host"), 2).alias("domain"), _last_labels(F.col("host"), 1).alias("suffix")
    )
    total = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    domains = named.groupBy("domain", "suffix").agg(*total)
    suffixes = domains.groupBy("suffix").agg(*total)
    everything = suffixes.agg(*total).withColumn("mean", (F.col("bad") + 0.5) / (F.col("n") + 1.0))
    whole = suffixes.withColumn("_all", F.lit(1)).join(
        F.broadcast(everything.select(F.lit(1).alias("_all"), F.col("mean").alias("above"))), "_all"  # one row
    )
    one = suffixes.agg(*total).withColumn("_all", F.lit(1))
    means = _towards(whole, spread(whole, one, "_all")).select("suffix", F.col("mean").alias("above"))
    lower = _towards(domains.join(means, "suffix"), spread(domains, suffixes, "suffix"))
    lower = lower.select("domain", F.col("mean").alias("above"))
    last = _towards(
        named.join(lower, "domain"), spread(named, domains.select("domain", "n", "bad"), "domain")
    )
    yes = F.col("mean") * F.col("_sum")
    no = F.col("_sum") - yes
    deviation = F.sqrt(yes * no / (F.col("_sum") * F.col("_sum") * (F.col("_sum") + 1)))
    return last.select("host", "mean", (F.col("mean") - F.lit(z) * deviation).alias("bound"))


def _towards(rows: DataFrame, weight: DataFrame) -> DataFrame:
    """Shrink ``bad / n`` towards the column ``above``; ``weight`` has one row."""
    joined = rows.withColumn("_one", F.lit(1)).join(
        F.broadcast(weight.select(F.lit(1).alias("_one"), "weight")), "_one"
    )
    total = F.col("n") + F.col("weight")
    return joined.withColumn("_sum", total).withColumn("mean", (F.col("bad") + F.col("weight") * F.col("above")) / total)


def fitting_rules(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Return per host the rules for it or a domain above it, longest first, a block before an allow of the same length."""
    parsed = [(verdict, rule, rule.split("/", 1)[0], "/" + rule.split("/", 1)[1]) for verdict, rule in rules]
    if not parsed:
        return hosts.select("host", F.expr("CAST(array() AS array<struct<path:string,rule:string,verdict:string>>)").alias("rules"))
    deepest = max(host.count(".") + 1 for _, _, host, _ in parsed)
    listed = F.array(*(
        F.struct(
            F.lit(host).alias("_above"), F.lit(-len(rule)).alias("_length"), F.lit(path).alias("path"),
            F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"),
        )
        for verdict, rule, host, path in parsed
    ))
    table = hosts.sparkSession.range(1).select(F.inline(listed))
    names = F.array_distinct(F.array(*(_last_labels(F.col("host"), count) for count in range(1, deepest + 1))))
    found = hosts.select("host", F.explode(names).alias("_above")).join(F.broadcast(table), "_above")  # the rules given
    order = F.sort_array(F.collect_list(F.struct("_length", (F.col("verdict") == "allow").alias("_allow"), "verdict", "path", "rule")))
    return found.groupBy("host").agg(order.alias("rules"))


def judge(
    pages: DataFrame,
    outcomes: DataFrame,
    *,
    rules: Sequence[tuple[str, str]] = RULES,
    z: float = Z,
    block_above: float = BLOCK_ABOVE,
) -> DataFrame:
    """Judge every page's URL and return ``page_id, host, path, rule, verdict, bad_mean, bad_bound``.

    ``outcomes`` has ``page_id`` and a boolean ``bad``; a page with several
    is bad when one of them says so, and null ids or outcomes count for
    nothing. A rule fits its host and all subdomains when the path starts
    with the rule's; the longest wins. Without a rule a page is blocked when
    the lower posterior bound of its host's bad share is above
    ``block_above``. A null URL or one without ``://`` has an empty host and
    path, fits no rule, and is judged as the empty host. Repeated pages are
    judged alike; an empty table gives an empty one.
    """
    prepared(pages)
    rows = pages.select("page_id", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    rows = rows.withColumns({name: F.coalesce(name, F.lit("")) for name in ("host", "path")})
    marks = outcomes.filter("page_id IS NOT NULL AND bad IS NOT NULL").groupBy("page_id").agg(F.max("bad").alias("bad"))
    marked = rows.join(marks, "page_id", "left")
    hosts = marked.groupBy("host").agg(
        F.count("bad").alias("n"), F.coalesce(F.sum(F.col("bad").cast("bigint")), F.lit(0)).alias("bad")
    ).checkpoint()
    known = reputations(hosts, z=z).join(fitting_rules(hosts, rules), "host", "left")
    fits = F.filter("rules", lambda rule: F.col("path").startswith(rule["path"]))
    judged = rows.join(known, "host", "left").withColumn("_rule", F.get(fits, F.lit(0)))
    own = F.when(F.col("bound") > F.lit(block_above), "block").otherwise("allow")
    return judged.select(
        "page_id", "host", "path", F.col("_rule.rule").alias("rule"),
        F.coalesce("_rule.verdict", own).alias("verdict"),
        F.col("mean").alias("bad_mean"), F.col("bound").alias("bad_bound"),
    )
