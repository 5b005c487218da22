"""Empirical-Bayes reputation of hosts, with an allow and block list in front.

Labelled page outcomes (1 good, 0 bad) are counted per host. A host's rate is shrunk towards its
registered domain, the domain towards its suffix, the suffix towards all pages, each by a
beta-binomial prior whose strength is fitted by moments to how much sibling rates differ. A host
passes when the lower bound of its posterior rate reaches a floor.

Defined results: a null url, or one without ``://``, has an empty host and path and is judged like
any host, of empty domain and suffix. A null outcome is no evidence. Without any outcome every rate
is one half. Repeated pages count each time. Other columns of ``pages`` are ignored.

DataFrame functions only. Pages are reduced to a row per host before the one join, and that is left
to adaptive execution, which splits a host that holds a large share of the pages.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize

# fixed values: public suffixes of more than one label; others are taken to be the last label
LONG_SUFFIXES = (
    "ac.uk", "co.uk", "gov.uk", "org.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp",
    "com.br", "com.cn", "com.tr", "com.mx", "co.in", "co.kr", "co.za",
)
# fixed values: strongest and weakest prior, as the correlation of two outcomes of one group
LEAST, MOST = 1e-4, 0.5

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, below = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & F.startswith(path, F.lit(slash + below))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def domain_and_suffix(host: Column, long_suffixes: Sequence[str] = LONG_SUFFIXES) -> tuple[Column, Column]:
    """Registered domain and suffix; an address or a single label is its own domain and suffix."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(host, r"^.*@", ""), r":[0-9]*$", ""), r"\.+$", "")
    last2 = F.substring_index(name, ".", -2)
    whole = name.rlike(r"^[0-9.]+$") | ~F.contains(name, F.lit("."))
    long = last2.isin(list(long_suffixes))
    suffix = F.when(whole, name).when(long, last2).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(whole, name).when(long, F.substring_index(name, ".", -3)).otherwise(last2)
    return domain, suffix


def _strength(groups: DataFrame) -> float:
    """Prior weight in outcomes, from groups with good, seen and their parent's mean rate."""
    p, n, k = F.col("parent"), F.col("seen").cast("double"), F.col("good").cast("double")
    spread = F.sum((k - n * p) * (k - n * p) - n * p * (1 - p))
    row = groups.agg(spread.alias("a"), F.sum(n * (n - 1) * p * (1 - p)).alias("b")).first()
    rho = min(MOST, max(LEAST, (row["a"] or 0.0) / row["b"])) if row["b"] else MOST
    return 1 / rho - 1


def reputation(judged: DataFrame, host: str, outcome: str, z: float = 1.645) -> DataFrame:
    """A row per host: good, seen, mean and lower bound of the posterior rate."""
    domain, suffix = domain_and_suffix(F.col("host"))
    hosts = materialize(
        judged.select(F.col(host).alias("host"), F.col(outcome).cast("bigint").alias("y"))
        .groupBy("host")
        .agg(F.coalesce(F.sum("y"), F.lit(0)).alias("good"), F.count("y").alias("seen"))
        .select("host", domain.alias("domain"), suffix.alias("suffix"), "good", "seen"),
        "hosts",
    )
    total = hosts.agg(F.sum("good"), F.sum("seen")).first()
    every = ((total[0] or 0) + 1) / ((total[1] or 0) + 2)
    counts = [F.sum("good").alias("good"), F.sum("seen").alias("seen")]

    def shrunk(groups: DataFrame) -> DataFrame:
        weight = F.lit(_strength(groups))
        return groups.withColumn("mean", (F.col("good") + weight * F.col("parent")) / (F.col("seen") + weight))

    suffixes = shrunk(hosts.groupBy("suffix").agg(*counts).withColumn("parent", F.lit(every)))
    above = suffixes.select("suffix", F.col("mean").alias("parent"))
    domains = shrunk(hosts.groupBy("suffix", "domain").agg(*counts).join(above, "suffix"))
    placed = hosts.join(domains.select("suffix", "domain", F.col("mean").alias("parent")), ["suffix", "domain"])
    weight = F.lit(_strength(placed))
    mean = (F.col("good") + weight * F.col("parent")) / (F.col("seen") + weight)
    lower = mean - z * F.sqrt(mean * (1 - mean) / (F.col("seen") + weight + 1))
    return placed.select("host", "good", "seen", mean.alias("mean"), lower.alias("lower"))


def judge(
    pages: DataFrame,
    rules: Sequence[tuple[str, str]] = (),
    key: str = "page_id",
    url: str = "url",
    outcome: str = "outcome",
    floor: float = 0.5,
    z: float = 1.645,
) -> DataFrame:
    """A row per page: key, host, path, rule, verdict, good, seen, mean, lower."""
    host, path = host_and_path(F.col("_url"))
    read = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url"), F.col(outcome).alias("_outcome")).select(
        F.col("_key").alias(key), host.alias("host"), path.alias("path"), F.col("_outcome").alias("outcome")
    )
    rule, said = match(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("lower") >= floor, F.lit("allow")).otherwise(F.lit("block"))
    return read.join(reputation(read, "host", "outcome", z), "host", "left").select(
        key, "host", "path", rule.alias("rule"), F.coalesce(said, own).alias("verdict"), "good", "seen", "mean", "lower"
    )
