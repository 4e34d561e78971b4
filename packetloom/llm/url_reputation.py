"""Host reputation of urls by empirical Bayes, with path rules in front.

Outcomes of labelled pages (1 bad, 0 good, null not labelled) are counted per host. A
beta-binomial prior at each level pulls a host towards its registered domain, a domain
towards its public suffix and a suffix towards all pages; how strongly is estimated from
the spread between the groups of that level. A host is blocked if the lower bound of its
posterior bad rate reaches a limit.

Everything is joins and sums: counts are taken per task before the shuffle, so a host with
a third of all pages costs one row per task, and in the join it is dealt over many keys.
Every level is a written table, and the strength of its prior one number.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.session import written

# Some public suffixes of two labels, where no table of them is given; any other
# name's suffix is its last label.
LONG_SUFFIXES = (
    "ac.uk", "co.in", "co.jp", "co.kr", "co.nz", "co.uk", "co.za", "com.ar", "com.au", "com.br",
    "com.cn", "com.mx", "com.tr", "gov.uk", "ne.jp", "net.au", "or.jp", "org.au", "org.uk",
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# Marks of a bad page.
BAD_PAGE = r"[%#$*]{3}\s|&amp;&amp;&amp;|(?i:\b(?:idiots?|morons?|worthless)\b)"


def url_host(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def page_outcome(html: Column) -> Column:
    """A heuristic label where no reviewed one exists: 1 for a page with junk marks or insults."""
    return F.regexp_like(html, F.lit(BAD_PAGE)).cast("int")


def with_domain(hosts: DataFrame, suffixes: Iterable[str] | DataFrame = LONG_SUFFIXES) -> DataFrame:
    """Hosts with their registered domain and public suffix.

    ``suffixes`` are public suffixes of two labels or more, names or a table with a column
    ``suffix``; the longest that ends a host is its suffix, else the last label is. Numeric
    addresses stand for themselves.
    """
    spark = hosts.sparkSession
    if not isinstance(suffixes, DataFrame):
        suffixes = spark.createDataFrame([(x,) for x in suffixes], "suffix string")
    bare = F.regexp_replace(F.regexp_replace("host", r"^.*@", ""), r":\d*$", "")
    named = hosts.withColumn("_bare", bare).withColumn("_labels", F.split("_bare", r"\."))
    n = F.size("_labels")
    tail = lambda k: F.array_join(F.slice("_labels", F.greatest(n - k + 1, F.lit(1)), k), ".")
    tails = F.when(n >= 2, F.transform(F.sequence(F.lit(2), n), lambda k: F.struct(k.alias("k"), tail(k).alias("tail"))))
    known = suffixes.select(F.lower("suffix").alias("_suffix")).distinct()
    found = (
        named.select("host", F.explode(tails).alias("t"))
        .join(known, F.col("t.tail") == F.col("_suffix"))
        .groupBy("host")
        .agg(F.max("t.k").alias("_k"))
        .withColumnRenamed("host", "_host")
    )
    k = F.coalesce("_k", F.lit(1))
    numeric = F.regexp_like("_bare", F.lit(r"^[0-9.]+$|^\["))
    rows = named.join(found, F.col("host") == F.col("_host"), "left")
    return rows.withColumns(
        {
            "domain": F.when(numeric, F.col("_bare")).otherwise(tail(k + 1)),
            "suffix": F.when(numeric, F.col("_bare")).otherwise(tail(k)),
        }
    ).drop("_bare", "_labels", "_host", "_k")


def host_counts(
    pages: DataFrame, url: str = "url", outcome: str = "outcome", suffixes: Iterable[str] | DataFrame = LONG_SUFFIXES
) -> DataFrame:
    """Pages, labelled pages and bad pages of each host, with its domain and suffix."""
    counts = (
        pages.select(url_host(F.col(url)).alias("host"), F.col(outcome).cast("double").alias("y"))
        .groupBy("host")
        .agg(
            F.count(F.lit(1)).alias("pages"),
            F.count("y").alias("n"),
            F.coalesce(F.sum("y"), F.lit(0.0)).alias("bad"),
        )
    )
    return with_domain(written(counts, "hosts"), suffixes)


def _strength(groups: DataFrame) -> float:
    """Weight of the prior (a + b) from the groups' spread about their parents' rate ``mu``.

    Moments of the beta-binomial: E (y - n mu)^2 = n mu (1 - mu) (1 + (n - 1) rho); the
    weight is 1 / rho - 1, held between 1 and 10,000; 1 where no group has two labels.
    """
    flat = F.col("n") * F.col("mu") * (1 - F.col("mu"))
    twice = F.sum(flat * (F.col("n") - 1))
    rho = (F.sum(F.pow(F.col("bad") - F.col("n") * F.col("mu"), 2)) - F.sum(flat)) / twice
    weight = F.least(F.greatest(1 / F.greatest(rho, F.lit(1e-9)) - 1, F.lit(1.0)), F.lit(1e4))
    return groups.agg(F.when(twice > 0, weight).otherwise(F.lit(1.0))).first()[0]  # one number


def _shrunk(groups: DataFrame, label: str) -> DataFrame:
    """Adds the posterior's mean and weight (a + b) from ``bad``, ``n`` and the parent's ``mu``."""
    groups = written(groups, label)
    weight = F.lit(_strength(groups))
    total = F.col("n") + weight
    return groups.withColumns({"mean": (F.col("bad") + weight * F.col("mu")) / total, "total": total})


def reputation(counts: DataFrame) -> DataFrame:
    """host, pages, n, bad, mean, deviation: the posterior bad rate of every host.

    ``counts`` as from :func:`host_counts`; it is read several times, so give a written
    table. An empty table gives no rows; without any label every rate is one half, with a bound
    near zero.
    """
    sums = [F.sum("n").alias("n"), F.sum("bad").alias("bad")]
    whole = counts.agg(
        (F.coalesce(F.sum("bad"), F.lit(0.0)) + 0.5) / (F.coalesce(F.sum("n"), F.lit(0)) + 1)
    ).first()[0]  # one number
    suffixes = _shrunk(counts.groupBy("suffix").agg(*sums).withColumn("mu", F.lit(whole)), "suffixes")
    domains = counts.groupBy("domain", "suffix").agg(*sums)
    domains = _shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("mu")), "suffix"), "domains")
    hosts = counts.join(domains.select("domain", "suffix", F.col("mean").alias("mu")), ["domain", "suffix"])
    hosts = _shrunk(hosts, "host-rates")
    deviation = F.sqrt(F.col("mean") * (1 - F.col("mean")) / (F.col("total") + 1))
    return hosts.select("host", "pages", "n", "bad", "mean", deviation.alias("deviation"))


#: Parts of all pages from which a host counts as hot, and is dealt over as many keys as it has such parts.
HOT_SHARE = 1 / 64


def _dealt(pages: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with ``_deal`` and hosts once for each of their deals, so that no host is one task."""
    total = known.agg(F.sum("pages")).first()[0] or 0
    known = known.withColumn("_deals", F.greatest(F.lit(1), F.ceil(F.col("pages") / F.lit(max(total * HOT_SHARE, 1.0)))).cast("int"))
    # fewer than 1 / HOT_SHARE rows
    hot = known.where("_deals > 1").select(F.col("_h").alias("_hot"), F.col("_deals").alias("_of"))
    pages = pages.join(F.broadcast(hot), F.col("_host") == F.col("_hot"), "left")
    deal = F.pmod(F.monotonically_increasing_id(), F.coalesce("_of", F.lit(1))).cast("int")
    pages = pages.withColumn("_deal", deal).drop("_hot", "_of")
    return pages, known.withColumn("_d", F.explode(F.sequence(F.lit(0), F.col("_deals") - 1))).drop("pages", "_deals")


def host_rules(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host, rules: those that fit the host or a parent of it, longest first, one array per host.

    ``rules``: host, path, action. Hosts meet rules by equality of each parent name.
    Equally long rules: the longer host first, then ``block`` before ``allow``.
    """
    labels = F.split("host", r"\.")
    parents = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."),
    )
    listed = rules.select(
        F.col("host").alias("parent"),
        F.struct(
            F.length(F.concat("host", "path")).alias("span"),
            F.length("host").alias("deep"),
            F.col("action").alias("action"),
            F.concat("host", "path").alias("rule"),
            F.col("path").alias("path"),
        ).alias("r"),
    )
    return (
        hosts.select("host", F.explode(parents).alias("parent"))
        .join(listed, "parent")
        .groupBy("host")
        .agg(F.sort_array(F.collect_set("r"), asc=False).alias("rules"))
    )


def judge(
    pages: DataFrame,
    rules: Iterable[tuple[str, str, str]] | DataFrame,
    *,
    url: str = "url",
    outcome: str = "outcome",
    limit: float = 0.10,
    deviations: float = 1.28,
    suffixes: Iterable[str] | DataFrame = LONG_SUFFIXES,
) -> DataFrame:
    """Every page with ``host``, ``path``, ``rule``, ``bad_rate``, ``bad_bound`` and ``verdict``.

    The longest fitting rule decides (``allow`` or ``block``); without one, a host whose
    posterior bad rate less ``deviations`` standard deviations is at least ``limit`` is
    blocked. ``rules``: (host, path, action) rows; ``suffixes`` as for :func:`with_domain`. A null url, or one without ``://``, has an
    empty host and path; such pages share the reputation of the empty host. Columns of
    ``pages`` with the added names are replaced; repeated rows are judged one by one.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame(list(rules), "host string, path string, action string")
    added = ("host", "path", "rule", "bad_rate", "bad_bound", "verdict")
    counts = written(host_counts(pages, url, outcome, suffixes), "host-counts")
    known = reputation(counts)
    known = known.join(host_rules(known.select("host"), rules), "host", "left").select(
        F.col("host").alias("_h"),
        "pages",
        F.col("mean").alias("_mean"),
        F.greatest(F.lit(0.0), F.col("mean") - F.lit(deviations) * F.col("deviation")).alias("_bound"),
        F.col("rules").alias("_rules"),
    )
    fit = F.filter("_rules", lambda r: F.startswith(F.col("_path"), r["path"]))
    keep = [F.col(f"`{c}`") for c in pages.columns if c not in added]
    parts = pages.select(*keep, url_host(F.col(url)).alias("_host"), url_path(F.col(url)).alias("_path"))
    parts, known = _dealt(parts, written(known, "known-hosts"))
    return (
        parts.join(known, (F.col("_host") == F.col("_h")) & (F.col("_deal") == F.col("_d")), "left")
        .withColumn("_fit", F.try_element_at(fit, F.lit(1)))
        .select(
            *keep,
            F.col("_host").alias("host"),
            F.col("_path").alias("path"),
            F.col("_fit.rule").alias("rule"),
            F.col("_mean").alias("bad_rate"),
            F.col("_bound").alias("bad_bound"),
            F.coalesce(
                F.col("_fit.action"),
                F.when(F.col("_bound") >= F.lit(limit), "block").otherwise("allow"),
            ).alias("verdict"),
        )
    )
