"""URL filter with empirical-Bayes host reputation, in DataFrame functions only.

Explicit rules come first. For the rest a host is judged by its labelled pages: the share of bad pages of all labels gives the prior
of suffixes, a suffix's shrunk share that of its registered domains, and theirs that of their hosts. Each level is a beta-binomial: the
parent's mean with a strength estimated by moments from the spread of the children. A host is blocked if the lower bound of its
posterior for the share of bad pages is over ``LIMIT``.

Counts are partial sums before any shuffle. Levels are joined upwards; a page takes part in a single join, with its host's row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The rules of the registered query: (host, path, verdict).
RULES = (("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block"))
#: A host is blocked if mean - Z * deviation of its share of bad pages is over LIMIT.
LIMIT, Z = 0.5, 1.645
#: Suffixes of two labels, under which a registered domain has three. A parameter: pass a whole list for real crawls.
LONG_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "com.au", "co.jp", "com.br", "co.nz", "co.in")


def parted(pages: DataFrame) -> DataFrame:
    """``pages`` with host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substr(url, instr(url, '://') + 3)"))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return pages.withColumns({"host": F.coalesce(F.translate(host, upper, lower), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def ruled(parts: DataFrame, rules=RULES) -> DataFrame:
    """``parts`` with the longest fitting rule and its verdict, nulls where none fits; a rule is written host + path."""
    rule = verdict = F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, F.lit(host + path)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return parts.withColumns({"rule": rule, "ruled": verdict})


def levels(rows: DataFrame, long_suffixes=LONG_SUFFIXES) -> DataFrame:
    """``rows`` with the domain and suffix of their host (without its port)."""
    name = F.regexp_replace("host", ":[0-9]*$", "")
    suffix = F.when(F.substring_index(name, ".", -2).isin(*long_suffixes), F.substring_index(name, ".", -2)).otherwise(F.substring_index(name, ".", -1))
    domain = F.when(F.substring_index(name, ".", -2).isin(*long_suffixes), F.substring_index(name, ".", -3)).otherwise(F.substring_index(name, ".", -2))
    return rows.withColumns({"domain": domain, "suffix": suffix})


def _shrunk(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``children(key, bad, n, <parent>)`` with the beta posterior (a, b) under their parent's posterior mean.

    The prior's strength s solves the moments of a beta-binomial over all children: with m and v the mean and variance of their
    shares and k the mean of 1 / n, v = m(1 - m)(1 + (1 / k - 1) / (s + 1)) * k; it is held between 1 and 1000.
    """
    moments = children.agg(
        F.avg(F.col("bad") / F.col("n")).alias("m"), F.coalesce(F.var_samp(F.col("bad") / F.col("n")), F.lit(0.0)).alias("v"), F.avg(1 / F.col("n")).alias("k")
    )
    base = F.greatest(F.col("m") * (1 - F.col("m")), F.lit(1e-9))
    spread = F.greatest(F.col("v") - base * F.col("k"), F.lit(1e-9)) / (1 - F.least("k", F.lit(0.999)))
    strength = moments.select(F.round(F.least(F.greatest(base / spread - 1, F.lit(1.0)), F.lit(1000.0)), 6).alias("s"))
    # one row, so a nested loop over it is no product of tables
    joined = children.join(parents.select(key, "mean"), key).join(F.broadcast(strength), how="left")
    a, b = F.col("mean") * F.col("s") + F.col("bad"), (1 - F.col("mean")) * F.col("s") + F.col("n") - F.col("bad")
    out = joined.withColumns({"a": a, "b": b})
    return out.drop("mean", "s").withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))


def reputation(outcomes: DataFrame) -> DataFrame:
    """host, a, b, mean and bound of each host of ``outcomes(host, domain, suffix, bad)``; bad is 0 or 1."""
    hosts = outcomes.groupBy("host", "domain", "suffix").agg(F.sum("bad").cast("double").alias("bad"), F.count("*").cast("double").alias("n"))
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("bad").alias("bad"), F.sum("n").alias("n"))
    whole = suffixes.agg(F.lit(1).alias("all"), ((F.sum("bad") + 1) / (F.sum("n") + 2)).alias("mean"))
    suffixes = _shrunk(suffixes.withColumn("all", F.lit(1)), whole, "all").drop("all")
    domains = _shrunk(domains, suffixes, "suffix")
    hosts = _shrunk(hosts, domains.select("domain", "mean"), "domain")
    total = F.col("a") + F.col("b")
    deviation = F.sqrt(F.col("a") * F.col("b") / (total * total * (total + 1)))
    return hosts.select("host", "a", "b", "mean", (F.col("mean") - Z * deviation).alias("bound"))


def judge(pages: DataFrame, outcomes: DataFrame, rules=RULES, long_suffixes=LONG_SUFFIXES) -> DataFrame:
    """page_id, host, path, rule and verdict of each row of ``pages(page_id, url)``.

    ``outcomes(page_id, bad)`` labels pages as bad (1) or good (0); other values and null ids are left out. Hosts without labelled
    pages are allowed unless a rule blocks them: nothing is known against them. Repeated pages are repeated rows, and repeated labels
    count as often as they stand; other columns are ignored; no rows give no rows.
    """
    parts = ruled(levels(parted(pages.select(F.col("page_id").cast("long").alias("page_id"), "url")), long_suffixes), rules)
    marks = outcomes.select(F.col("page_id").cast("long").alias("labelled"), F.col("bad").cast("int").alias("bad")).where("labelled is not null and bad in (0, 1)")
    seen = parts.select("page_id", "host", "domain", "suffix").join(marks, F.col("page_id") == F.col("labelled"))
    blocked = reputation(seen).where(F.col("bound") > LIMIT).select(F.col("host").alias("bad_host"))
    out = parts.join(blocked, F.col("host") == F.col("bad_host"), "left")
    method = F.when(F.col("bad_host").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"))
