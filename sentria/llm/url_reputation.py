"""URL filter by rules and by host reputation, with DataFrame functions only.

Rules name a host suffix and a path prefix; the longest that fits decides.
Where none fits, the host's reputation does: labelled page outcomes are
counted by host, and bad rates are shrunk through a chain of beta-binomial
priors, from all pages to the suffix, to the registered domain, to the host.
The strength of each level's prior comes from the spread of its groups (method
of moments). A registered domain is a public suffix and the label before it; public
suffixes are the last labels, and those of several labels that the caller lists
(``suffixes``, one pattern: some hundred at most). A host is blocked if the lower posterior bound of its bad rate is
above ``max_rate``.

Hosts are counted by partial sums before they are shuffled. Their reputations come
back by a broadcast where the planner knows them to be small; else by a shuffle, in
which Spark's skew join deals a hot host's rows to several tasks. Rules become one
expression with a branch for each: some hundred at most.

Defined cases: a null url, or one without ``://``, has an empty host and path,
and no rule fits it; a host of one label is its own registered domain and
suffix; repeated pages are judged row by row; of several outcomes of a
page the majority counts, a tie as bad; null outcomes and null ids don't count; without outcomes nothing is blocked
but by rules; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
Rule = tuple[str, str]  # ("allow" or "block", "host/path prefix")


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path as the contract of the filter defines them."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; both null if none fits."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of_host, slash, prefix = text.partition("/")
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(slash + prefix)
        name, verdict = F.when(fits, F.lit(text)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def _strength(groups: DataFrame) -> DataFrame:
    """One row ``m, s``: the mean of the groups' rates and how firmly they keep to it (1 to 10000)."""
    total = groups.agg(
        F.coalesce(F.sum("k"), F.lit(0)).alias("all_k"), F.coalesce(F.sum("n"), F.lit(0)).alias("all_n"), F.count(F.lit(1)).alias("groups"),
        F.sum(F.col("n") * F.col("n")).alias("sq_n"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("sq_k"),
    )
    m = F.col("all_k") / F.nullif(F.col("all_n"), F.lit(0))
    between = (F.col("sq_k") - F.col("all_n") * m * m - (F.col("groups") - 1) * m * (1 - m)) / F.nullif(F.col("all_n") - F.col("sq_n") / F.col("all_n"), F.lit(0.0))
    s = F.least(F.lit(10000.0), F.greatest(F.lit(1.0), F.coalesce(m * (1 - m) / F.nullif(F.greatest(between, F.lit(0.0)), F.lit(0.0)) - 1, F.lit(10000.0))))
    return total.select(F.coalesce(m, F.lit(0.0)).alias("m"), s.alias("s"))


def domain_parts(host: Column, suffixes: Sequence[str] = ()) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host."""
    suffix = "|".join([*(re.escape(s) for s in sorted(suffixes, key=len, reverse=True)), "[^.]*"])
    return F.regexp_extract(host, rf"(?:[^.]*\.)?(?:{suffix})$", 0), F.regexp_extract(host, rf"(?:^|\.)({suffix})$", 1)


def reputations(seen: DataFrame, z: float = 2.0, max_rate: float = 0.5, suffixes: Sequence[str] = ()) -> DataFrame:
    """Per host of ``seen`` (host, bad): posterior ``rate`` and ``reputation``.

    ``bad`` is 1, 0 or null (no label). All hosts are kept, labelled or not.
    """
    domain, suffix = domain_parts(F.col("host"), suffixes)
    hosts = written(
        seen.groupBy("host").agg(F.coalesce(F.sum("bad"), F.lit(0)).cast("long").alias("k"), F.count("bad").alias("n"))
        .withColumn("domain", domain).withColumn("suffix", suffix),
        "hosts",
    )
    domains = hosts.groupBy("suffix", "domain").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    # each prior is an aggregate without keys: one row, whatever the input
    prior = {name: F.broadcast(_strength(df.filter("n > 0")).toDF(f"{name}_m", f"{name}_s")) for name, df in (("suffix", suffixes), ("domain", domains), ("host", hosts))}
    shrunk = lambda parent, s: (F.col("k") + F.col(parent) * F.col(s)) / (F.col("n") + F.col(s))
    suffixes = suffixes.join(prior["suffix"]).select("suffix", shrunk("suffix_m", "suffix_s").alias("suffix_rate"))
    domains = domains.join(suffixes, "suffix").join(prior["domain"]).select("domain", shrunk("suffix_rate", "domain_s").alias("domain_rate"))
    rated = hosts.join(domains, "domain").join(prior["host"]).withColumn("rate", shrunk("domain_rate", "host_s"))
    bound = F.col("rate") - z * F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("host_s") + 1))
    return rated.select("host", "rate", F.when(bound > max_rate, "block").otherwise("allow").alias("reputation"))


def url_filter(pages: DataFrame, outcomes: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", z: float = 2.0, max_rate: float = 0.5, suffixes: Sequence[str] = ()) -> DataFrame:
    """Per row of ``pages``: ``page_id, host, path, rule, verdict, rate``.

    ``outcomes`` has ``page_id`` and ``bad`` (1, 0 or null), any number for a page.
    """
    host, path = url_parts(F.col(url_col))
    parts = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    judged = outcomes.select(F.col("page_id").alias("of_page"), F.col("bad").cast("long").alias("bad")).filter("bad is not null and of_page is not null")
    labels = judged.groupBy("of_page").agg(F.sum("bad").alias("bad_n"), F.count(F.lit(1)).alias("label_n"))
    seen = parts.join(labels, F.col("page_id") == F.col("of_page"), "left")
    rated = reputations(seen.select("host", F.when(F.col("label_n") > 0, F.col("bad_n") / F.col("label_n") >= 0.5).cast("int").alias("bad")), z, max_rate, suffixes)
    name, verdict = matching_rule(F.col("host"), F.col("path"), rules)
    known = rated.withColumnRenamed("host", "of_host")
    joined = parts.join(known, parts["host"] == known["of_host"], "left")
    return joined.select("page_id", "host", "path", name.alias("rule"), F.coalesce(verdict, F.col("reputation"), F.lit("allow")).alias("verdict"), "rate")
