"""Host-level quality rules, with DataFrame functions only.

Every document is measured by rules on its words and lines. Failures are then
counted by host (the ``source`` of a document), host rates are shrunk by a
beta prior that the hosts themselves give (method of moments), and a host whose
posterior failure rate is above ``max_rate`` with confidence ``z`` is rejected
with all of its documents. Hosts are counted by partial sums before they are
shuffled. Their verdicts come back by a broadcast where the planner knows them to
be small; else by a shuffle, in which Spark's skew join deals a hot host's rows to several tasks.

Defined cases: a null or empty text has no words, so it fails the word rule; a
null source is a host of its own; repeated rows and repeated ids are measured
row by row; an empty table gives an empty result; columns beside ``id_col``,
``text_col`` and ``host_col`` are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import written

#: White space that separates words, as a regular expression.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[^#*$%&|<>]+"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30


def measures(text: Column) -> dict[str, Column]:
    """Rule inputs that need no word array."""
    whole = F.coalesce(text, F.lit(""))
    return {
        "n_symbols": F.length(F.regexp_replace(whole, SYMBOLS, "")).cast("long"),
        "lines": F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        "words": F.filter(F.split(whole, SPACE), lambda x: x != ""),
    }


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once; projections may be merged, lambda arguments are not."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def repeated_words(words: Column) -> Column:
    """Words within windows of 8 words that the text has twice or more.

    Windows are compared by one 64-bit hash each. Only texts that have one
    twice pay for the sort; covered words are then the sum of the
    distances between neighbouring repeated windows, 8 at most each.
    """
    windows = lambda hashes: F.transform(F.sequence(F.lit(1), F.size(hashes) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    same = lambda pairs, p, i: F.coalesce(F.get(pairs, i)["h"] == p["h"], F.lit(False))
    paired = lambda win: F.array_sort(F.transform(win, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    twins = lambda pairs: F.array_sort(F.transform(F.filter(pairs, lambda p, i: same(pairs, p, i - 1) | same(pairs, p, i + 1)), lambda p: p["i"]))
    step = lambda at: lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - x, F.lit(WINDOW)))
    covered = lambda at: F.aggregate(F.transform(at, step(at)), F.lit(0).cast("long"), lambda a, x: a + x)
    counted = lambda win: F.when(F.size(F.array_distinct(win)) < F.size(win), _let(_let(paired(win), twins), covered)).otherwise(F.lit(0).cast("long"))
    found = _let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), counted)
    return F.when(F.size(words) > WINDOW, found).otherwise(F.lit(0).cast("long"))


def document_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Columns ``doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed`` per row."""
    split = docs.select(F.col(id_col).alias("doc_id"), F.col(host_col).alias("host"), *(c.alias(n) for n, c in measures(F.col(text_col)).items()))
    measured = split.select(
        "doc_id", "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("words")).alias("n_repeat_words"),
    )
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return measured.withColumn("base_failed", failed)


def host_verdicts(measured: DataFrame, max_rate: float = 0.5, z: float = 3.0) -> DataFrame:
    """Per host: failures, documents, posterior ``rate`` and ``host_ok``.

    The prior is Beta(m * s, (1 - m) * s): m is the overall rate, and s comes
    from the spread between hosts beyond that of a binomial (kept within
    1 and 10000). A host is rejected if rate - z * sd is above ``max_rate``.
    """
    hosts = measured.groupBy("host").agg(F.sum(F.col("base_failed").cast("long")).alias("k"), F.count(F.lit(1)).alias("n"))
    total = hosts.agg(F.sum("k").alias("all_k"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("n_hosts"), F.sum(F.col("n") * F.col("n")).alias("sq_n"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("sq_k"))
    m = F.col("all_k") / F.col("all_n")
    between = (F.col("sq_k") - F.col("all_n") * m * m - (F.col("n_hosts") - 1) * m * (1 - m)) / F.nullif(F.col("all_n") - F.col("sq_n") / F.col("all_n"), F.lit(0.0))
    s = F.least(F.lit(10000.0), F.greatest(F.lit(1.0), F.coalesce(m * (1 - m) / F.nullif(F.greatest(between, F.lit(0.0)), F.lit(0.0)) - 1, F.lit(10000.0))))
    prior = total.select(m.alias("m"), s.alias("s"))
    rate = (F.col("k") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s"))
    sd = F.sqrt(F.col("rate") * (1 - F.col("rate")) / (F.col("n") + F.col("s") + 1))
    # the prior is an aggregate without keys: one row, whatever the input
    return hosts.join(F.broadcast(prior)).withColumn("rate", rate).withColumn("host_ok", F.col("rate") - z * sd <= max_rate).select("host", "k", "n", "rate", "host_ok")


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_rate: float = 0.5, z: float = 3.0) -> DataFrame:
    """Measures of every row with ``kept``: false if the row fails a rule or its host is rejected."""
    measured = written(document_rules(docs, id_col, text_col, host_col), "rules")
    hosts = host_verdicts(measured, max_rate, z).withColumnRenamed("host", "of_host").select("of_host", "rate", "host_ok")
    joined = measured.join(hosts, measured["host"].eqNullSafe(hosts["of_host"]), "left").drop("of_host")
    return joined.withColumn("kept", ~F.col("base_failed") & F.col("host_ok"))
