"""URL filters with history: captures against the list entries in force when they were fetched.

A list is a sequence of dated entries per pattern: from its day on, an entry blocks or allows
the pattern until the next one. Entries become validity intervals, which are joined by
pattern and month, so a capture only meets what can apply to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from eventloom.llm.common import write_table

END = "9999-12-01"
# The ranks of patterns: what says more about a URL decides.
RANKS = ("domain", "host", "path")


def host_of(url: Column) -> Column:
    """Lower-case host without user, port and a trailing dot; empty if there is none."""
    host = F.regexp_extract(F.lower(url), "^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.coalesce(host, F.lit("")), "[.]$", "")


def patterns_of(url: Column) -> Column:
    """Array of (rank, pattern): last two labels of the host, the host, host and first path step."""
    host = host_of(url)
    domain = F.regexp_extract(host, "([^.]+[.][^.]+)$", 1)
    step = F.regexp_extract(url, "^[^:]+://[^/?#]*/([^/?#]+)", 1)
    path = F.when(step != "", F.concat(host, F.lit("/"), step))
    found = F.array(
        F.struct(F.lit(0).alias("rank"), F.when(domain != "", domain).alias("pattern")),
        F.struct(F.lit(1).alias("rank"), F.when(host != "", host).alias("pattern")),
        F.struct(F.lit(2).alias("rank"), F.when(host != "", path).alias("pattern")),
    )
    return F.filter(found, lambda p: p["pattern"].isNotNull())


def candidates_of(url: Column) -> Column:
    """Array of (rank, length, pattern): all that an entry may say about a URL.

    Every suffix of the host's labels from two on as a domain, the host, and the host with each number of
    path steps from the first on; `length` is the number of labels or steps.
    """
    host = host_of(url)
    labels = F.split(host, "[.]")
    number = F.size(labels)
    # An IPv4 address has no domains above it but the last two numbers, which `patterns_of` lists.
    most = F.when(host.rlike("^[0-9]+([.][0-9]+){3}$"), F.least(number, F.lit(2))).otherwise(number)
    path = F.regexp_extract(url, "^[^:]+://[^/?#]*/([^?#]*)", 1)
    steps = F.split(F.regexp_replace(path, "/+$", ""), "/")
    domains = F.transform(
        F.sequence(F.lit(2), F.greatest(most, F.lit(2))),
        lambda n: F.struct(
            F.lit(0).alias("rank"), n.alias("length"),
            F.when(n <= most, F.array_join(F.slice(labels, -n, n), ".")).alias("pattern"),
        ),
    )
    hosts = F.array(F.struct(F.lit(1).alias("rank"), number.alias("length"), F.when(host != "", host).alias("pattern")))
    paths = F.transform(
        F.sequence(F.lit(1), F.size(steps)),
        lambda n: F.struct(
            F.lit(2).alias("rank"), n.alias("length"),
            F.when(
                (host != "") & (F.element_at(steps, 1) != ""),
                F.concat(host, F.lit("/"), F.array_join(F.slice(steps, F.lit(1), n), "/")),
            ).alias("pattern"),
        ),
    )
    # A host without an empty label only, as a suffix of one would start with a dot.
    whole = F.filter(domains, lambda p: ~p["pattern"].rlike("^[.]|[.][.]|[.]$"))
    return F.filter(F.concat(whole, hosts, paths), lambda p: p["pattern"].isNotNull())


def intervals(entries: DataFrame) -> DataFrame:
    """(rank, pattern, action, since, until) of entries (rank, pattern, action, day).

    An entry holds from its day to the day before the next one of its pattern. Of several
    entries of a day, `block` wins. Entries with a null are ignored.
    """
    known = entries.where("rank is not null and pattern is not null and action is not null and day is not null")
    daily = known.groupBy("rank", "pattern", "day").agg(F.max("action").alias("action"))
    following = F.lead("day").over(W.partitionBy("rank", "pattern").orderBy("day"))
    return daily.select(
        "rank", "pattern", "action", F.col("day").alias("since"),
        F.coalesce(following, F.lit(END).cast("date")).alias("until"),
    )


def filter_urls(captures: DataFrame, entries: DataFrame, last_day: str) -> DataFrame:
    """One row per capture (page_id, url, fetched): adds host, blocked, pattern and since.

    Of the patterns of a URL that have an entry in force on the day of the fetch, the longest decides:
    path before host before domain, and of paths or domains that with the most steps or labels. Without any the capture is allowed, as are captures
    without a URL, a host or a day; the pattern is then null. Rows that repeat page_id, url and day are one
    question and each gets the answer. Open intervals are spread over the months up to `last_day` or the
    last capture, whichever is later.
    """
    # One row: the last day that is asked for.
    last = captures.agg(F.greatest(F.max("fetched").cast("date"), F.lit(last_day).cast("date")).alias("last_day"))
    upto = F.least(F.col("until"), F.col("last_day"))
    months = F.sequence(F.trunc("since", "month"), F.trunc(F.greatest("since", upto), "month"), F.expr("interval 1 month"))
    spread = intervals(entries).join(last).withColumn("month", F.explode(months)).drop("last_day")
    asked = captures.select("page_id", "url", "fetched").withColumn("day", F.col("fetched").cast("date"))
    # Each question once, however often it is repeated.
    questions = asked.where("url is not null and day is not null").select("url", "day").distinct()
    met = questions.select("url", "day", F.trunc("day", "month").alias("month"), F.explode(candidates_of(F.col("url"))).alias("p")).select(
        "url", "day", "month", "p.rank", "p.length", "p.pattern"
    )
    found = met.join(spread, ["rank", "pattern", "month"]).where("since <= day and day < until")
    answer = found.groupBy("url", "day").agg(
        F.max_by(F.struct("action", "pattern", "since"), F.struct("rank", "length")).alias("a")
    )
    return asked.join(answer, ["url", "day"], "left").select(
        "page_id", "url", "fetched", host_of(F.col("url")).alias("host"),
        F.coalesce(F.col("a.action") == "block", F.lit(False)).alias("blocked"),
        F.col("a.pattern").alias("pattern"), F.col("a.since").alias("since"),
    )


def captures_of(pages: DataFrame) -> DataFrame:
    """(page_id, url, fetched): the pages, fetched over the days of 2024 in the order of a hash."""
    nth = F.conv(F.substring(F.md5(F.col("page_id").cast("string")), 1, 4), 16, 10).cast("int") % 366
    return pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.date_add(F.lit("2024-01-01").cast("date"), nth).alias("fetched"),
    )


def entries_of(captures: DataFrame) -> DataFrame:
    """A dated list over the patterns that occur: a hash of the pattern gives its three entries.

    Half the paths, half the hosts and an eighth of the domains are listed; each is blocked,
    allowed and, for half of them, blocked again.
    """
    seen = captures.select(F.explode(patterns_of(F.col("url"))).alias("p")).select("p.rank", "p.pattern").distinct()
    md5 = F.md5(F.concat_ws("|", "rank", "pattern"))
    digits = lambda at, n: F.conv(F.substring(md5, at, n), 16, 10).cast("int")
    first = F.lit("2024-01-01").cast("date")
    day = digits(2, 2) % 180
    again = F.when(digits(6, 1) % 2 == 0, F.date_add(first, day + digits(4, 2) % 90 + 31))
    listed = seen.where(F.when(F.col("rank") == 0, digits(1, 1) % 8 == 0).otherwise(digits(1, 1) % 2 == 0))
    return listed.select(
        "rank", "pattern",
        F.explode(
            F.array(
                F.struct(F.lit("block").alias("action"), F.date_add(first, day).alias("day")),
                F.struct(F.lit("allow").alias("action"), F.date_add(first, day + digits(4, 2) % 90 + 1).alias("day")),
                F.struct(F.lit("block").alias("action"), again.alias("day")),
            )
        ).alias("e"),
    ).select("rank", "pattern", "e.action", "e.day")


def filtered_pages(pages: DataFrame) -> DataFrame:
    """The pages' captures against the list derived from them."""
    captures = write_table(captures_of(pages), "captures")
    return filter_urls(captures, write_table(entries_of(captures), "entries"), "2024-12-31")
