"""URL rules: the longest host-and-path prefix that fits each url."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stewardspark.llm.common import ascii_lower, stored

OPEN, PROBE, CLOSE = 0, 1, 2


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _host_key(host: Column) -> Column:
    """The labels from the last to the first, each ended by a zero byte: the key of a host
    starts with those of the hosts it is a subdomain of, and with no other host's."""
    labels = F.array_join(F.reverse(F.split(host, r"\.")), "\0")
    return F.concat(F.encode(labels, "UTF-8"), F.unhex(F.lit("00")))


def _path_key(host: Column, path: Column) -> Column:
    """Bytes that sort by host, then path; a prefix of a path is a prefix of the key."""
    return F.concat(_host_key(host), F.unhex(F.lit("00")), F.encode(path, "UTF-8"))


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    default: str = "allow",
    id_column: str = "page_id",
    url_column: str = "url",
) -> DataFrame:
    """(id, host, path, rule, verdict) of each row, by the longest rule that fits.

    ``rules`` has ``host``, ``path`` and ``verdict``. A rule fits its host and all
    subdomains if the url's path starts with the rule's. ``rule`` is host and path
    put together, null where none fits; the verdict is then ``default``. Of rules
    that are written twice, or equally long, the one with the longer host counts,
    then ``block`` before ``allow``. A null url or one without ``://`` has an empty
    host and path and fits no rule. Repeated rows and ids stay, further columns are
    not read, an empty table gives an empty result.

    Two sort-merge range joins. In the order of reversed hosts the hosts of rules are
    intervals that nest: one sorted sweep finds all that a url's host lies in. Under
    each of these the paths of its rules are intervals that nest, too, and a second
    sweep finds the innermost that a url's path lies in. Keys are dealt out by range;
    every range gets the openings and closings of the intervals that reach into it.
    The sweep's depth is a running sum, and what is open at a level is what was opened
    there last. Equal keys were merged before, so no range is hot.
    """
    rules = rules.select(
        ascii_lower(F.col("host")).alias("rule_host"),
        F.coalesce("path", F.lit("")).alias("rule_path"),
        F.col("verdict").alias("rule_verdict"),
    ).filter("rule_host <> ''")
    rules = rules.groupBy("rule_host", "rule_path").agg(F.max("rule_verdict").alias("rule_verdict"))
    rules = stored(rules, "rules")
    rows = pages.select(
        F.col(id_column),
        url_host(F.col(url_column)).alias("host"),
        url_path(F.col(url_column)).alias("path"),
    )
    urls = rows.filter("host <> ''").groupBy("host", "path").agg(F.count("*").alias("n"))
    hosts = urls.select("host").distinct().select(
        F.struct("host").alias("point"), _host_key(F.col("host")).alias("key")
    )
    ruled = rules.select("rule_host").distinct().select(
        F.struct("rule_host").alias("rule"), _host_key(F.col("rule_host")).alias("start")
    )
    within = _all_open(hosts, ruled).select("point.host", "rule.rule_host")
    probes = urls.join(within, "host").select(
        F.struct("host", "path").alias("point"), _path_key(F.col("rule_host"), F.col("path")).alias("key")
    )
    prefixes = rules.select(
        F.struct("rule_host", "rule_path", "rule_verdict").alias("rule"),
        _path_key(F.col("rule_host"), F.col("rule_path")).alias("start"),
    )
    found = _innermost(probes, prefixes).select("point.*", "rule")
    best = F.struct(
        F.length(F.concat("rule.rule_host", "rule.rule_path")), F.length("rule.rule_host"), "rule.*"
    )
    found = found.filter("rule IS NOT NULL").groupBy("host", "path").agg(F.max(best).alias("best"))
    return rows.join(found, ["host", "path"], "left").select(
        id_column,
        "host",
        "path",
        F.concat("best.rule_host", "best.rule_path").alias("rule"),
        F.coalesce("best.rule_verdict", F.lit(default)).alias("verdict"),
    )


def _events(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """What a sweep meets, by range and key: (range, key, kind, point, rule, depth).

    ``points`` are (point, key), ``intervals`` (rule, start): the keys that start with
    ``start``. ``depth`` is the number of intervals open after an event.
    """
    dealt = points.repartitionByRange("key").withColumn("range", F.spark_partition_id())
    dealt = stored(dealt, "url-keys")
    # One row for each range: as many as there are shuffle partitions.
    ends = dealt.groupBy("range").agg(F.min("key").alias("lo"), F.max("key").alias("hi"))
    ends = sorted((r["range"], bytes(r["lo"]), bytes(r["hi"])) for r in ends.collect())
    stop = F.concat("start", F.unhex(F.lit("FF")))
    reached = F.array(
        *[
            F.when((F.col("start") <= F.lit(hi)) & (F.col("stop") >= F.lit(lo)), F.lit(part))
            for part, lo, hi in ends
        ]
    ).cast("array<int>")
    spread = intervals.select("rule", "start", stop.alias("stop"))
    spread = spread.select("rule", "start", "stop", F.explode(reached).alias("range"))
    spread = spread.filter("range IS NOT NULL")
    events = dealt.select("range", "key", F.lit(PROBE).alias("kind"), "point", F.lit(None).alias("rule"))
    for kind, column in ((OPEN, "start"), (CLOSE, "stop")):
        events = events.unionByName(
            spread.select(
                "range", F.col(column).alias("key"), F.lit(kind).alias("kind"), F.lit(None).alias("point"), "rule"
            )
        )
    order = Window.partitionBy("range").orderBy("key", "kind")
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    return events.withColumn("depth", F.sum(step).over(order)).filter(F.col("kind") != CLOSE)


def _at_level(events: DataFrame) -> DataFrame:
    """(point, rule): what is open for each point at its ``depth``, null at none."""
    stack = Window.partitionBy("range", "depth").orderBy("key", "kind")
    opened = F.last(F.when(F.col("kind") == OPEN, F.col("rule")), ignorenulls=True).over(stack)
    return events.withColumn("rule", opened).filter(F.col("kind") == PROBE).select("point", "rule")


def _innermost(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(point, rule) of each point, with the innermost interval it lies in, or null."""
    return _at_level(_events(points, intervals))


def _all_open(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """(point, rule) for each point and each interval it lies in: the whole stack."""
    events = _events(points, intervals)
    levels = F.when(F.col("kind") == OPEN, F.array("depth")).when(
        F.col("depth") > 0, F.sequence(F.lit(1).cast("bigint"), "depth")
    )
    return _at_level(events.withColumn("depth", F.explode(levels)))
