"""URL filters: a sort-merge range join of reversed-host canonical keys with nested prefix rules.

A key is the host's labels from the last to the first, each followed by a space, then a tab and the path. A rule stands for the
interval of all keys that begin with its own key. As a rule also fits subdomains, a URL gets one key for each host suffix with at
most as many labels as the deepest rule has; longer suffixes can't equal a rule's host.

The sweep: rules and keys sorted together; the last rule that began, with the stack of rules that enclose it, holds every
rule that is open at a key, as intervals of prefixes nest. The keys are dealt by a hash into slices that each sweep all
rules, so that a hot host is spread evenly; slices times rules is what is copied.

Defined cases: a null url, or one without ``://``, has an empty host and path and fits no rule; an empty path fits no rule whose path is
longer; the same rule given twice counts once (block wins); repeated rows are judged one by one; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The contract's rules: verdict, host, path.
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
DEFAULT = "allow"


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rules, "verdict string, host string, path string")


def with_host_path(pages: DataFrame) -> DataFrame:
    rest = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://(.*)$", 1)
    lower = F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.withColumns({"__u_host": lower, "__u_path": F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)})


def key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), " "), F.lit(" \t"), path)


def with_stack(rules: DataFrame) -> DataFrame:
    """Each rule with its key and the stack of keys of the rules that enclose it, itself first."""
    r = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    r = r.withColumn("__r_key", key(F.col("host"), F.col("path")))
    # A rule encloses another if its key equals one of the other's prefixes, which are bounded by the key's length.
    inner = r.select(F.col("__r_key").alias("__r_in"), F.explode(F.transform(F.sequence(F.lit(1), F.length("__r_key")), lambda n: F.substring(F.col("__r_key"), F.lit(1), n))).alias("__r_key"))
    found = inner.join(r, "__r_key").groupBy("__r_in").agg(F.sort_array(F.collect_list(F.struct(F.length("__r_key").alias("n"), F.col("__r_key").alias("k"), "host", "path", "verdict")), asc=False).alias("__r_stack"))
    return found.withColumnRenamed("__r_in", "__r_key")


def url_filter(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, slices: int | None = None) -> DataFrame:
    """The rows with __u_host, __u_path, __u_rule (host and path of the longest rule that fits, else null) and __u_verdict."""
    slices = slices or max(8, int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    stacks = with_stack(rules)
    depth = rules.select(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 1  # one number
    d = with_host_path(pages).withColumn("__u_id", F.monotonically_increasing_id())
    hosts = F.array_distinct(F.array(*(F.substring_index("__u_host", ".", -k) for k in range(1, depth + 1))))
    keys = d.select(
        F.pmod(F.xxhash64("__u_id"), F.lit(slices)).cast("int").alias("__u_slice"),
        "__u_id",
        "__u_path",
        F.struct(*pages.columns, "__u_host", "__u_path").alias("__u_row"),
        F.posexplode(hosts).alias("__u_n", "__u_suffix"),
    )
    keys = keys.select("__u_slice", key(F.col("__u_suffix"), F.col("__u_path")).alias("__u_key"), F.lit(1).alias("__u_kind"), "__u_id", F.when(F.col("__u_n") == 0, F.col("__u_row")).alias("__u_row"), F.lit(None).cast(stacks.schema["__r_stack"].dataType).alias("__r_stack"))
    starts = stacks.select(F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("__u_slice"), F.col("__r_key").alias("__u_key"), F.lit(0).alias("__u_kind"), F.lit(None).cast("long").alias("__u_id"), F.lit(None).cast(keys.schema["__u_row"].dataType).alias("__u_row"), "__r_stack")
    sweep = Window.partitionBy("__u_slice").orderBy("__u_key", "__u_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = keys.unionByName(starts).withColumn("__r_stack", F.last("__r_stack", ignorenulls=True).over(sweep)).where("__u_kind = 1")
    open_ = F.get(F.filter("__r_stack", lambda r: F.col("__u_key").startswith(r["k"])), F.lit(0))
    best = swept.withColumn("__u_hit", open_).withColumn("__u_rank", F.length(F.concat("__u_hit.host", "__u_hit.path")))
    out = best.groupBy("__u_slice", "__u_id").agg(F.first("__u_row", ignorenulls=True).alias("__u_row"), F.max_by("__u_hit", "__u_rank").alias("__u_hit"))
    return out.select("__u_row.*", F.concat("__u_hit.host", "__u_hit.path").alias("__u_rule"), F.coalesce("__u_hit.verdict", F.lit(default)).alias("__u_verdict"))
