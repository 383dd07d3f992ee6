"""URL filters: a sort-merge range join between URLs and host rules, in DataFrame functions only.

A host's canonical key is its labels in reverse, each ended by U+0001: ``a.example.net`` becomes
``net<1>example<1>a<1>``. All subdomains of a rule's host then lie in one interval of keys that
begins at the rule's key, and these intervals are nested or apart. Rules and URLs are sorted
together; a running window keeps one slot per nesting depth, the stack of the rules opened last.
A slot is active while the URL's key starts with the slot's key. Path tests and the choice of the
longest rule follow on the few active slots.

The sort is a range partitioning over all URLs (a hot host is cut by path and id across partitions),
and each partition takes over the stack with which the ones before it ended: a table of one row per
partition, so nothing is broadcast or collected.

Cases: a null URL or one without ``://`` has an empty host and path and no rule; repeated rows are judged
each; extra columns are ignored; an empty table gives an empty result; no rule at all gives the
default verdict everywhere; of equally long fitting rules, ``block`` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm._common import shuffle_partitions, stored, table

END = "\u0001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (host, path, verdict) of the registered query.
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), END), F.lit(END))


def rules_frame(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    if not rules:
        return spark.createDataFrame([], "host string, path string, verdict string")
    text = lambda x: F.lit(x).cast("string")
    rows = [F.struct(text(host).alias("host"), text(path).alias("path"), text(verdict).alias("verdict")) for host, path, verdict in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _ranked(host: Column):
    return lambda r: F.struct((F.length(host) + F.length(r["path"])).alias("size"), F.length(host).alias("host_size"), r["verdict"].alias("verdict"), F.concat(host, r["path"]).alias("rule"))


def judge_urls(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict) of each row; ``rules`` has host, path and verdict."""
    spark = pages.sparkSession
    n = shuffle_partitions(spark)
    rules = rules.where("host is not null and path is not null and verdict is not null").withColumn("host", F.translate("host", UPPER, LOWER))
    by_host = rules.groupBy("host").agg(F.collect_set(F.struct("path", "verdict")).alias("own")).withColumn("depth", F.size(F.split("host", r"\.", -1)))
    depths = sorted(r[0] for r in by_host.select("depth").distinct().collect())  # at most 127, by the length of a host name

    host, path = host_and_path(F.col("url"))
    urls = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url")).select("id", host.alias("host"), path.alias("path"))
    opened = F.struct(canonical_key(F.col("host")).alias("key"), F.col("host").alias("host"), F.col("own").alias("own"))
    events = urls.select("id", "host", "path", canonical_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.lit(None).cast("int").alias("depth"))
    events = events.unionByName(by_host.select(canonical_key(F.col("host")).alias("key"), F.lit(0).alias("kind"), "depth", opened.alias("opened")), allowMissingColumns=True)
    # range bounds come from a sample, so the cut is written once and read by both branches below
    cut, _ = stored(events.repartitionByRange(n, "key", "kind", "path", "id").withColumn("part", F.spark_partition_id()), "url-sweep")

    slot = lambda d: F.when((F.col("kind") == 0) & (F.col("depth") == d), F.col("opened"))
    so_far = Window.partitionBy("part").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = cut.select("id", "host", "path", "key", "kind", "part", *[F.last(slot(d), ignorenulls=True).over(so_far).alias(f"slot{d}") for d in depths]).where("kind = 1")
    if depths:
        ends = cut.where("kind = 0").groupBy("part").agg(*[F.max_by(slot(d), F.when(F.col("depth") == d, F.col("key"))).alias(f"end{d}") for d in depths])
        before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
        ends = spark.range(n).select(F.col("id").cast("int").alias("part")).join(ends, "part", "left")
        ends = ends.select("part", *[F.last(f"end{d}", ignorenulls=True).over(before).alias(f"from{d}") for d in depths])
        swept = swept.join(ends, "part", "left")
    found = []
    for d in depths:
        top = F.coalesce(f"slot{d}", f"from{d}")
        fits = F.startswith("key", top["key"]) & ((F.col("host") == top["host"]) | F.endswith("host", F.concat(F.lit("."), top["host"])))
        found.append(F.when(fits, F.transform(F.filter(top["own"], lambda r: F.startswith(F.col("path"), r["path"])), _ranked(top["host"]))))
    if not found:
        return swept.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    best = F.array_max(F.flatten(F.filter(F.array(*found), lambda x: x.isNotNull())))
    return swept.withColumn("best", best).select(F.col("id").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), rules_frame(spark, RULES))


ORACLE = """
with r(host, path, verdict) as (values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
p as (select page_id, coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
      coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
m as (select p.page_id, p.host, p.path, (select r.host || r.path from r where (p.host = r.host or ends_with(p.host, '.' || r.host)) and starts_with(p.path, r.path)
      order by length(r.host || r.path) desc limit 1) as rule from p)
select m.page_id, m.host, m.path, m.rule, coalesce(r.verdict, 'allow') as verdict from m left join r on m.rule = r.host || r.path
"""
