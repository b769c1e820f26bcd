"""robots.txt: lines, groups, rules, delays, and access of agents to URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitequarry.functions.urls import path_and_query

#: Milliseconds that a crawl delay is cut to.
MOST_DELAY = 2000
#: Agents asked for at once, at most.
MOST_AGENTS = 1000


def directives(bodies: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, no, field, value, group_no): directives of each body in order; ``group_no`` counts runs of user-agent lines.

    Comments, blank lines and lines without a colon are left out. Sitemap lines neither start nor end a run.
    Directives before any agent have group 0. A body is one value, so its lines stay few.
    """
    rows = bodies.where("body IS NOT NULL").select(key, F.posexplode(F.split("body", r"\r?\n")).alias("no", "raw"))
    line = F.trim(F.regexp_replace("raw", "#.*$", ""))
    rows = rows.withColumn("line", line).where(F.col("line").contains(":"))
    rows = rows.select(key, "no", F.lower(F.trim(F.substring_index("line", ":", 1))).alias("field"), F.trim(F.regexp_replace("line", "^[^:]*:", "")).alias("value"))
    own = Window.partitionBy(key).orderBy("no")
    counted = rows.where("field != 'sitemap'").withColumn("agent", (F.col("field") == "user-agent").cast("int"))
    counted = counted.withColumn("starts", (F.col("agent") == 1) & (F.coalesce(F.lag("agent").over(own), F.lit(0)) == 0))
    counted = counted.withColumn("group_no", F.sum(F.col("starts").cast("int")).over(own)).drop("agent", "starts")
    return counted.unionByName(rows.where("field = 'sitemap'").withColumn("group_no", F.lit(None).cast("long")))


def sitemap_hints(lines: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, no, sitemap): advertised sitemaps in file order, whatever the agent."""
    return lines.where("field = 'sitemap'").select(key, "no", F.col("value").alias("sitemap"))


def _of_agents(lines: DataFrame, key: str) -> DataFrame:
    agents = lines.where("field = 'user-agent'").select(key, "group_no", F.lower("value").alias("agent")).distinct()
    others = lines.where("field != 'user-agent' AND field != 'sitemap' AND group_no > 0")
    return others.join(agents, [key, "group_no"])


def rules(lines: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, agent, rule_no, allow, pattern): rules of each agent; an empty disallow is none, an empty allow matches all."""
    found = _of_agents(lines, key).where("field = 'allow' OR (field = 'disallow' AND value != '')")
    return found.select(key, "agent", F.col("no").alias("rule_no"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("pattern"))


def delays(lines: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, agent, delay_ms): the last finite crawl delay of each agent, at most MOST_DELAY."""
    seconds = F.when(F.col("value") == "", 0.0).otherwise(F.expr("try_cast(value AS double)"))
    found = _of_agents(lines, key).where("field = 'crawl-delay'").withColumn("s", seconds).where("s IS NOT NULL AND NOT isnan(s) AND abs(s) < 1e300")
    return found.groupBy(key, "agent").agg(F.least(F.max_by("s", "no") * 1000, F.lit(float(MOST_DELAY))).alias("delay_ms"))


def pattern_regex(pattern: Column) -> Column:
    """Regular expression of a rule: ``*`` is any run, a final ``$`` the end, all else literal."""
    body = F.regexp_replace(pattern, r"\$$", "")
    literal = F.regexp_replace(body, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(literal, r"\*", ".*"), F.when(pattern.endswith("$"), "$").otherwise(""))


def access(urls: DataFrame, lines: DataFrame, agents: DataFrame, key: str = "site_id") -> DataFrame:
    """(key, url, agent, allowed) for each url (key, url) and each agent (token).

    An agent follows its own group where the file names it, else that of ``*``, else nothing. The longest matching rule
    wins, its stars not counted, allow on ties; without one the url is allowed. The join is by site, the pattern
    a residual condition, and a site's rules are as few as its file is long.
    """
    named = lines.where("field = 'user-agent'").select(key, F.lower("value").alias("agent")).distinct()
    # crawlers are a fixed, short list
    tokens = [r[0] for r in agents.select(F.lower(F.trim(F.substring_index("token", "/", 1))).alias("token")).where("token IS NOT NULL").distinct().limit(MOST_AGENTS + 1).collect()]
    if len(tokens) > MOST_AGENTS:
        raise ValueError(f"more than {MOST_AGENTS} agents: ask for them in parts")
    each = F.explode(F.array(*[F.lit(t) for t in tokens]) if tokens else F.array().cast("array<string>"))
    has = named.groupBy(key).agg(F.collect_set("agent").alias("names"))
    asked = urls.select(key, "url").distinct().select(key, "url", each.alias("token")).join(has, key, "left")
    asked = asked.withColumn("agent", F.when(F.array_contains("names", F.col("token")), F.col("token")).when(F.array_contains("names", F.lit("*")), "*")).drop("names")
    own = rules(lines, key).select(key, "agent", "allow", pattern_regex(F.col("pattern")).alias("regex"), F.length(F.regexp_replace("pattern", r"\*", "")).alias("length"))
    tried = asked.withColumn("path", path_and_query(F.col("url"))).join(own, [key, "agent"], "left")
    hit = tried.where("regex IS NOT NULL").where(F.expr("path rlike regex"))
    best = hit.groupBy(key, "url", "token").agg(F.max_by("allow", F.struct("length", "allow")).alias("allow"))
    return asked.join(best, [key, "url", "token"], "left").select(key, "url", F.col("token").alias("agent"), F.coalesce("allow", F.lit(True)).alias("allowed"))
