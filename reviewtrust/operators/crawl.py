"""Crawl rules: parsing rule files and deciding for every URL at once.

The longest matching pattern wins and Allow breaks ties. A host's rules travel as one
array (one rule file per host is one input row), so a host with a third of all URLs costs
one joined column per URL and never URL x rule rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewtrust.functions.urls import host, part


def parse_rules(files: DataFrame) -> DataFrame:
    """``(host, text)`` to ``(host, agent, pattern, allow)``; a bare agent has a null pattern.

    A blank line ends a group; consecutive agents share the rules that follow them.
    """
    lines = files.select(
        "host", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n")).alias("line", "raw")
    )
    clean = F.trim(F.regexp_replace("raw", r"#.*$", ""))
    lines = lines.select("host", "line", clean.alias("raw")).select(
        "host",
        "line",
        (F.col("raw") == "").alias("blank"),
        F.lower(F.trim(F.regexp_extract("raw", r"^([^:]*):", 1))).alias("name"),
        F.trim(F.regexp_extract("raw", r"^[^:]*:(.*)$", 1)).alias("value"),
    )
    in_file = Window.partitionBy("host").orderBy("line")
    is_agent = F.col("name") == "user-agent"
    lines = lines.withColumn("blanks", F.sum(F.col("blank").cast("int")).over(in_file))
    before = F.last(F.when(is_agent, F.col("blanks")), ignorenulls=True).over(
        in_file.rowsBetween(Window.unboundedPreceding, -1)
    )
    opens = is_agent & (before.isNull() | (F.col("blanks") > before))
    lines = lines.withColumn("opens", opens.cast("int")).withColumn(
        "rule_group", F.sum("opens").over(in_file)
    )
    agents = lines.where(is_agent).select(
        "host", "rule_group", F.col("line").alias("agent_line"), F.lower("value").alias("agent")
    )
    rules = lines.where(
        F.col("name").isin("allow", "disallow") & ~((F.col("name") == "disallow") & (F.col("value") == ""))
    ).select("host", "rule_group", "line", F.col("value").alias("pattern"), (F.col("name") == "allow").alias("allow"))
    return agents.join(rules, ["host", "rule_group"], "left").select(
        "host",
        "agent",
        F.when(F.col("agent_line") < F.col("line"), F.col("pattern")).alias("pattern"),
        F.when(F.col("agent_line") < F.col("line"), F.col("allow")).alias("allow"),
    )


def rules_for_agent(rules: DataFrame, user_agent: str) -> DataFrame:
    """Per host, the rule array of the most specific agent group, else of ``*``."""
    mine = rules.where(
        (F.col("agent") == "*") | ((F.col("agent") != "") & F.lit(user_agent.lower()).contains(F.col("agent")))
    )
    priority = F.when(F.col("agent") == "*", F.lit(0)).otherwise(F.length("agent"))
    chosen = mine.groupBy("host").agg(F.max_by("agent", F.struct(priority, F.col("agent"))).alias("agent"))
    body = F.regexp_replace("pattern", r"\$$", "")
    anchored = F.col("pattern").endswith("$")
    parts = F.split(body, r"\*")
    rest = F.slice(parts, 2, F.size(parts))
    entry = F.struct(
        F.length("pattern").alias("length"),
        F.col("allow"),
        F.get(parts, F.lit(0)).alias("prefix"),
        # Texts that must follow in this order; the last of an anchored pattern must end the path.
        F.filter(F.when(anchored, F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))).otherwise(rest), lambda p: p != "").alias("middle"),
        F.when(anchored & (F.size(parts) > 1), F.element_at(parts, -1)).alias("suffix"),
        (anchored & (F.size(parts) == 1)).alias("whole"),
    )
    return (
        mine.join(chosen, ["host", "agent"])
        .groupBy("host")
        .agg(F.collect_set(F.when(F.length("pattern") > 0, entry)).alias("rules"))
    )


def _fits(path: Column, rule: Column) -> Column:
    """Does a rule's pattern match the path? By its parts between wildcards, leftmost first, so no pattern is compiled."""
    reached = F.aggregate(
        rule["middle"],
        F.length(rule["prefix"]) + 1,
        lambda at, part: F.when(
            F.position(part, path, at) > 0, F.position(part, path, at) + F.length(part)
        ),
    )
    ends = rule["suffix"].isNull() | (
        path.endswith(rule["suffix"]) & (F.length(path) - F.length(rule["suffix"]) + 1 >= reached)
    )
    return F.coalesce(
        F.when(rule["whole"], path == rule["prefix"]).otherwise(
            path.startswith(rule["prefix"]) & reached.isNotNull() & ends
        ),
        F.lit(False),
    )


def request_path(url: Column) -> Column:
    """Decoded path plus the query as written."""
    raw = F.coalesce(F.nullif(part(url, "PATH"), F.lit("")), F.lit("/"))
    decoded = F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)
    query = part(url, "QUERY")
    return F.concat(decoded, F.coalesce(F.concat(F.lit("?"), F.nullif(query, F.lit(""))), F.lit("")))


def allowed_urls(urls: DataFrame, rules: DataFrame, user_agent: str, url: str = "url") -> DataFrame:
    """Add ``crawl_allowed``; a URL without any matching rule is allowed."""
    keyed = urls.withColumns({"_host": host(F.col(url)), "_path": request_path(F.col(url))})
    arrays = rules_for_agent(rules, user_agent).withColumnRenamed("host", "_host")
    hits = F.filter("rules", lambda r: _fits(F.col("_path"), r))
    best = F.array_max(
        F.transform(hits, lambda r: F.struct(r["length"].alias("length"), r["allow"].alias("allow")))
    )
    return (
        keyed.join(arrays, "_host", "left")
        .withColumn("crawl_allowed", F.coalesce(best["allow"], F.lit(True)))
        .drop("_host", "_path", "rules")
    )
