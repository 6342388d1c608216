"""robots.txt: parsing to rules, the choice of a group and pattern matching, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

GROUP = "struct<agents: array<string>, rules: array<struct<pattern: string, allow: boolean>>, delay: double>"
MAX_BYTES = 512 * 1024
_TRIM = r"^\s+|\s+$"


def _lines(body: Column) -> Column:
    """struct(key, value) of each line that states something; comments go."""
    strip = lambda x: F.regexp_replace(x, _TRIM, "")
    plain = F.transform(F.split(body, "\n"), lambda x: strip(F.regexp_replace(x, "#.*$", "")))
    return F.transform(
        F.filter(plain, lambda x: x.contains(":")),
        lambda x: F.struct(
            F.lower(strip(F.regexp_extract(x, "^([^:]*):", 1))).alias("key"),
            strip(F.regexp_extract(x, "(?s)^[^:]*:(.*)$", 1)).alias("value"),
        ),
    )


def groups(body: Column) -> Column:
    """array of GROUP, in their order: user-agent lines extend a group until it has a rule."""

    def step(acc: Column, line: Column) -> Column:
        key, value, n = line["key"], line["value"], F.size(acc)
        last = F.get(acc, n - 1)
        before = F.slice(acc, F.lit(1), F.greatest(n - 1, F.lit(0)))
        put = lambda agents, rules, delay: F.concat(
            before, F.array(F.struct(agents.alias("agents"), rules.alias("rules"), delay.alias("delay")))
        )
        fresh = F.array(
            F.struct(
                F.array(F.lower(value)).alias("agents"),
                F.expr("CAST(array() AS array<struct<pattern: string, allow: boolean>>)").alias("rules"),
                F.lit(None).cast("double").alias("delay"),
            )
        )
        seconds = F.when(value.rlike(r"^[0-9]*\.?[0-9]+$"), value.cast("double"))
        rule = F.struct(value.alias("pattern"), (key == "allow").alias("allow"))
        return (
            F.when((key == "user-agent") & (n > 0) & (F.size(last["rules"]) == 0), put(F.array_append(last["agents"], F.lower(value)), last["rules"], last["delay"]))
            .when(key == "user-agent", F.concat(acc, fresh))
            .when(key.isin("allow", "disallow") & (n > 0) & (value != ""), put(last["agents"], F.array_append(last["rules"], rule), last["delay"]))
            .when((key == "crawl-delay") & (n > 0) & (seconds > 0), put(last["agents"], last["rules"], seconds))
            .otherwise(acc)
        )

    return F.aggregate(_lines(body), F.expr(f"CAST(array() AS array<{GROUP}>)"), step)


def sitemaps(body: Column) -> Column:
    return F.transform(
        F.filter(_lines(body), lambda x: (x["key"] == "sitemap") & (x["value"] != "")), lambda x: x["value"]
    )


def chosen_group(found: Column, agent: str) -> Column:
    """The group with the longest name that starts the agent's, the first of equals; * counts as one letter. Null: none."""
    name = agent.lower()

    def length(group: Column) -> Column:
        fits = F.transform(
            group["agents"],
            lambda a: F.when(a == "*", F.lit(1)).when((a != "") & F.lit(name).startswith(a), F.length(a)).otherwise(F.lit(0)),
        )
        return F.array_max(fits)

    best = F.array_max(F.transform(found, length))
    return F.when(best > 0, F.get(F.filter(found, lambda g: length(g) == best), F.lit(0)))


def matches(path: Column, pattern: Column) -> Column:
    """Prefix, or segments between * in turn, each at its first place; $ at the end asks for the path's end.

    It doesn't backtrack: /*.php$ doesn't match /a.php.php.
    """
    anchored = pattern.endswith("$")
    parts = F.split(F.regexp_replace(pattern, r"\$$", ""), r"\*")
    end = F.aggregate(
        F.transform(parts, lambda p, i: F.struct(p.alias("p"), i.alias("i"))),
        F.lit(1),
        lambda at, s: F.when((at == 0) | (s["p"] == ""), at)
        .when(
            s["i"] == 0,
            F.when(path.startswith(s["p"]), F.length(s["p"]) + 1).otherwise(F.lit(0)),
        )
        .otherwise(
            F.when(
                F.position(s["p"], path, at) > 0,
                F.position(s["p"], path, at) + F.length(s["p"]),
            ).otherwise(F.lit(0))
        ),
    )
    return (end > 0) & (~anchored | (end == F.length(path) + 1))


def allowed(path: Column, rules: Column) -> Column:
    """The longest matching pattern decides, the first of equals; without one, or without rules, yes."""
    fits = F.filter(rules, lambda r: matches(path, r["pattern"]))
    longest = F.array_max(F.transform(fits, lambda r: F.octet_length(r["pattern"])))
    return F.coalesce(F.get(F.filter(fits, lambda r: F.octet_length(r["pattern"]) == longest), F.lit(0))["allow"], F.lit(True))
