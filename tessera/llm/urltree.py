"""URL filters: host and path rules, then a path-template tree for each host.

Rules decide first: a rule fits its host and all subdomains if the path starts with the rule's, and the longest wins. Urls
that a rule decides are the labelled ones. For the rest, the segments of a path are shapes (runs of digits as <n>, long
hexadecimal names as <h>), and each host's shapes make a tree, which is generalised level by level: the children of a
node are those of all branches that became it. At every node

- variable segments become a wildcard: of more than `LITERALS` children, those with less than `SHARE` of the node's urls;
- statistically similar branches merge into the wildcard: two or more children, of `LEAST_URLS` urls each, whose urls go on
  like the node's. The shares of what comes next (the end, or the kind of the next segment, letters being one kind)
  may differ by `DISTANCE` in total variation and `Z` times half a standard error; and a labelled child's share
  of blocked urls must lie within `Z` standard errors of the node's. Children that never go on have nothing to be similar
  in but labels, and stay by themselves without.

A template is a path of such names; segments from the `LEVELS`-th on count as one. It is rejected if the share of blocked
ones among its labelled urls, smoothed by `ALPHA` urls of share `PRIOR` (the rule of succession), is `PURITY` or more; urls of other templates, and of those without
labels, are allowed.

All steps are DataFrame functions on the distinct (host, shapes) of the table, which are counted first; a host or template
with most of the urls is one row there. Children are joined to sums of their node, never gathered. Each level is written
to the shared folder.

Defined results: a null url, or one without ://, has an empty host and path and is allowed unless a rule fits it. Repeated
rows and null page_ids are kept. An empty table gives no rows. Columns besides page_id and url are not read, whatever
their names. A path's length is not limited; work is linear in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_path, materialize, work_path

#: (rule, verdict); a rule is a host and, from its first slash on, a path.
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
LITERALS, SHARE, LEVELS = 20, 0.05, 8
Z, LEAST_URLS, DISTANCE = 2.0, 8, 0.1
ALPHA, PRIOR, PURITY = 2.0, 0.5, 0.9
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HEX, _DIGITS, _LETTERS = "^[0-9a-f]{8,}$", "[0-9]+", "[A-Za-z]+"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), _UPPER, _LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def _split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def fitting_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = RULES) -> Column:
    """A struct of the rule and its verdict, or null. rules are a parameter, and so bounded."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        h, p = _split_rule(rule)
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def shapes_of(path: Column) -> Column:
    """The shapes of a path's segments, those from the `LEVELS`-th on in one."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shapes = F.transform(segments, lambda s: F.regexp_replace(F.regexp_replace(s, _HEX, "<h>"), _DIGITS, "<n>"))
    rest = F.array(F.concat_ws("/", F.slice(shapes, LEVELS, F.greatest(F.size(shapes), F.lit(1)))))
    return F.when(F.size(shapes) > LEVELS, F.concat(F.slice(shapes, 1, LEVELS - 1), rest)).otherwise(shapes)


def _sums(grouped) -> DataFrame:
    return grouped.agg(*(F.sum(c).alias(c) for c in ("n", "n_labelled", "n_blocked")))


def _level(shapes: DataFrame, depth: int) -> DataFrame:
    """shapes: (host, lexical, shapes, n, n_labelled, n_blocked, template), the template of the segments before `depth`.
    The same with the segment at `depth` generalised and added."""
    node = ["host", "template"]
    deep = shapes.filter(F.size("shapes") > depth).withColumn("name", F.col("shapes")[depth])
    kind = F.when(F.size("shapes") > depth + 1, F.regexp_replace(F.get("shapes", F.lit(depth + 1)), _LETTERS, "a")).otherwise("")
    nexts = _sums(deep.withColumn("next", kind).groupBy(*node, "name", "next"))
    children = _sums(nexts.groupBy(*node, "name"))
    nodes = children.groupBy(*node).agg(F.count("*").alias("children"), *(F.sum(c).alias(f"node_{c}") for c in ("n", "n_labelled", "n_blocked")))
    pooled = nexts.groupBy(*node, "next").agg(F.sum("n").alias("pooled_n"))
    # the shares that a child and its node have in common, in whole numbers: 1 less the distance, times n and node_n
    alike = nexts.join(pooled, [*node, "next"]).join(children.select(*node, "name", F.col("n").alias("child_n")), [*node, "name"]).join(nodes.select(*node, "node_n"), node)
    alike = alike.groupBy(*node, "name").agg(F.sum(F.least(F.col("n") * F.col("node_n"), F.col("pooled_n") * F.col("child_n"))).alias("common"), F.bool_or(F.col("next") != "").alias("goes_on"))
    named = children.join(nodes, node).join(alike, [*node, "name"])
    variable = (F.col("children") > LITERALS) & (F.col("n") < SHARE * F.col("node_n"))
    distance = 1.0 - F.col("common").cast("double") / (F.col("n") * F.col("node_n")).cast("double")
    # |b/l - B/L| <= Z * sqrt(B/L * (1 - B/L) / l) without a quotient that may be 0/0
    gap = (F.col("n_blocked") * F.col("node_n_labelled") - F.col("node_n_blocked") * F.col("n_labelled")).cast("double")
    spread = (F.col("node_n_blocked") * (F.col("node_n_labelled") - F.col("node_n_blocked"))).cast("double") * F.col("n_labelled")
    similar = (F.col("children") > 1) & (F.col("n") >= LEAST_URLS) & (F.col("goes_on") | (F.col("n_labelled") > 0)) & (distance <= DISTANCE + 0.5 * Z / F.sqrt(F.col("n").cast("double"))) & (gap * gap <= Z * Z * spread)
    named = named.select(*node, "name", variable.alias("variable"), similar.alias("similar"))
    merged = named.groupBy(*node).agg(F.count_if("similar").alias("n_similar"))
    general = F.when(F.col("variable") | (F.col("similar") & (F.col("n_similar") > 1)), "*").otherwise(F.col("name"))
    named = named.join(merged, node).select(*node, "name", F.concat("template", F.lit("/"), general).alias("longer"))
    found = shapes.withColumn("name", F.get("shapes", F.lit(depth))).join(named, [*node, "name"], "left")
    return found.withColumn("template", F.coalesce("longer", "template")).drop("name", "longer")


def templates(shapes: DataFrame) -> DataFrame:
    """shapes: (host, lexical, shapes, n, n_labelled, n_blocked), a row for each host and path of shapes. Gives (host,
    lexical, template, purity)."""
    spark = shapes.sparkSession
    paths = [work_path(spark, "tree")]
    at = materialize(shapes.withColumn("template", F.lit("")), "", paths[0])
    for depth in range(at.agg(F.max(F.size("shapes"))).first()[0] or 0):
        paths.append(work_path(spark, "tree"))
        at = materialize(_level(at, depth), "", paths[-1])
        drop_path(spark, paths[-2])
    found = at.select("host", "lexical", "n", "n_labelled", "n_blocked", F.when(F.col("template") == "", "/").otherwise(F.col("template")).alias("template"))
    pure = _sums(found.groupBy("host", "template")).select("host", "template", ((F.col("n_blocked") + ALPHA * PRIOR) / (F.col("n_labelled") + ALPHA)).alias("purity"))
    return found.select("host", "lexical", "template").join(pure, ["host", "template"])


def judge(pages: DataFrame, rules: tuple[tuple[str, str], ...] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity) of each row."""
    host, path = host_and_path(F.col("url"))
    parsed = pages.select("page_id", host.alias("host"), path.alias("path"))
    parsed = parsed.withColumn("found", fitting_rule(F.col("host"), F.col("path"), rules)).withColumn("shapes", shapes_of(F.col("path")))
    parsed = parsed.withColumn("lexical", F.concat_ws("/", "shapes"))
    labelled, blocked = F.col("found.verdict").isNotNull(), F.col("found.verdict") == "block"
    shapes = parsed.groupBy("host", "lexical").agg(F.first("shapes").alias("shapes"), F.count("*").alias("n"), F.count_if(labelled).alias("n_labelled"), F.count_if(blocked).alias("n_blocked"))
    judged = parsed.join(templates(shapes), ["host", "lexical"])
    verdict = F.coalesce("found.verdict", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "template", "purity")


def op10_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "host", "path", "rule", "verdict", "template")


def _rule_cases(column: int) -> str:
    cases = []
    for r in sorted(RULES, key=lambda r: (-len(r[0]), r[0])):
        host, path = _split_rule(r[0])
        cases.append(f"WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}') THEN '{r[column]}'")
    return f"CASE {' '.join(cases)} END"


def _level_sql(d: int) -> str:
    """The CTEs of one level: from t{d} to t{d + 1}."""
    return f"""
e{d} AS MATERIALIZED (
  SELECT host, template, shapes[{d + 1}] AS name, CASE WHEN len(shapes) > {d + 1} THEN regexp_replace(shapes[{d + 2}], '{_LETTERS}', 'a', 'g') ELSE '' END AS nx, sum(n) AS n, sum(l) AS l, sum(b) AS b
  FROM t{d} WHERE len(shapes) > {d} GROUP BY ALL),
c{d} AS (
  SELECT e.*, sum(n) OVER child AS cn, sum(l) OVER child AS cl, sum(b) OVER child AS cb, sum(n) OVER (PARTITION BY host, template) AS nn, sum(l) OVER (PARTITION BY host, template) AS nl,
         sum(b) OVER (PARTITION BY host, template) AS nb, sum(n) OVER (PARTITION BY host, template, nx) AS pn
  FROM e{d} e WINDOW child AS (PARTITION BY host, template, name)),
k{d} AS (
  SELECT host, template, name, any_value(cn) AS cn, any_value(cl) AS cl, any_value(cb) AS cb, any_value(nn) AS nn, any_value(nl) AS nl, any_value(nb) AS nb,
         1.0::DOUBLE - CAST(sum(least(n * nn, pn * cn)) AS DOUBLE) / CAST(any_value(cn) * any_value(nn) AS DOUBLE) AS distance, bool_or(nx <> '') AS goes_on, count(*) OVER (PARTITION BY host, template) AS kids
  FROM c{d} GROUP BY host, template, name),
s{d} AS (
  SELECT *, kids > {LITERALS} AND cn < {SHARE}::DOUBLE * nn AS variable,
         kids > 1 AND cn >= {LEAST_URLS} AND (goes_on OR cl > 0) AND distance <= {DISTANCE}::DOUBLE + {0.5 * Z}::DOUBLE / sqrt(CAST(cn AS DOUBLE))
         AND CAST(cb * nl - nb * cl AS DOUBLE) * CAST(cb * nl - nb * cl AS DOUBLE) <= {Z * Z}::DOUBLE * (CAST(nb * (nl - nb) AS DOUBLE) * cl) AS alike
  FROM k{d}),
g{d} AS (SELECT host, template, name, CASE WHEN variable OR (alike AND count(*) FILTER (WHERE alike) OVER (PARTITION BY host, template) > 1) THEN '*' ELSE name END AS general FROM s{d}),
t{d + 1} AS MATERIALIZED (
  SELECT t.* REPLACE (CASE WHEN g.general IS NULL THEN t.template ELSE t.template || '/' || g.general END AS template)
  FROM t{d} t LEFT JOIN g{d} g ON g.host = t.host AND g.template = t.template AND g.name = t.shapes[{d + 1}]),"""


ORACLE_SQL = f"""
WITH cut AS (SELECT page_id, CASE WHEN strpos(coalesce(url, ''), '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
parsed AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
ruled AS (
  SELECT page_id, host, path, {_rule_cases(0)} AS rule, {_rule_cases(1)} AS by_rule,
         list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: regexp_replace(regexp_replace(s, '{_HEX}', '<h>'), '{_DIGITS}', '<n>', 'g')) AS parts
  FROM parsed),
keyed AS (
  SELECT *, coalesce(array_to_string(parts, '/'), '') AS lexical,
         CASE WHEN len(parts) > {LEVELS} THEN list_append(parts[1:{LEVELS - 1}], array_to_string(parts[{LEVELS}:], '/')) ELSE parts END AS shapes
  FROM ruled),
t0 AS MATERIALIZED (
  SELECT host, lexical, any_value(shapes) AS shapes, count(*) AS n, count(by_rule) AS l, count(*) FILTER (WHERE by_rule = 'block') AS b, '' AS template
  FROM keyed GROUP BY host, lexical),{"".join(_level_sql(d) for d in range(LEVELS))}
found AS (SELECT host, lexical, n, l, b, CASE WHEN template = '' THEN '/' ELSE template END AS template FROM t{LEVELS}),
pure AS (SELECT host, template, (sum(b) + {ALPHA * PRIOR}) / (sum(l) + {ALPHA}) AS purity FROM found GROUP BY ALL)
SELECT k.page_id, k.host, k.path, k.rule, coalesce(k.by_rule, CASE WHEN p.purity >= {PURITY} THEN 'block' ELSE 'allow' END) AS verdict, f.template
FROM keyed k JOIN found f USING (host, lexical) JOIN pure p ON p.host = f.host AND p.template = f.template
"""
