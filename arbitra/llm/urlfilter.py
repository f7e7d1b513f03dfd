"""URL filters by path-template trees, with DataFrame functions only.

Every host has a tree of path templates. Node by node, a path segment stays literal where enough of what reached its
node goes through it; the others share a wildcard. Sibling templates whose labelled share can't be told from their pooled
share are merged. A branch's share of blocked labels is smoothed towards that of its template over all hosts, and this towards the
share of all labels, so a host without labels is judged by what its templates mean elsewhere. Templates above the share of all labels are
rejected. Explicit rules come first, and label the urls that they fit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (verdict, host, path): fits the host and its subdomains where the path starts so; the longest wins.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: A segment stays literal with this many urls and this share of its node's.
SUPPORT, SHARE = 8, 0.05
#: Standard errors within which a branch counts as similar to its siblings.
SIMILAR = 2.0
#: Weight of the wider share that a narrower one is smoothed towards.
PRIOR = 4.0
WILD = "*"
#: Levels that the SQL form of the tree is written out for; the plan itself goes as deep as paths do.
SQL_LEVELS = 6


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The lower-cased host after the first ``://`` and the path after it; both empty without one."""
    rest = F.when(F.instr(url, "://") > 0, F.substr(url, F.instr(url, "://") + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]] = RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, or null. The list is a setting, compiled into the plan."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _shared(first: Column, last: Column) -> Column:
    """How many leading entries two arrays share."""
    same = F.zip_with(first, last, lambda a, b: a.eqNullSafe(b))
    differ = F.array_position(same, False)
    return F.when(differ > 0, differ - 1).otherwise(F.size(first)).cast("int")


def templates(paths: DataFrame) -> DataFrame:
    """host, path, parent, template of ``paths(host, path, n)``, which are distinct and stand for n urls each.

    Each step takes the paths that aren't through one node on. What all of a node's paths share is literal and taken at once, so steps
    follow branchings, not segments; below a node of fewer than SUPPORT urls nothing can be literal, so the rest is wild at once.
    A node has at most 1 / SHARE literal segments. Only paths that go on are written again.
    """
    left = paths.select("host", "path", "n", F.filter(F.split("path", "/"), lambda s: s != "").alias("rest"), F.lit("").alias("parent"), F.lit("").alias("template"))
    done = []
    while True:
        left = cut(left)
        done.append(left.where(F.size("rest") == 0).select("host", "path", "parent", "template"))
        left = left.where(F.size("rest") > 0)
        if left.isEmpty():
            break
        through = left.groupBy("host", "template", F.get("rest", F.lit(0)).alias("segment")).agg(F.sum("n").alias("n"), F.min("rest").alias("first"), F.max("rest").alias("last"))
        node = through.groupBy("host", "template").agg(F.sum("n").alias("all"), F.min("first").alias("first"), F.max("last").alias("last"))
        node = node.select("host", "template", "all", _shared(F.col("first"), F.col("last")).alias("shared"))
        often = through.where(F.col("n") >= SUPPORT).join(node, ["host", "template"]).where(F.col("n") >= SHARE * F.col("all"))
        # written first, so that a node of very many paths is split where it meets them
        node = cut(node.join(often.groupBy("host", "template").agg(F.collect_list("segment").alias("literal")), ["host", "template"], "left"))
        wild = F.transform("rest", lambda s: F.lit(WILD))
        own = F.when(F.array_contains("literal", F.get("rest", F.lit(0))), F.slice("rest", F.lit(1), F.greatest("shared", F.lit(1)))).otherwise(F.array(F.lit(WILD)))
        step = F.when(F.col("all") < SUPPORT, wild).otherwise(own)
        joined = left.join(node, ["host", "template"]).withColumn("step", step)
        under = lambda segments: F.concat("template", F.when(F.size(segments) > 0, F.concat(F.lit("/"), F.array_join(segments, "/"))).otherwise(""))
        left = joined.select("host", "path", "n", F.slice("rest", F.size("step") + 1, F.size("rest")).alias("rest"), under(F.slice("step", F.lit(1), F.size("step") - 1)).alias("parent"), under(F.col("step")).alias("template"))
    return reduce(DataFrame.unionByName, done)


def judge(labelled: DataFrame) -> DataFrame:
    """host, template, purity, blocked from ``labelled(host, parent, template, n, label)``; label 1 blocked, 0 allowed, else null."""
    seen = F.coalesce(F.sum(F.when(F.col("label").isNotNull(), F.col("n"))), F.lit(0)).alias("seen")
    bad = F.coalesce(F.sum(F.col("n") * F.col("label")), F.lit(0)).alias("bad")
    counted = cut(labelled.groupBy("host", "parent", "template").agg(seen, bad))
    seen, bad = counted.agg(F.coalesce(F.sum("seen"), F.lit(0)), F.coalesce(F.sum("bad"), F.lit(0))).first()
    prior = bad / seen if seen else 0.0
    anywhere = counted.groupBy("template").agg(((F.sum("bad") + PRIOR * prior) / (F.sum("seen") + PRIOR)).alias("_anywhere"))
    pooled = counted.groupBy("host", "parent").agg((F.sum("bad") / F.greatest(F.sum("seen"), F.lit(1))).alias("_pool"))
    own = F.col("bad") / F.greatest("seen", F.lit(1))
    error = F.sqrt(F.col("_pool") * (1 - F.col("_pool")) / F.greatest("seen", F.lit(1)))
    similar = (F.col("seen") > 0) & (F.abs(own - F.col("_pool")) <= SIMILAR * error + 1e-9)
    branches = counted.join(pooled, ["host", "parent"]).withColumn("branch", F.when(similar, F.lit("")).otherwise(F.col("template")))
    merged = branches.groupBy("host", "parent", "branch").agg(F.sum("seen").alias("_seen"), F.sum("bad").alias("_bad"))
    purity = (F.col("_bad") + PRIOR * F.col("_anywhere")) / (F.col("_seen") + PRIOR)
    return branches.join(merged, ["host", "parent", "branch"]).join(anywhere, "template").select("host", "parent", "template", purity.alias("purity"), (purity > prior).alias("blocked"))


def filter_urls(pages: DataFrame, rules: list[tuple[str, str, str]] = RULES, id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, purity: one row per row of ``pages``.

    Null urls and urls without ``://`` have an empty host and path, and a tree of their own. Repeated rows each count
    and each get a row; a null id stays null. Without labels, or with labels of one verdict only, nothing stands out and nothing is
    blocked but by rules. No rows: no rows. Other columns are ignored.
    """
    host, path = host_and_path(F.col(url_column).cast("string"))
    rows = pages.select(F.col(id_column).alias("page_id"), host.alias("host"), path.alias("path"))
    ruled = rule_of(F.col("host"), F.col("path"), rules)
    given = F.col("_rule.verdict")
    label = F.when(given == "block", 1).when(given == "allow", 0)
    paths = cut(rows.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("_rule", ruled).select("host", "path", "n", F.col("_rule.rule").alias("rule"), given.alias("given"), label.alias("label")))
    treed = cut(paths.join(templates(paths.select("host", "path", "n")), ["host", "path"]))
    found = F.when(F.col("blocked"), F.lit("block")).otherwise("allow")
    judged = treed.join(judge(treed), ["host", "parent", "template"]).select("host", "path", "rule", F.coalesce("given", found).alias("verdict"), "template", F.round("purity", 9).alias("purity"))
    return rows.join(judged, ["host", "path"]).select("page_id", "host", "path", "rule", "verdict", "template", "purity")


def _oracle() -> str:
    """The same in DuckDB SQL."""
    fits = sorted(RULES, key=lambda r: -len(r[1] + r[2]))

    def case(pick):
        return "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{pick(v, h, p)}'" for v, h, p in fits) + " END"

    levels = []
    for k in range(1, SQL_LEVELS + 1):
        levels.append(f"""
 s{k} AS (SELECT *, segs[{k}] AS seg FROM t{k - 1}),
 c{k} AS (SELECT host, template, seg, count(*) AS n FROM s{k} WHERE seg IS NOT NULL GROUP BY ALL),
 l{k} AS (SELECT host, template, seg FROM (SELECT *, sum(n) OVER (PARTITION BY host, template) AS total FROM c{k}) WHERE n >= {SUPPORT} AND n >= {SHARE!r}::DOUBLE * total),
 t{k} AS (SELECT s.page_id, s.host, s.path, s.rule, s.given, s.segs,
  CASE WHEN s.seg IS NULL THEN s.parent ELSE s.template END AS parent,
  CASE WHEN s.seg IS NULL THEN s.template ELSE s.template || '/' || CASE WHEN l.seg IS NULL THEN '{WILD}' ELSE s.seg END END AS template
  FROM s{k} s LEFT JOIN l{k} l ON s.host = l.host AND s.template = l.template AND s.seg = l.seg),""")
    return f"""
WITH u AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
 p AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
 t0 AS (SELECT page_id, host, path, {case(lambda v, h, p: h + p)} AS rule, {case(lambda v, h, p: v)} AS given,
  list_filter(string_split(path, '/'), lambda s: s <> '') AS segs, '' AS parent, '' AS template FROM p),{"".join(levels)}
 t AS (SELECT * FROM t{SQL_LEVELS}),
 k AS (SELECT host, parent, template, count(given) AS seen, count(*) FILTER (WHERE given = 'block') AS bad FROM t GROUP BY ALL),
 g AS (SELECT CASE WHEN sum(seen) > 0 THEN sum(bad)::DOUBLE / sum(seen) ELSE 0 END AS prior FROM k),
 a AS (SELECT template, (sum(bad) + {PRIOR} * (SELECT prior FROM g)) / (sum(seen) + {PRIOR}) AS anywhere FROM k GROUP BY template),
 b AS (SELECT *, sum(bad) OVER w::DOUBLE / greatest(sum(seen) OVER w, 1) AS pool FROM k WINDOW w AS (PARTITION BY host, parent)),
 m AS (SELECT *, CASE WHEN seen > 0 AND abs(bad::DOUBLE / greatest(seen, 1) - pool) <= {SIMILAR} * sqrt(pool * (1 - pool) / greatest(seen, 1)) + 1e-9 THEN '' ELSE template END AS branch FROM b),
 j AS (SELECT host, parent, m.template, (sum(bad) OVER v + {PRIOR} * anywhere) / (sum(seen) OVER v + {PRIOR}) AS purity FROM m JOIN a ON m.template = a.template WINDOW v AS (PARTITION BY host, parent, branch))
SELECT t.page_id, t.host, t.path, t.rule, coalesce(t.given, CASE WHEN j.purity > (SELECT prior FROM g) THEN 'block' ELSE 'allow' END) AS verdict, t.template, round(j.purity, 9) AS purity
FROM t JOIN j ON t.host = j.host AND t.parent = j.parent AND t.template = j.template"""


ORACLE = _oracle()
