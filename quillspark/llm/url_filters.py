"""URL filter: host/path rules, then a path-template tree per host judged by labelled purity.

DataFrame expressions only.  Levels of the tree are aggregated tables, so no host's URLs meet in
one task; rows of hot hosts, nodes and templates are dealt over many tasks where they are joined.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.relational import join_dealt

from .shared import stored

# Fixed values: (verdict, rule); a rule is a host, with all its subdomains, and a path prefix.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
# Chi-squared at one in a hundred for one and two degrees of freedom, and the divergence a
# count (in nats) under which branches are alike however many URLs they hold.
CHI_1, CHI_2, TRIFLE = 6.635, 9.21, 0.02
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def longest_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, slash, rule_path = text.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(slash + rule_path)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def split_path(path: Column) -> Column:
    """The segments of a path, those with a digit or over 24 characters as ``*``."""
    return F.transform(F.array_remove(F.split(path, "/"), ""), lambda x: F.when(x.rlike("[0-9]") | (F.length(x) > 24), "*").otherwise(x))


def segments(parts: Column, depth: int, longer: bool) -> list[Column]:
    """s1 to s<depth>, the first segments, empty where missing; and, if some path is ``longer``, all that
    follows them as one more."""
    first = [F.coalesce(F.get(parts, F.lit(k)), F.lit("")).alias(f"s{k + 1}") for k in range(depth)]
    rest = F.array_join(F.slice(parts, depth + 1, F.greatest(F.size(parts) - depth, F.lit(0))), "/").alias(f"s{depth + 1}")
    return [*first, rest] if longer else first


def purity(bad: Column, good: Column, smoothing: float) -> Column:
    return (bad + smoothing) / (bad + good + 2 * smoothing)


def divergence(counts: list[Column], pools: list[Column]) -> Column:
    """The G statistic of counts against the shares of a pool that contains them; 0 where there are none."""
    total, pool = reduce(add, counts), reduce(add, pools)
    terms = [F.when(c > 0, c * F.ln(c * pool / (p * total))).otherwise(0.0) for c, p in zip(counts, pools)]
    return F.round(2 * reduce(add, terms), 6)


def alike(counts: list[Column], pools: list[Column], limit: float) -> Column:
    return divergence(counts, pools) <= F.lit(limit) + reduce(add, counts) * (2 * TRIFLE)


def branch_labels(tree: DataFrame, key: str, below: str | None, min_share: float, pooled: bool = True) -> DataFrame:
    """host, template, ``key``, label and n (rows of tree) for each child of each node of a level.

    Children under ``min_share`` of their node are one branch, ``*``.  Branches are then
    compared with the pool of all of their node that have the same most frequent child: where neither
    the shares of children that end, vary or are named, nor those of bad and good labels, differ
    by more than chance (G-test) or a trifle, they are one branch, named after the least of them.  A branch without
    labels can so join a labelled one.  The branch of URLs that end at the node stays alone.
    """
    node, child = ["host", "template"], F.col(below) if below else F.lit("")
    counts = ["ends", "varies", "named", "bad", "good"]
    kinds = [F.when(child == "", F.col("n")), F.when(child == "*", F.col("n")), F.when(~child.isin("", "*"), F.col("n"))]
    fine = tree.groupBy(*node, key, child.alias("child")).agg(F.sum("n").alias("cn"), F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(k), F.lit(0)).alias(c) for k, c in zip(kinds, counts)], F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    children = stored(fine.groupBy(*node, key).agg(*[F.sum(c).alias(c) for c in ("cn", "rows", *counts)], F.max(F.struct("cn", "child")).alias("main")), "url-children")
    parents = children.groupBy(*node).agg(F.count(F.lit(1)).alias("n"), F.sum("cn").alias("pn"))
    rare = (F.col("cn") < F.col("pn") * F.lit(min_share)) & (F.col(key) != "") & F.lit(pooled)
    segs = join_dealt(children, parents, node).withColumn("seg", F.when(rare, "*").otherwise(F.col(key)))
    branches = segs.groupBy(*node, "seg").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in counts], F.max("main").alias("main"))
    branches = branches.withColumn("mark", F.when(F.col("seg") == "", F.lit(None).cast("string")).otherwise(F.col("main.child")))
    pools = branches.filter("mark IS NOT NULL").groupBy(*node, "mark").agg(*[F.sum(c).alias(f"all_{c}") for c in counts])
    mine, theirs = [F.col(c) for c in counts], [F.col(f"all_{c}") for c in counts]
    same = F.coalesce(alike(mine[:3], theirs[:3], CHI_2) & alike(mine[3:], theirs[3:], CHI_1), F.lit(False))
    judged = branches.join(pools, [*node, "mark"], "left").withColumn("same", same & F.lit(pooled))
    groups = judged.filter("same").groupBy(*node, "mark").agg(F.count(F.lit(1)).alias("width"), F.min("seg").alias("least"))
    label = F.when(F.col("same") & (F.col("width") > 1), F.concat(F.lit("{"), F.col("least"), F.lit("}"))).otherwise(F.col("seg"))
    labels = judged.join(groups, [*node, "mark"], "left").select(*node, "seg", "n", label.alias("label"))
    return join_dealt(segs.select(*node, key, "seg", "rows"), labels, [*node, "seg"]).select(*node, key, "label", F.col("rows").alias("n"))


def template_tree(urls: DataFrame, keys: list[str], depth: int, smoothing: float, min_share: float) -> DataFrame:
    """Each distinct (host, s1..) with its count n, its template and the template's smoothed purity.

    urls: host, the ``keys`` s1.., bad, good (0 or 1).  Branches are merged level by level below a host;
    what follows the first ``depth`` segments is told apart whole and not merged.
    """
    tree = urls.groupBy("host", *keys).agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("template", F.lit(""))
    for level, (key, below) in enumerate(zip(keys, [*keys[1:], None])):
        tree = stored(tree, "url-tree")
        labels = stored(branch_labels(tree, key, below, min_share, level < depth), "url-labels")
        named = join_dealt(tree, labels, ["host", "template", key])
        tree = named.withColumn("template", F.when(F.col(key) == "", F.col("template")).otherwise(F.concat_ws("/", "template", "label"))).drop("label")
    tree = stored(tree, "url-tree")
    totals = tree.groupBy("host", "template").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"), F.count(F.lit(1)).alias("n"))
    judged = totals.select("host", "template", "n", purity(F.col("b"), F.col("g"), smoothing).alias("purity"))
    return join_dealt(tree, judged, ["host", "template"]).select("host", *keys, "n", "template", "purity")


def url_filter(pages: DataFrame, rules=RULES, depth: int = 6, smoothing: float = 1.0, min_share: float = 0.01, reject_at: float = 0.8) -> DataFrame:
    """page_id, host, path, rule, verdict, template and purity of every page's url.

    URLs that a rule decides are the labelled ones (block is bad, allow is good).  The verdict is the
    longest fitting rule's; else block where the template's smoothed share of bad labels is at least
    ``reject_at``, else allow.  The tree is as deep as the longest path, ``depth`` levels at most; the
    rest of a longer path is one more segment, which only equal rests share.  Children under
    ``min_share`` of their node, however many it has, are its variable branch.  Null urls, or urls
    without ``://``, have an empty host and path and are allowed; repeated rows and null page_ids keep their row; an empty table gives none; other columns
    are ignored; a very long path costs its own length.
    """
    host, path = host_and_path(F.col("url"))
    found = pages.select("page_id", host.alias("host"), path.alias("path"))
    deepest = found.agg(F.max(F.size(split_path(F.col("path"))))).first()[0] or 0
    longer, depth = deepest > depth, max(1, min(depth, deepest))
    rule, said = longest_rule(F.col("host"), F.col("path"), rules)
    found = found.select("page_id", "host", "path", rule.alias("rule"), said.alias("said"), split_path(F.col("path")).alias("parts"))
    keys = [f"s{k}" for k in range(1, depth + 1 + longer)]
    found = found.select("page_id", "host", "path", "rule", "said", *segments(F.col("parts"), depth, longer))
    flag = lambda what: F.coalesce((F.col("said") == what).cast("long"), F.lit(0))
    labelled = found.withColumns({"bad": flag("block"), "good": flag("allow")})
    tree = template_tree(labelled, keys, depth, smoothing, min_share)
    method = F.when(F.col("purity") >= reject_at, "block").otherwise("allow")
    return join_dealt(found, stored(tree, "url-templates"), ["host", *keys]).select("page_id", "host", "path", "rule", F.coalesce("said", method).alias("verdict"), "template", F.round("purity", 6).alias("purity"))


def oracle_sql(rules=RULES, depth: int = 6, smoothing: float = 1.0, min_share: float = 0.01, reject_at: float = 0.8) -> str:
    """The same in DuckDB SQL over ``pages``."""
    ordered = sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    keys = [f"s{k}" for k in range(1, depth + 2)]

    def case(pick):
        arms = ""
        for said, text in ordered:
            host, slash, path = text.partition("/")
            arms += f" WHEN (host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{slash}{path}') THEN '{(said, text)[pick]}'"
        return f"CASE{arms} END"

    segs = ", ".join(f"coalesce(parts[{k}], '') AS s{k}" for k in range(1, depth + 1))
    pure = lambda b, g: f"(({b} + {smoothing}) / ({b} + {g} + {2 * smoothing}))"
    sql = f"""WITH u AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, {case(1)} AS rule, {case(0)} AS said, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') OR length(x) > 24 THEN '*' ELSE x END) AS parts FROM h),
f AS MATERIALIZED (SELECT page_id, host, path, rule, said, {segs}, CASE WHEN len(parts) > {depth} THEN array_to_string(parts[{depth + 1}:], '/') ELSE '' END AS s{depth + 1},
  CASE WHEN said = 'block' THEN 1 ELSE 0 END AS bad, CASE WHEN said = 'allow' THEN 1 ELSE 0 END AS good FROM r),
t0 AS MATERIALIZED (SELECT host, {', '.join(keys)}, count(*) AS n, sum(bad) AS bad, sum(good) AS good, '' AS template FROM f GROUP BY ALL)"""
    node = "host, template"

    def alike_sql(cols: list[str], limit: float) -> str:
        total, pool = " + ".join(cols), " + ".join(f"all_{c}" for c in cols)
        terms = " + ".join(f"CASE WHEN {c} > 0 THEN {c} * ln({c}::DOUBLE * ({pool}) / (all_{c} * ({total}))) ELSE 0.0 END" for c in cols)
        return f"round(2 * ({terms}), 6) <= {limit} + ({total}) * {2 * TRIFLE}"

    counts = ["ends", "varies", "named", "bad", "good"]
    sums = ", ".join(f"sum({c}) AS {c}" for c in counts)
    for i, key in enumerate(keys):
        pooled = "true" if i < depth else "false"
        child = keys[i + 1] if i + 1 < len(keys) else "''"
        sql += f""",
d{i} AS MATERIALIZED (SELECT {node}, {key}, {child} AS child, sum(n) AS cn, sum(CASE WHEN {child} = '' THEN n ELSE 0 END) AS ends, sum(CASE WHEN {child} = '*' THEN n ELSE 0 END) AS varies,
  sum(CASE WHEN {child} NOT IN ('', '*') THEN n ELSE 0 END) AS named, sum(bad) AS bad, sum(good) AS good FROM t{i} GROUP BY host, template, {key}, {child}),
c{i} AS MATERIALIZED (SELECT {node}, {key}, {sums}, max({{'n': cn, 'child': child}}) AS main, sum(cn) AS cn FROM d{i} GROUP BY {node}, {key}),
p{i} AS MATERIALIZED (SELECT {node}, sum(cn) AS pn FROM c{i} GROUP BY {node}),
n{i} AS MATERIALIZED (SELECT c{i}.*, CASE WHEN cn < pn * {min_share} AND {key} <> '' AND {pooled} THEN '*' ELSE {key} END AS seg FROM c{i} JOIN p{i} USING ({node})),
b{i} AS MATERIALIZED (SELECT {node}, seg, {sums}, CASE WHEN seg = '' THEN NULL ELSE max(main).child END AS mark FROM n{i} GROUP BY {node}, seg),
o{i} AS MATERIALIZED (SELECT {node}, mark, {', '.join(f'sum({c}) AS all_{c}' for c in counts)} FROM b{i} WHERE mark IS NOT NULL GROUP BY {node}, mark),
q{i} AS MATERIALIZED (SELECT b{i}.{node.replace(', ', f', b{i}.')}, seg, b{i}.mark, {pooled} AND coalesce({alike_sql(counts[:3], CHI_2)}, false) AND coalesce(CASE WHEN bad + good = 0 THEN true ELSE {alike_sql(counts[3:], CHI_1)} END, false) AS same
  FROM b{i} LEFT JOIN o{i} ON b{i}.host = o{i}.host AND b{i}.template = o{i}.template AND b{i}.mark = o{i}.mark),
m{i} AS MATERIALIZED (SELECT {node}, mark, count(*) AS width, min(seg) AS least_seg FROM q{i} WHERE same GROUP BY {node}, mark),
l{i} AS MATERIALIZED (SELECT q{i}.host, q{i}.template, seg, CASE WHEN same AND width > 1 THEN '{{' || least_seg || '}}' ELSE seg END AS label FROM q{i} LEFT JOIN m{i} ON q{i}.host = m{i}.host AND q{i}.template = m{i}.template AND q{i}.mark = m{i}.mark),
t{i + 1} AS MATERIALIZED (SELECT t{i}.host, {', '.join(f't{i}.{k}' for k in keys)}, t{i}.n, t{i}.bad, t{i}.good, CASE WHEN {key} = '' THEN t{i}.template ELSE t{i}.template || '/' || label END AS template
  FROM t{i} JOIN n{i} USING (host, template, {key}) JOIN l{i} USING (host, template, seg))"""
    last = f"t{len(keys)}"
    return sql + f""",
j AS (SELECT host, template, {pure('sum(bad)', 'sum(good)')} AS purity FROM {last} GROUP BY host, template),
k AS (SELECT host, {', '.join(keys)}, template, purity FROM {last} JOIN j USING (host, template))
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN purity >= {reject_at} THEN 'block' ELSE 'allow' END) AS verdict, template, round(purity, 6) AS purity
FROM f JOIN k USING (host, {', '.join(keys)})"""
