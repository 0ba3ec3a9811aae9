"""URL filtering with explicit rules and a learned tree of path templates.

Per host, path segments that vary freely (numbers, hex ids, mixed tokens) become wildcards, so
that paths share templates. The templates of a host form a tree. A branch is merged with its
siblings, which pools their labels, if neither its labelled rate nor that of any branch below it
can be told from that of the siblings there. A merged template is rejected where the smoothed share
of bad labels reaches the threshold.
Explicit rules go first. All of it is DataFrame expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from axiomata.llm.tables import table

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A segment that names one page: only digits or hex digits and dashes with a digit among them, with any file ending.
VARIABLE = r"^(?=[^.]*[0-9])[0-9a-fA-F_-]+(\.[A-Za-z0-9]+)?$"
#: A branch differs from its siblings beyond so many standard errors of its labelled rate.
Z = 2.58
#: Weight of the overall rate in a template's smoothed rate, in labels, and the rate that rejects.
PRIOR_WEIGHT, REJECT = 10.0, 0.5
#: A template with more than one of so many pages is hot; there are fewer such templates than that, so their list is broadcast. Pages of a hot one are spread over so many join keys.
HOT, SALT = 1000, 64


def with_host_and_path(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds ``host`` and ``path``; both are empty for a null url or one without ``://``."""
    u = F.coalesce(F.col(url), F.lit(""))
    rest = F.when(F.instr(u, "://") > 0, F.expr(f"substring(coalesce(`{url}`, ''), instr(coalesce(`{url}`, ''), '://') + 3)")).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return pages.withColumns({"host": F.translate(raw, UPPER, LOWER), "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)})


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits host and path; nulls where none does."""
    host, path = F.col("host"), F.col("path")
    fits = lambda h, p: ((host == h) | host.endswith("." + h)) & path.startswith(p)
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    name = F.coalesce(*[F.when(fits(h, p), F.lit(h + p)) for _, h, p in ordered])
    verdict = F.coalesce(*[F.when(fits(h, p), F.lit(v)) for v, h, p in ordered])
    return name, verdict


def segments() -> Column:
    """The generalised segments of ``path``: variable ones become ``*``."""
    some = F.filter(F.split(F.col("path"), "/", -1), lambda s: s != "")
    return F.transform(some, lambda s: F.when(s.rlike(VARIABLE), F.lit("*")).otherwise(s))


def template_rates(paths: DataFrame) -> DataFrame:
    """Merged template and smoothed bad rate of every (host, template).

    ``paths`` has host, template (array), n_labels and n_bad. Nodes of the tree are the prefixes
    of templates; a node's labels are those of all templates below. A node merges with its
    siblings if its rate, and that of every node below it, lies within Z standard errors of the rate
    of all nodes under the same parent.
    """
    leaves = paths.groupBy("host", "template").agg(F.sum("n_labels").alias("n_labels"), F.sum("n_bad").alias("n_bad"))
    depth = F.posexplode(F.transform(F.col("template"), lambda _, i: F.slice(F.col("template"), 1, i + 1)))
    steps = leaves.select("host", "template", "n_labels", "n_bad", depth.alias("at", "node"))
    nodes = steps.groupBy("host", "node").agg(F.sum("n_labels").alias("n"), F.sum("n_bad").alias("bad"))
    nodes = nodes.withColumn("parent", F.slice("node", 1, F.size("node") - 1))
    above = nodes.groupBy("host", "parent").agg(F.sum("n").alias("all_n"), F.sum("bad").alias("all_bad"))
    judged = nodes.join(above, ["host", "parent"])
    rate = (F.col("all_bad") + 1) / (F.col("all_n") + 2)
    error = F.sqrt(rate * (1 - rate) / F.greatest(F.col("n"), F.lit(1)))
    apart = (F.col("n") > 0) & (F.abs(F.col("bad") / F.greatest(F.col("n"), F.lit(1)) - rate) > Z * error)
    # a node keeps its name if it, or any node below it, stands apart
    above_apart = F.explode(F.transform(F.col("node"), lambda _, i: F.slice(F.col("node"), 1, i + 1)))
    kept = judged.where(apart).select("host", above_apart.alias("node")).distinct().withColumn("own", F.lit(True))
    named = steps.join(kept, ["host", "node"], "left").withColumn("step", F.struct("at", F.when(F.col("own"), F.element_at("node", -1)).otherwise(F.lit("*")).alias("name")))
    merged = named.groupBy("host", "template").agg(F.sort_array(F.collect_list("step")).alias("steps"), F.first("n_labels").alias("n_labels"), F.first("n_bad").alias("n_bad"))
    merged = merged.select("host", "template", "n_labels", "n_bad", F.concat(F.lit("/"), F.array_join("steps.name", "/")).alias("merged"))
    merged = merged.unionByName(leaves.where(F.size("template") == 0).withColumn("merged", F.lit("/")))
    pooled = merged.groupBy("host", "merged").agg(F.sum("n_labels").alias("n"), F.sum("n_bad").alias("bad"))
    overall = leaves.agg((F.sum("n_bad") + 1) / (F.sum("n_labels") + 2))
    rates = pooled.withColumn("rate", (F.col("bad") + PRIOR_WEIGHT * overall.scalar()) / (F.col("n") + PRIOR_WEIGHT))
    return merged.select("host", "template", "merged").join(rates.select("host", "merged", "rate"), ["host", "merged"])


def filtered(pages: DataFrame, labels: DataFrame, rules=RULES, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: host, path, rule, verdict, and the merged template with its rate.

    ``labels`` has doc_id, quality and toxic; a page is bad if any label of its id says quality 0
    or toxic 1. Only the named columns of ``pages`` are read. Repeated pages give repeated rows;
    a null url has an empty host and path and is allowed, as is a page whose template has no
    labels enough to lift the smoothed rate. Empty tables give empty results.
    """
    book = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("page_id")).agg(
        F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), F.lit(1)).otherwise(F.lit(0))).alias("is_bad")
    )
    found = with_host_and_path(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))).select("page_id", "host", "path", segments().alias("template"))
    marked = found.join(book, "page_id", "left")
    counts = marked.groupBy("host", "template").agg(F.count("*").alias("n_pages"), F.count("is_bad").alias("n_labels"), F.coalesce(F.sum("is_bad"), F.lit(0)).alias("n_bad"))
    rates = template_rates(counts)
    pages_total = counts.agg(F.sum("n_pages")).scalar()
    hot = counts.where(F.col("n_pages") * HOT > pages_total).select("host", "template", F.lit(SALT).alias("salts"))
    salts = F.coalesce("salts", F.lit(1))
    spread = F.pmod(F.coalesce(F.xxhash64("page_id", "path"), F.lit(0)), salts).cast("int")
    salted = rates.join(F.broadcast(hot), ["host", "template"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    rule, verdict = rule_of(rules)
    judged = found.join(F.broadcast(hot), ["host", "template"], "left").withColumn("salt", spread).join(salted, ["host", "template", "salt"], "left")
    method = F.when((F.col("host") != "") & (F.col("rate") >= REJECT), F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), F.col("merged").alias("template"), F.round("rate", 6).alias("bad_rate"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels", "doc_id", "quality", "toxic"))


#: The same in DuckDB. Templates are kept as strings there.
ORACLE = r"""
WITH p0 AS (
  SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p0
), f AS (
  SELECT *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s:
    CASE WHEN regexp_matches(s, '^[0-9a-fA-F_-]+(\.[A-Za-z0-9]+)?$') AND regexp_matches(s, '^[^.]*[0-9]') THEN '*' ELSE s END) AS tpl FROM p
), lab AS (
  SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS is_bad FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), leaves AS (
  SELECT host, tpl, count(is_bad) AS n_labels, coalesce(sum(is_bad), 0) AS n_bad FROM f LEFT JOIN lab ON f.page_id = lab.doc_id GROUP BY host, tpl
), steps AS (
  SELECT host, tpl, n_labels, n_bad, i, list_slice(tpl, 1, i) AS node, list_slice(tpl, 1, i - 1) AS parent
  FROM (SELECT *, unnest(range(1, len(tpl) + 1)) AS i FROM leaves)
), nodes AS (SELECT host, node, parent, sum(n_labels) AS n, sum(n_bad) AS bad FROM steps GROUP BY ALL),
above AS (SELECT host, parent, (sum(bad) + 1) / (sum(n) + 2) AS rate FROM nodes GROUP BY ALL),
judged AS (
  SELECT host, node, n > 0 AND abs(bad / greatest(n, 1) - rate) > 2.58 * sqrt(rate * (1 - rate) / greatest(n, 1)) AS apart
  FROM nodes JOIN above USING (host, parent)
), kept AS (SELECT DISTINCT host, list_slice(node, 1, i) AS node, true AS own FROM (SELECT host, node, unnest(range(1, len(node) + 1)) AS i FROM judged WHERE apart)
), merged AS (
  SELECT host, tpl, '/' || string_agg(CASE WHEN own THEN node[i] ELSE '*' END, '/' ORDER BY i) AS merged, any_value(n_labels) AS n_labels, any_value(n_bad) AS n_bad
  FROM steps LEFT JOIN kept USING (host, node) GROUP BY host, tpl
  UNION ALL SELECT host, tpl, '/', n_labels, n_bad FROM leaves WHERE len(tpl) = 0
), overall AS (SELECT (sum(n_bad) + 1) / (sum(n_labels) + 2) AS r FROM leaves),
rates AS (SELECT host, merged, (sum(n_bad) + 10 * any_value(r)) / (sum(n_labels) + 10) AS rate FROM merged, overall GROUP BY host, merged),
j AS (
  SELECT f.page_id, f.host, f.path, merged, rate,
    CASE WHEN (f.host = 'www.example.com' OR suffix(f.host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
         WHEN (f.host = 'example.com' OR suffix(f.host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
         WHEN (f.host = 'net' OR suffix(f.host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
         WHEN (f.host = 'net' OR suffix(f.host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
         WHEN (f.host = 'com' OR suffix(f.host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule
  FROM f LEFT JOIN merged USING (host, tpl) LEFT JOIN rates USING (host, merged)
)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN host <> '' AND rate >= 0.5 THEN 'block' ELSE 'allow' END AS verdict,
  merged AS template, round(rate, 6) AS bad_rate FROM j
"""
