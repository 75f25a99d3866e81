"""URL filter: a tree of path templates per host, judged by labelled purity.

Each host's paths form a tree of segments. Level by level, segments that vary (numbers and
identifiers) are generalised into a wildcard; sibling branches whose labels do not differ
significantly (two-proportion test) are merged into the wildcard branch too, and every branch
that differs stays, however many siblings it has. A template's purity is its share of good labelled urls,
smoothed towards its parent's, from the host's root down. A url gets the verdict of the
deepest template that matches it; templates below ``LEAST_PURITY`` are rejected.

Everything is grouping and joining: a level is one row per template, and the labelled urls
are the only rows that are counted. Explicit rules come first: the longest rule of a host
suffix and path prefix that fits decides.

Defined cases: null urls and urls without ``://`` have an empty host and path and are judged
by the overall purity; hosts without a labelled url get the overall purity as well; without
any label everything is allowed; repeated rows get equal answers; clashing columns of the
input are not used.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brinewave.llm.common import llm_query, materialise, table

#: pseudo-count of the parent's purity
SMOOTH = 8.0
LEAST_PURITY = 0.5
#: two-sided 95 % of the normal distribution
Z = 1.96

#: (verdict, host, path prefix)
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)


def host_of(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(found, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def segments(path: Column) -> Column:
    """Segments of a path, numbers and identifiers as ``*``."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    variable = r"^(?:[0-9]+|[0-9a-fA-F]{8,}(?:-[0-9a-fA-F]+)*|[^/]*[0-9]{4,}[^/]*|[0-9]+\.[A-Za-z0-9]+)$"
    return F.transform(parts, lambda s: F.when(s.rlike(variable), F.lit("*")).otherwise(s))


class Tree:
    """Templates ``(host, level, parent, segment, node, purity)`` as tables, one for each level.

    ``root``: ``(host, purity)``; ``levels[k]``: ``(node, segment, child, purity)`` where
    ``node`` is the template above and ``segment`` may be the wildcard.
    """

    def __init__(self, overall: float | None, root: DataFrame, levels: list[DataFrame]):
        self.overall, self.root, self.levels = overall, root, levels


def build(labelled: DataFrame) -> Tree:
    """A tree of ``labelled(host, path, good)``; ``good`` is 1 or 0, nulls are left out.

    It is as deep as the longest labelled path; a level costs a few jobs.
    """
    spark = labelled.sparkSession
    rows = labelled.where("good is not null").groupBy("host", segments(F.col("path")).alias("parts")).agg(F.sum("good").alias("g"), F.count("*").alias("n"))
    rows = materialise(rows, "labelled-paths")
    total = rows.agg(F.sum("g").alias("g"), F.sum("n").alias("n")).first()
    if not total.n:
        return Tree(None, spark.createDataFrame([], "host string, purity double"), [])
    overall = total.g / total.n
    smooth = lambda prior: (F.col("g") + SMOOTH * prior) / (F.col("n") + SMOOTH)
    root = rows.groupBy("host").agg(F.sum("g").alias("g"), F.sum("n").alias("n")).select("host", smooth(F.lit(overall)).alias("purity"))
    root = materialise(root, "template-0")
    at = rows.join(root, "host").select(F.concat("host", F.lit("/")).alias("node"), "parts", "g", "n", F.col("purity").alias("above"))
    levels = []
    while True:
        at = materialise(at.where(F.size("parts") > 0), "labelled-left")
        if at.isEmpty():
            return Tree(overall, root, levels)
        here = at.withColumn("segment", F.get("parts", 0))
        by = here.groupBy("node", "segment").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.max("above").alias("above"))
        siblings = by.where("segment <> '*'").groupBy("node").agg(F.count("*").alias("kinds"), F.sum("g").alias("ag"), F.sum("n").alias("an"))
        by = by.join(siblings, "node", "left")
        # the branch against all its literal siblings, by the pooled two-proportion test
        rest_n, rest_g = F.col("an") - F.col("n"), F.col("ag") - F.col("g")
        pooled = F.col("ag") / F.col("an")
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n") + 1 / F.nullif(rest_n, F.lit(0))))
        differs = F.abs(F.col("g") / F.col("n") - rest_g / F.nullif(rest_n, F.lit(0))) > Z * spread
        alone = F.col("kinds") == 1
        literal = (F.col("segment") != "*") & (alone | F.coalesce(differs, F.lit(False)))
        kept = materialise(by.withColumn("into", F.when(literal, F.col("segment")).otherwise("*")), "branches")
        merged = kept.groupBy("node", "into").agg(F.sum("g").alias("g"), F.sum("n").alias("n"), F.max("above").alias("above"))
        level = merged.select("node", F.col("into").alias("segment"), F.concat("node", "into", F.lit("/")).alias("child"), smooth(F.col("above")).alias("purity"))
        level = materialise(level, "template")
        levels.append(level)
        # a branch that was merged goes on below the wildcard
        step = kept.select("node", "segment", "into").join(level.withColumnRenamed("segment", "into"), ["node", "into"])
        at = here.drop("above").join(step.select("node", "segment", "child", "purity"), ["node", "segment"])
        at = at.select(F.col("child").alias("node"), F.slice("parts", F.lit(2), F.size("parts")).alias("parts"), "g", "n", F.col("purity").alias("above"))


def purity(urls: DataFrame, tree: Tree) -> DataFrame:
    """Distinct ``(host, path)`` of ``urls`` with the purity of the deepest template that matches."""
    if tree.overall is None:
        return urls.select("host", "path").distinct().withColumn("purity", F.lit(1.0)).withColumn("template", F.lit(None).cast("string"))
    parts = urls.select("host", segments(F.col("path")).alias("parts")).distinct()
    at = parts.join(tree.root, "host", "left").select(
        "host", "parts", F.concat("host", F.lit("/")).alias("node"), F.coalesce("purity", F.lit(tree.overall)).alias("purity"), F.col("purity").isNotNull().alias("on")
    )
    for k, level in enumerate(tree.levels):
        if k and k % 4 == 0:  # deep trees: the plan stays small
            at = materialise(at, "matched")
        exact = level.where("segment <> '*'").select("node", F.col("segment").alias("_s"), F.col("child").alias("_c"), F.col("purity").alias("_p"))
        wild = level.where("segment = '*'").select("node", F.col("child").alias("_wc"), F.col("purity").alias("_wp"))
        at = at.withColumn("_s", F.when(F.col("on"), F.get("parts", k)))
        at = at.join(exact, ["node", "_s"], "left").join(wild, "node", "left")
        child = F.when(F.col("_s").isNotNull(), F.coalesce("_c", "_wc"))
        better = F.when(F.col("_c").isNotNull(), F.col("_p")).otherwise(F.col("_wp"))
        at = at.select(
            "host", "parts", F.coalesce(child, "node").alias("node"), F.when(child.isNotNull(), better).otherwise(F.col("purity")).alias("purity"), child.isNotNull().alias("on")
        )
    found = at.select("host", "parts", "purity", F.col("node").alias("template"))
    return urls.select("host", "path", segments(F.col("path")).alias("parts")).distinct().join(found, ["host", "parts"]).drop("parts")


def matching_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name (``host/``...) and verdict of the longest rule that fits, else nulls."""
    fits = []
    for verdict, name, prefix in rules:
        ok = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        fits.append((len(name) + len(prefix), F.when(ok, F.lit(name + prefix)), F.when(ok, F.lit(verdict))))
    fits.sort(key=lambda f: -f[0])
    return F.coalesce(*(f[1] for f in fits)), F.coalesce(*(f[2] for f in fits))


def judge(pages: DataFrame, tree: Tree, rules=RULES, key: str = "page_id", url: str = "url", least: float = LEAST_PURITY) -> DataFrame:
    """``(page_id, host, path, rule, verdict, purity, template)`` of every row."""
    rows = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    scored = rows.join(purity(rows, tree), ["host", "path"], "left")
    rule, said = matching_rule(F.col("host"), F.col("path"), rules)
    method = F.when(F.coalesce("purity", F.lit(1.0)) >= least, "allow").otherwise("block")
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(said, method).alias("verdict"), "purity", "template")


@llm_query("op4_path_templates")
def op4(spark, sf_dir):
    """Every page's url judged by the rules, else by its template.

    A page is labelled by the document its path names, where that one has a label.
    """
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    marked = table(spark, sf_dir, "labels").groupBy(F.col("doc_id")).agg(F.max("quality").alias("good"))
    path = path_of(F.col("url"))
    named = pages.select(host_of(F.col("url")).alias("host"), path.alias("path"), F.expr("try_cast(nullif(regexp_extract(url, '/([0-9]{1,18})(?:[./?#]|$)', 1), '') as bigint)").alias("doc_id"))
    return judge(pages, build(named.join(marked, "doc_id").select("host", "path", "good")))
