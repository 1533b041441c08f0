"""URL verdicts by rules and by a path-template tree per host, with DataFrame operations only.

The tree is grown of the distinct paths, level by level, at most ``depth`` levels (what lies deeper is one last segment, "**") or, if it is None, all.
At each node of a host's tree the digits of a segment become "*". If the node has over ``CHILDREN`` different segments after that,
those without any label become "*" as a whole; the test below would merge them anyway. Every segment with labels keeps its name, at any
number of siblings. So below a node of ``CHILDREN`` paths or fewer all is known at once, and there are as many passes as levels at which more
paths share a node. Then, from the deepest level up, at each level at which paths of one host and length differ, a branch whose share
of good labels doesn't differ from that of its siblings together, by a z-test of a proportion, is merged with them into "*".
Each template that is left has the smoothed purity (good + PRIOR * g) / (labelled + PRIOR), g being the share of good among all
labels; a template of a purity under ``PURITY`` is rejected and its urls get the verdict block.

Rules come first: a rule (host, path) fits the host and its subdomains where the url's path starts with the rule's path; of
the rules that fit, the longest wins. Rules are a short list of the caller's.

Defined cases: the host and path of a null url or one without "://" are empty, and such urls form the tree of the empty host;
null labels and labels of unknown ids count for nothing; of several labels of one id each counts; null ids have no label; repeated
rows are judged alike; without any labels the prior is 1 and nothing is rejected; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mediafold.llm._common import drop_table, join_groups, materialise, table

DEPTH = 8
CHILDREN = 16
Z = 1.96
PRIOR = 10.0
PURITY = 0.5
#: verdict, host, path
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _URL, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def longest_rule(rules: Sequence[tuple[str, str, str]], host: Column, path: Column) -> tuple[Column, Column]:
    """The text and the verdict of the longest rule that fits, or nulls."""
    text = verdict = F.lit(None).cast("string")
    for kind, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = F.when(fits, F.lit(rule_host + rule_path)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def _generalised(paths: DataFrame, depth: int | None, children: int) -> DataFrame:
    """paths (host, segments, n, good, bad; each once) with template, an array as long as segments."""
    first = materialise(paths.withColumn("template", F.array().cast("array<string>")), "tree-0")
    total = first.count()
    rows, done, tables, d = first, [], [first], 0

    def plain(segment: Column, at: Column) -> Column:
        last = F.lit(False) if depth is None else at == depth
        return F.when(last | (at == 0), segment).otherwise(F.regexp_replace(segment, "[0-9]+", "*"))

    while total and not rows.isEmpty():
        node = rows.withColumns({"node": F.array_join("template", "/"), "plain": plain(F.get("segments", F.lit(d)), F.lit(d))})
        counts = node.groupBy("host", "node", "plain").agg(F.count(F.lit(1)).alias("k"), F.sum(F.col("good") + F.col("bad")).alias("labelled"))
        counts = materialise(counts, f"segments-{d}")
        nodes = counts.groupBy("host", "node").agg(F.count(F.lit(1)).alias("branches"), F.sum("k").alias("paths"))
        named = counts.join(nodes, ["host", "node"])
        rare = (F.col("branches") > children) & (F.col("labelled") == 0) & F.lit(d > 0 and d != depth)
        named = named.withColumn("named", F.when(rare, F.regexp_replace("plain", r"^[^.]+", "*")).otherwise(F.col("plain"))).drop("branches", "labelled")
        grown = join_groups(node, named, ["host", "node", "plain"], "k", total).withColumn("template", F.concat("template", F.array("named")))
        rest = F.transform(F.slice("segments", d + 2, 1 << 30), lambda s, i: plain(s, i + d + 1))
        over = (F.col("paths") <= children) | (F.size("segments") <= d + 1)
        grown = grown.withColumns({"over": over, "template": F.when(over, F.concat("template", rest)).otherwise(F.col("template"))})
        rows = materialise(grown.select(*first.columns, "over"), f"tree-{d + 1}")
        tables += [counts, rows]
        done.append(rows.filter("over").drop("over"))
        rows, d = rows.filter("NOT over").drop("over"), d + 1
    out = first.filter("false")
    for part in done:
        out = out.unionByName(part)
    out = materialise(out, "tree")
    for old in tables:
        drop_table(old)
    return out


def _merged(templates: DataFrame, depth: int | None, z: float) -> DataFrame:
    """templates (host, template, n, good, bad) with ``branch``, the template after merging."""
    templates = materialise(templates.withColumn("branch", F.col("template")), "branches")
    # siblings are of one length and differ at one level; merging only makes templates more alike
    places = templates.select("host", F.size("template").alias("size"), F.posexplode("template").alias("d", "segment"))
    apart = places.groupBy("host", "size", "d").agg((F.min("segment") != F.max("segment")).alias("differ")).filter("differ AND d > 0")
    apart = apart if depth is None else apart.filter(F.col("d") <= depth)
    for d in sorted((r["d"] for r in apart.select("d").distinct().collect()), reverse=True):  # as many as the deepest path has levels at most
        before = templates
        templates = templates.withColumn("parent", F.transform("branch", lambda s, i: F.when(i == d, F.lit("*")).otherwise(s)))
        own, all_ = Window.partitionBy("host", "branch"), Window.partitionBy("host", "parent")
        templates = templates.select(
            "*", F.sum("good").over(own).alias("g"), F.sum(F.col("good") + F.col("bad")).over(own).alias("k"),
            F.sum("good").over(all_).alias("pg"), F.sum(F.col("good") + F.col("bad")).over(all_).alias("pk"),
            (F.min("branch").over(all_) != F.max("branch").over(all_)).alias("siblings"),
        )
        share = (F.col("pg") + 1) / (F.col("pk") + 2)
        far = F.abs(F.col("g") - F.col("k") * share) > z * F.sqrt(F.col("k") * share * (1 - share))
        templates = templates.withColumn("branch", F.when((F.size("branch") > d) & F.col("siblings") & ~far, F.col("parent")).otherwise(F.col("branch"))).drop("parent", "g", "k", "pg", "pk", "siblings")
        templates = materialise(templates, f"branches-{d}")
        drop_table(before)
    return templates


def judge_urls(
    pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str, str]] = (), id_col: str = "page_id", url_col: str = "url",
    label_id_col: str = "doc_id", good_col: str = "quality", depth: int | None = DEPTH, children: int = CHILDREN, purity: float = PURITY,
) -> DataFrame:
    """One row per url: ``id_col``, host, path, rule, verdict, template and purity. ``good_col`` is 1 for good, 0 for bad."""
    urls = pages.select(pages[id_col].alias("id"), host_of(pages[url_col]).alias("host"), path_of(pages[url_col]).alias("path"))
    cut = F.split("path", "/")
    tail = cut if depth is None else F.when(F.size(cut) > depth, F.concat(F.slice(cut, 1, depth), F.array(F.lit("**")))).otherwise(cut)
    known = labels.filter(labels[label_id_col].isNotNull()).groupBy(labels[label_id_col].alias("id")).agg(F.count_if(labels[good_col] == 1).alias("good"), F.count_if(labels[good_col] == 0).alias("bad"))
    urls = materialise(urls.join(known, "id", "left").fillna(0, ["good", "bad"]), "urls")
    total, good, bad = urls.agg(F.count(F.lit(1)), F.sum("good"), F.sum("bad")).first()
    prior = (good or 0) / ((good or 0) + (bad or 0) or 1) if (good or 0) + (bad or 0) else 1.0
    counts = (F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("bad").alias("bad"))
    paths = urls.withColumn("n", F.lit(1).cast("long")).groupBy("host", "path").agg(*counts)
    paths = _generalised(paths.select("host", "path", tail.alias("segments"), "n", "good", "bad"), depth, children)
    branches = _merged(paths.groupBy("host", "template").agg(*counts), depth, Z)
    own = Window.partitionBy("host", "branch")
    pure = (F.sum("good").over(own) + PRIOR * prior) / (F.sum(F.col("good") + F.col("bad")).over(own) + PRIOR)
    verdicts = materialise(branches.select("host", "template", "n", F.array_join("branch", "/").alias("branch"), pure.alias("purity")), "templates")
    of_path = join_groups(paths.select("host", "path", F.col("n").alias("copies"), "template"), verdicts, ["host", "template"], "n", total).select("host", "path", "copies", "branch", "purity")
    of_path = materialise(of_path, "verdicts")
    rows = join_groups(urls.select("id", "host", "path"), of_path, ["host", "path"], "copies", total)
    for old in (paths, branches, verdicts):
        drop_table(old)
    rule, said = longest_rule(rules, F.col("host"), F.col("path"))
    return rows.select(
        F.col("id").alias(id_col), "host", "path", rule.alias("rule"), F.coalesce(said, F.when(F.col("purity") < purity, F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.col("branch").alias("template"), F.round("purity", 6).alias("purity"),
    )


def op5_path_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels: the quality of ``labels``, taken as that of the page of the same number."""
    return judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), RULES, depth=None)
