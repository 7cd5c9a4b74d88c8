"""URL filtering by a tree of path templates per host.

The tree grows level by level, to the deepest path. Under each node, segments with digits become patterns; in a
node with many different children, those with few labels become one wildcard; the children that remain are
merged where their labelled shares of good pages do not differ significantly from the branch's pooled one. What is
left of a path is its template. A
template is rejected when its labelled purity, smoothed towards its host's and that towards the overall
share, is under a threshold. Pages that a rule of the allow and block list fits are the labelled ones, and
the rule decides them.

Each level is an aggregation by (host, template so far, segment), folded in every task first, so a host
with a third of all pages is no single group; a node's children meet only once they are few.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workspace import Workspace, pages

QUERY = "op3_url_templates"

#: (verdict, host, path); the host also stands for its subdomains, the path for what begins with it.
RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: In a node with more different children, those with fewer pages than this share of its labelled ones, or without a label, become a wildcard.
MAX_CHILDREN = 24
RARE = 0.02
#: Children whose shares differ by less than so many standard errors are merged.
SIMILAR = 1.96
#: Labelled pages that a prior counts for.
PRIOR_PAGES = 5.0
MIN_PURITY = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """After the first ://, the host up to / ? # or the end with A-Z lower-cased, and the path up to ? # or the end; else both empty."""
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    there = F.coalesce(F.locate("://", url) > 0, F.lit(False))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.when(there, host).otherwise(""), F.when(there, path).otherwise("")


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(verdict, rule) of the longest rule that fits, else nulls. Rules of one length: the first given."""
    verdict = rule = F.lit(None).cast("string")
    for said, h, p in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((host == h) | F.endswith(host, F.lit(f".{h}"))) & F.startswith(path, F.lit(p))
        verdict, rule = F.when(fits, said).otherwise(verdict), F.when(fits, h + p).otherwise(rule)
    return verdict, rule


def _segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda x: x != "")


def _branches(children: Column, similar: float) -> Column:
    """Children sorted by share as branches (good, labelled, segments), each tested against the pooled share of the branch before."""
    kind = "array<struct<good:double,labelled:double,segments:array<string>>>"

    def put(branches: Column, child: Column) -> Column:
        last = F.try_element_at(branches, F.lit(-1))
        pooled = (last["good"] + child["good"]) / (last["labelled"] + child["labelled"])
        error = F.sqrt(pooled * (1 - pooled) * (1 / last["labelled"] + 1 / child["labelled"]))
        alike = (child["labelled"] > 0) & F.coalesce(last["labelled"] > 0, F.lit(False)) & (child["good"] / child["labelled"] - last["good"] / last["labelled"] <= similar * error)
        alone = F.struct(child["good"].alias("good"), child["labelled"].alias("labelled"), F.array(child["segment"]).alias("segments"))
        grown = F.struct((last["good"] + child["good"]).alias("good"), (last["labelled"] + child["labelled"]).alias("labelled"), F.concat(last["segments"], F.array(child["segment"])).alias("segments"))
        return F.when(F.coalesce(alike, F.lit(False)), F.concat(F.slice(branches, F.lit(1), F.size(branches) - 1), F.array(grown))).otherwise(F.concat(branches, F.array(alone))).cast(kind)

    return F.aggregate(children, F.array().cast(kind), put)


def grow(urls: DataFrame, ws: Workspace, max_children: int = MAX_CHILDREN, similar: float = SIMILAR) -> DataFrame:
    """host, path, template of a table of host, path, n, good, bad with a row for each host and path."""
    tree = ws.table(urls.select("host", "path", "n", "good", "bad", F.transform(_segments(F.col("path")), lambda x: F.regexp_replace(x, "[0-9]+", "*")).alias("segments"), F.lit("").alias("template")), "tree-0")
    deepest = tree.agg(F.max(F.size("segments"))).first()[0] or 0
    ended = []
    for level in range(deepest):
        # Paths that end here are read from this level's table in the end; only longer ones go on.
        ended.append(tree.where(F.size("segments") <= level))
        here = tree.where(F.size("segments") > level).withColumn("segment", F.col("segments")[level])
        sums = [F.sum(c).alias(c) for c in ("n", "good", "bad")]
        children = ws.table(here.groupBy("host", "template", "segment").agg(*sums), f"children-{level}")
        # In a wide node only children with a good part of its labels keep a name: at most 1 / RARE of them.
        labels = F.col("good") + F.col("bad")
        node = children.groupBy("host", "template").agg(F.count(F.lit(1)).alias("children"), F.sum(labels).alias("node_labels"))
        wide = ws.table(node.where(F.col("children") > max_children).select("host", "template", "node_labels"), f"wide-{level}")
        few = children.withColumn("labelled", labels).join(wide, ["host", "template"], "left")
        few = few.where(F.col("node_labels").isNull() | ((F.col("labelled") > 0) & (F.col("labelled") >= RARE * F.col("node_labels"))))
        # In the order of their shares, a child joins the branch before it unless it differs from that branch as a whole.
        row = F.struct(F.coalesce(F.col("good") / F.nullif("labelled", F.lit(0)), F.lit(2.0)).alias("share"), "segment", F.col("good").cast("double").alias("good"), F.col("labelled").cast("double").alias("labelled"))
        nodes = few.groupBy("host", "template").agg(F.sort_array(F.collect_list(row)).alias("children"))
        merged = nodes.select("host", "template", F.explode(_branches(F.col("children"), similar)).alias("branch"))
        merged = merged.select("host", "template", F.explode("branch.segments").alias("segment"), F.array_join(F.array_sort("branch.segments"), "|").alias("name"))
        merged = ws.table(merged.select("host", "template", "segment", "name"), f"branches-{level}")
        named = here.join(merged, ["host", "template", "segment"], "left").withColumn("template", F.concat("template", F.lit("/"), F.coalesce("name", F.lit("*"))))
        tree = ws.table(named.select(tree.columns), f"tree-{level + 1}")
    return reduce(DataFrame.unionByName, ended, tree)


def url_templates(table: DataFrame, ws: Workspace, rules: Sequence[tuple[str, str, str]] = RULES, min_purity: float = MIN_PURITY, prior_pages: float = PRIOR_PAGES, **tree: float) -> DataFrame:
    """One row per input row: page_id, host, path, rule, verdict, template, purity.

    A null url, or one without ://, has an empty host and path and is judged like other pages of the empty
    host. Null ids and repeated rows are judged alike, each row counting. Without any labelled page the
    overall share is taken as 1 and every template passes. An empty table gives an empty result; columns
    other than page_id and url are ignored.
    """
    host, path = host_and_path(F.col("url"))
    said, rule = match_rules(F.col("host"), F.col("path"), rules)
    judged = table.select("page_id", host.alias("host"), path.alias("path")).withColumns({"said": said, "rule": rule})
    good, bad = (F.sum((F.col("said") == v).cast("long")) for v in ("allow", "block"))
    urls = judged.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.coalesce(good, F.lit(0)).alias("good"), F.coalesce(bad, F.lit(0)).alias("bad"))
    leaves = ws.table(grow(ws.table(urls, "urls"), ws, **tree).select("host", "path", "template", "good", "bad"), "leaves")
    hosts = ws.table(leaves.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad")), "hosts")
    total = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_bad").alias("bad")).first()
    labelled = (total["good"] or 0) + (total["bad"] or 0)
    overall = total["good"] / labelled if labelled else 1.0
    smooth = lambda good, bad, prior: (good + prior_pages * prior) / (good + bad + prior_pages)
    templates = ws.table(leaves.groupBy("host", "template").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), "sums").join(hosts, "host")
    purity = smooth(F.col("good"), F.col("bad"), smooth(F.col("host_good"), F.col("host_bad"), F.lit(overall)))
    templates = ws.table(templates.select("host", "template", purity.alias("purity")), "templates")
    found = ws.table(leaves.select("host", "path", "template").join(templates, ["host", "template"]), "found")
    # The right side is a table of one row a host and path; a hot url on the left can be split.
    return judged.join(found, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("purity") >= min_purity, "allow").otherwise("block")).alias("verdict"), "template", "purity"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_templates(pages(spark, sf_dir), Workspace(spark, "url-templates"))


ORACLE_SQL = None
