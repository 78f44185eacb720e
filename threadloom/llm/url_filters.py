"""URL filters with a path-template tree per host, native DataFrame operations only.

Rules (host, path, verdict) decide first: a rule fits its host and all subdomains if the path starts with the rule's, and
the longest wins. For the rest, paths become templates:

1. Segments of digits, of hexadecimal digits and of mixed letters and digits become wildcards by their form. What follows
   works on a host's distinct path forms, so repeated rows change nothing but the labels' counts.
2. Level by level, a node of a host's tree gets one wildcard child if it has MANY_CHILDREN different children or more and fewer than
   FORMS_A_CHILD path forms for each. Levels go on as deep as any node has MANY_CHILDREN forms; below, nothing can change.
3. Sibling nodes, inner ones and leaves, with LABELS labels or more whose share of bad ones doesn't differ from their common share
   by a z-test are merged. Nodes with fewer labels are left as they are.
4. A branch whose smoothed share of bad labels, its purity, reaches PURITY is rejected. The share is smoothed step by step: all
   labels, the same branch on all hosts (one label a host, its share), the domain (the host's last two names), the same branch in the domain, the host, the nodes on
   the way, and the branch itself; each step adds its labels to WEIGHT labels of the step before. So a
   branch without labels is judged by what is known around it.

Labels are a nullable 0/1 column ``bad``; the query labels the pages that a rule decides. Pages are combined to counts
per host and path form before anything is joined, so the tree's tables grow with distinct path forms; joins split
nodes that hold a large share of them. Null urls and urls without ``://`` have an empty host and path; pages with null ids and repeated
pages keep their rows; an empty table gives an empty result. Rules are a list of the caller's, held in the plan. Paths of any
length are read whole.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..scratch import Scratch
from ..skew import split_join

MANY_CHILDREN = 8
FORMS_A_CHILD = 4
LABELS = 5
Z = 1.96
WEIGHT = 10.0
PURITY = 0.8
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path) after the first ``://``."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest) + 1), r"^[^?#]*", 0)


def ruling(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as (length, rule, verdict); null if none does."""
    each = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.greatest(*each, each[0]) if each else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def path_form(path: Column) -> Column:
    """The path's segments, variable ones as wildcards by form."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(
        parts,
        lambda x: F.when(x.rlike("^[0-9]+$"), "<n>")
        .when(x.rlike("^[0-9a-fA-F-]{8,}$"), "<x>")
        .when(x.rlike("[0-9]") & x.rlike("[A-Za-z]"), "<w>")
        .otherwise(x),
    )


def _segments(template: str) -> Column:
    """The segments of a template, which has a slash before each."""
    return F.filter(F.split(template, "/"), lambda x: x != "")


def template_tree(pages: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, form, template) with the labels and how many are bad of each path form, from (host, path, bad)."""
    forms = pages.groupBy("host", path_form(F.col("path")).alias("form")).agg(F.count("bad").alias("labels"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    live = scratch.write(forms.withColumn("template", F.lit("")), "forms")
    done, level = [live.where(F.size("form") == 0)], 0
    live = live.where(F.size("form") > 0)
    while total := live.count():
        child = F.get("form", F.lit(level))
        nodes = live.groupBy("host", "template", child.alias("child")).agg(F.count("*").alias("forms"))
        nodes = nodes.groupBy("host", "template").agg(F.count("*").alias("children"), F.sum("forms").alias("k")).where(F.col("k") >= MANY_CHILDREN)
        wild = (F.col("children") >= MANY_CHILDREN) & (F.col("k") < F.col("children") * FORMS_A_CHILD)
        nodes = scratch.write(nodes.select("host", "template", "k", wild.alias("wild")), f"nodes{level}")
        known = split_join(live, nodes, ["host", "template"], total, how="left")
        rest = F.slice("form", level + 1, F.size("form"))  # under a node of few forms nothing changes any more
        step = F.when(F.col("wild").isNull(), F.array_join(rest, "/")).when(F.col("wild"), "<*>").otherwise(child)
        ended = F.col("wild").isNull() | (F.size("form") == level + 1)
        known = known.select("host", "form", "labels", "bad", F.concat("template", F.lit("/"), step).alias("template"), ended.alias("ended"))
        known = scratch.write(known, f"level{level}")  # each level reads the one before several times
        done.append(known.where("ended").drop("ended"))
        live, level = known.where("NOT ended").drop("ended"), level + 1
    return scratch.write(reduce(DataFrame.unionByName, done), "tree")


def _named(*parts: Column) -> Column:
    """128 bits that stand for a path, so that long ones aren't copied or compared."""
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit(1), *parts).alias("b"))


def _nodes(rows: DataFrame, keep: list[str], key: list[str], path: str) -> DataFrame:
    """A row per segment of each row's path, and one of depth 0: the columns ``keep``, depth, segment, node, above.

    A node is named by 128 bits, the combined hashes of depth and segment of all on the way to it, which a running sum along the path makes; so a
    path's rows are as many and as long as its segments, however deep it is.
    """
    each = rows.select(*keep, F.posexplode(F.concat(F.array(F.lit("")), _segments(path))).alias("depth", "segment"))
    each = each.withColumns({"__a": F.xxhash64("depth", "segment"), "__b": F.xxhash64(F.lit(1), "segment", "depth")})
    way = Window.partitionBy(*key).orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    each = each.withColumn("node", F.struct(F.bit_xor("__a").over(way).alias("a"), F.bit_xor("__b").over(way).alias("b")))
    above = F.struct(F.col("node.a").bitwiseXOR(F.col("__a")).alias("a"), F.col("node.b").bitwiseXOR(F.col("__b")).alias("b"))
    return each.withColumn("above", above).drop("__a", "__b")


def merged_branches(leaves: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, leaf, branch) of the leaves (host, leaf, template, labels, bad): a segment merged with its siblings reads <~>."""
    each = scratch.write(_nodes(leaves, ["host", "leaf", "labels", "bad"], ["host", "leaf"], "template"), "steps")
    nodes = each.where("depth > 0").groupBy("host", "depth", "above", "node").agg(F.sum("labels").alias("n"), F.sum("bad").alias("b"), F.count("*").alias("k")).where(F.col("n") >= LABELS)
    nodes = scratch.write(nodes, "nodes")
    pooled = nodes.groupBy("host", "depth", "above").agg((F.sum("b") / F.sum("n")).alias("rate"), F.count("*").alias("siblings")).where("siblings > 1")
    spread = F.sqrt(F.col("rate") * (1 - F.col("rate")) / F.col("n"))
    alike = F.abs(F.col("b") / F.col("n") - F.col("rate")) <= Z * spread + 1e-12
    met = split_join(nodes, scratch.write(pooled, "pooled"), ["host", "depth", "above"], nodes.count(), count="siblings")
    same = met.where(alike).select("host", "depth", "node", "k", F.lit("<~>").alias("merged"))
    same = scratch.write(same, "merged")
    named = split_join(each, same, ["host", "depth", "node"], each.count(), how="left")
    shown = F.struct("depth", F.coalesce("merged", "segment").alias("segment"))
    path = F.transform(F.filter(F.array_sort(F.collect_list(shown)), lambda x: x["depth"] > 0), lambda x: x["segment"])  # as long as a path
    return named.groupBy("host", "leaf").agg(path.alias("parts")).select("host", "leaf", F.concat_ws("", F.transform("parts", lambda x: F.concat(F.lit("/"), x))).alias("branch"))


def purities(branches: DataFrame, scratch: Scratch) -> DataFrame:
    """(host, branch, purity) of the branches (host, branch, labels, bad)."""
    branches = scratch.write(branches.withColumn("whole", _named(F.col("branch"))), "branches")
    names = F.split("host", r"\.")
    domain = F.array_join(F.slice(names, F.greatest(F.size(names) - 1, F.lit(1)), 2), ".")
    scope = lambda level, owner, node: F.struct(F.lit(level).alias("level"), owner.alias("owner"), node.alias("node"))
    around = F.array(scope(0, F.lit("*"), F.col("whole")), scope(1, domain, _named(F.lit(""))), scope(2, domain, F.col("whole")))
    kept = ["host", "whole", "labels", "bad"]
    near = branches.select(*kept, F.inline(around))
    way = _nodes(branches, kept, ["host", "whole"], "branch").select(*kept, (F.col("depth") + 3).alias("level"), F.col("host").alias("owner"), "node")
    each = scratch.write(near.unionByName(way), "scopes")
    own = F.col("level") == 0  # a host counts once among all hosts, so that no single one speaks for the others
    n = F.when(own, F.least(F.col("labels"), F.lit(1))).otherwise(F.col("labels"))
    b = F.when(own, F.coalesce(F.try_divide("bad", "labels"), F.lit(0.0))).otherwise(F.col("bad"))
    sums = each.groupBy("level", "owner", "node").agg(F.sum(n).alias("n"), F.sum(b).alias("b"), F.count("*").alias("k"))
    sums = scratch.write(sums, "sums")
    chains = split_join(each.select("host", "whole", "level", "owner", "node"), sums, ["level", "owner", "node"], each.count())
    chains = chains.groupBy("host", "whole").agg(F.array_sort(F.collect_list(F.struct("level", "n", "b"))).alias("chain"))  # as long as a path
    prior = branches.agg(F.coalesce(F.try_divide(F.sum("bad"), F.sum("labels")), F.lit(0.0)).alias("prior"))  # one row
    smooth = F.aggregate("chain", F.col("prior"), lambda share, x: (x["b"] + F.lit(WEIGHT) * share) / (x["n"] + F.lit(WEIGHT)))
    found = chains.crossJoin(F.broadcast(prior)).select("host", "whole", F.round(smooth, 9).alias("purity"))
    return branches.select("host", "whole", "branch").join(found, ["host", "whole"]).select("host", "branch", "purity")


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """Per row of ``pages`` (page_id, url, and bad if there are labels): page_id, host, path, rule, verdict, template, purity."""
    host, path = split_url(F.col("url"))
    split = pages.withColumns({"host": host, "path": path})
    rule = ruling(F.col("host"), F.col("path"), rules)
    label = F.when(rule["verdict"] == "block", 1).when(rule["verdict"] == "allow", 0)
    bad = F.coalesce("bad", label) if "bad" in pages.columns else label
    scratch = Scratch(pages.sparkSession, "url-filters")
    split = split.select("page_id", "host", "path", path_form(F.col("path")).alias("form"), rule["rule"].alias("rule"), rule["verdict"].alias("ruled"), bad.cast("int").alias("bad"))
    split = scratch.write(split, "split")
    tree = template_tree(split.select("host", "path", "bad"), scratch)
    leaves = tree.groupBy("host", "template").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad")).withColumn("leaf", _named(F.col("template")))
    leaves = scratch.write(leaves, "leaves")
    named = scratch.write(leaves.join(merged_branches(leaves, scratch), ["host", "leaf"]), "named")
    found = purities(named.groupBy("host", "branch").agg(F.sum("labels").alias("labels"), F.sum("bad").alias("bad")), scratch)
    known = tree.select("host", "form", "template").join(named.select("host", "template", "branch").join(found, ["host", "branch"]), ["host", "template"])
    counts = split.groupBy("host", "form").agg(F.count("*").alias("k"))
    known = scratch.write(known.join(counts, ["host", "form"]), "known")
    out = split_join(split, known, ["host", "form"], split.count())
    verdict = F.coalesce("ruled", F.when(F.col("purity") >= PURITY, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "branch", "purity")
