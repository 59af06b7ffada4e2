"""URL filters: longest-prefix rules, and a path-template tree for the rest.

DataFrame functions only. Pages are summed by host and path shape before anything
else (segments that are plainly variable are wildcards in a shape), so the tree is
built on far fewer rows than there are pages, and no host's pages meet in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Children with less than one in so many of a branching's pages are variable segments.
THIN = 50
#: Sibling branches merge while their bad rates differ by fewer standard errors.
ALIKE = 1.96
#: Templates with a smoothed bad rate over this are blocked; the prior weighs as so many labelled pages.
MOST_BAD, PRIOR = 0.5, 4.0


@dataclass(frozen=True)
class Rule:
    """``verdict`` (allow or block) for a host, its subdomains, and paths that start with ``path``."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or without ``://``."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring(url, F.instr(url, "://") + 3, F.length(url))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    low = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(has, low).otherwise(""), F.when(has, path).otherwise("")


def match(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (ties by name); null without one."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: (len(r.host) + len(r.path), r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def shape(path: Column) -> Column:
    """The path's segments: those that hold a number of two digits or more, a long hex
    run or a uuid are `*` (with their extension), the rest stand."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    variable = lambda x: F.when(
        x.rlike(r"^(?:[^.]*\d{2,}[^.]*|\d+|[0-9a-fA-F-]{16,})(\.[A-Za-z]{1,5})?$"), F.concat(F.lit("*"), F.regexp_extract(x, r"(\.[A-Za-z]{1,5})$", 1))
    ).otherwise(x)
    return F.transform(parts, variable)


_COUNTS = ("pages", "labelled", "bad")


def _sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in _COUNTS]


def _apart(b1: Column, l1: Column, b2: Column, l2: Column, mean: Column) -> Column:
    """How many standard errors the bad rates of two branches differ by, each smoothed towards ``mean``."""
    p1, p2 = (b1 + PRIOR * mean) / (l1 + PRIOR), (b2 + PRIOR * mean) / (l2 + PRIOR)
    return (p1 - p2) / F.sqrt(p1 * (1 - p1) / (l1 + PRIOR) + p2 * (1 - p2) / (l2 + PRIOR))


def _merged(branches: DataFrame) -> DataFrame:
    """(host, template, branch, name): which branches of (host, template, branch, mean,
    labelled, bad) share a name. In order of their rates, each joins the group before it
    unless it differs from all of that group together by ALIKE standard errors. A
    branching has at most THIN branches that are not thin, and three of thin children."""
    rate = (F.col("bad") + PRIOR * F.col("mean")) / (F.col("labelled") + PRIOR)
    one = F.struct(rate.alias("p"), "branch", F.col("labelled").cast("double").alias("l"), F.col("bad").cast("double").alias("b"))
    lists = branches.groupBy("host", "template").agg(F.first("mean").alias("mean"), F.array_sort(F.collect_list(one)).alias("all"))
    start = F.struct(F.lit(0).alias("g"), F.lit(0.0).alias("l"), F.lit(0.0).alias("b"), F.array().cast("array<struct<branch:string,g:int>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        new = (F.size(acc["out"]) > 0) & (F.abs(_apart(x["b"], x["l"], acc["b"], acc["l"], F.col("mean"))) > ALIKE)
        g = acc["g"] + F.when(new, 1).otherwise(0)
        pooled = lambda c: F.when(new, x[c]).otherwise(acc[c] + x[c]).alias(c)
        return F.struct(g.alias("g"), pooled("l"), pooled("b"), F.concat(acc["out"], F.array(F.struct(x["branch"].alias("branch"), g.alias("g")))).alias("out"))

    folded = lists.select("host", "template", F.aggregate("all", start, step)["out"].alias("out"))
    members = lambda x: F.size(F.filter("out", lambda y: y["g"] == x["g"]))
    named = F.transform("out", lambda x: F.struct(x["branch"].alias("branch"), F.when(members(x) > 1, F.concat(F.lit("{"), x["g"].cast("string"), F.lit("}"))).otherwise(x["branch"]).alias("name")))
    return folded.select("host", "template", F.explode(named).alias("n")).select("host", "template", "n.branch", "n.name")


def grow(shapes: DataFrame) -> DataFrame:
    """From (host, shape, pages, labelled, bad) to the same rows with their template.

    A round takes every node (host, template) to its next branching: first along the
    segments that all its shapes share (those that the least and the greatest share).
    There, children with less than a THIN-th of the pages are one wildcard, but for
    those whose bad rate is apart from that of all of these together: the worse and the
    better ones are a wildcard each. Then siblings merge (`_merged`). Rounds end when no
    shape has segments left; there are as many as branchings on the longest way.
    """
    key = ["host", "template"]
    now = shapes.withColumns({"template": F.lit(""), "rest": F.col("shape")})
    done = []
    while True:
        ends = F.size("rest") == 0
        done.append(now.where(ends).drop("rest"))
        now = now.where(~ends)
        lo, hi = F.col("lo"), F.col("hi")
        least = F.least(F.size(lo), F.size(hi))
        differ = F.array_min(F.filter(F.sequence(F.lit(1), least), lambda i: F.element_at(lo, i) != F.element_at(hi, i)))
        nodes = now.groupBy(*key).agg(F.min("rest").alias("lo"), F.max("rest").alias("hi")).select(*key, F.coalesce(differ - 1, least).alias("same"))
        way = F.array_join(F.slice("rest", 1, F.col("same")), "/")
        now = now.join(nodes, key).withColumn("template", F.when(F.col("same") > 0, F.concat("template", F.lit("/"), way)).otherwise(F.col("template")))
        now = now.withColumn("rest", F.slice("rest", F.col("same") + 1, F.size("rest"))).withColumn("child", F.coalesce(F.get("rest", F.lit(0)), F.lit(""))).drop("same")
        now = cut(now, "level")
        if now.isEmpty():
            break
        children = now.where("child <> ''").groupBy(*key, "child").agg(*_sums())
        whole = now.groupBy(*key).agg(F.sum("pages").alias("all"), F.sum("labelled").alias("l"), F.sum("bad").alias("b"))
        whole = whole.select(*key, "all", ((F.col("b") + 1) / (F.col("l") + 2)).alias("mean"))
        children = children.join(whole, key).withColumn("thin", F.col("pages") * THIN < F.col("all"))
        wild = children.where("thin").groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.sum("labelled").alias("tl"), F.sum("bad").alias("tb"))
        children = children.join(wild, key, "left")
        off = _apart(F.col("bad"), F.col("labelled"), F.col("tb"), F.col("tl"), F.col("mean"))
        kind = F.when(off > ALIKE, "*+").when(off < -ALIKE, "*-").otherwise("*")
        children = cut(children.select(*key, "child", "mean", "labelled", "bad", F.when(F.col("thin") & (F.col("n") > 1), kind).otherwise(F.col("child")).alias("branch")), "children")
        branches = children.groupBy(*key, "branch").agg(F.first("mean").alias("mean"), F.sum("labelled").alias("labelled"), F.sum("bad").alias("bad"))
        names = children.select(*key, "child", "branch").join(_merged(branches), [*key, "branch"]).drop("branch")
        now = now.join(names, [*key, "child"], "left")
        now = now.withColumn("template", F.when(F.col("name").isNull(), F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")))
        now = cut(now.withColumn("rest", F.slice("rest", 2, F.greatest(F.size("rest"), F.lit(1)))).drop("child", "name"), "level")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def purity(shapes: DataFrame) -> DataFrame:
    """By (host, template): pages, labelled, bad, and the bad rate smoothed towards the
    host's, which is smoothed towards the rate of all."""
    by_template = shapes.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in ("pages", "labelled", "bad")))
    by_host = shapes.groupBy("host").agg(F.sum("labelled").alias("hl"), F.sum("bad").alias("hb"))
    everything = by_host.agg(((F.coalesce(F.sum("hb"), F.lit(0)) + 1) / (F.coalesce(F.sum("hl"), F.lit(0)) + 4)).alias("g"))
    by_host = by_host.crossJoin(F.broadcast(everything)).select("host", ((F.col("hb") + PRIOR * F.col("g")) / (F.col("hl") + PRIOR)).alias("h"))  # everything: one row
    rate = (F.col("bad") + PRIOR * F.col("h")) / (F.col("labelled") + PRIOR)
    return by_template.join(by_host, "host").withColumn("bad_rate", rate).drop("h")


def judge(pages: DataFrame, labels: DataFrame, rules: list[Rule], carry: list[str], url: str = "url") -> DataFrame:
    """``carry``, host, path, rule, verdict, template and bad_rate, one row for each page.

    ``labels`` has url and bad (boolean). A rule decides where one fits, else the
    template's smoothed bad rate (of several labels of a url the majority counts). A null
    url, or one without ``://``, has an empty host and path, fits no rule and shares one
    template. Urls are taken whole, of whatever length and depth. Rules of one length
    are ordered by name, the last wins. Repeated pages count and are judged each; a null
    page id is carried. An empty table gives an empty result; without labels every
    template has the prior's rate. Other columns are not read.
    """
    host, path = host_path(F.col("_u"))
    parsed = pages.select(*(F.col(c).alias(f"_c{i}") for i, c in enumerate(carry)), F.col(url).alias("_u")).withColumns({"host": host, "path": path})
    parsed = cut(parsed.withColumn("shape", shape(F.col("path"))), "pages")
    marks = labels.groupBy(F.col("url").alias("_l")).agg(F.count("bad").alias("labelled"), F.sum(F.col("bad").cast("long")).alias("bad"))
    known = parsed.join(marks, F.col("_u") == F.col("_l"), "left")
    some = F.coalesce(F.col("labelled"), F.lit(0)) > 0
    bad = F.when(some, (2 * F.col("bad") > F.col("labelled")).cast("long")).otherwise(0)
    shapes = known.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("pages"), F.sum(some.cast("long")).alias("labelled"), F.sum(bad).alias("bad"))
    tree = cut(grow(cut(shapes, "shapes")), "tree")
    found = tree.join(purity(tree).select("host", "template", "bad_rate"), ["host", "template"]).select(
        F.col("host").alias("_h"), F.col("shape").alias("_s"), "template", "bad_rate"
    )
    rule, verdict = match(F.col("host"), F.col("path"), rules)
    out = parsed.join(found, (F.col("host") == F.col("_h")) & (F.col("shape") == F.col("_s")), "left")
    method = F.when(F.coalesce(F.col("bad_rate"), F.lit(0.0)) > MOST_BAD, F.lit("block")).otherwise(F.lit("allow"))
    return out.select(*(F.col(f"_c{i}").alias(c) for i, c in enumerate(carry)), "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "bad_rate")
