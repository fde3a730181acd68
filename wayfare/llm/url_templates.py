"""URL filter by rules and by path templates.

Rules come first. For the other addresses a template tree is grown per host: level by level, a path segment becomes
the wildcard `*` if it looks like an identifier or if its node has too many different children; sibling branches
whose continuations and labels are alike by Hoeffding's test (the merging test of stochastic grammar inference)
become one. A template is rejected when it has labelled addresses and the share of blocked among them, smoothed towards
the share over all hosts, is high enough; without labels of its own nothing speaks against it.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfare.llm.common import ascii_lower, let_workers_import
from wayfare.session import written

MAX_CHILDREN = 50  # a node with more different children is variable
DEPTH = 8  # segments that the tree tells apart; what follows is the one wildcard **
ALIKE = 0.05  # significance of the test that keeps branches apart
WEIGHT = 20.0  # labelled addresses that the prior counts for
PURE = 0.9  # smoothed share of blocked from which a template is rejected
_IDENTIFIER = r"^(?:\d+|[0-9a-fA-F-]{8,}|.*\d{3,}.*)(?:\.[A-Za-z]{2,5})?$"


def address(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without `://` or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise(F.lit(""))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return ascii_lower(host), path


def judged_by_rules(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null if none fits. A rule is (`host/path prefix`, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # the longest is tested first
        of, _, start = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith("/" + start)
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _alike(a: dict, b: dict) -> bool:
    n, m = sum(a.values()), sum(b.values())
    limit = math.sqrt(0.5 * math.log(2 / ALIKE)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
    return all(abs(a.get(k, 0) / n - b.get(k, 0) / m) <= limit for k in a.keys() | b.keys())


def merged_children(rows: pd.DataFrame) -> pd.DataFrame:
    """Children of one node (at most MAX_CHILDREN, each with a few outcome counts) -> the branch each belongs to."""
    counts = {c: dict(zip(g["outcome"], g["n"].astype(float))) for c, g in rows.groupby("child", sort=True)}
    branches: list[tuple[list[str], dict]] = []
    for child in sorted(counts, key=lambda c: (-sum(counts[c].values()), c)):
        for names, total in branches:
            if _alike(total, counts[child]):
                names.append(child)
                for k, v in counts[child].items():
                    total[k] = total.get(k, 0) + v
                break
        else:
            branches.append(([child], dict(counts[child])))
    out = [(c, "|".join(sorted(names)) if len(names) <= 8 else f"{min(names)}|..|{max(names)}") for names, _ in branches for c in names]
    return pd.DataFrame(
        [(rows["host"].iloc[0], rows["prefix"].iloc[0], c, b) for c, b in out], columns=["host", "prefix", "child", "branch"]
    )


def templates(urls: DataFrame) -> DataFrame:
    """(host, path, template) for the distinct (host, path) of `urls` (host, path, n, n_block, n_allow)."""
    let_workers_import(urls.sparkSession)
    parts = F.filter(F.split("path", "/"), lambda s: s != "")
    deep = F.size(parts) > DEPTH
    cut = F.when(deep, F.concat(F.slice(parts, 1, DEPTH), F.array(F.lit("**")))).otherwise(parts)
    state = urls.select("host", "path", "n", "n_block", "n_allow", cut.alias("parts"), F.lit("").alias("prefix"))
    state = written(state, "urls")
    levels = state.agg(F.max(F.size("parts"))).first()[0] or 0  # at most DEPTH + 1

    for level in range(levels):  # wildcards
        child = F.get("parts", F.lit(level))
        state = state.withColumn("child", F.when(child.rlike(_IDENTIFIER), F.lit("*")).otherwise(child))
        children = state.filter("child is not null and child not in ('*', '**')").groupBy("host", "prefix", "child")
        nodes = children.agg(F.sum("n").alias("n")).groupBy("host", "prefix")
        nodes = nodes.agg(F.count("*").alias("k"), F.sum("n").alias("n"))
        variable = nodes.filter(
            (F.col("k") > MAX_CHILDREN) | ((F.col("k") >= 5) & (F.col("k") >= 0.5 * F.col("n")))
        ).select("host", "prefix", F.lit(True).alias("variable"))
        variable = written(variable, "variable-nodes")  # few; so written, the join can be split at a hot host
        state = state.join(variable, ["host", "prefix"], "left")
        segment = F.when(F.col("variable") & (F.col("child") != "**"), F.lit("*")).otherwise(F.col("child"))
        state = state.withColumn("prefix", F.concat("prefix", F.coalesce(F.concat(F.lit("/"), segment), F.lit(""))))
        state = state.drop("child", "variable")
    state = written(state.withColumnRenamed("prefix", "raw").drop("parts"), "templates")

    # Branches are merged on the templates, which are few, from the root downwards.
    tree = state.groupBy("host", "raw").agg(F.sum("n").alias("n"), F.sum("n_block").alias("n_block"), F.sum("n_allow").alias("n_allow"))
    segments = F.filter(F.split("raw", "/"), lambda s: s != "")
    tree = written(tree.withColumn("parts", segments).withColumn("prefix", F.lit("")), "tree")
    for level in range(levels):
        tree = tree.withColumn("child", F.get("parts", F.lit(level)))
        following = F.get("parts", F.lit(level + 1))
        shape = F.when(following.isNull(), "end").when(following.isin("*", "**"), following).otherwise("name")
        outcome = F.explode(
            F.array(
                *[
                    F.struct(F.concat_ws(" ", shape, F.lit(label)).alias("outcome"), count.alias("n"))
                    for label, count in (
                        ("block", F.col("n_block")),
                        ("allow", F.col("n_allow")),
                        ("none", F.col("n") - F.col("n_block") - F.col("n_allow")),
                    )
                ]
            )
        )
        named = tree.filter("child is not null and child not in ('*', '**')")
        counts = named.select("host", "prefix", "child", outcome.alias("o")).select("host", "prefix", "child", "o.*")
        counts = counts.filter("n > 0").groupBy("host", "prefix", "child", "outcome").agg(F.sum("n").alias("n"))
        branches = counts.groupBy("host", "prefix").applyInPandas(
            merged_children, "host string, prefix string, child string, branch string"
        )
        tree = tree.join(branches, ["host", "prefix", "child"], "left")
        segment = F.coalesce("branch", "child")
        tree = tree.withColumn("prefix", F.concat("prefix", F.coalesce(F.concat(F.lit("/"), segment), F.lit(""))))
        tree = tree.drop("child", "branch")
    final = written(tree.select("host", "raw", F.col("prefix").alias("template")), "merged-templates")
    return state.join(final, ["host", "raw"]).select("host", "path", "template", "n", "n_block", "n_allow")


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """One row per row of `pages`: page_id, host, path, rule, verdict, template, purity.

    Addresses that a rule fits are the labelled ones. A null address or one without `://` has an empty host and path
    and the template of an empty path; repeated rows get equal results; an empty table gives no rows. Only page_id
    and url are read, so other columns cannot clash.
    """
    host, path = address(F.col("url"))
    rows = pages.select(F.col("page_id"), F.col("url")).select("page_id", host.alias("host"), path.alias("path"))
    rule, says = judged_by_rules(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "says": says})
    urls = rows.groupBy("host", "path").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("says") == "block").alias("n_block"),
        F.count_if(F.col("says") == "allow").alias("n_allow"),
    )
    grown = written(templates(urls), "url-templates")
    total = grown.agg(F.sum("n_block").alias("b"), F.sum(F.col("n_block") + F.col("n_allow")).alias("l")).first()
    prior = total["b"] / total["l"] if total["l"] else 0.0
    blocked, labelled = F.sum("n_block"), F.sum(F.col("n_block") + F.col("n_allow"))
    by_template = grown.groupBy("host", "template").agg(
        ((blocked + F.lit(WEIGHT * prior)) / (labelled + F.lit(WEIGHT))).alias("purity"), labelled.alias("n_labelled")
    )
    by_template = written(by_template, "purities")
    by_path = grown.select("host", "path", "template").join(by_template, ["host", "template"])
    verdict = F.coalesce("says", F.when((F.col("n_labelled") > 0) & (F.col("purity") >= PURE), "block").otherwise("allow"))
    return rows.join(by_path, ["host", "path"]).select(
        "page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity"
    )

