"""URL filters: rules first, then the purity of path templates.

The path of a URL becomes a template. Segments that read as numbers, hex strings or
mixed identifiers are generalised by their look. Then a tree is built per host, level
by level: under a node with many branches, branches of little traffic become ``*``;
branches whose share of blocked labels doesn't differ significantly from their
siblings' (a two-proportion test) are merged into ``*`` too. Labels come from the
rules, and they carry over: the labelled pages of a path shape on all hosts count on
each host as up to ``carried`` labels more, so hosts without a rule are judged by how
the same shapes fare elsewhere. A template is rejected when its smoothed purity, the
blocked share of its labels drawn towards its host's and that towards the whole
table's, reaches ``reject``. Rules always win over templates; of several that fit, the
longest wins.

Paths are aggregated to distinct shapes before anything is joined, and the joins from
node to branch are spread over salts, so a host with a third of all pages is dealt out.

Defined cases: null URLs and those without ``://`` have empty host and path; repeated
pages each count as a label and are each returned; paths may be of any depth: a pass is
made for each level at which nodes still branch, and what hangs on one branch alone is
settled at once; without any label all templates are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.storage import materialize

SALTS = 32


@dataclass(frozen=True)
class Rule:
    verdict: str  # allow or block
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Params:
    rules: tuple[Rule, ...]
    branches: int = 8  # above so many, branches of little traffic are variable
    little: int = 20  # less than one in so many of the node's pages
    differs: float = 3.84  # chi-squared of a significant difference
    strength: float = 4.0  # pages that a prior counts for
    carried: float = 16.0  # labels at most that a shape's pages on all hosts count for on each
    reject: float = 0.8


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), "^[^/?#]*([^?#]*)", 1)


def rule_for(params: Params, what) -> Column:
    """``what(rule)`` of the longest rule that fits host and path; null without one."""
    out = F.lit(None).cast("string")
    for r in sorted(params.rules, key=lambda r: (len(r.text), r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        out = F.when(fits, F.lit(what(r))).otherwise(out)
    return out


def _look(segment: Column) -> Column:
    return (
        F.when(segment.rlike("^[0-9]+$"), "{n}")
        .when(segment.rlike(r"^[0-9]+\.[a-z]+$"), F.concat(F.lit("{n}."), F.regexp_extract(segment, r"\.([a-z]+)$", 1)))
        .when(segment.rlike("^[0-9a-f]{8,}$"), "{x}")
        .when(segment.rlike("[0-9]"), "{d}")
        .otherwise(segment)
    )


def parsed(pages: DataFrame, params: Params, url_col: str = "url") -> DataFrame:
    """The pages' ids with host, path, rule, verdict by rule, and ``shape``, the looks of the path's segments."""
    rows = pages.select(F.col("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = rows.withColumns({"rule": rule_for(params, lambda r: r.text), "ruled": rule_for(params, lambda r: r.verdict)})
    return rows.withColumn("shape", F.array_join(F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), _look), "/"))


SUMS = ("n", "allowed", "blocked")


def _general(look: Column) -> Column:
    return F.when(look.startswith("{"), look).otherwise("*")


def _carried(shapes: DataFrame, params: Params) -> DataFrame:
    """The shapes with the labels added that pages of their shape have on all hosts."""
    pooled = shapes.groupBy("shape").agg(F.sum("allowed").alias("a"), F.sum("blocked").alias("b")).where("a + b > 0")
    pooled = pooled.withColumn("weight", F.lit(params.carried) / (F.col("a") + F.col("b") + F.lit(params.carried)))
    spread = pooled.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = shapes.withColumn("salt", F.pmod(F.xxhash64("host"), F.lit(SALTS)).cast("int")).join(spread, ["shape", "salt"], "left")
    more = lambda own, all_of: (F.col(own) + F.coalesce(F.col(all_of) * F.col("weight"), F.lit(0.0))).alias(own)
    return salted.select("host", "shape", "n", more("allowed", "a"), more("blocked", "b"))


def templates(rows: DataFrame, params: Params) -> DataFrame:
    """(host, shape, template, rejected) of all shapes."""
    shapes = rows.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("ruled") == "allow").alias("allowed"), F.count_if(F.col("ruled") == "block").alias("blocked")
    )
    shapes = _carried(materialize(shapes, "shapes"), params)
    todo = materialize(shapes.select("*", F.when(F.col("shape") == "", F.array().cast("array<string>")).otherwise(F.split("shape", "/")).alias("looks"), F.lit("").alias("prefix")), "shapes")
    settled, depth, node = None, 0, ["host", "prefix"]
    while True:
        here = F.get("looks", F.lit(depth))
        salted = todo.where(here.isNotNull()).withColumn("own", here)
        branches = salted.groupBy(*node, "own").agg(F.count(F.lit(1)).alias("shapes"), *(F.sum(c).alias(c) for c in SUMS))
        parents = branches.groupBy(*node).agg(F.count(F.lit(1)).alias("k"), F.sum("shapes").alias("below"), *(F.sum(c).alias(f"all_{c}") for c in SUMS))
        spread = parents.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        b = branches.withColumn("salt", F.pmod(F.xxhash64("own"), F.lit(SALTS)).cast("int")).join(spread, [*node, "salt"])
        labelled, all_labelled = F.col("allowed") + F.col("blocked"), F.col("all_allowed") + F.col("all_blocked")
        x = F.col("blocked") * all_labelled - F.col("all_blocked") * labelled
        spread_of = F.col("all_blocked") * F.col("all_allowed") * labelled * (all_labelled - labelled)
        differs = (spread_of > 0) & (x * x * all_labelled > params.differs * spread_of)
        variable = (F.col("k") > params.branches) & (F.col("n") * params.little < F.col("all_n"))
        chosen = b.select(*node, "own", (F.col("below") == 1).alias("lone"), F.when(differs & ~variable, F.col("own")).otherwise(_general(F.col("own"))).alias("as"))
        placed = todo.withColumn("own", here).join(chosen, [*node, "own"], "left")
        # The only shape below a node has no siblings to differ from at any depth.
        rest = F.concat_ws("/", F.transform(F.slice("looks", depth + 1, F.greatest(F.size("looks") - depth, F.lit(0))), _general))
        ended = F.col("own").isNull()
        full = F.when(ended, F.col("prefix")).when(F.col("lone"), F.concat_ws("/", "prefix", rest))
        placed = materialize(placed.select("host", "shape", *SUMS, "looks", F.when(ended | F.col("lone"), full).alias("template"), F.concat_ws("/", "prefix", "as").alias("prefix")), "shapes")
        done = placed.where("template is not null").select("host", "shape", *SUMS[1:], "template")
        settled = done if settled is None else settled.union(done)
        todo = placed.where("template is null").drop("template")
        depth += 1
        if todo.isEmpty():
            break
    shapes = materialize(settled, "settled")
    of_template = shapes.groupBy("host", "template").agg(*(F.sum(c).alias(c) for c in SUMS[1:]))
    of_host = of_template.groupBy("host").agg(*(F.sum(c).alias(f"host_{c}") for c in SUMS[1:]))
    of_all = of_host.agg(*(F.coalesce(F.sum(f"host_{c}"), F.lit(0.0)).alias(c) for c in SUMS[1:])).first()
    m, seen = params.strength, of_all["allowed"] + of_all["blocked"]
    general = of_all["blocked"] / seen if seen else 0.0
    spread = of_host.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    t = of_template.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(SALTS)).cast("int")).join(spread, ["host", "salt"])
    prior = (F.col("host_blocked") + m * general) / (F.col("host_allowed") + F.col("host_blocked") + m)
    purity = (F.col("blocked") + m * prior) / (F.col("allowed") + F.col("blocked") + m)
    t = t.select("host", "template", (purity >= params.reject).alias("rejected"))
    return materialize(shapes.join(t, ["host", "template"]).select("host", "shape", "template", "rejected"), "templates")


def judge(pages: DataFrame, params: Params, url_col: str = "url") -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, template."""
    rows = parsed(pages, params, url_col)
    found = templates(rows, params)
    return rows.join(found, ["host", "shape"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("rejected"), "block").otherwise("allow")).alias("verdict"), "template"
    )
