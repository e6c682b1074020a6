"""URL filters by a path-template tree.

A few rules (host suffix, path prefix, verdict) label the URLs they fit.  For all others a tree of
path templates is learned per host: segments become typed tokens (a word, a number, a hash, ...), word
tokens that vary too much below their parent become wildcards, and sibling branches whose verdicts are
statistically alike are merged.  A template's purity is its smoothed share of blocked URLs, each level
shrunk towards its parent, and a URL takes the verdict of the deepest template it reaches.

DataFrame functions only.  The tree is built from counts per (host, template), pre-aggregated before
every shuffle; a hot host is many rows of counts at most once per task, never a task of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import as_row, small_side
from routelens.session import materialize

# The contract's rules: host, path prefix, verdict.
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
#: Levels of the tree (deeper segments share their ancestor's template), observations that a parent's
#: purity weighs, distinct words below one parent from which they become a wildcard, and the standard
#: errors within which sibling branches count as alike.
DEPTH = 4
PRIOR = 4.0
VARIETY = 30
ALIKE = 1.0
THRESHOLD = 0.5


def host_of(url: Column) -> Column:
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substr(url, at + 3), r"^[^/?#]*", 0)
    lowered = F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(at > 0, lowered).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    at = F.instr(url, "://")
    path = F.regexp_extract(F.substr(url, at + 3), r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.when(at > 0, path).otherwise(F.lit(""))


def rule_column(host: Column, path: Column, rules: tuple = RULES) -> Column:
    """The longest rule that fits, as a struct (rule, verdict); null if none does."""
    best = F.lit(None).cast("struct<rule:string,verdict:string>")
    for name, prefix, verdict in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(prefix))
        best = F.when(fits, F.struct(F.lit(name + prefix).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(best)
    return best


def tokens_of(path: Column) -> Column:
    """The path's segments, each a typed token: numbers, hex strings and dates lose their value, file
    names keep their extension, words are kept."""
    def token(s: Column) -> Column:
        ext = F.regexp_extract(s, r"\.([A-Za-z]{1,5})$", 1)
        stem = F.regexp_replace(s, r"\.[A-Za-z]{1,5}$", "")
        kind = (F.when(F.rlike(stem, F.lit(r"^\d{4}-\d{2}(-\d{2})?$")), F.lit("{date}"))
                .when(F.rlike(stem, F.lit(r"^\d+$")), F.lit("{n}"))
                .when(F.rlike(stem, F.lit(r"^[0-9a-fA-F-]{8,}$")), F.lit("{hex}"))
                .when(F.rlike(stem, F.lit(r"\d")), F.lit("{mixed}"))
                .otherwise(F.lower(stem)))
        return F.when(ext != "", F.concat(kind, F.lit("."), F.lower(ext))).otherwise(kind)

    return F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), token)


def template_tree(labelled: DataFrame, depth: int = DEPTH, prior: float = PRIOR, variety: int = VARIETY,
                  alike: float = ALIKE) -> tuple[list[DataFrame], DataFrame]:
    """Per level 1 to ``depth``: (host, parent, token) -> (template, purity); and the hosts' own purity.

    ``labelled`` has host, tokens, weight (URLs), bad (blocked among the labelled), seen (labelled).
    """
    totals = labelled.agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen")).first()
    base = ((totals["bad"] or 0) + 0.5) / ((totals["seen"] or 0) + 1.0)
    hosts = (labelled.groupBy("host").agg(F.sum("bad").alias("bad"), F.sum("seen").alias("seen"))
             .select(F.col("host").alias("h0"),
                     ((F.col("bad") + F.lit(prior * base)) / (F.col("seen") + F.lit(prior))).alias("p0")))
    hosts = materialize(hosts, "url-hosts")
    rows = (labelled.join(small_side(hosts, 80), F.col("host") == F.col("h0")).drop("h0")
            .withColumnsRenamed({"p0": "purity"}).withColumn("template", F.lit("")))
    rows = materialize(rows, "url-level-0")
    levels = []
    for level in range(1, depth + 1):
        here = rows.where(F.size("tokens") >= level).withColumn("token", F.element_at("tokens", level))
        counts = here.groupBy("host", "template", "purity", "token").agg(
            *[F.sum(c).alias(c) for c in ("weight", "bad", "seen")])
        parent = counts.groupBy("host", "template").agg(
            F.sum(F.when(~F.startswith("token", F.lit("{")), 1).otherwise(0)).alias("words"))
        # words that vary become one wildcard
        renamed = (counts.join(parent.withColumnsRenamed({"host": "h1", "template": "t1"}),
                               (F.col("host") == F.col("h1")) & (F.col("template") == F.col("t1")))
                   .withColumn("name", F.when((F.col("words") >= variety) & ~F.startswith("token", F.lit("{")),
                                              F.lit("*")).otherwise(F.col("token"))))
        branch = renamed.groupBy("host", "template", "purity", "name").agg(F.sum("bad").alias("b"), F.sum("seen").alias("n"))
        # siblings alike: the labelled share of a branch, and its distance from its parent's in standard
        # errors, fall into the same class; one merged branch pools the class (branches without labels
        # are a class of their own, with the parent's purity)
        error = F.sqrt(F.greatest(F.col("purity") * (1 - F.col("purity")), F.lit(0.01)) / F.greatest("n", F.lit(1)))
        z = (F.col("b") / F.greatest("n", F.lit(1)) - F.col("purity")) / error
        side = F.when(F.col("n") == 0, "unlabelled").when(z > alike, "worse").when(z < -alike, "better").otherwise("alike")
        sided = branch.withColumn("side", side)
        merged = sided.groupBy(F.col("host").alias("h2"), F.col("template").alias("t2"), F.col("side").alias("s2")).agg(
            F.sum("b").alias("mb"), F.sum("n").alias("mn"))
        names = (sided.join(merged, (F.col("host") == F.col("h2")) & (F.col("template") == F.col("t2"))
                            & (F.col("side") == F.col("s2")))
                 .select(F.col("host").alias("h3"), F.col("template").alias("t3"), F.col("name").alias("n3"),
                         F.concat("template", F.lit("/"), F.col("side")).alias("next"),
                         ((F.col("mb") + prior * F.col("purity")) / (F.col("mn") + prior)).alias("next_purity")))
        table = (renamed.select("host", "template", "token", "name")
                 .join(names, (F.col("host") == F.col("h3")) & (F.col("template") == F.col("t3")) & (F.col("name") == F.col("n3")))
                 .select(F.col("host").alias("h4"), F.col("template").alias("t4"), F.col("token").alias("k4"), "next", "next_purity"))
        table = materialize(table, f"url-level-{level}-templates")
        levels.append(table)
        rows = materialize(_descend(rows, table, level), f"url-level-{level}")
    return levels, rows


def _descend(rows: DataFrame, table: DataFrame, level: int) -> DataFrame:
    """Rows with a token at ``level`` move on to the template of the branch they take."""
    token = F.when(F.size("tokens") >= level, F.element_at("tokens", level))
    on = ((F.col("host") == F.col("h4")) & (F.col("template") == F.col("t4")) & (token == F.col("k4")))
    return (rows.join(small_side(table, 160), on, "left")
            .withColumn("template", F.coalesce("next", "template"))
            .withColumn("purity", F.coalesce("next_purity", "purity"))
            .drop("h4", "t4", "k4", "next", "next_purity"))


def judge(pages: DataFrame, rules: tuple = RULES, depth: int = DEPTH, prior: float = PRIOR, variety: int = VARIETY,
          alike: float = ALIKE, threshold: float = THRESHOLD) -> DataFrame:
    """``__row`` (the input row), host, path, rule, verdict, template and purity of every row of ``pages``.

    A null url, or one without ``://``, has an empty host and path.  Without any labelled URL the base
    purity is a half and unruled URLs are allowed (the verdict is block above ``threshold`` only).
    Rows that repeat are judged alike; an empty table gives no rows.
    """
    url = F.coalesce(F.col("__row.url"), F.lit(""))
    rows = (as_row(pages).select("__row", host_of(url).alias("host"), path_of(url).alias("path"))
            .withColumn("fit", rule_column(F.col("host"), F.col("path"), rules))
            .withColumn("tokens", F.slice(tokens_of(F.col("path")), 1, depth)))
    # one row per (host, tokens): copies of a URL, and URLs that differ in numbers only, are counted once per task
    shapes = rows.groupBy("host", "tokens").agg(
        F.count(F.lit(1)).alias("weight"),
        F.sum(F.when(F.col("fit.verdict") == "block", 1).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("fit").isNotNull(), 1).otherwise(0)).alias("seen"))
    _, judged = template_tree(materialize(shapes, "url-shapes"), depth, prior, variety, alike)
    verdicts = judged.select(F.col("host").alias("h5"), F.col("tokens").alias("k5"), "template", "purity")
    return (rows.join(small_side(verdicts, 200), (F.col("host") == F.col("h5")) & (F.col("tokens") == F.col("k5")))
            .select("__row", "host", "path", F.col("fit.rule").alias("rule"),
                    F.coalesce(F.col("fit.verdict"),
                               F.when(F.col("purity") > threshold, "block").otherwise("allow")).alias("verdict"),
                    "template", "purity"))


def url_digest(pages: DataFrame, **params) -> DataFrame:
    return judge(pages, **params).select("__row.page_id", "host", "path", "rule", "verdict", "template", "purity")
