"""URL rules and redirect equivalence, in DataFrame operations only.

A rule is a host with its subdomains and a start of the path; the longest that
fits a url decides it. Urls that redirect to each other or share a canonical
link are aliases: connected components over those edges. A url that no rule
fits takes over from its aliases: allow if a rule allows one of them, else
block if a rule blocks one, else allow. A rule's own verdict always holds.

Edges come from canonical links and refresh redirects in the pages, and from a
table of redirects if there is one. Nodes are urls without scheme and fragment.
Components are found over edges only, so pages without links cost a scan.

A null url, or one without "://", has no host and no path, fits no rule and has
no aliases. Repeated pages get a row each. Empty tables give an empty result.
Columns of the input named like added ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spandrel.runtime import materialise

from .components import components

#: Up to so many rules stand in the plan as literals; more are joined.
INLINE_RULES = 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)([^#]*)"


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def node(url: Column) -> Column:
    """A url's node; null if it has no host."""
    h = host(url)
    return F.when(h != "", F.concat(h, F.regexp_extract(url, _URL, 2), F.regexp_extract(url, _URL, 3)))


def _suffixes(h: Column) -> Column:
    """A host and the domains it is in."""
    labels = F.split(h, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."))


def decide(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """``rows`` (with host and path) and columns rule and action, null where no rule fits.

    ``rules`` has action, host and path; of equally long rules that fit, allow wins, then the greater host.
    """
    rules = rules.select("action", "host", "path").distinct()
    n = rules.count()
    if n <= INLINE_RULES:  # counted: at most that many rows come to the driver
        found = [(len(r["host"]) + len(r["path"]), r["action"], r["host"], r["path"]) for r in rules.collect()]
        rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
        for _, a, h, p in sorted(found, key=lambda x: (x[0], x[1] == "allow", x[2:])):
            fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
            rule, action = F.when(fits, h + p).otherwise(rule), F.when(fits, a).otherwise(action)
        return rows.withColumns({"rule": rule, "action": action})
    # Verdicts by distinct host and path; each looks up its domains with the starts of its path that rules have by
    # their length, so a domain with many rules meets a place only in those that fit.
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())  # as many as the longest path at most
    places = rows.select("host", "path").where("host <> ''").distinct()
    starts = F.transform(F.filter(F.lit(lengths), lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))
    looked = places.select("host", "path", starts.alias("starts"), F.explode(_suffixes(F.col("host"))).alias("suffix")).select("host", "path", "suffix", F.explode("starts").alias("start"))
    met = looked.join(rules.select("action", F.col("host").alias("suffix"), F.col("path").alias("start")), ["suffix", "start"])
    best = F.max_by(F.struct(F.concat("suffix", "start").alias("rule"), "action"), F.struct(F.length("suffix") + F.length("start"), F.col("action") == "allow", "suffix", "start"))
    verdicts = met.groupBy("host", "path").agg(best.alias("b")).select("host", "path", "b.rule", "b.action")
    return rows.join(verdicts, ["host", "path"], "left")


def _resolved(url: Column, target: Column) -> Column:
    """A link's target as an absolute url."""
    folder = F.regexp_replace(F.when(path(url) == "", "/").otherwise(path(url)), r"[^/]*$", "")
    return (
        F.when(target == "", F.lit(None).cast("string"))
        .when(target.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), target)
        .when(target.startswith("//"), F.concat(F.lit("x:"), target))
        .when(target.startswith("/"), F.concat(F.lit("x://"), host(url), target))
        .otherwise(F.concat(F.lit("x://"), host(url), folder, target))
    )


def page_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Edges (a, b) of canonical links and refresh redirects."""
    html, url = F.col(html_col), F.col(url_col)
    canonical = F.regexp_extract(F.regexp_extract(html, r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical\b[^>]*>""", 0), r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)""", 1)
    refresh = F.regexp_extract(F.regexp_extract(html, r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh\b[^>]*>""", 0), r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)""", 1)
    links = pages.select(url.alias("u"), F.explode(F.array(canonical, refresh)).alias("t")).where("t <> ''")
    return links.select(node(F.col("u")).alias("a"), node(_resolved(F.col("u"), F.col("t"))).alias("b"))


def judge(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, key: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """key, host, path, rule, verdict and inherited (whether the verdict came from an alias).

    ``redirects`` has columns src and dst.
    """
    edges = page_links(pages, url_col, html_col)
    if redirects is not None:
        edges = edges.unionByName(redirects.select(node(F.col("src")).alias("a"), node(F.col("dst")).alias("b")))
    found = components(edges)
    placed = found.withColumn("u", F.concat(F.lit("x://"), F.col("node")))
    decided = decide(placed.select("node", "component", host(F.col("u")).alias("host"), path(F.col("u")).alias("path")), rules)
    by_component = decided.groupBy("component").agg(F.max((F.col("action") == "allow").cast("int")).alias("allowed"), F.max((F.col("action") == "block").cast("int")).alias("blocked"))
    taken = by_component.select("component", F.when(F.col("allowed") == 1, "allow").when(F.col("blocked") == 1, "block").alias("inherited_action")).where("inherited_action is not null")
    aliases = materialise(found.join(taken, "component").select(F.col("node").alias("__node"), "inherited_action"), "aliases")
    rows = pages.select(F.col(key), F.col(url_col).alias("__url")).select(key, host(F.col("__url")).alias("host"), path(F.col("__url")).alias("path"), node(F.col("__url")).alias("__n"))
    # Pages without a node must not meet in one task.
    rows = decide(rows, rules).withColumn("__node", F.coalesce("__n", F.concat(F.lit(" "), F.xxhash64(key).cast("string"))))
    joined = rows.join(aliases, "__node", "left")
    return joined.select(key, "host", "path", "rule", F.coalesce("action", "inherited_action", F.lit("allow")).alias("verdict"), (F.col("action").isNull() & F.col("inherited_action").isNotNull()).alias("inherited"))


RULES = T.StructType([T.StructField(c, T.StringType()) for c in ("action", "host", "path")])


def rules_frame(spark, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A table of rules from (action, host, path)."""
    values = ", ".join("('" + "', '".join(x.replace("\\", "\\\\").replace("'", "\\'") for x in r) + "')" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {values} AS r(action, host, path)")
