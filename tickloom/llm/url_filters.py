"""URL verdicts by rules and, where none fits, by a tree of path templates.

Host and path are cut from the text after the first ``://``; a null URL, or one without it, has
both empty. A rule such as ``example.org/en/`` fits its host, all subdomains, and paths that start
with its path; the longest fitting rule decides, ties by code point.

Where no rule fits, the path's template decides. Per host, paths are read segment by segment. A
number or a long hexadecimal string is a variable segment, ``*``. Any other segment keeps its name
if at least ``SUPPORT * 2**depth`` pages take it and they are one in ``MOST_BRANCHES`` or more of
the pages at its parent; the rest are generalised into ``*`` too. Where these do not reach that support together,
the path ends in ``**``: a tree is as deep as its pages bear, and the depth grows with the logarithm
of their number at most.

Pages that a rule has judged are the labels. From the host down, siblings whose shares of blocked
labels do not differ are merged: in order of share, a branch joins the one before it unless the
difference passes ``DEVIATIONS`` standard deviations. A merged branch's purity is its share of
blocked labels, smoothed towards its parent's by ``STRENGTH`` labels; where it does not differ from
the parent's, or there are no labels, it takes the parent's. Hosts are compared with all labels and
are not siblings; a host without labels has no purity. Templates are rejected where more than
``REJECT`` of the smoothed labels are blocked.

Counts are combined per host and path before any shuffle, and per node below, so a host with most
pages leaves no large group. Repeated rows and null ids come back one row each; an empty table
gives no rows; other columns are not read. All of it is DataFrame functions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import stored

SUPPORT, MOST_BRANCHES = 4, 20
STRENGTH, DEVIATIONS, REJECT = 10.0, 2.0, 0.5
#: Levels of the tree between two working tables.
LEVELS_AT_ONCE = 4
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
VARIABLE = r"\A([*]+|[0-9]+([.][A-Za-z0-9]+)?|[0-9a-fA-F-]{16,})\z"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

Rule = tuple[str, str]


def host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def fitting(rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits the columns ``host`` and ``path``, and its verdict; else null."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        place, _, rest = text.partition("/")
        fits = ((F.col("host") == place) | F.col("host").endswith("." + place)) & F.col("path").startswith("/" + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def depth(paths: DataFrame) -> int:
    """Levels that the tree of ``paths`` (path, host, pages) can have, by longest path and largest host."""
    hosts = paths.groupBy("host").agg(F.sum("pages").alias("pages"), F.max(F.size(F.split("path", "/"))).alias("segments"))
    most = hosts.agg(F.max("pages"), F.max("segments")).first()
    return min(most[1] - 1, max(1, (most[0] // SUPPORT).bit_length())) if most[0] else 0


def templates(paths: DataFrame) -> tuple[DataFrame, int]:
    """``paths`` (host, path, pages, labels, blocked) with ``t0`` .. : the template after each depth."""
    levels = depth(paths)
    out = paths.select("*", F.lit("").alias("t0"), F.lit(True).alias("open"))
    for d in range(1, levels + 1):
        up, raw = f"t{d - 1}", F.get(F.split("path", "/"), F.lit(d))
        out = out.withColumn("segment", F.when(F.col("open"), F.when(raw.rlike(VARIABLE), F.lit("*")).otherwise(raw)))
        branches = out.where("segment IS NOT NULL").groupBy("host", up, "segment").agg(F.sum("pages").alias("through"))
        whole = branches.groupBy("host", up).agg(F.sum("through").alias("whole"))
        named = (F.col("segment") != "*") & (F.col("through") >= SUPPORT << d)
        named = named & (F.col("through") * MOST_BRANCHES >= F.col("whole"))
        kept = branches.join(whole, ["host", up]).groupBy("host", up).agg(
            F.collect_list(F.when(named, F.col("segment"))).alias("names"),
            (F.coalesce(F.sum(F.when(~named, F.col("through"))), F.lit(0)) >= SUPPORT << d).alias("bears"),
        )
        out = out.join(kept, ["host", up], "left")
        by_name = F.array_contains("names", F.col("segment"))
        shown = F.when(by_name, F.col("segment")).when(F.col("bears"), "*").otherwise("**")
        out = out.withColumn(f"t{d}", F.coalesce(F.concat(up, F.lit("/"), F.when(F.col("segment").isNotNull(), shown)), up))
        out = out.withColumn("open", F.coalesce(by_name | F.col("bears"), F.lit(False))).drop("names", "bears", "segment")
        if d % LEVELS_AT_ONCE == 0 and d < levels:
            out = stored(out, "path-templates")
    return stored(out.drop("open"), "path-templates"), levels


def purities(found: DataFrame, levels: int) -> DataFrame:
    """Per host and template: ``purity``, worked out from the host down."""
    columns = [f"t{d}" for d in range(levels + 1)]
    nodes = found.groupBy("host", *columns).agg(F.sum("labels").alias("labels"), F.sum("blocked").alias("blocked"))
    nodes = stored(nodes, "templates")
    overall = nodes.agg(F.sum("blocked").alias("b"), F.sum("labels").alias("n"))
    overall = overall.select(F.coalesce(F.try_divide("b", "n"), F.lit(0.0)).alias("purity"))
    known = nodes.select("host").distinct().join(F.broadcast(overall)).withColumn("up", F.lit("").cast("string"))
    n, b, p = F.col("n"), F.col("b"), F.col("p")
    for d, level in enumerate(columns):
        up = f"t{max(d - 1, 0)}"
        here = nodes.groupBy("host", F.col(up).alias("up"), F.col(level).alias("t")).agg(
            F.sum("labels").cast("double").alias("n"), F.sum("blocked").cast("double").alias("b")
        )
        here = here.join(known.withColumnRenamed("purity", "p"), ["host", "up"])
        if d:
            line = Window.partitionBy("host", "up").orderBy((n == 0) | (F.col("t") == F.col("up")), F.try_divide(b, n), "t")
            m, c = F.lag("n").over(line), F.lag("b").over(line)
            share = F.try_divide(b + c, n + m)
            spread = F.sqrt(share * (1 - share) * (F.try_divide(F.lit(1.0), n) + F.try_divide(F.lit(1.0), m)))
            joins = F.coalesce(F.abs(F.try_divide(b, n) - F.try_divide(c, m)) <= DEVIATIONS * spread, F.lit(False))
            joins = joins & (F.col("t") != F.col("up"))
            here = here.withColumn("alone", F.when(joins, 0).otherwise(1))
            here = here.withColumn("pool", F.sum("alone").over(line.rowsBetween(Window.unboundedPreceding, 0)))
            pool = Window.partitionBy("host", "up", "pool")
            here = here.withColumn("n", F.sum("n").over(pool)).withColumn("b", F.sum("b").over(pool))
        same = (n == 0) | (F.abs(F.try_divide(b, n) - p) <= DEVIATIONS * F.try_divide(F.sqrt(p * (1 - p)), F.sqrt(n)))
        if d:
            same = same | (F.col("t") == F.col("up"))
        own = (b + STRENGTH * p) / (n + STRENGTH)
        purity = F.when(same, p).otherwise(own)
        if not d:
            purity = F.when(n > 0, purity)
        known = here.select("host", F.col("t").alias("up"), purity.alias("purity"))
        if d and d % LEVELS_AT_ONCE == 0:
            known = stored(known, "purities")
    return known.withColumnRenamed("up", "template")


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, template (null where a rule fits)."""
    url = pages[url_col].cast("string")
    cut = pages.select(pages[id_col].alias("page_id"), host(url).alias("host"), path(url).alias("path"))
    rule, verdict = fitting(rules)
    cut = cut.select("*", rule.alias("rule"), verdict.alias("ruled"))
    paths = cut.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count("ruled").alias("labels"),
        F.count_if(F.col("ruled") == "block").alias("blocked"),
    )
    found, levels = templates(stored(paths, "paths"))
    leaves = found.select("host", "path", F.col(f"t{levels}").alias("template"))
    judged = leaves.join(purities(found, levels), ["host", "template"])
    says = F.coalesce("ruled", F.when(F.col("purity") > REJECT, "block").otherwise("allow"))
    template = F.when(F.col("rule").isNull(), F.col("template"))
    return cut.join(judged, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", says.alias("verdict"), template.alias("template")
    )


def oracle(rules: Sequence[Rule]) -> str:
    """The same in DuckDB's SQL, over ``pages`` (page_id, url)."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    whens = {"rule": "", "ruled": ""}
    for r, says in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        place, _, rest = r.partition("/")
        fits = f"(host = {text(place)} OR ends_with(host, {text('.' + place)})) AND starts_with(path, {text('/' + rest)})"
        whens["rule"] += f" WHEN {fits} THEN {text(r)}"
        whens["ruled"] += f" WHEN {fits} THEN {text(says)}"
    steps = [
        f"""cut AS (SELECT page_id, translate(coalesce(regexp_extract(url, '{URL}', 1), ''), '{UPPER}', '{LOWER}') AS host,
            coalesce(regexp_extract(url, '{URL}', 2), '') AS path FROM pages)""",
        f"ruled AS (SELECT *, CASE {whens['rule']} END AS rule, CASE {whens['ruled']} END AS ruled FROM cut)",
        """paths AS (SELECT host, path, count(*) AS pages, count(ruled) AS labels, count(*) FILTER (ruled = 'block') AS blocked
            FROM ruled GROUP BY host, path)""",
        f"""tree AS (
            SELECT 0 AS d, host, path, pages, labels, blocked, '' AS up, '' AS t, TRUE AS open FROM paths
            UNION ALL
            SELECT d + 1, host, path, pages, labels, blocked, t,
                t || '/' || CASE WHEN named THEN segment WHEN bears THEN '*' ELSE '**' END, named OR bears
            FROM (SELECT *, coalesce(sum(pages) FILTER (NOT named) OVER (PARTITION BY host, t), 0) >= {SUPPORT} << (d + 1) AS bears
                FROM (SELECT *, segment <> '*' AND through >= {SUPPORT} << (d + 1) AND through * {MOST_BRANCHES} >= whole AS named
                    FROM (SELECT *, sum(pages) OVER (PARTITION BY host, t, segment) AS through,
                            sum(pages) OVER (PARTITION BY host, t) AS whole
                        FROM (SELECT *, CASE WHEN regexp_matches(raw, '{VARIABLE}') THEN '*' ELSE raw END AS segment
                            FROM (SELECT *, string_split(path, '/')[d + 2] AS raw FROM tree WHERE open) WHERE raw IS NOT NULL)))))""",
        "leaves AS (SELECT host, path, max_by(t, d) AS template FROM tree GROUP BY host, path)",
        """nodes AS (SELECT d, host, up, t, sum(labels)::DOUBLE AS n, sum(blocked)::DOUBLE AS b FROM tree GROUP BY d, host, up, t)""",
        f"""pure AS (
            SELECT 0 AS d, host, '' AS t, CASE WHEN n = 0 THEN NULL WHEN abs(b / n - p) <= {DEVIATIONS} * (sqrt(p * (1 - p)) / sqrt(n))
                THEN p ELSE (b + {STRENGTH} * p) / (n + {STRENGTH}) END AS purity
            FROM nodes, (SELECT coalesce(sum(blocked)::DOUBLE / nullif(sum(labels), 0), 0) AS p FROM paths) WHERE d = 0
            UNION ALL
            SELECT d, host, t, CASE WHEN n = 0 OR abs(b / n - p) <= {DEVIATIONS} * (sqrt(p * (1 - p)) / sqrt(n))
                THEN p ELSE (b + {STRENGTH} * p) / (n + {STRENGTH}) END
            FROM (SELECT d, host, t, p, sum(n) OVER (PARTITION BY host, up, pool) AS n, sum(b) OVER (PARTITION BY host, up, pool) AS b
                FROM (SELECT *, sum(alone) OVER (PARTITION BY host, up ORDER BY n = 0, b / nullif(n, 0), t ROWS UNBOUNDED PRECEDING) AS pool
                    FROM (SELECT *, CASE WHEN abs(b / nullif(n, 0) - c / nullif(m, 0)) <= {DEVIATIONS} * sqrt((b + c) / nullif(n + m, 0)
                                * (1 - (b + c) / nullif(n + m, 0)) * (1.0::DOUBLE / nullif(n, 0) + 1.0::DOUBLE / nullif(m, 0)))
                            THEN 0 ELSE 1 END AS alone
                        FROM (SELECT o.*, u.purity AS p, lag(n) OVER line AS m, lag(b) OVER line AS c
                            FROM pure u JOIN nodes o ON o.d = u.d + 1 AND o.host = u.host AND o.up = u.t
                            WINDOW line AS (PARTITION BY o.host, o.up ORDER BY n = 0, b / nullif(n, 0), o.t))))))""",
    ]
    return f"""WITH RECURSIVE {", ".join(steps)}
        SELECT page_id, r.host, r.path, rule,
            coalesce(ruled, CASE WHEN purity > {REJECT} THEN 'block' ELSE 'allow' END) AS verdict,
            CASE WHEN rule IS NULL THEN template END AS template
        FROM ruled r JOIN leaves l ON r.host = l.host AND r.path = l.path
            JOIN (SELECT DISTINCT host, t, purity FROM pure) k ON k.host = l.host AND k.t = template"""
