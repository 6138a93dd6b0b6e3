"""URL filter: fixed rules first, then trust and distrust spread over the link graph.

Pages that a rule allows make their host a trusted seed, pages that a rule
blocks make it a blocked seed. Trust and ordinary rank flow along links between
hosts, distrust against them (a host that links to a blocked one becomes
suspect): personalised PageRank, with the seeds as restart vectors. Pages no
rule fits get the verdict of their host: blocked where distrust outweighs trust
and ordinary rank together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from framewright.operators.lookups import lookup_join
from framewright.session import reliable

# Fixed values: (verdict, host, path).
RULES = (
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
)
DAMPING = 0.85
# Mass of all three ranks on its way below which spreading ends.
TOLERANCE = 1e-12
# Steps of one written stage, after which the mass on its way is looked at.
STEPS = 8
# Share of distrust in all rank of a host from which it is blocked.
THRESHOLD = 0.5

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(F.coalesce(host, F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) of the longest rule that fits, else null; equal lengths go by text."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    fits = [
        F.when(
            ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p)),
            F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")),
        )
        for v, h, p in ordered
    ]
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame, host: str, html: str) -> DataFrame:
    """(src, dst, n): links between different hosts, counted on each task before the shuffle."""
    found = F.regexp_extract_all(
        html, F.lit(r"(?i)<a\s[^>]*?href\s*=\s*[\"']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), 1
    )
    targets = pages.filter(F.col(html).contains("//")).select(
        F.col(host).alias("src"), F.explode(found).alias("url")
    )
    absolute = F.when(F.startswith("url", F.lit("//")), F.concat(F.lit("http:"), F.col("url"))).otherwise(
        F.col("url")
    )
    return (
        targets.withColumn("dst", host_of(absolute))
        .filter("dst <> '' and src <> '' and dst <> src")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("n"))
    )


def _weighted(links: DataFrame, start: str, end: str) -> DataFrame:
    """(start, end, weight): shares of the links of each start."""
    totals = links.groupBy(F.col(start).alias("h")).agg(F.sum("n").alias("total"))
    return links.join(totals, F.col(start) == F.col("h")).select(
        F.col(start).alias("start"), F.col(end).alias("end"), (F.col("n") / F.col("total")).alias("weight")
    )


def _edges(links: DataFrame) -> DataFrame:
    """(start, end, onward, back, own): what a step passes along each link, against it, and keeps."""
    zero, one = F.lit(0.0), F.lit(1.0)

    def parts(df: DataFrame, onward: Column, back: Column, own: Column) -> DataFrame:
        return df.select("start", "end", onward.alias("onward"), back.alias("back"), own.alias("own"))

    ends = links.select(F.col("src").alias("start")).unionAll(links.select("dst")).distinct()
    every = (
        parts(_weighted(links, "src", "dst"), F.col("weight"), zero, zero)
        .unionAll(parts(_weighted(links, "dst", "src"), zero, F.col("weight"), zero))
        .unionAll(parts(ends.withColumn("end", F.col("start")), zero, zero, one))
    )
    return every.groupBy("start", "end").agg(*[F.sum(c).alias(c) for c in ("onward", "back", "own")])


def spread(
    seeds: DataFrame, links: DataFrame, tolerance: float = TOLERANCE, steps: int = STEPS
) -> DataFrame:
    """Trust, rank and distrust of every host.

    ``seeds``: host, and restart masses s_trust, s_rank, s_distrust (each sums to
    1, or to 0 where there are no seeds). Hosts known from links alone have none.
    A step joins what the last one brought with the links, adds it up by host
    and passes it on, until that is less than ``tolerance`` in all; it falls by
    DAMPING at least. ``steps`` of them make one written stage. A host without
    links on keeps its rank, which is a link to itself: summed at once, not step
    by step. Hosts without any link take no part in the steps.
    """
    names = ("trust", "rank", "distrust")
    edges = reliable(_edges(links))
    linked = edges.groupBy("start").agg(
        (F.max("onward") > 0).alias("goes_on"), (F.max("back") > 0).alias("goes_back")
    )
    starts = linked.join(seeds, F.col("start") == F.col("host"), "left")
    first = [(F.coalesce(f"s_{c}", F.lit(0.0)) * (1 - DAMPING)).alias(c) for c in names]
    state = starts.select(F.col("start").alias("at"), *first).select(
        "at", *names, *[F.col(c).alias(f"new_{c}") for c in names]
    )
    along = {"trust": "onward", "rank": "onward", "distrust": "back"}
    while True:
        for _ in range(steps):
            moved = state.join(edges, F.col("at") == F.col("start")).groupBy(F.col("end").alias("at")).agg(
                *[F.sum(F.col(c) * F.col("own")).alias(c) for c in names],
                *[(F.sum(F.col(f"new_{c}") * F.col(along[c])) * DAMPING).alias(f"new_{c}") for c in names],
            )
            sums = [(F.col(c) + F.col(f"new_{c}")).alias(c) for c in names]
            state = moved.select("at", *sums, *[f"new_{c}" for c in names])
        left = Observation()
        mass = F.sum(F.col("new_trust") + F.col("new_rank") + F.col("new_distrust"))
        state = reliable(state.observe(left, mass.alias("mass")))
        if (left.get["mass"] or 0) < tolerance:
            break
    kept = {"trust": "goes_on", "rank": "goes_on", "distrust": "goes_back"}
    solved = state.join(linked, F.col("at") == F.col("start")).select(
        F.col("at").alias("host"),
        *[F.when(F.col(kept[c]), F.col(c)).otherwise(F.col(c) / (1 - DAMPING)).alias(c) for c in names],
    )
    alone = seeds.join(linked.select("start"), F.col("host") == F.col("start"), "left_anti")
    return alone.select("host", *[F.col(f"s_{c}").alias(c) for c in names]).unionAll(solved)


def judge(
    pages: DataFrame,
    rules=RULES,
    threshold: float = THRESHOLD,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
) -> DataFrame:
    """page_id, host, path, rule, verdict and the host's scores, one row per page.

    A null URL or one without ``://`` has an empty host and path; the empty
    host is judged like any other, but takes no part in links. A null html has
    no links. Repeated rows count as often as they come. Where nothing is
    blocked by a rule, the method blocks nothing. Host tables are skinny; hosts
    with a large share of the pages are looked up by broadcast, others by shuffle.
    """
    judged = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    judged = judged.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    judged = judged.withColumn("by", rule_of(F.col("host"), F.col("path"), rules))
    counts = reliable(
        judged.groupBy("host").agg(
            F.count("*").alias("pages"),
            F.count_if(F.col("by.verdict") == "allow").alias("allowed"),
            F.count_if(F.col("by.verdict") == "block").alias("blocked"),
        )
    )
    totals = counts.agg(F.sum("pages"), F.sum("allowed"), F.sum("blocked")).first()
    pages_n, allowed_n, blocked_n = [max(t or 0, 1) for t in totals]
    seeds = counts.select(
        "host",
        (F.col("allowed") / allowed_n).alias("s_trust"),
        (F.col("pages") / pages_n).alias("s_rank"),
        (F.col("blocked") / blocked_n).alias("s_distrust"),
    )
    links = reliable(host_links(judged, "host", "html"))
    ranks = spread(seeds, links)
    total = F.col("trust") + F.col("rank") + F.col("distrust")
    share = F.when(total > 0, F.col("distrust") / total).otherwise(F.lit(0.0))
    scores = reliable(
        counts.join(ranks, "host").select(
            F.col("host").alias("key"), share.alias("value"), F.col("pages").alias("occurrences")
        )
    )
    skinny = judged.select(
        "page_id", "host", "path", F.col("by.rule").alias("rule"), F.col("by.verdict").alias("ruled")
    )
    found = lookup_join(skinny, "host", scores, "distrust_share")
    method = F.when(F.col("distrust_share") > threshold, F.lit("block")).otherwise(F.lit("allow"))
    return found.select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), "distrust_share"
    )
