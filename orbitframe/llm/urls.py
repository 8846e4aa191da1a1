"""URL verdicts: host and path rules, and trust and distrust propagated over links between hosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from orbitframe.llm.blocks import join_spread
from orbitframe.session import cut_lineage, read_table

#: (verdict, host suffix, path prefix); a rule's name is its host and path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Damping, what of the ranks may be missing in all when the iteration stops, and rounds before giving up.
DAMPING, TOLERANCE, MAX_ROUNDS = 0.85, 1e-6, 400


def _lower_ascii(c: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(c, upper, upper.lower())


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(_lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ? or #; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, null if none does.

    A rule fits its host and all subdomains if the path starts with the rule's path. Of rules of the
    same length the one given first wins.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(reversed(rules), key=lambda r: len(r[1] + r[2])):  # the longest, of equals the first given, is tried first, so it is wrapped last
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def host_links(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(src, dst, n): links of pages of host src to other hosts, by absolute or //-relative href or src.

    Counted before the shuffle, so a host or link in very many pages makes few rows.
    """
    found = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?i)\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.\-]*:)?//[^"'\s>]+)"""), 1)
    e = pages.select(url_host(F.col(url_col)).alias("src"), F.explode(found).alias("to"))
    whole = F.when(F.col("to").startswith("//"), F.concat(F.lit("x:"), "to")).otherwise(F.col("to"))
    e = e.select("src", url_host(whole).alias("dst"))
    return e.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def personalised_pagerank(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, rank) at the fixed point; edges (src, dst, n), seeds (host, seed >= 0).

    A walker follows links by their counts with probability ``damping``, else, or from a host without
    links, jumps to a seed. Only hosts that a seed reaches have rows; without seeds there are none.

    Walks that start at the seeds are summed by length: what a round adds is the last one's addition, moved on. Walks from hosts without links end
    there; that they go on from the seeds only scales all ranks, so ranks are scaled to a sum of one. Each round adds at most ``damping`` times
    the last one's, so rounds stop when all that is to come, times the seeds' mass, is below ``tolerance``.
    """
    total = seeds.agg(F.sum("seed")).first()[0] or 0.0
    if total <= 0:
        return seeds.select("host", F.lit(0.0).alias("rank")).where("false")
    added = cut_lineage(seeds.where("seed > 0").select("host", (F.col("seed") / total).alias("rank")))
    out = edges.groupBy("src").agg(F.sum("n").alias("all"))
    step = cut_lineage(edges.join(out, "src").select("src", "dst", (F.col("n") / F.col("all") * damping).alias("p")))
    if step.isEmpty():
        return added  # from every host the walker jumps to a seed
    ranks, mass = added, 1.0
    for k in range(MAX_ROUNDS):
        added = added.join(step, F.col("host") == F.col("src")).groupBy(F.col("dst").alias("host")).agg(F.sum(F.col("rank") * F.col("p")).alias("rank"))
        added = cut_lineage(added)
        more = added.agg(F.sum("rank")).first()[0] or 0.0
        mass += more
        ranks = ranks.unionByName(added)
        if more * damping / (1 - damping) * total < tolerance:
            break
        if k % 16 == 15:
            ranks = cut_lineage(ranks.groupBy("host").agg(F.sum("rank").alias("rank")))
    else:
        raise RuntimeError(f"ranks did not settle in {MAX_ROUNDS} rounds")
    return ranks.groupBy("host").agg((F.sum("rank") / mass).alias("rank"))


def host_scores(pages: DataFrame, edges: DataFrame) -> DataFrame:
    """(host, n, trust, distrust) from the verdicts that rules give; pages (host, ruled); n: a host's pages.

    A host is a trusted seed by the share of its pages that a rule allows, and a distrusted one by
    the share that a rule blocks. Trust follows links, distrust runs against them: who links to
    a distrusted host gets part of its distrust. Both are scaled so that a lone full seed has about 1.
    """
    by = pages.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("a"), F.count_if(F.col("ruled") == "block").alias("b"))
    by = cut_lineage(by)
    mass = by.agg(F.sum(F.col("a") / F.col("n")), F.sum(F.col("b") / F.col("n"))).first()
    good = personalised_pagerank(edges, by.select("host", (F.col("a") / F.col("n")).alias("seed")))
    bad = personalised_pagerank(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"), by.select("host", (F.col("b") / F.col("n")).alias("seed")))
    s = by.select("host", "n").join(good.select("host", (F.col("rank") * (mass[0] or 0.0)).alias("trust")), "host", "left")
    s = s.join(bad.select("host", (F.col("rank") * (mass[1] or 0.0)).alias("distrust")), "host", "left")
    return s.select("host", "n", F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def url_verdicts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = 0.1) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every row of pages.

    The longest fitting rule decides. For other urls the host does: it is blocked if its distrust
    exceeds its trust by ``threshold`` or more, else allowed. Null urls and those without :// have
    the empty host, which no rule fits and which is allowed; null ids and repeated rows stay. Null
    html has no links; html and urls of any length are read whole. Other columns may have any names. An
    empty table gives no rows. A host may have any number of pages (see blocks.join_spread).
    """
    p = pages.select(F.col(id_col).cast("long").alias("id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    name, ruled = matched_rule(F.col("host"), F.col("path"), rules)
    p = p.withColumns({"rule": name, "ruled": ruled})
    edges = cut_lineage(host_links(pages, url_col, html_col))
    scores = host_scores(p.where("host <> ''"), edges)
    out = join_spread(p.withColumn("at", F.nullif("host", F.lit(""))), scores.withColumnRenamed("host", "at"), "at", "n", "id", "path")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    verdict = F.coalesce("ruled", F.when(distrust - trust >= threshold, "block").otherwise("allow"))
    return out.select("id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = url_verdicts(read_table(spark, sf_dir, "pages"))
    return v.select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict", F.round("trust", 9).alias("trust"), F.round("distrust", 9).alias("distrust"))
