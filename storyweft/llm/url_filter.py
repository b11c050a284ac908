"""URL verdicts by rules and, where none fits, by link-graph propagation over hosts.

A page's links to other hosts become host edges, summed up per pair before anything else, so a
host with any number of pages is a few rows; where pages meet their host's rank, those of hot hosts
are salted. Trust is a personalised PageRank from hosts with
pages that the rules allow, along the links; distrust is one from hosts with pages that the rules
block, against the links (who links to a blocked host is suspect). A host keeps ``1 - damping`` of
its own seed and passes the rest on by link counts; what has nowhere to go is lost. A host's pages
without a rule are blocked if its distrust is above ``ratio`` times its trust; a host that neither
reached is allowed. Ranks are compared as they are, and rounds go on until no rank changes by more
than a tiny share of its size, however far a host is from the seeds.

Null urls, and those without ``://``, have an empty host and path; they fit no rule and, having no
links to or from them, are allowed. Of rules of equal length that fit, the one later in the alphabet
holds. Repeated rows stay, a missing page_id stays missing. An empty table gives an empty result.
Null or empty html has no links; urls and html of any length are read whole. Only page_id, url and
html are read. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from storyweft.llm.columns import cut, table

#: (verdict, host and path) of each rule.
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Ranks count as settled when none changes by more than DAMPING ** ROUNDS of its size in a round.
DAMPING, ROUNDS, CUT_EVERY, RATIO = 0.85, 150, 4, 1.0
#: Share by which distrust has to be above; sums of doubles differ by less.
MARGIN = 1e-9
#: Hosts with more than one in SALTS of all pages are dealt, where their pages meet their rank, into
#: parts of about that size.
SALTS = 1000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']?([^"'\s>]+)"""


def _rest(url: Column) -> Column:
    """What follows the first ``://``; null if there is none."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _first_fit(host: Column, path: Column, rules, give) -> Column:
    """give(rule) of the longest rule that fits, else null; rules are a short list of parameters."""
    out = F.lit(None).cast("string")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(path, F.lit(slash + rest))
        out = F.when(fits, F.lit(give(verdict, rule))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """(src, dst, links) between different hosts."""
    links = pages.select(F.col("host").alias("src"), F.explode(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))).alias("href"))
    absolute = F.when(F.startswith("href", F.lit("//")), F.concat(F.lit("http:"), "href")).otherwise(F.col("href"))
    return links.select("src", host_of(absolute).alias("dst")).where("dst <> '' AND src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("links"))


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from edges (src, dst, links) and seeds (host, good, bad), whose good
    and bad each add up to 1 or 0. Both walks advance in one join per round, until the largest change
    of a rank is below damping ** rounds of it."""
    walk = lambda kind, a, b: edges.select(F.lit(kind).alias("kind"), F.col(a).alias("host"), F.col(b).alias("to"), "links")
    steps = walk("good", "src", "dst").union(walk("bad", "dst", "src"))
    out_of = steps.groupBy("kind", "host").agg(F.sum("links").alias("total"))
    steps = cut(steps.join(out_of, ["kind", "host"]).select("kind", "host", "to", (F.col("links") / F.col("total")).alias("share")))
    start = cut(seeds.select("host", F.inline(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("seed")) for k in ("good", "bad"))))).where("seed > 0"))
    ranks = start.select("kind", "host", F.col("seed").alias("rank"))
    if not steps.isEmpty():
        change, i = 1.0, 0
        while change > damping**rounds:
            moved = steps.join(ranks, ["kind", "host"]).select("kind", F.col("to").alias("host"), (F.col("share") * F.col("rank") * damping).alias("rank"), F.lit(0.0).alias("was"))
            stayed = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"), F.lit(0.0).alias("was"))
            before = ranks.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))
            last = i % CUT_EVERY == CUT_EVERY - 1
            met = moved.union(stayed)
            met = met.union(before) if last else met
            ranks = met.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")).where("rank > 0 OR was > 0")
            if last:
                ranks = cut(ranks)
                change = ranks.agg(F.max(F.abs(F.col("rank") - F.col("was")) / F.greatest("rank", "was"))).first()[0] or 0.0
            ranks, i = ranks.select("kind", "host", "rank"), i + 1
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return ranks.groupBy("host").agg(of("good").alias("trust"), of("bad").alias("distrust"))


def judge(pages: DataFrame, rules=RULES, ratio: float = RATIO) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for each row of pages."""
    placed = pages.select("page_id", "html", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    fit = lambda give: _first_fit(F.col("host"), F.col("path"), rules, give)
    ruled = cut(placed.select("page_id", "host", "path", fit(lambda v, r: r).alias("rule"), fit(lambda v, r: v).alias("ruled")))
    sums = cut(ruled.groupBy("host").agg(F.count("*").alias("n"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad")))
    whole = sums.agg(F.sum("n").alias("all"), F.sum("good").alias("all_good"), F.sum("bad").alias("all_bad")).first()
    share = lambda n, total: F.col(n) / F.lit(float(total or 1))
    seeds = sums.select("host", share("good", whole["all_good"]).alias("good"), share("bad", whole["all_bad"]).alias("bad"))
    ranks = propagate(host_edges(placed), seeds)
    trust, distrust = (F.coalesce(c, F.lit(0.0)) for c in ("trust", "distrust"))
    verdict = F.coalesce("ruled", F.when(distrust > ratio * trust * (1 + MARGIN), "block").otherwise("allow"))
    part = max(1.0, (whole["all"] or 0) / SALTS)
    hot = F.broadcast(sums.where(F.col("n") > part).select("host", F.ceil(F.col("n") / part).cast("int").alias("salts")))  # SALTS rows at most
    salts = F.coalesce("salts", F.lit(1))
    salted = ruled.join(hot, "host", "left").withColumn("salt", F.pmod(F.xxhash64("page_id", "path"), salts).cast("int")).drop("salts")
    spread = ranks.join(hot, "host", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    return salted.join(spread, ["host", "salt"], "left").select("page_id", "host", "path", "rule", verdict.alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
