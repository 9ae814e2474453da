"""List ranking: every page that leads on to one other gets a chain and a rank, once for all starts.

A page is continued by one of the pages that lead to it (the smallest), so pages fall into chains; the last page of a
chain may lead into another, or back into its own. Ranks are found by pointer jumping: in round k a page that has not
met the head of its chain yet looks 2^k pages back, so a chain of n pages needs log2 n rounds, and a page is written
again only until its head is found. A start is then an interval of ranks, and one more for each chain that follows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..session import scratch, scratch_path, written

#: Ranks of an interval that one row spreads over.
PIECE = 4_096


@dataclass
class Chains:
    """`pages`: url, chain (its first page), rank from 0. `chains`: chain, size and, where it leads on, to_chain and to_rank."""

    pages: DataFrame
    chains: DataFrame


def rank_chains(next_links: DataFrame) -> Chains:
    """Chains of the pages in `src_url -> next_url`; of several next links of a page the smallest counts."""
    spark = next_links.sparkSession
    links = written(
        next_links.where("src_url IS NOT NULL AND next_url IS NOT NULL").groupBy("src_url").agg(F.min("next_url").alias("next_url")), "next-links"
    )
    done = scratch_path(spark, "ranked")
    ranked = lambda: spark.read.schema("url STRING, chain STRING, rank BIGINT").parquet(f"{done}/*")
    with scratch(spark) as keep:
        before = links.groupBy(F.col("next_url").alias("url")).agg(F.min("src_url").alias("before"))
        urls = links.select(F.col("src_url").alias("url")).union(links.select("next_url")).distinct()
        pages = keep(urls.join(before, "url", "left"), "pages")
        head = lambda url: url.select("url", F.col("url").alias("chain"), F.lit(0).cast("long").alias("rank"))
        head(pages.where("before IS NULL")).write.parquet(f"{done}/round=0")
        first = pages.where("before IS NOT NULL").select("url", "before", F.col("before").alias("back"), F.lit(1).cast("long").alias("by"), F.col("before").alias("least"))
        open_, round_ = keep(first, "open"), 0
        while not open_.isEmpty():
            round_ += 1
            # a page that is the least of those before it has come round: it heads a chain that is a circle
            circles = keep(open_.where("least = url").select("url"), "circles")
            rest = open_
            if not circles.isEmpty():
                head(circles).write.parquet(f"{done}/circles-round={round_}")
                again = open_.join(circles, "url", "left_anti").join(circles.select(F.col("url").alias("least"), F.lit(True).alias("_cut")), "least", "left")
                anew = lambda new, old: F.when(F.col("_cut"), new).otherwise(F.col(old)).alias(old)
                rest = again.select("url", "before", anew(F.col("before"), "back"), anew(F.lit(1), "by"), anew(F.col("before"), "least"))
            start = ranked()
            met = rest.join(start.select(F.col("url").alias("back"), "chain", "rank"), "back")
            met.select("url", "chain", (F.col("rank") + F.col("by")).alias("rank")).write.parquet(f"{done}/round={round_}")
            onward = rest.select(F.col("url").alias("back"), F.col("back").alias("_back"), F.col("by").alias("_by"), F.col("least").alias("_least"))
            unmet = rest.join(start.select(F.col("url").alias("back")), "back", "left_anti")
            jumped = unmet.join(onward, "back").select(
                "url", "before", F.col("_back").alias("back"), (F.col("by") + F.col("_by")).alias("by"), F.least("least", "_least").alias("least")
            )
            open_ = keep(jumped, "open")
    pages = ranked()
    ends = pages.groupBy("chain").agg((F.max("rank") + 1).alias("size"), F.max_by("url", "rank").alias("src_url"))
    to = pages.select(F.col("url").alias("next_url"), F.col("chain").alias("to_chain"), F.col("rank").alias("to_rank"))
    chains = ends.join(links, "src_url", "left").join(to, "next_url", "left").select("chain", "size", "to_chain", "to_rank")
    return Chains(pages, written(chains, "chains"))


def intervals(chains: Chains, starts: DataFrame) -> DataFrame:
    """`start, chain, low, high, step`: the ranks that a walk from each `url` of `starts` passes, `step` pages after it.

    A walk that comes back to a page it has passed stops before it. A start that leads nowhere has a null chain.
    """
    spark = chains.pages.sparkSession
    path = scratch_path(spark, "intervals")
    read = lambda folder: spark.read.schema("start STRING, chain STRING, low BIGINT, high BIGINT, step BIGINT, ended BOOLEAN").parquet(f"{path}/{folder}")
    at = starts.select(F.col("url").alias("start")).where("start IS NOT NULL").distinct()
    first = at.join(chains.pages.withColumnRenamed("url", "start"), "start", "left").join(chains.chains, "chain", "left")
    first.select("start", "chain", F.col("rank").alias("low"), (F.col("size") - 1).alias("high"), F.lit(0).cast("long").alias("step"), F.col("to_chain").isNull().alias("ended")).write.parquet(f"{path}/round=0")
    round_ = 0
    while True:
        last = read(f"round={round_}").where("NOT ended")
        if last.isEmpty():
            return read("*").drop("ended")
        sizes = chains.chains.select(F.col("chain").alias("to_chain"), (F.col("size") - 1).alias("to_high"), F.col("to_chain").isNull().alias("to_end"))
        moved = last.join(chains.chains.select("chain", "to_chain", "to_rank"), "chain").join(sizes, "to_chain")
        passed = read("*").groupBy("start", F.col("chain").alias("to_chain")).agg(F.min("low").alias("_from"))
        moved = moved.join(passed, ["start", "to_chain"], "left")
        high = F.least("to_high", F.col("_from") - 1)
        found = moved.select(
            "start", F.col("to_chain").alias("chain"), F.col("to_rank").alias("low"), high.alias("high"),
            (F.col("step") + F.col("high") - F.col("low") + 1).alias("step"), (F.col("_from").isNotNull() | F.col("to_end")).alias("ended"),
        )
        round_ += 1
        found.where("low <= high").write.parquet(f"{path}/round={round_}")


def pages_of(chains: Chains, found: DataFrame) -> DataFrame:
    """`start, url, step` of every page of the intervals `found`."""
    low = F.explode(F.sequence("low", "high", F.lit(PIECE).cast("long"))).alias("from")
    pieces = found.where("chain IS NOT NULL").select("start", "chain", "step", "low", "high", low)
    ranks = F.explode(F.sequence("from", F.least(F.col("from") + PIECE - 1, F.col("high")))).alias("rank")
    spread = pieces.select("start", "chain", "step", "low", ranks)
    walked = spread.join(chains.pages, ["chain", "rank"]).select("start", "url", (F.col("step") + F.col("rank") - F.col("low")).alias("step"))
    alone = found.where("chain IS NULL").select("start", F.col("start").alias("url"), F.lit(0).cast("long").alias("step"))
    return walked.unionByName(alone)
