"""Mixing sources to target weights in equal-token blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pointquarry.llm.common import staged


def word_count(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sources: DataFrame, weights: list[float], epochs: float, most: float) -> DataFrame:
    """Adds ``target``: the source's part by weight of ``epochs`` times all sizes.

    ``sources`` has a row per source: ``src`` (in the order of weights) and ``source_size``. A
    target stops at ``most`` times its source's size; what is over is shared again
    by weight among the rest. In the order of size over weight the sources that stop
    come first, so running sums find the level at which all is shared.
    """
    ranked = sources.withColumn("rank", F.row_number().over(W.orderBy("src")))
    ranked = ranked.withColumn("weight", F.get(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("rank") - 1, F.lit(len(weights)))))
    top = F.lit(float(most)) * F.col("source_size")
    by_ratio = W.orderBy("ratio", "rank")
    filled = ranked.withColumn("ratio", top / F.col("weight")).withColumns(
        {
            "total": F.lit(float(epochs)) * F.sum("source_size").over(W.partitionBy()),
            "full": F.coalesce(F.sum(top).over(by_ratio.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
            "rest": F.sum("weight").over(by_ratio.rowsBetween(0, W.unboundedFollowing)),
            "place": F.row_number().over(by_ratio),
        }
    )
    level = filled.withColumn("level", (F.col("total") - F.col("full")) / F.col("rest"))
    level = level.withColumn("level", F.min_by("level", F.when(F.col("level") <= F.col("ratio"), F.col("place"))).over(W.partitionBy()))
    return level.select("src", "source_size", "rank", "total", F.least(top, F.coalesce("level", F.lit(0.0)) * F.col("weight")).alias("target"))


def sainte_lague(claims: DataFrame, seats: str, weight: str, within: list[str], order: str) -> DataFrame:
    """Adds ``quota``: of ``seats`` (one number per group ``within``), those that the
    highest quotients weight / (2k + 1) win; ties go to the smaller ``order``.

    Quotients far above the last winning one are not listed: with n claims, a divisor
    of total / (seats - n/2) rounds to at most all seats, each of which wins, and one
    of total / (seats + n/2) to at least all. Only the quotients between, about two
    for each claim, are ranked.
    """
    group, n = W.partitionBy(*within), F.count("*").over(W.partitionBy(*within))
    sums = claims.withColumns({"__sum": F.sum(weight).over(group), "__half": n / 2})
    share = F.when(F.col("__sum") > 0, F.col(weight) / F.col("__sum")).otherwise(F.lit(0.0))
    won = F.floor(share * F.greatest(F.col(seats) - F.col("__half"), F.lit(0.0)) + 0.5)
    won = F.when(F.col(seats) > F.col("__half"), won).otherwise(F.lit(0)).cast("long")
    most = F.floor(share * (F.col(seats) + F.col("__half")) + 0.5).cast("long") + 1
    bounds = sums.withColumns({"__won": won, "__most": F.when(share > 0, most).otherwise(won)})
    left = F.col(seats) - F.sum("__won").over(group)
    listed = bounds.withColumn("__left", left).select(*claims.columns, "__won", "__left", F.explode_outer(F.when(F.col("__most") > F.col("__won"), F.sequence("__won", F.col("__most") - 1))).alias("__k"))
    listed = listed.withColumn("__quotient", F.col(weight) / (2 * F.col("__k") + 1))
    best = F.row_number().over(W.partitionBy(*within).orderBy(F.desc_nulls_last("__quotient"), order))
    wins = F.col("__k").isNotNull() & (best <= F.col("__left"))
    return listed.withColumn("__wins", wins.cast("long")).groupBy(*claims.columns, "__won").agg(F.sum("__wins").alias("__more")).select(*claims.columns, (F.col("__won") + F.col("__more")).alias("quota"))


def mix(
    docs: DataFrame,
    weights: list[float],
    epochs: float = 1.5,
    most: float = 2.0,
    block_words: int = 16,
    seed: int = 42,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """How many words of each document a mix of the sources takes.

    Sources in the order of code points, null last, take ``weights`` in turn. Their
    targets are apportioned in blocks of ``block_words`` words: first among the
    sources; then whole rounds of a source go to all its shards, and the blocks of the rest
    among them, both by the highest quotients. What a shard cannot hold is shared again, by
    words, among those with room, so a source of small shards reaches its target too. A
    document's shard and its place there come from a seeded hash; the blocks of a shard
    are cut from the words in that order, and its quota takes whole rounds of them and then those
    from a seeded block on. So a document is taken at most ``most`` times (shards
    end at that, in whole words), in parts at the edges only, and reruns agree.
    The shards of a source number the square root of all documents, so a hot source is
    spread like the rest and no window holds more than such a part.

    Returns the id, ``size``, ``source_size``, ``target``, ``taken`` and the columns named in
    ``carry``, which should be narrow.

    Null and empty texts have no words and nothing is taken of them; texts of any length are counted
    whole. The ids may be null or repeat; rows of equal ids, sizes and carried columns are interchangeable. An empty table gives an empty
    table. The table of sources, a row for each, is ordered in one task.
    """
    src = F.when(F.col(source_col).isNull(), F.lit("2")).otherwise(F.concat(F.lit("1"), F.col(source_col).cast("string")))
    draw = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("null"))))
    sizes = staged(docs.select(F.col(id_col).alias("id"), src.alias("src"), word_count(F.col(text_col)).alias("size"), draw.alias("draw"), *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)]), "mix")
    shards = max(1, math.isqrt(sizes.count()))
    spread = sizes.withColumn("shard", F.pmod(F.conv(F.substring("draw", 1, 12), 16, 10).cast("long"), F.lit(shards)))
    held = spread.groupBy("src", "shard").agg(F.sum("size").alias("held"))
    targets = source_targets(held.groupBy("src").agg(F.sum("held").alias("source_size")), weights, epochs, most)
    claims = targets.withColumn("blocks", F.floor(F.col("total") / block_words + 0.5))
    quotas = sainte_lague(claims, "blocks", "target", [], "rank").select("src", "source_size", "target", "quota")
    # Whole rounds of all shards come first, and only the rest is apportioned.
    words = F.least(F.col("quota") * block_words, F.floor(F.col("source_size") * float(most)))
    around = F.when(F.col("source_size") > 0, F.floor(F.col("words") / F.col("source_size"))).otherwise(F.lit(0))
    of_source = quotas.withColumn("words", words.cast("long")).withColumn("around", around).withColumn("left", F.col("words") - F.col("around") * F.col("source_size"))
    of_source = of_source.select("src", "source_size", "target", "around", "left", F.floor(F.col("left") / block_words).alias("left_blocks"))
    shared = sainte_lague(held.join(of_source, "src"), "left_blocks", "held", ["src"], "shard")
    ceiling = F.least(F.col("held"), F.floor(F.col("held") * float(most)) - F.col("around") * F.col("held"))
    shared = shared.withColumn("part", F.least(F.col("quota") * block_words, ceiling).cast("long")).withColumn("room", (ceiling - F.col("part")).cast("long")).drop("quota")
    # What was clipped, and less than a block, goes by words to the shards with room.
    shared = shared.withColumn("short", F.col("left") - F.sum("part").over(W.partitionBy("src")))
    shared = staged(shared.select("src", "shard", "source_size", "target", "held", "around", "part", "room", "short"), "mix-shares")
    parts = sainte_lague(shared, "short", "room", ["src"], "shard")
    take = F.col("around") * F.col("held") + F.col("part") + F.least(F.col("quota"), F.col("room"))
    parts = parts.select("src", "shard", "source_size", "target", "held", take.cast("long").alias("take"))
    line = W.partitionBy("src", "shard").orderBy("draw", "id", "size", *[f"carry_{i}" for i in range(len(carry))]).rowsBetween(W.unboundedPreceding, -1)
    laid = spread.withColumn("start", F.coalesce(F.sum("size").over(line), F.lit(0))).join(parts, ["src", "shard"])
    rounds = F.when(F.col("held") > 0, F.floor(F.col("take") / F.col("held"))).otherwise(F.lit(0))
    rest = F.col("take") - rounds * F.col("held")
    # The blocks of the last round run on from a seeded one, around the end of the shard.
    blocks = F.greatest(F.ceil(F.col("held") / block_words), F.lit(1))
    first = F.pmod(F.xxhash64(F.lit(seed), "src", "shard"), blocks) * block_words
    first = F.when(F.col("held") > 0, F.pmod(first, F.greatest(F.col("held"), F.lit(1)))).otherwise(F.lit(0))
    fin = F.col("start") + F.col("size")
    ahead = F.greatest(F.lit(0), F.least(fin, first + rest, F.col("held")) - F.greatest(F.col("start"), first))
    around = F.greatest(F.lit(0), F.least(fin, first + rest - F.col("held")) - F.col("start"))
    part = ahead + around
    return laid.select(F.col("id").alias(id_col), "size", "source_size", "target", (rounds * F.col("size") + part).cast("long").alias("taken"), *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(carry)])
