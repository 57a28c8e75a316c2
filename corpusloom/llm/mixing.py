"""Mixing sources to target weights by Sainte-Laguë apportionment, in DataFrame operations only.

Every document belongs to a source. A source's target is its share by weight of
all words, at most ``max_repeats`` times its size; what it can't use goes to
the others by weight. The words of a source lie in shards (a seeded hash of the
document's id and text, so rows without an id are dealt out too, but for equal ones) of bounded words and rows, and each shard is cut into blocks of ``block_words`` words. Equal
blocks are allotted to sources, and within a source to its shards, by the
highest quotients target / (2 seats + 1). In a shard all blocks are taken as
often as its quota fills it, and a seeded choice of blocks once more.

Defined cases: null text has size 0; a null source is a source of its own, last
in order; documents without words take nothing; an empty table gives no rows;
rows with the same id are separate rows; other columns are ignored. Windows over all
sources hold one small row of each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusloom.llm.common import WORD, free_names, write_table

BLOCK_WORDS = 64
SHARD_WORDS = 2_000_000
SHARD_ROWS = 10_000
MAX_REPEATS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weight_targets(sources: DataFrame, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): water-filling under the limit ``max_repeats * source_size``.

    Sources sorted by limit per weight: the first k are at their limit, and the
    level of the rest is what remains divided by the weight that remains.
    """
    limit = F.lit(max_repeats) * F.col("source_size")
    by_room = W.orderBy(F.col("_room"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy(F.lit(1))
    level = (
        sources.withColumn("_limit", limit.cast("double"))
        .withColumn("_room", F.col("_limit") / F.col("weight"))
        .withColumn("_left", F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0)))
        .withColumn("_weights", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("_level", F.col("_left") / F.col("_weights"))
        .withColumn("_level", F.min(F.when(F.col("_level") <= F.col("_room"), F.struct("_room", "_level"))).over(everything)["_level"])
    )
    return level.withColumn("target", F.when(F.col("_level").isNull(), F.col("_limit")).otherwise(F.least("_limit", F.col("_level") * F.col("weight")))).drop("_limit", "_room", "_left", "_weights", "_level")


def sainte_lague(parties: DataFrame, claim: str, seats: str, group: list[str], order: list[str]) -> DataFrame:
    """Adds ``quota``: the integer seats of each party by the highest quotients claim / (2 seats + 1).

    In each ``group`` the column ``seats`` holds the seats to allot. Rounding the
    fair shares misses that number by at most half a seat per party, and only
    quotients within that distance of the cut can decide, so the quotients that
    are listed stay in proportion to the parties, not to the seats.
    """
    inside = W.partitionBy(*[F.col(c) for c in group]) if group else W.partitionBy(F.lit(1))
    base = (
        parties.withColumn("_claims", F.sum(claim).over(inside))
        .withColumn("_parties", F.count(F.lit(1)).over(inside))
        .withColumn("_share", F.when(F.col("_claims") > 0, F.col(claim) / F.col("_claims") * F.col(seats)).otherwise(F.lit(0.0)))
        .withColumn("_round", F.floor(F.col("_share") + 0.5).cast("long"))
        .withColumn("_miss", F.when(F.col("_claims") > 0, F.col(seats) - F.sum("_round").over(inside)).otherwise(F.lit(0)))
        .withColumn("_near", (F.ceil(F.col("_share") * F.col("_parties") / F.greatest(F.col(seats), F.lit(1))) + 2).cast("long"))
    )
    one = F.lit(1).cast("long")
    steps = F.when(F.col("_miss") > 0, F.sequence(one, F.col("_near"))).when(F.col("_miss") < 0, F.sequence(-one, -F.least("_near", "_round"), -one))
    keys = [*group, *order]
    moved = (
        base.filter((F.col("_miss") != 0) & (F.col("_share") > 0) & ((F.col("_miss") > 0) | (F.col("_round") > 0)))
        .select(*keys, "_share", "_round", "_miss", F.explode(steps).alias("_step"))
        # the seat in question is number _round + _step when won, _round + _step + 1 when lost
        .withColumn("_quotient", F.col("_share") / (2 * (F.col("_round") + F.col("_step") + F.when(F.col("_step") > 0, 0).otherwise(1)) - 1))
        .withColumn("_gain", F.signum(F.col("_miss")))
        .withColumn("_place", F.row_number().over(inside.orderBy(F.col("_quotient") * -F.col("_gain"), *[F.col(c).asc_nulls_last() for c in order], F.abs("_step"))))
        .filter(F.col("_place") <= F.abs("_miss"))
        .groupBy(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(keys)])
        .agg(F.sum("_gain").cast("long").alias("_extra"))
    )
    same = [F.col(c).eqNullSafe(F.col(f"_k{i}")) for i, c in enumerate(keys)]
    condition = same[0]
    for x in same[1:]:
        condition &= x
    return base.join(moved, condition, "left").withColumn("quota", (F.col("_round") + F.coalesce("_extra", F.lit(0))).cast("long")).drop("_claims", "_parties", "_share", "_round", "_miss", "_near", "_extra", *[f"_k{i}" for i in range(len(keys))])


def mix(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(doc_id, size, source_size, target, taken): how many words the mix takes of each document, repeats counted.

    ``docs`` needs doc_id, text and source. Sources in code point order, null
    last, weigh 1, 2, 3, 1, ... No document is taken more than ``max_repeats`` times.
    """
    return _taken(docs, seed, block_words, shard_words, max_repeats, []).select("doc_id", "size", "source_size", "target", "taken")


def repeat_documents(docs: DataFrame, seed: int = 17, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """``docs`` with each row as often as the mix takes its words, at most ``max_repeats`` times.

    A row appears floor(taken / size) times, and once more with the remainder as
    its probability: in a shard the remainders are cumulated by size and then in
    a seeded order, and a row whose sum passes the next whole number (from a
    seeded start) gets the extra copy. Sizes ascend, so the words of a shard
    differ from what the mix takes of it by less than its longest document.
    Rows with null or repeated ids are told apart by their content and a row number.
    """
    row, content, copy, count = free_names(docs.columns, "_row", "_content", "_copy", "_times")
    rows = write_table(docs.withColumns({row: F.monotonically_increasing_id(), content: F.xxhash64(*docs.columns)}), "mix-rows")
    taken = _taken(rows.select("doc_id", "text", "source", F.col(row).alias("_row"), F.col(content).alias("_content")), seed, block_words, shard_words, max_repeats, ["_content", "_row"]).filter("taken > 0")
    whole = F.floor(F.col("taken") / F.col("size")).cast("long")
    order = W.partitionBy("source", "shard").orderBy("size", F.xxhash64(F.lit(seed + 2), "doc_id", "_content"), "doc_id", "_content", "_row")
    start = F.pmod(F.xxhash64(F.lit(seed + 3), "source", "shard"), F.lit(1 << 30)) / float(1 << 30)
    taken = taken.withColumn("_times", whole).withColumn("_rest", F.col("taken") / F.col("size") - F.col("_times"))
    upto, before = (F.floor(start + F.coalesce(F.sum("_rest").over(order.rowsBetween(W.unboundedPreceding, end)), F.lit(0.0))) for end in (0, -1))
    times = taken.select(F.col("_row").alias(row), (F.col("_times") + upto - before).cast("int").alias(count)).filter(F.col(count) > 0)
    return rows.join(times, row).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(count)))).select(*docs.columns)


def _taken(docs: DataFrame, seed: int, block_words: int, shard_words: int, max_repeats: int, keep: list[str]) -> DataFrame:
    """The columns of ``mix`` with source, shard and those in ``keep``, which also settle the order of rows with the same id."""
    # rows without an id, or with the same one, mustn't all lie in one shard: their texts tell them apart
    sizes = write_table(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("text").alias("_salt"), *keep), "mix-sizes")
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count_if(F.col("size") > 0).alias("_rows"))
    sources = weight_targets(by_source.withColumn("weight", (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % 3 + 1), max_repeats)
    sources = sources.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / F.lit(shard_words)), F.ceil(F.col("_rows") / F.lit(SHARD_ROWS))).cast("long")).select("source", "source_size", "target", "shards")

    # a document's place in its shard: words of the shard before it, in a seeded order
    # documents without words take nothing and lie in no shard
    located = sizes.drop("_salt").join(sources.select(F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    empty = located.filter("size = 0").withColumns({"shard": F.lit(0).cast("long"), "_taken": F.lit(0).cast("long")})
    placed = sizes.filter("size > 0").join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    placed = placed.withColumn("_mix", F.xxhash64(F.lit(seed), "doc_id", "_salt")).withColumn("shard", F.pmod(F.col("_mix"), F.greatest("shards", F.lit(1))))
    in_shard = W.partitionBy("source", "shard").orderBy("_mix", "doc_id", "size", *keep).rowsBetween(W.unboundedPreceding, 0)
    placed = placed.withColumn("end", F.sum("size").over(in_shard)).select("doc_id", "source", "size", "source_size", "target", "shard", "end", *keep)
    placed = write_table(placed, "mix-placed")

    shards = placed.groupBy("source", "shard").agg(F.sum("size").alias("shard_size")).filter("shard_size > 0")
    shards = shards.withColumn("blocks", F.ceil(F.col("shard_size") / F.lit(block_words)).cast("long"))
    held = shards.groupBy(F.col("source").alias("_s")).agg(F.sum("blocks").alias("source_blocks"))
    parties = sources.join(held, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # at its limit a source takes each of its blocks max_repeats times, the short last ones too
    parties = parties.withColumn("full", F.col("target") >= F.lit(max_repeats) * F.col("source_size"))
    seats = F.round(F.sum(F.when(~F.col("full"), F.col("target")).otherwise(F.lit(0.0))).over(W.partitionBy(F.lit(1))) / F.lit(block_words)).cast("long")
    parties = parties.withColumn("seats", seats).withColumn("claim", F.when(F.col("full"), F.lit(0.0)).otherwise(F.col("target")))
    parties = sainte_lague(parties, "claim", "seats", [], ["source"])
    parties = parties.withColumn("quota", F.when(F.col("full"), F.col("source_blocks") * max_repeats).otherwise(F.least("quota", F.col("source_blocks") * max_repeats)))
    shares = shards.join(parties.select(F.col("source").alias("_s"), F.col("quota").alias("source_quota")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    shares = sainte_lague(shares.withColumn("claim", F.col("shard_size").cast("double")), "claim", "source_quota", ["source"], ["shard"])
    shares = shares.withColumn("quota", F.least("quota", F.col("blocks") * max_repeats)).select("source", "shard", "blocks", "quota")

    blocks = shares.select("source", "shard", "blocks", "quota", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    drawn = W.partitionBy("source", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "source", "shard", "block"), "block")
    times = (F.floor(F.col("quota") / F.col("blocks")) + (F.row_number().over(drawn) <= F.pmod(F.col("quota"), F.col("blocks"))).cast("long")).cast("long")
    blocks = blocks.select(F.coalesce(F.xxhash64("source"), F.lit(0)).alias("_sh"), F.col("source").alias("_s"), F.col("shard").alias("_shard"), F.col("block").alias("_block"), times.alias("times")).filter("times > 0")

    # a document takes, of each block it reaches into, its own words as often as the block is taken
    n = F.lit(block_words)
    begin = F.col("end") - F.col("size")
    pieces = placed.select("doc_id", "source", "shard", "end", "size", F.explode(F.sequence(F.floor(begin / n), F.floor((F.col("end") - 1) / n))).alias("block"))
    overlap = F.least(F.col("end"), (F.col("block") + 1) * n) - F.greatest(begin, F.col("block") * n)
    same = (F.xxhash64("source") == F.col("_sh")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_shard")) & (F.col("block") == F.col("_block"))
    # Spark takes an exploded table for as small as it was before: without the hint it would broadcast all blocks
    taken = pieces.join(blocks.hint("merge"), same).groupBy(F.col("source").alias("_s"), F.col("shard").alias("_shard"), F.col("end").alias("_end")).agg(F.sum(overlap * F.col("times")).cast("long").alias("_taken"))
    out = placed.join(taken, F.col("source").eqNullSafe(F.col("_s")) & (F.col("shard") == F.col("_shard")) & (F.col("end") == F.col("_end")), "left")
    columns = ["doc_id", "source", "shard", *keep, "size", "source_size", "target", "_taken"]
    out = out.select(*columns).unionByName(empty.select(*columns))
    return out.select("doc_id", "source", "shard", *keep, "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.coalesce("target", F.lit(0.0)).alias("target"), F.coalesce("_taken", F.lit(0)).cast("long").alias("taken"))
