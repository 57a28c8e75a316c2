"""Near-duplicate groups by SetSketch registers.

A document's set holds its distinct shingles. Register i of its sketch is
floor(1 - log_b m), m being the smallest of the set's exponential hash values of
number i: minima spaced exponentially and truncated to ``REGISTERS`` bytes.
Registers of a union are the larger ones of the two sets, and two sets agree on
a register at least as often as their similarity. Sketches are cut into bands;
texts that agree on a band share a bucket.

1. Equal sets become one class, named by its smallest id.
2. In each bucket every class is paired with the one that shares most bands with others, so
   a bucket of n gives n - 1 pairs. The joint likelihood of both sketches,
   given the set sizes, estimates their similarity; pairs far below the
   threshold go, all others are verified on the full sets.
3. A bucket of three or more classes that those links leave in different groups
   isn't settled. Its classes are compared exactly by prefix filtering: with
   shingles in order of rarity, two sets over the threshold share one of their
   first (1 - t) n + 1, at places that leave enough of both sets to come, so shingles that
   only one group has drop out, and only classes of different groups are paired. Each set has a bitmap
   of ``BITS`` parities; two sets differ in at least as many shingles as their bitmaps in bits, so
   near misses of a template go inside the join, and what is left is verified.
4. Groups are the connected components of the verified links.

Shingles are kept as 64-bit hashes of words; verification compares whole sets
of them. A pair at the threshold is missed by all bands with probability
(1 - t ** ROWS) ** BANDS, 2e-7 for 0.85.

Defined cases: texts without words, and null ones, have an empty set, are linked with
nothing and kept; texts shorter than a shingle are one shingle; rows with a null
id are linked with nothing and kept, with a null group; rows that repeat an id
belong to one group with it, and the links of all their texts count; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import WordHashes, mixed, over_rows, utf8, windows, write_table
from corpusloom.llm.components import components

BASE, BANDS, ROWS = 1.1, 40, 7
REGISTERS = BANDS * ROWS
_MARGIN = 0.11  # five standard deviations of the estimate at the threshold
BITS = 1024  # parities of a set, in 64-bit words

_SEEDS = np.random.default_rng(20).integers(1, 2**32, (2, REGISTERS), dtype=np.uint64).astype(np.uint32)
_MULTIPLY, _ADD = _SEEDS[0] | np.uint32(1), _SEEDS[1]


def shingle_hashes(text: str | None, size: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased."""
    words = utf8(text).lower().split()  # bytes: lower() changes A-Z alone
    if not words:
        return np.empty(0, np.uint64)
    h = hashes.of(words)
    if len(words) < size:
        return windows(np.r_[h, np.uint64(len(words))], len(words) + 1)
    return np.unique(windows(h, size))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """Registers of a set: uint8, 0 for the empty set."""
    if not len(shingles):
        return np.zeros(REGISTERS, np.uint8)
    x = (mixed(shingles) >> np.uint64(32)).astype(np.uint32)
    low = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 256):  # a block of hash values stays in the processor's cache
        h = x[at : at + 256, None] * _MULTIPLY + _ADD
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        np.minimum(low, h.min(0), out=low)
    exponential = -np.log1p(-(low.astype(np.float64) + 0.5) / 2**32)
    return np.clip(np.floor(1 - np.log(exponential) / np.log(BASE)) + 40, 1, 255).astype(np.uint8)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity of pairs of sketches (rows) of known set sizes: the maximum of the joint likelihood over a grid."""
    greater, less = (a > b).sum(1)[:, None], (a < b).sum(1)[:, None]
    equal = a.shape[1] - greater - less
    u = (size_a / (size_a + size_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, 101)[None, :]
    inside = j <= np.minimum(u / v, v / u) + 1e-12

    def p(x):
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = np.clip(p(u - v * j), 1e-12, 1), np.clip(p(v - u * j), 1e-12, 1)
    logs = greater * np.log(up) + less * np.log(down) + equal * np.log(np.clip(1 - up - down, 1e-12, 1))
    return j[0][np.where(inside, logs, -np.inf).argmax(1)]


def parities(shingles: np.ndarray) -> np.ndarray:
    """``BITS`` parities of a set as 64-bit words: shingles are dealt to bits, and each turns its bit over."""
    turned = np.bincount((mixed(shingles) % np.uint64(BITS)).astype(np.int64), minlength=BITS) & 1
    return np.packbits(turned.astype(np.uint8)).view(np.int64)


def sketches(docs: DataFrame, shingle: int) -> DataFrame:
    """Written table (doc_id, n_shingles, set_a, set_b, sketch): a 128-bit name of each set beside its sketch."""

    def make():
        hashes, memory = WordHashes(), {}

        def row(doc_id, text):
            s = shingle_hashes(text, shingle, hashes)
            whole = mixed(s)
            name = (int(np.bitwise_xor.reduce(whole, initial=0)) ^ (len(s) << 40), int(np.add.reduce(mixed(whole ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64))) if len(s) else (0, 0)
            signed = tuple(x - (1 << 64) if x >= 1 << 63 else x for x in name)
            data = memory.get(signed) or sketch(s).tobytes()
            if len(memory) < 2000:
                memory[signed] = data
            return (doc_id, len(s), *signed, data)

        return row

    rows = over_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, "doc_id long, n_shingles long, set_a long, set_b long, sketch binary")
    return write_table(rows, "sketches")


def band_keys(classes: DataFrame) -> DataFrame:
    """Written table (band, id): a 64-bit key of each band of each class."""

    def run(batches):
        place = mixed(np.arange(1, BANDS + 1, dtype=np.uint64))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                piece = batch.slice(at, 2048)
                x = np.frombuffer(b"".join(piece.column(1).to_pylist()), np.uint8).reshape(-1, BANDS, ROWS)
                key = np.zeros(x.shape[:2], np.uint64)
                for r in range(ROWS):
                    key = (key << np.uint64(8)) | x[:, :, r]
                key = mixed(key ^ place)
                ids = np.repeat(piece.column(0).to_numpy(), BANDS)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64).reshape(-1)), pa.array(ids)], ["band", "id"])

    return write_table(classes.select("id", "sketch").mapInArrow(run, "band long, id long"), "bands")


def _likely(pairs: DataFrame, classes: DataFrame, least: float) -> DataFrame:
    """Pairs whose sketches make ``least`` similarity plausible and whose sizes allow it."""
    side = classes.select("id", "n_shingles", "sketch")
    a = side.toDF("a", "size_a", "sketch_a")
    b = side.toDF("b", "size_b", "sketch_b")
    both = pairs.join(a, "a").join(b, "b").select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b")

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                x = batch.slice(at, 1024)
                left, right = (np.frombuffer(b"".join(x.column(i).to_pylist()), np.uint8).reshape(-1, REGISTERS) for i in (4, 5))
                n, m = (x.column(i).to_numpy().astype(float) for i in (2, 3))
                likely = estimate(left, right, n, m) >= least - _MARGIN
                yield x.select(["a", "b"]).filter(pa.array(likely))

    fits = F.least("size_a", "size_b") >= F.greatest("size_a", "size_b") * (least - 1e-9)
    return both.filter(fits).mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs with 100 * intersection >= percent * union, on full sets; (id, shingles) in ``sets``."""
    sets = sets.select("id", "shingles")
    a, b = sets.toDF("a", "set_a"), sets.toDF("b", "set_b")
    shared = F.size(F.array_intersect("set_a", "set_b"))
    total = F.size("set_a") + F.size("set_b") - shared
    return pairs.join(a, "a").join(b, "b").filter(100 * shared >= percent * total).select("a", "b")


def _sets(docs: DataFrame, ids: DataFrame, shingle: int) -> DataFrame:
    """Written table (id, shingles, bits) for the classes in ``ids``."""

    def make():
        hashes = WordHashes()

        def row(doc_id, text):
            s = shingle_hashes(text, shingle, hashes)
            return doc_id, s.view(np.int64), parities(s)

        return row

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id")
    rows = over_rows(texts, make, "id long, shingles array<bigint>, bits array<bigint>")
    return write_table(rows.filter(F.size("shingles") > 0), "sets")


def _unsettled_pairs(sets: DataFrame, groups: DataFrame, percent: int) -> DataFrame:
    """All pairs of different groups that could be linked, by prefix filtering; ``groups`` has (id, component)."""
    # an id that several texts share has several sets
    words = sets.join(groups, "id").select("id", "component", "shingles", "bits", F.xxhash64("shingles").alias("set"))
    # a shingle of one group matches nothing: it ranks first, and only the counts of the others are joined, from a
    # table of their own, so that a very common one is a skewed join that can be split
    rarity = words.select("component", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
    rarity = write_table(rarity.filter("low < high").select("s", "often"), "shared-shingles")
    held = words.select("id", "set", "component", F.size("shingles").alias("n"), F.explode("shingles").alias("s")).join(rarity, "s", "left")
    # rarity ranks every shingle of a set; only the first n - ceil(t n) + 1 are looked up
    ranked = F.struct(F.coalesce("often", F.lit(0)).alias("often"), "s", F.col("often").isNotNull().alias("shared"))
    # rows that repeat an id with its text hold each shingle twice, which a set of them doesn't count
    ordered = held.groupBy("id", "set", "component", "n").agg(F.sort_array(F.collect_set(ranked)).alias("all"))
    reach = (F.col("n") - F.ceil(F.col("n") * percent / 100) + 1).cast("int")
    placed = F.transform(F.slice("all", F.lit(1), reach), lambda x, i: F.struct(x["s"].alias("s"), i.alias("at"), x["shared"].alias("shared")))
    prefix = ordered.select("id", "set", "component", "n", F.explode(F.filter(placed, lambda x: x["shared"])).alias("x")).select("id", "set", "component", "n", F.col("x.s").alias("s"), F.col("x.at").alias("at"))
    # the full count made a shingle shared; what matters is whether prefixes of two groups hold it
    prefix = write_table(prefix, "all-prefixes")
    ends = write_table(prefix.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("s"), "shared-prefixes")
    parity = words.select("id", "set", *[F.col("bits")[i].alias(f"bits{i}") for i in range(BITS // 64)]).dropDuplicates(["id", "set"])
    prefix = write_table(prefix.join(ends, "s").join(parity, ["id", "set"]).drop("set"), "prefixes")
    a, b = prefix.alias("a"), prefix.alias("b")
    na, nb, pa, pb = (F.col(c) for c in ("a.n", "b.n", "a.at", "b.at"))
    # at the first shingle that two sets share, what follows in the shorter rest bounds the intersection
    enough = (100 + percent) * F.least(na - pa, nb - pb) >= percent * (na + nb)
    # sets differ in at least as many shingles as their bitmaps in bits
    differ = reduce(Column.__add__, (F.bit_count(F.col(f"a.bits{i}").bitwiseXOR(F.col(f"b.bits{i}"))) for i in range(BITS // 64)))
    near = (100 + percent) * differ <= (100 - percent) * (na + nb)
    fits = (F.col("a.id") < F.col("b.id")) & (F.col("a.component") != F.col("b.component")) & (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & enough & near
    return a.join(b, F.col("a.s") == F.col("b.s")).filter(fits).select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row; similarity in percent."""
    sketched = sketches(docs, shingle)
    named = sketched.filter("n_shingles > 0 and doc_id is not null")
    names = named.groupBy("set_a", "set_b", "n_shingles").agg(F.min("doc_id").alias("id"))
    classes = write_table(named.join(names.select(F.col("id").alias("doc_id"), "set_a", "set_b"), ["doc_id", "set_a", "set_b"]).select(F.col("doc_id").alias("id"), "n_shingles", "sketch").distinct(), "classes")

    bands = band_keys(classes)
    buckets = bands.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
    members = write_table(bands.join(buckets, "band"), "members")  # (band, id, members)
    # a class that shares many bands with many others is near the middle of its group
    central = members.groupBy("id").agg(F.sum("members").alias("weight"))
    weighted = members.join(central, "id")
    first = weighted.groupBy("band").agg(F.max(F.struct("weight", (-F.col("id")).alias("id"))).alias("m")).select("band", (-F.col("m.id")).alias("first"))
    stars = weighted.join(first, "band").filter("id != first").select(F.col("id").alias("a"), F.col("first").alias("b")).distinct()
    likely = write_table(_likely(stars, classes, percent / 100), "likely")
    crowded = members.filter("members > 2").select("id").distinct()
    wanted = likely.select(F.explode(F.array("a", "b")).alias("id")).unionByName(crowded).distinct()
    sets = _sets(docs, wanted, shingle)
    links = write_table(_verified(likely, sets, percent), "verified")

    groups = components(links)
    grouped = crowded.join(groups, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
    placed = members.filter("members > 2").select("band", "id").join(grouped, "id")
    split = placed.groupBy("band").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("band")
    unsettled = write_table(placed.join(split, "band").select("id", "component").distinct(), "unsettled")
    more = _verified(write_table(_unsettled_pairs(sets.join(unsettled.select("id"), "id"), unsettled, percent), "remaining"), sets, percent)
    groups = write_table(components(links.unionByName(more)), "groups")

    # one row per set: its group; then every document by its set
    group = names.join(groups, "id", "left").select("set_a", "set_b", F.coalesce("component", "id").alias("group"))
    found = sketched.select("doc_id", "n_shingles", "set_a", "set_b").join(group, ["set_a", "set_b"], "left")
    own = F.when((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.col("group")).otherwise(F.col("doc_id"))
    return found.select("doc_id", "n_shingles", own.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
