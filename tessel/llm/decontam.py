"""Benchmark decontamination: SimHash over item-sized windows, multi-index Hamming blocks, exact weighted-shingle similarity.

All of it is DataFrame expressions. A window of a text that shares no shingle with an item has similarity 0 to it, so windows are placed where
a text's five-word shingle meets an item's (its place there fixes the window's start); the windows have the item's length.
Every window and item gets a 64-bit SimHash of its weighted shingles. Fingerprints within RADIUS bits agree on one of BLOCKS blocks but for
RADIUS // BLOCKS bits (pigeonhole), so the items' blocks are indexed with all their neighbours and the join finds every pair within the radius.
A pair counts when its exact weighted Jaccard similarity reaches THRESHOLD; a shingle's weight is its count
times log(1 + items / items that hold it).

Defined cases: null or blank texts and items match nothing; items of fewer than five words are one shingle of all their words and match
windows of that many words; texts that share a doc_id are looked at each by itself and give one row for an item; a document without an id matches nothing; items that repeat are
matched one by one. The items' shingles, and the places of candidate windows, are broadcast only if their counted rows are few, else joined by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, cut

N, THRESHOLD, RADIUS, BITS = 5, 0.8, 20, 64
#: Bits of each block: ten blocks, so that a pair within RADIUS differs in two bits at most in one of them.
BLOCKS = (7, 7, 7, 7, 6, 6, 6, 6, 6, 6)
SPACE = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE), "")


def shingles(w: str) -> str:
    """Hashes of the five-word shingles of an array column, by place; shorter arrays: one of all words."""
    each = f"xxhash64({w}[i], {w}[i + 1], {w}[i + 2], {w}[i + 3], {w}[i + 4])"
    return f"CASE WHEN size({w}) = 0 THEN cast(array() AS array<bigint>) WHEN size({w}) < {N} THEN array(xxhash64({w})) ELSE transform(sequence(0, size({w}) - {N}), i -> {each}) END"


def whole(idf: Column) -> Column:
    """Weights in whole thousandths, so that sums don't depend on their order."""
    return F.round(1000 * F.col("tf") * idf).cast("long")


def simhash(rows: DataFrame, keys: list[str], shingle: str, weight: str) -> DataFrame:
    """Fingerprints of groups of weighted shingles."""
    h, w = F.xxhash64(F.col(shingle), F.lit(11)), F.col(weight)
    bits = [F.sum(F.when(F.shiftright(h, b).bitwiseAND(1) == 1, w).otherwise(-w)) for b in range(BITS)]
    out = rows.groupBy(*keys).agg(*(s.alias(f"__b{b}") for b, s in enumerate(bits)))
    print_ = F.lit(0).cast("long")
    for b in range(BITS):
        print_ = print_.bitwiseOR(F.when(F.col(f"__b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")))
    return out.select(*keys, print_.alias("print"))


def blocks(column: str) -> Column:
    out, at = [], 0
    for k, n in enumerate(BLOCKS):
        out.append(F.struct(F.lit(k).alias("block"), F.shiftrightunsigned(F.col(column), at).bitwiseAND((1 << n) - 1).alias("value"), F.lit(1 << n).alias("values")))
        at += n
    return F.array(*out)


def neighbours() -> Column:
    """All values that differ from a block's in at most RADIUS // len(BLOCKS) bits."""
    most = RADIUS // len(BLOCKS)
    masks = [m for m in range(1 << max(BLOCKS)) if m.bit_count() <= most]
    return F.transform(F.filter(F.array(*map(F.lit, masks)), lambda m: m < F.col("b.values")), lambda m: F.col("b.value").bitwiseXOR(m))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Matches: doc_id, item_id, start (word of the text), n_words, similarity, distance; each document's best window for each item."""
    it = items.select("item_id", words(F.col("text")).alias("w")).withColumn("item", F.monotonically_increasing_id())
    it = it.withColumns({"s": F.expr(shingles("w")), "n": F.size("w")}).where("n > 0")
    flat = cut(it.select("item", "item_id", "n", F.posexplode("s").alias("at", "h")), "items")
    n_items = flat.select(F.count_distinct("item")).first()[0]  # one number
    weight = F.log(1 + F.lit(float(max(n_items, 1))) / F.col("df"))
    idf = flat.groupBy("h").agg(F.count_distinct("item").cast("double").alias("df")).select("h", weight.alias("idf"))
    own = flat.groupBy("item", "item_id", "n", "h").agg(F.count(F.lit(1)).cast("double").alias("tf")).join(idf, "h").select("item", "item_id", "n", "h", whole(F.col("idf")).alias("weight"))
    own = cut(own, "items")

    d = docs.where("doc_id IS NOT NULL").select(F.struct("doc_id", F.xxhash64("text").alias("th")).alias("doc"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    small = [r[0] for r in flat.where(f"n < {N}").select("n").distinct().collect()]  # at most four numbers
    places = f"transform(sequence(0, size(w) - {N}), i -> struct(i AS at, xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]) AS h))"
    places = f"CASE WHEN size(w) >= {N} THEN {places} ELSE cast(array() AS array<struct<at: int, h: bigint>>) END"
    for n in small:
        places = f"concat({places}, CASE WHEN size(w) >= {n} THEN transform(sequence(0, size(w) - {n}), i -> struct(i AS at, xxhash64(slice(w, i + 1, {n})) AS h)) ELSE array() END)"
    hits = d.select("doc", F.size("w").alias("size"), F.expr(f"inline({places})"))
    spots = flat.groupBy("h").agg(F.collect_set(F.struct("item", "at", "n")).alias("spots"))
    hits = hits.join(checked_broadcast(spots), "h").select("doc", "size", "at", F.explode("spots").alias("p"))
    start = F.greatest(F.lit(0), F.least(F.col("at") - F.col("p.at"), F.col("size") - F.col("p.n")))
    windows = cut(hits.select("doc", start.cast("int").alias("start"), F.col("p.n").alias("n")).distinct(), "windows")

    lengths = checked_broadcast(cut(windows.groupBy("doc").agg(F.collect_set(F.struct("start", "n")).alias("places")), "windows"))
    text = d.join(lengths, "doc").select("doc", "w", F.explode("places").alias("p")).select("doc", "p.start", "p.n", F.expr("slice(w, p.start + 1, p.n)").alias("x"))
    win = text.select("doc", "start", "n", F.explode(F.expr(shingles("x"))).alias("h")).groupBy("doc", "start", "n", "h").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    other = F.log(1 + F.lit(float(max(n_items, 1))))  # a shingle that no item holds weighs as one that a single item holds
    win = cut(win.join(idf, "h", "left").select("doc", "start", "n", "h", whole(F.coalesce("idf", other)).alias("weight")), "windows")

    item_prints = simhash(own, ["item", "item_id", "n"], "h", "weight")
    index = item_prints.select("item", "item_id", F.col("n").alias("item_n"), F.col("print").alias("item_print"), F.explode(blocks("print")).alias("b"))
    index = index.select("item", "item_id", "item_n", "item_print", "b.block", F.explode(neighbours()).alias("value"))
    doc_prints = simhash(win, ["doc", "start", "n"], "h", "weight").select("*", F.explode(blocks("print")).alias("b")).select("doc", "start", "n", "print", "b.block", "b.value")
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    pairs = doc_prints.join(index, ["block", "value"]).where((F.col("n") == F.col("item_n")) & (apart <= RADIUS))
    pairs = pairs.select("doc", "start", "n", "item", "item_id", apart.alias("distance")).distinct()

    sides = pairs.join(win.select("doc", "start", "n", "h", F.col("weight").alias("a")), ["doc", "start", "n"])
    total = own.groupBy("item").agg(F.sum("weight").alias("item_total"))
    sides = sides.join(own.select("item", "h", F.col("weight").alias("b")), ["item", "h"], "left").join(total, "item")
    both, mine = F.sum(F.least("a", F.coalesce("b", F.lit(0)))), F.sum("a")
    sim = sides.groupBy("doc", "start", "n", "item", "item_id", "distance", "item_total").agg(both.alias("both"), mine.alias("mine"))
    sim = sim.withColumn("similarity", F.col("both") / (F.col("mine") + F.col("item_total") - F.col("both"))).where(F.col("similarity") >= threshold)
    best = F.max_by(F.struct("start", "n", "similarity", "distance"), F.struct("similarity", -F.col("start"))).alias("m")
    out = sim.groupBy(F.col("doc.doc_id").alias("doc_id"), "item_id").agg(best)
    return out.select("doc_id", "item_id", F.col("m.start").alias("start"), F.col("m.n").alias("n_words"), F.round("m.similarity", 6).alias("similarity"), F.col("m.distance").alias("distance"))


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without those that hold a benchmark item."""
    bad = contaminated(docs, items, threshold).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti").select(*docs.columns)
