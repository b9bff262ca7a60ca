"""N-gram Jaccard join by token-combination prefixes: single rare tokens, pairs of frequent ones, then exact verification.

A token is a distinct five-word shingle, by a hash of 40 bits and those of its range; ranges are sized from the bytes of text. Steps:

1. Counting. Chunks of documents send their tokens, packed by hash range, to the ranges' tasks, which return to each chunk those
   that other documents hold too, with document frequencies. A document of which fewer than 80 % are shared can link with nothing.
2. Documents with equal sets are one class, represented by the smallest doc_id.
3. Signatures. In the order (frequency, token) a prefix is extended until its coverage exceeds the tokens that a partner may lack. A token
   with frequency up to RARE covers by itself and is indexed alone. Frequent tokens are dealt by hash into classes, whose number follows the size
   band of the set; all pairs inside a class are indexed, and c tokens of a class cover c - 1. Two sets that link are in the same or neighbouring
   bands and share a signature.
4. Verification in rounds. In every bucket of a signature the next pivots are compared with the later members that are not yet in their
   component; links join components, and the rounds, with ever more pivots, go on until no bucket holds two components that were not compared.
   No bucket is capped. Members of one component need no further comparison; those that never link are compared with each other, by maps of BITS parity
   bits, which bound what two sets share from above: from the second round on, a pair's sets are fetched only if the maps leave a link possible.
   A bucket is dealt in parts as large as a range partition, and its pivots go to each part, so that none meets in one task.

Defined cases: null, empty or blank texts have an empty set and are alone; texts of fewer than five words are one shingle of all words; a null
doc_id takes no part (its component is null); rows that share a doc_id are one node, which links wherever one of its texts does, with n_shingles
of their own text; repeated rows give a row each.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, mix, range_bits, text_slices, word_hashes

N, PERCENT = 5, 80
#: Tokens of a chunk, tokens' frequency up to which they are indexed alone, and sizes' share of a band.
CHUNK, RARE, BAND = 1_000_000, 8, math.log(100 / PERCENT)
#: Bits of a set's parity map, in 64-bit words of MAP columns.
BITS = 512
MAP = [f"m{k}" for k in range(BITS // 64)]
_FACTOR = np.uint64(0xC6A4A7935BD1E995)


def shingle_sets(texts: list[bytes], n: int = N) -> list[np.ndarray]:
    """The distinct shingles of each text, as sorted 64-bit hashes."""
    words, bounds = word_hashes(texts)
    rolled = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for k in range(n):
        rolled = rolled * _FACTOR + words[k : k + len(rolled)]
    rolled = mix(rolled)
    out = []
    for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        if hi - lo >= n:
            out.append(np.unique(rolled[lo : hi - n + 1]))
        elif hi > lo:
            h = np.array([hi - lo], np.uint64)
            for w in words[lo:hi]:
                h = h * _FACTOR + w
            out.append(mix(h ^ np.uint64(0x5851F42D4C957F2D)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _packed(own: np.ndarray, documents: int, values: np.ndarray, codes: np.ndarray | None = None) -> bytes:
    """Values of 40 bits, their documents (ascending numbers inside a chunk, as counts for each) and, where given, their frequency codes."""
    counts = np.bincount(own, minlength=documents)
    parts = [np.array([documents, len(values)], "<u4").tobytes(), counts.astype("<u4").tobytes(), (values & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes(), (values >> np.uint64(32)).astype("u1").tobytes()]
    return b"".join(parts if codes is None else [*parts, codes.astype("u1").tobytes()])


def _unpacked(data: bytes, bucket: int, bits: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Number of documents, each value's document, the values with their bucket's bits, and the codes (empty where there are none)."""
    m, n = np.frombuffer(data, "<u4", 2).tolist()
    own = np.repeat(np.arange(m, dtype=np.uint32), np.frombuffer(data, "<u4", m, 8))
    at = 8 + 4 * m
    values = np.frombuffer(data, "u1", n, at + 4 * n).astype(np.uint64) << np.uint64(32) | np.frombuffer(data, "<u4", n, at)
    return m, own, (values << np.uint64(bits)) | np.uint64(bucket), np.frombuffer(data, "u1", -1, at + 5 * n)


def _code(df: np.ndarray) -> np.ndarray:
    """Frequencies in one byte: exact to 64, then eighths of a doubling."""
    return np.where(df <= 64, df, np.minimum(255, 64 + np.floor(8 * np.log2(np.maximum(df, 1) / 64)))).astype(np.int64)


def _chunks(batches: Iterator[pa.RecordBatch], sets_of: Callable = shingle_sets) -> Iterator[tuple[list, list[np.ndarray]]]:
    keys, sets, size = [], [], 0
    for ids, texts in text_slices(batches):
        keys += ids
        new = sets_of(texts)
        sets += new
        size += sum(map(len, new))
        if size >= CHUNK:
            yield keys, sets
            keys, sets, size = [], [], 0
    if keys:
        yield keys, sets


def shared_tokens(docs: DataFrame, sets_of: Callable = shingle_sets, percent: int = PERCENT) -> DataFrame:
    """doc_id, n (set size), tokens (those that other documents hold, by frequency and value; null if none or under percent of n) and frequencies.

    A token is the low 40 bits, and those of the ranges, of the 64-bit numbers that sets_of gives for a list of texts.
    """
    bits = range_bits(docs, 0.8)
    low = np.uint64((1 << bits) - 1)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for k, (keys, sets) in enumerate(_chunks(batches, sets_of)):
            n = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate(sets) & np.uint64((1 << (40 + bits)) - 1)
            own = np.repeat(np.arange(len(sets), dtype=np.uint32), n)
            bucket = (flat & low).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            flat, own, edges = flat[order] >> np.uint64(bits), own[order], np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
            filled = [b for b in range(1 << bits) if edges[b] < edges[b + 1]]
            data = [b"".join([np.array([-1 if x is None else x for x in keys], "<i8").tobytes(), n.astype("<i8").tobytes(), np.array([x is None for x in keys], np.int8).tobytes()])]
            for b in filled:
                lo, hi = edges[b], edges[b + 1]
                data.append(_packed(own[lo:hi], len(sets), flat[lo:hi]))
            chunk = (part << 24) + k
            # The chunk's list of documents travels with one of the buckets and is passed on as it is.
            yield pa.RecordBatch.from_arrays([pa.array([chunk % (1 << bits), *filled], pa.int32()), pa.array([chunk] * len(data), pa.int64()), pa.array([True] + [False] * len(filled)), pa.array(data, pa.binary())], ["bucket", "chunk", "head", "data"])

    def count(group: pd.DataFrame) -> pd.DataFrame:
        bucket = int(group["bucket"].iloc[0])
        heads, group = group[group["head"]], group[~group["head"]]
        if not len(group):
            return heads
        found = [_unpacked(d, bucket, bits)[:3] for d in group["data"]]
        _, inverse, df = np.unique(np.concatenate([v for _, _, v in found]), return_inverse=True, return_counts=True)
        df, out, at = df[inverse], [], 0
        for m, own, v in found:
            f = df[at : at + len(v)]
            at += len(v)
            keep = f > 1
            out.append(_packed(own[keep], m, v[keep] >> np.uint64(bits), _code(f[keep])) if keep.any() else None)
        counted = pd.DataFrame({"bucket": bucket, "chunk": group["chunk"], "head": False, "data": out}).dropna()
        return pd.concat([heads, counted])

    def gather(group: pd.DataFrame) -> pd.DataFrame:
        head, body = group["data"][group["head"]].iloc[0], group[~group["head"]]
        m = len(head) // 17
        keys, n = np.frombuffer(head, "<i8", m), np.frombuffer(head, "<i8", m, 8 * m)
        null = np.frombuffer(head, np.int8, m, 16 * m)
        found = [_unpacked(d, int(b), bits)[1:] for b, d in zip(body["bucket"], body["data"], strict=True)]
        own, values, df = (np.concatenate([np.empty(0, t), *(f[k] for f in found)]) for k, t in enumerate((np.uint32, np.uint64, np.uint8)))
        order = np.lexsort((values, df, own))
        values, df, edges = values[order].astype(np.int64), df[order], np.searchsorted(own[order], np.arange(m + 1))
        tokens, freqs = [None] * m, [None] * m
        for k in np.flatnonzero((100 * np.diff(edges) >= percent * n) & (np.diff(edges) > 0) & (null == 0)):
            tokens[k], freqs[k] = values[edges[k] : edges[k + 1]], df[edges[k] : edges[k + 1]].astype(np.int32)
        return pd.DataFrame({"doc_id": pd.array([None if x else k for k, x in zip(keys.tolist(), null, strict=True)], dtype="Int64"), "n": n, "tokens": tokens, "dfs": freqs})

    sent = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(send, "bucket int, chunk long, head boolean, data binary")
    counted = sent.groupBy("bucket").applyInPandas(count, "bucket int, chunk long, head boolean, data binary")
    return counted.groupBy("chunk").applyInPandas(gather, "doc_id long, n long, tokens array<long>, dfs array<int>")


def _signatures(n: int, tokens: np.ndarray, dfs: np.ndarray) -> np.ndarray:
    """Hashes of the single tokens and of the pairs that index a set."""
    tokens = tokens.astype(np.uint64)
    need = n - -(-PERCENT * n // 100) + 1 - (n - len(tokens))
    rare, out = dfs <= RARE, []
    band = int(math.log(n) / BAND + 1e-9)
    for b in (band, band + 1):
        classes = np.uint64(max(1, int(math.exp(BAND * b) / 10)))
        own = np.where(rare, np.uint64(0), mix(tokens ^ np.uint64(0xABCDEF)) % classes + np.uint64(1))
        first = np.zeros(len(tokens), bool)
        first[np.unique(own, return_index=True)[1]] = True
        cover = np.cumsum(rare | ~first)
        end = int(np.searchsorted(cover, need)) + 1
        out.append(mix(tokens[:end][rare[:end]] + np.uint64(1)))
        frequent = np.flatnonzero(~rare[:end])
        frequent = frequent[np.argsort(own[frequent], kind="stable")]
        for step in range(1, len(frequent)):
            same = own[frequent[step:]] == own[frequent[:-step]]
            if not same.any():
                break
            x, y = tokens[frequent[:-step][same]], tokens[frequent[step:][same]]
            out.append(mix(mix(np.minimum(x, y) + np.uint64(b)) * _FACTOR + np.maximum(x, y)))
    return np.unique(np.concatenate(out)).astype(np.int64)


def signatures(sets: DataFrame) -> DataFrame:
    """sig, doc_id, n for each class representative with tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                keys, sizes, sigs = [], [], []
                for key, n, tokens, dfs in zip(b.column(0)[lo : lo + 200].to_pylist(), b.column(1)[lo : lo + 200].to_pylist(), b.column(2)[lo : lo + 200], b.column(3)[lo : lo + 200], strict=True):
                    if n >= 4:  # smaller sets link with equal ones only
                        s = _signatures(n, tokens.values.to_numpy(zero_copy_only=False), dfs.values.to_numpy(zero_copy_only=False))
                        sigs.append(s)
                        keys.append(np.full(len(s), key))
                        sizes.append(np.full(len(s), n))
                if sigs:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), pa.int64()) for x in (sigs, keys, sizes)], ["sig", "doc_id", "n"])

    return sets.select("doc_id", "n", "tokens", "dfs").mapInArrow(run, "sig long, doc_id long, n long")


def parity_maps(sets: DataFrame) -> DataFrame:
    """doc_id, shared (number of tokens) and the parity of the number of tokens that hash to each of BITS bits; sets differ in no fewer tokens than maps in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 200):
                tokens = b.column(1)[lo : lo + 200]
                sizes = np.diff(tokens.offsets.to_numpy())
                bit = (mix(tokens.flatten().to_numpy(zero_copy_only=False).astype(np.uint64) ^ np.uint64(0x1234567)) % np.uint64(BITS)).astype(np.int64)
                odd = np.bincount(np.repeat(np.arange(len(sizes)), sizes) * BITS + bit, minlength=len(sizes) * BITS) & 1
                words = np.packbits(odd.astype(np.uint8)).view("<i8").reshape(len(sizes), len(MAP))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo : lo + 200], pa.array(sizes, pa.int64()), *(pa.array(np.ascontiguousarray(w), pa.int64()) for w in words.T)], ["doc_id", "shared", *MAP])

    return sets.select("doc_id", "tokens").mapInArrow(run, "doc_id long, shared long, " + ", ".join(f"{m} long" for m in MAP))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of the edges (a, b); root is the smallest node of its component. Alternates large and small stars."""

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        near = both if large else both.where("v < u")
        least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        joined = near.join(least, "u")
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    now = mark(e)
    while True:
        e = cut(star(star(e, True), False), "edges")
        before, now = now, mark(e)
        if before == now:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets link."""
    side = lambda c: sets.select(F.col("doc_id").alias(c), F.col("n").alias(f"n{c}"), F.col("tokens").alias(f"t{c}"))
    both = F.size(F.array_intersect("ta", "tb"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(100 * both >= PERCENT * (F.col("na") + F.col("nb") - both)).select("a", "b")


def ranked(sig: DataFrame) -> DataFrame:
    """The signatures with each member's rank in its bucket, and the part of the bucket that it is in: a bucket as large as a range partition is dealt over several."""
    parts = int(sig.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sig = cut(sig.repartitionByRange(parts, "sig", "doc_id").withColumn("part", F.spark_partition_id()), "signatures")
    before = "coalesce(sum(k) OVER (PARTITION BY sig ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    spans = sig.groupBy("sig", "part").agg(F.count(F.lit(1)).alias("k")).withColumn("before", F.expr(before)).drop("k")
    own = sig.withColumn("own", F.expr("row_number() OVER (PARTITION BY sig, part ORDER BY doc_id)"))
    return cut(own.join(spans, ["sig", "part"]).withColumn("rank", F.col("own") + F.col("before")).drop("own", "before"), "signatures")


def join_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs."""
    names = ["k0", "k1", "k2", "k3"]
    key: list[Column] = [F.col("n"), F.xxhash64("tokens"), F.hash("tokens"), F.size("tokens")]
    every = cut(shared_tokens(docs), "sets").withColumns(dict(zip(names, key, strict=True)))
    keyed = every.where("tokens IS NOT NULL AND size(tokens) = n").select("doc_id", *names)
    same = keyed.groupBy(*names).agg(F.min("doc_id").alias("root"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
    # A doc_id may have several texts: only those that are copies leave, the others stay its own.
    copied = cut(keyed.join(same, names).where("doc_id > root").distinct(), "copies")
    copies = copied.select(F.col("doc_id").alias("a"), F.col("root").alias("b")).distinct()
    reps = cut(every.where("tokens IS NOT NULL").join(copied.drop("root"), ["doc_id", *names], "left_anti").drop(*names), "reps")

    sig = signatures(reps)
    busy = sig.groupBy("sig").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    sig = ranked(cut(sig.join(busy.select("sig"), "sig", "left_semi").withColumn("comp", F.col("doc_id")), "signatures"))
    links = copies
    done, step, first = 0, 1, True
    while True:
        last = done + step
        maps = [] if first else ["shared", *MAP]
        pivots = sig.where((F.col("rank") > done) & (F.col("rank") <= last)).select("sig", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("comp").alias("cb"), F.col("rank").alias("rb"), *(F.col(m).alias(f"b_{m}") for m in maps))
        fits = (F.col("rank") > F.col("rb")) & (F.col("comp") != F.col("cb")) & (100 * F.least("n", "nb") >= PERCENT * F.greatest("n", "nb"))
        if maps:
            apart = sum((F.bit_count(F.col(m).bitwiseXOR(F.col(f"b_{m}"))) for m in MAP), F.lit(0))
            most = F.col("shared") + F.col("b_shared") - apart  # twice what both hold, at most
            fits &= (100 + PERCENT) * most >= 2 * PERCENT * (F.col("n") + F.col("nb"))
        pivots = pivots.join(sig.select("sig", "part").distinct(), "sig")  # pivots go to every part of their bucket
        pairs = sig.join(pivots, ["sig", "part"]).where(fits)
        if first:  # one comparison for each member, with the smallest of its buckets' pivots, joins most of a group of copies
            pairs = pairs.groupBy(F.col("doc_id").alias("a")).agg(F.min("b").alias("b"))
        else:
            pairs = pairs.select(F.col("doc_id").alias("a"), "b").distinct()
        found = cut(_verified(pairs, reps), "links")
        if first or not found.isEmpty():  # else the components are as they were
            links = cut(links.unionByName(found), "links")
            roots = components(links)
            sig = sig.join(roots, sig["doc_id"] == roots["node"], "left").withColumn("comp", F.coalesce("root", "doc_id")).drop("node", "root")
        done = 0 if first else last
        left = sig.groupBy("sig").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max("rank").alias("members")).where((F.col("lo") != F.col("hi")) & (F.col("members") > done + 1))
        sig = sig.join(left.select("sig"), "sig", "left_semi")
        sig = cut(sig.join(parity_maps(reps), "doc_id") if first else sig, "signatures")
        if sig.isEmpty():
            break
        step, first = (step, False) if first else (step * 16, False)
    out = every.select("doc_id", F.col("n").alias("n_shingles"))
    return out.join(roots, out["doc_id"] == roots["node"], "left").select("doc_id", "n_shingles", F.coalesce("root", "doc_id").alias("component_id"))
