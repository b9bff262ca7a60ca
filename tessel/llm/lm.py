"""LM scoring: an interpolated modified Kneser-Ney bigram model, counted in Spark, stored as sorted hash arrays, memory-mapped by workers.

Counting: every task sends its distinct bigrams, unigrams and their counts, packed by hash range, to the ranges' tasks. These merge them and write one
file for each range to the shared folder: bigrams as (hash of the first word, hash of the second) sorted, with counts; the contexts' totals and numbers of
followers seen once, twice and more often; unigrams with counts. A second exchange sums for each word the number of distinct words before it. The
scoring tasks map these files and look up their sorted keys by binary search; the model is never held in a task's own memory, nor sent to the driver,
which gets only sums: N, V and counts of counts. Bytes gathered grow with the corpus.

A word is known by a 64-bit hash; inside bigram keys by 32 bits of it, besides the bits of the range for the first. Words: A-Z lower-cased, split at
space and 0x09-0x0D, then one end token; a begin mark stands before the first and is not predicted.

Defined cases: null or blank texts are the end token alone; rows that repeat count and are scored each; a null doc_id counts as held out of nothing: its
remainder is that of the text "null"; no training documents give a uniform model over the unknown word.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_file, mix, new_folder, put_file, text_slices, word_hashes

HELD_OUT = 10
#: Tokens that a task gathers before it sends them on.
CHUNK = 3_000_000
END = mix(np.array([0x0E0E0E0E0E0E0E0E], np.uint64))[0]
BEGIN = mix(np.array([0x0B0B0B0B0B0B0B0B], np.uint64))[0]
_LOW = np.uint64(0xFFFFFFFF)


def held_out(key) -> bool:
    return zlib.crc32(b"null" if key is None else str(key).encode()) % HELD_OUT == 0


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all texts' tokens, each text closed by END, and the texts' borders."""
    words, bounds = word_hashes(texts)
    n = np.diff(bounds)
    out = np.full(len(words) + len(texts), END, np.uint64)
    ends = np.cumsum(n + 1)
    keep = np.ones(len(out), bool)
    keep[ends - 1] = False
    out[keep] = words
    return out, np.concatenate([[0], ends])


def before(toks: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.empty_like(toks)
    out[1:] = toks[:-1]
    out[bounds[:-1]] = BEGIN
    return out


def end_bits(bits: int) -> int:
    """Bits of the ranges of words that the second exchange sums over. These are fewer, as every range of contexts sends a row to each."""
    return min(bits, max(6, bits - 3))


def _sorted_counts(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    unique, inverse = np.unique(values, return_inverse=True)
    return unique, np.bincount(inverse, counts, len(unique)).astype(np.int64)


class Model:
    """The mapped files of a model and its few numbers."""

    def __init__(self, folder: str, bits: int, stats: dict) -> None:
        self.bits, self.stats = bits, stats
        self.parts, less = [], bits - end_bits(bits)
        ends = [[map_file(f"{folder}/{name}-{b}", "<u4") for name in ("cont", "contn")] for b in range(1 << end_bits(bits))]
        for b in range(1 << bits):
            read = lambda name, kind, b=b: map_file(f"{folder}/{name}-{b}", kind)
            self.parts.append((read("uni", "<u8"), read("unic", "<u4"), *ends[b >> less], read("ctx", "<u4"), read("ctxn", "<u4"), read("bi", "<u8"), read("bic", "u1"), read("big", "<u4")))

    def _each(self, keys: np.ndarray):
        """The parts of the model with the sorted keys that they hold."""
        edges = np.searchsorted(keys, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)) if self.bits else []
        edges = [0, *edges, len(keys)]
        return ((self.parts[b], int(lo), int(hi)) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if lo < hi)

    @staticmethod
    def _find(array: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(array, keys)
        hit = at < len(array)
        hit[hit] = array[at[hit]] == keys[hit]
        return at, hit

    def words(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For sorted word hashes: training counts, continuation counts, and the contexts' (total, once, twice, more)."""
        count, cont, ctx = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64), np.zeros((len(keys), 4), np.int64)
        for (uni, unic, words, n, starts, table, _, _, _), lo, hi in self._each(keys):
            at, hit = self._find(uni, keys[lo:hi])
            count[lo:hi][hit] = unic[at[hit]]
            short = ((keys[lo:hi] << np.uint64(self.bits)) >> np.uint64(32)).astype(np.uint32)
            at, hit = self._find(words, (keys[lo:hi] >> np.uint64(32)).astype(np.uint32))
            cont[lo:hi][hit] = n[at[hit]]
            at, hit = self._find(starts, short)
            ctx[lo:hi][hit] = table.reshape(-1, 4)[at[hit]]
        return count, cont, ctx

    def pairs(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """Counts of bigrams, given by word hashes."""
        key = (first << np.uint64(self.bits)) & ~_LOW | second >> np.uint64(32)
        part = (first >> np.uint64(64 - self.bits)).astype(np.int64) if self.bits else np.zeros(len(first), np.int64)
        order = np.lexsort((key, part))
        edges = np.searchsorted(part[order], np.arange((1 << self.bits) + 1))
        out = np.zeros(len(first), np.int64)
        for b in range(1 << self.bits):
            own = order[edges[b] : edges[b + 1]]
            if len(own):
                bi, bic, big = self.parts[b][6:]
                at, hit = self._find(bi, key[own])
                found = bic[at[hit]].astype(np.int64)
                if (large := found == 255).any():
                    rest = big.reshape(-1, 2)
                    found[large] = rest[np.searchsorted(rest[:, 0], at[hit][large]), 1]
                out[own[hit]] = found
        return out

    def probability(self, count: np.ndarray, ctx: np.ndarray, cont: np.ndarray) -> np.ndarray:
        """Interpolated probability from a bigram's count, its context's numbers and its word's continuation count."""
        s = self.stats
        d1, d2 = np.array([0.0, *s["d1"]]), np.array([0.0, *s["d2"]])
        if s["types"]:
            low = (np.maximum(cont - d1[np.minimum(cont, 3)], 0) + s["left1"] / (s["V"] + 1)) / s["types"]
        else:
            low = np.full(len(cont), 1 / (s["V"] + 1))
        total = np.maximum(ctx[:, 0], 1)
        high = (np.maximum(count - d2[np.minimum(count, 3)], 0) + ctx[:, 1:] @ np.array(s["d2"]) * low) / total
        return np.where(ctx[:, 0] > 0, high, low)


def discounts(n: list[int]) -> list[float]:
    """D1, D2 and D3+ from the numbers of types seen one to four times; 0.5, 1 and 1.5 where these don't give them."""
    if min(n) <= 0:
        return [0.5, 1.0, 1.5]
    y = n[0] / (n[0] + 2 * n[1])
    found = [k + 1 - (k + 2) * y * n[k + 1] / n[k] for k in range(3)]
    return [min(max(d, 0.0), k + 1) for k, d in enumerate(found)]


def train(docs: DataFrame, bits: int | None = None) -> tuple[str, int, dict]:
    """Counts the model from the rows; gives its folder, the bits of its ranges, and its numbers."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    bits = max(6, (parts - 1).bit_length() - 1) if bits is None else bits
    ends = end_bits(bits)
    folder, ranges, shift = new_folder(spark, "lm"), 1 << bits, np.uint64(64 - bits)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        uni, first, size = [], [], 0

        def flush() -> pa.RecordBatch:
            toks, prev = np.concatenate(uni), np.concatenate(first)
            u, c = np.unique(toks, return_counts=True)
            edges = np.searchsorted(u >> shift, np.arange(ranges + 1, dtype=np.uint64))
            key = (prev << np.uint64(bits)) & ~_LOW | toks >> np.uint64(32)
            part = (prev >> shift).astype(np.uint32)
            order = np.argsort(part, kind="stable")
            at = np.searchsorted(part[order], np.arange(ranges + 1))
            rows, data = [], []
            for b in range(ranges):
                x, n = np.unique(key[order[at[b] : at[b + 1]]], return_counts=True)
                lo, hi = edges[b], edges[b + 1]
                if hi > lo or len(x):
                    few = np.minimum(n, 255).astype("u1")
                    rows.append(b)
                    data.append(b"".join([np.array([hi - lo, len(x), (few == 255).sum()], "<u4").tobytes(), u[lo:hi].astype("<u8").tobytes(), c[lo:hi].astype("<u4").tobytes(), n[few == 255].astype("<u4").tobytes(), x.astype("<u8").tobytes(), few.tobytes()]))
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(data, pa.binary())], ["part", "data"])

        for keys, texts in text_slices(batches):
            if learn := [t for k, t in zip(keys, texts, strict=True) if not held_out(k)]:
                toks, bounds = tokens(learn)
                uni.append(toks)
                first.append(before(toks, bounds))
                size += len(toks)
                if size >= CHUNK:
                    yield flush()
                    uni, first, size = [], [], 0
        if uni:
            yield flush()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        b, us, cs, xs, ns = int(group["part"].iloc[0]), [], [], [], []
        for d in group["data"]:
            u, x, big = np.frombuffer(d, "<u4", 3).tolist()
            at = 12
            us.append(np.frombuffer(d, "<u8", u, at))
            cs.append(np.frombuffer(d, "<u4", u, at + 8 * u))
            at += 12 * u
            large = np.frombuffer(d, "<u4", big, at)
            xs.append(np.frombuffer(d, "<u8", x, at + 4 * big))
            few = np.frombuffer(d, "u1", x, at + 4 * big + 8 * x).astype(np.int64)
            few[few == 255] = large
            ns.append(few)
        uni, c = _sorted_counts(np.concatenate(us), np.concatenate(cs))
        bi, n = _sorted_counts(np.concatenate(xs), np.concatenate(ns))
        starts, first, group_n = np.unique((bi >> np.uint64(32)).astype(np.uint32), return_index=True, return_counts=True)
        edges = np.append(first, len(bi)).astype(np.int64)
        sums = lambda v: np.diff(np.concatenate([[0], np.cumsum(v)])[edges])
        table = np.stack([sums(n), sums(n == 1), sums(n == 2), sums(n >= 3)], axis=1) if len(bi) else np.zeros((0, 4))
        large = np.flatnonzero(n >= 255)
        put_file(f"{folder}/uni-{b}", uni.astype("<u8").tobytes())
        put_file(f"{folder}/unic-{b}", c.astype("<u4").tobytes())
        put_file(f"{folder}/ctx-{b}", starts.astype("<u4").tobytes())
        put_file(f"{folder}/ctxn-{b}", table.astype("<u4").tobytes())
        put_file(f"{folder}/bi-{b}", bi.astype("<u8").tobytes())
        put_file(f"{folder}/bic-{b}", np.minimum(n, 255).astype("u1").tobytes())
        put_file(f"{folder}/big-{b}", np.stack([large, n[large]], axis=1).astype("<u4").tobytes())
        seconds, m = np.unique((bi & _LOW).astype(np.uint32), return_counts=True)
        to = seconds >> np.uint32(32 - ends)
        edges = np.searchsorted(to, np.arange((1 << ends) + 1))
        numbers = np.array([c.sum(), len(uni), *((n == k).sum() for k in (1, 2, 3, 4))], "<i8").tobytes()
        rows = [(-1, numbers)]
        rows += [(k, np.array([hi - lo], "<u4").tobytes() + seconds[lo:hi].tobytes() + m[lo:hi].astype("<u4").tobytes()) for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo or k == b >> (bits - ends)]
        return pd.DataFrame(rows, columns=["part", "data"])

    def follow(group: pd.DataFrame) -> pd.DataFrame:
        b = int(group["part"].iloc[0])
        if b < 0:
            return pd.DataFrame({"kind": 0, "v": [np.sum([np.frombuffer(d, "<i8") for d in group["data"]], axis=0)]})
        size = [int(np.frombuffer(d, "<u4", 1)[0]) for d in group["data"]]
        words, n = _sorted_counts(np.concatenate([np.frombuffer(d, "<u4", k, 4) for d, k in zip(group["data"], size, strict=True)]), np.concatenate([np.frombuffer(d, "<u4", k, 4 + 4 * k) for d, k in zip(group["data"], size, strict=True)]))
        put_file(f"{folder}/cont-{b}", words.astype("<u4").tobytes())
        put_file(f"{folder}/contn-{b}", n.astype("<u4").tobytes())
        return pd.DataFrame({"kind": 1, "v": [[int(n.sum()), *(int((n == k).sum()) for k in (1, 2, 3, 4)), len(n)]]})

    sent = docs.select("doc_id", "text").mapInArrow(count, "part int, data binary")
    # Ranges without words get their empty files too.
    sent = sent.unionByName(spark.range(0, ranges, 1, 1).select(F.col("id").cast("int").alias("part"), F.lit(bytes(12)).alias("data")))
    merged = sent.groupBy("part").applyInPandas(merge, "part int, data binary")
    rows = merged.groupBy("part").applyInPandas(follow, "kind int, v array<long>").groupBy("kind").agg(*(F.sum(F.col("v")[k]) for k in range(6))).collect()  # two rows
    found = {r[0]: [int(x) for x in r[1:]] for r in rows}
    n, v, *two = found.get(0, [0] * 6)
    types, *one, words = found.get(1, [0] * 6)
    d1, d2 = discounts(one), discounts(two)
    left = d1[0] * one[0] + d1[1] * one[1] + d1[2] * (words - one[0] - one[1])
    return folder, bits, {"N": n, "V": v, "types": types, "d1": d1, "d2": d2, "left1": left}


def score(docs: DataFrame, folder: str, bits: int, stats: dict) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for keys, texts in text_slices(batches):
            model = model or Model(folder, bits, stats)
            toks, bounds = tokens(texts)
            unique, at = np.unique(np.append(toks, BEGIN), return_inverse=True)
            count, cont, ctx = model.words(unique)
            prev = before(toks, bounds)
            own, context = at[:-1], before(at[:-1], bounds)
            context[bounds[:-1]] = at[-1]
            pair = model.pairs(prev, toks)
            p = np.log10(model.probability(pair, ctx[context], cont[own]))
            base = np.log10((count[own] + 0.1) / (stats["N"] + 0.1 * (stats["V"] + 1)))
            add = lambda x: np.add.reduceat(x, bounds[:-1])
            m = len(keys)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array([held_out(k) for k in keys]), pa.array(np.diff(bounds), pa.int64()), pa.array(add((count[own] > 0).astype(np.int64)), pa.int64()), pa.array([stats["N"]] * m, pa.int64()), pa.array(add(base)), pa.array(add(p))],
                ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
