"""Suffix-array dedup: removes every byte of a 50-byte string that also starts in a document with a smaller id.

1. Super strings. Each 50-byte string has a minimizer: the 25-byte string in it with the least hash (the leftmost of equals), which depends on
   its bytes alone. Neighbouring strings with one minimizer make up a super string. Chunks of documents exchange the hashes of their
   minimizers by ranges and learn which occur again.
2. Equal super strings, by 96 bits of hash beside those of their minimizer's range, are settled by the smallest document: in all others the whole
   super string goes. Any string of those stands in that first holder too, so only first holders go on.
3. Suffix arrays. The strings of a super string fall into RANGES by where the minimizer lies; all strings of a range hold the same core around it.
   Where first holders that differ share a core, the range's strings may be shared. These pieces are dealt by the bytes of their core; a suffix
   array by linear grouping (gsaca.py) over each core's pieces sorts them, and neighbours with 50 equal bytes, compared as
   bytes, form classes, which give each string's smallest document. Blocks are bounded by BLOCK bytes: a core with more is dealt
   in several blocks, whose classes are joined by their 50 bytes.

Texts travel compressed with their chunk; ranges and chunks are sized from the data, so no task holds more than one of each. What a chunk repeats it
settles before it sends, so that a group of copies does not meet in one range.

Defined cases: a null text is empty; texts under 50 bytes lose nothing; matches never cross documents; rows that share a doc_id count as one
document, so they don't remove from each other, and each keeps its own result; rows with a null doc_id lose and remove nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, mix, range_bits, release
from .gsaca import suffix_arrays

LENGTH, GRAM = 50, 25
#: Distances (least, greatest) from a string's start to its minimizer, and the length of the bytes that all strings of such a range share.
RANGES = ((0, 12), (13, 25))
CORE = LENGTH - 12
#: Bytes of text in a chunk and in one pass over it, bytes of one suffix array, of those sorted together, and pieces of a core dealt to one task.
CHUNK, PASS, BLOCK, BATCH, HOT = 4 << 20, 1 << 18, 4096, 1 << 19, 2_000
_MASK = np.uint64((1 << 20) - 1)
_LOW = np.uint64(0xFFFFFFFF)

FINAL = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PIECES = "pieces array<struct<at: int, core: int, data: binary>>"
PLAIN = "bucket int, chunk long, data binary"
SENT = f"bucket int, chunk long, data binary, {FINAL}"
OPEN = f"{FINAL}, chunk long, row int, text binary, gone array<int>, {PIECES}"


@lru_cache(1)
def _tables() -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each of two rolling hashes a number for each byte, and the powers of an odd base and of its inverse."""
    rng, out = np.random.default_rng(20240301), []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        of = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        powers = [np.multiply.accumulate(np.append(np.uint64(1), np.full(PASS + LENGTH, b, np.uint64))) for b in (base, pow(base, -1, 1 << 64))]
        out.append((of, *powers))
    return out


def _prefix(part: np.ndarray, which: int) -> tuple[np.ndarray, np.ndarray]:
    of, power, inverse = _tables()[which]
    sums = np.zeros(len(part) + 1, np.uint64)
    np.cumsum(of[part] * power[: len(part)], out=sums[1:])
    return sums, inverse


def _hash(prefix: tuple[np.ndarray, np.ndarray], lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Hashes of part[lo:hi]."""
    return mix((prefix[0][hi] - prefix[0][lo]) * prefix[1][lo])


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    size = 1
    while size * 2 <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return x if size == n else np.minimum(x[: len(x) - (n - size)], x[n - size :])


def supers(buf: np.ndarray, edges: np.ndarray, skip: np.ndarray) -> Iterator[tuple]:
    """Super strings of joined texts but for the skipped, pass by pass: where the pass begins, its bytes and prefix sums, then each one's first and last start, minimizer and that one's hash."""
    n = len(buf)
    step = np.zeros(n + 1, np.int8)
    long = (np.diff(edges) >= LENGTH) & ~skip
    np.add.at(step, edges[:-1][long], 1)
    np.add.at(step, edges[1:][long] - LENGTH + 1, -1)
    ok = np.cumsum(step, dtype=np.int8)[:n] > 0
    for begin in range(0, n, PASS):
        part = buf[begin : begin + PASS + LENGTH - 1]
        if len(part) < LENGTH:
            return
        sums, inverse = prefix = _prefix(part, 0)
        m = len(part) - GRAM + 1
        h = mix((sums[GRAM:] - sums[:m]) * inverse[:m])
        least = _least(h & ~_MASK | np.arange(m, dtype=np.uint64), LENGTH - GRAM + 1)
        i = np.flatnonzero(ok[begin : begin + len(least)])
        if not len(i):
            continue
        at = (least[i] & _MASK).astype(np.int64)
        first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (i[1:] != i[:-1] + 1)))
        yield begin, part, prefix, i[first], i[np.append(first[1:], len(i)) - 1], at[first], h[at[first]]


# --- what travels -------------------------------------------------------------------------------------------------


def _join(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays one after another, each led by its length in bytes."""
    parts = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return b"".join([np.array([len(p) for p in parts], "<i8").tobytes(), *parts])


def _split(data: bytes, *kinds: str) -> list:
    sizes, out, at = np.frombuffer(data, "<i8", len(kinds)).tolist(), [], 8 * len(kinds)
    for size, kind in zip(sizes, kinds, strict=True):
        out.append(data[at : at + size] if kind == "raw" else np.frombuffer(data, kind, size // np.dtype(kind).itemsize, at))
        at += size
    return out


def _head(docs: np.ndarray, null: np.ndarray, edges: np.ndarray, buf: np.ndarray, *more: np.ndarray) -> bytes:
    return _join(docs.astype("<i8"), null.astype("u1"), edges.astype("<i8"), pa.Codec("zstd", compression_level=3).compress(np.ascontiguousarray(buf).tobytes(), asbytes=True), *more)


def _unhead(data: bytes, *kinds: str) -> list:
    docs, null, edges, text, *more = _split(data, "<i8", "u1", "<i8", "raw", *kinds)
    buf = np.frombuffer(pa.decompress(text, int(edges[-1]), "zstd", asbytes=True), np.uint8)
    return [docs, null.astype(bool), edges, buf, *more]


def _table(schema: str, rows: list[tuple]) -> pa.Table:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split(" ", 1) for f in schema.split(", ") if not f.startswith("pieces") and not f.startswith(("core:", "data:"))]
    types = [(name, kinds[kind]) for name, kind in fields]
    if "pieces" in schema:
        types.append(("pieces", pa.list_(pa.struct([("at", pa.int32()), ("core", pa.int32()), ("data", pa.binary())]))))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(types)
    return pa.table([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


def _result(doc: int | None, text: np.ndarray, gone: np.ndarray | None) -> tuple:
    """The row of a document whose bytes under gone are removed."""
    if gone is None or not gone.any():
        return doc, len(text), 0, 0, hashlib.sha256(text.tobytes()).hexdigest()
    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
    return doc, len(text), int(gone.sum()), spans, hashlib.sha256(text[~gone].tobytes()).hexdigest()


def _covered(n: int, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in one of the intervals."""
    step = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(end, minlength=n + 1)[: n + 1]
    return np.cumsum(step[:n]) > 0


# --- the steps ----------------------------------------------------------------------------------------------------


def _send_minimizers(bits: int):
    low, keep = np.uint64((1 << bits) - 1), np.uint64((1 << (40 + bits)) - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, k = TaskContext.get().partitionId(), 0
        docs, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            null = np.array([d is None for d in docs])
            edges = np.cumsum([0, *map(len, texts)])
            buf = np.frombuffer(b"".join(texts), np.uint8)
            found = [h & keep for *_, h in supers(buf, edges, null)]
            values, times = np.unique(np.concatenate([np.empty(0, np.uint64), *found]), return_counts=True)
            bucket = (values & low).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            values, times = values[order] >> np.uint64(bits), times[order] > 1
            cuts = np.flatnonzero(np.append(True, bucket[order][1:] != bucket[order][:-1])) if len(values) else np.empty(0, np.int64)
            rows = [(-1, chunk, _head(np.array([0 if d is None else d for d in docs]), null, edges, buf))]
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)], strict=True) if len(cuts) else ():
                v = values[lo:hi]
                rows.append((int(bucket[order[lo]]), chunk, _join((v & _LOW).astype("<u4"), (v >> np.uint64(32)).astype("u1"), np.packbits(times[lo:hi]))))
            return _table(PLAIN, rows).to_batches()[0]

        for b in batches:
            for lo in range(0, b.num_rows, 256):
                for d, t in zip(b.column(0)[lo : lo + 256].to_pylist(), b.column(1)[lo : lo + 256].to_pylist(), strict=True):
                    docs.append(d)
                    texts.append((t or "").encode("utf-8", "surrogatepass"))
                    size += len(texts[-1]) + 64
                    if size >= CHUNK:
                        chunk, k = (part << 24) + k, k + 1
                        yield flush()
                        docs, texts, size = [], [], 0
        if docs:
            chunk = (part << 24) + k
            yield flush()

    return run


def _again(group: pa.Table) -> pa.Table:
    """For each chunk the minimizers of a range that occur again somewhere."""
    bucket = group.column("bucket")[0].as_py()
    found = [_split(d, "<u4", "u1", "u1") for d in group.column("data").to_pylist()]
    values = [lo | hi.astype(np.uint64) << np.uint64(32) for lo, hi, _ in found]
    times = [1 + np.unpackbits(t, count=len(v)).astype(np.int64) for v, (_, _, t) in zip(values, found, strict=True)]
    _, inverse = np.unique(np.concatenate(values), return_inverse=True)
    again = (np.bincount(inverse, np.concatenate(times)) > 1)[inverse]
    rows, at = [], 0
    for chunk, v, (lo, hi, _) in zip(group.column("chunk").to_pylist(), values, found, strict=True):
        own = again[at : at + len(v)]
        at += len(v)
        if own.any():
            rows.append((bucket, chunk, _join(lo[own], hi[own])))
    return _table(PLAIN, rows)


def _entries(buf: np.ndarray, edges: np.ndarray, null: np.ndarray, docs: np.ndarray, shared: np.ndarray, keep: np.uint64) -> dict[str, np.ndarray]:
    """The super strings of a chunk whose minimizers occur again."""
    out: dict[str, list] = {c: [] for c in ("h", "snip", "more", "core0", "core1", "at", "back0", "back1")}
    for begin, part, prefix, a, b, p, h in supers(buf, edges, null):
        h = h & keep
        spot = np.minimum(np.searchsorted(shared, h), len(shared) - 1)
        own = shared[spot] == h
        if not own.any():
            continue
        a, b, p, h, second = a[own], b[own], p[own], h[own], _prefix(part, 1)
        whole = _hash(prefix, a, b + LENGTH)
        out["h"].append(h)
        out["snip"].append(mix(whole + ((p - a) * 64 + (p - b)).astype(np.uint64)))
        out["more"].append(_hash(second, a, b + LENGTH) & _LOW)
        for j, (lo, hi) in enumerate(RANGES):
            fits = np.maximum(a, p - hi) <= np.minimum(b, p - lo)
            at = np.where(fits, p - lo, 0)
            out[f"core{j}"].append(np.where(fits, _hash(second, at, at + CORE), mix(whole + np.uint64(j + 1))) >> np.uint64(32))
        out["at"].append(p + begin)
        out["back0"].append(p - a)
        out["back1"].append(p - b)
    kinds = [np.uint64] * 5 + [np.int64] * 3
    found = {c: np.concatenate(x) if x else np.empty(0, k) for (c, x), k in zip(out.items(), kinds, strict=True)}
    found["row"] = np.searchsorted(edges, found["at"], side="right") - 1
    found["doc"] = docs[found["row"]]
    return found


def _send_supers(bits: int):
    low, keep = np.uint64((1 << bits) - 1), np.uint64((1 << (40 + bits)) - 1)

    def run(group: pa.Table) -> pa.Table:
        chunk = group.column("chunk")[0].as_py()
        head, shared = None, [np.empty(0, np.uint64)]
        for bucket, data in zip(group.column("bucket").to_pylist(), group.column("data").to_pylist(), strict=True):
            if bucket < 0:
                head = data
            else:
                lo, hi = _split(data, "<u4", "u1")
                shared.append((lo | hi.astype(np.uint64) << np.uint64(32)) << np.uint64(bits) | np.uint64(bucket))
        docs, null, edges, buf = _unhead(head)
        shared = np.sort(np.concatenate(shared))
        x = _entries(buf, edges, null, docs, shared, keep) if len(shared) else None
        on = np.zeros(len(docs), bool)
        if x is not None:
            on[x["row"]] = True
        rows = [(None, None, None, *_result(None if null[r] else int(docs[r]), buf[edges[r] : edges[r + 1]], None)) for r in np.flatnonzero(~on).tolist()]
        nothing = (None,) * 5
        if on.any():
            # What the chunk itself holds in a smaller document needs no exchange.
            order = np.lexsort((x["doc"], x["more"], x["snip"]))
            x = {c: v[order] for c, v in x.items()}
            first = np.append(True, (x["snip"][1:] != x["snip"][:-1]) | (x["more"][1:] != x["more"][:-1]))
            root = x["doc"][first][np.cumsum(first) - 1]
            lengths = np.where(on, np.diff(edges), 0)
            moved = np.concatenate([[0], np.cumsum(lengths)])
            x["at"] = x["at"] - edges[x["row"]] + moved[x["row"]]
            gone = x["doc"] > root
            text = buf[np.repeat(on, np.diff(edges))]
            local = [x[c][gone].astype(k) for c, k in (("at", "<u4"), ("back0", "u1"), ("back1", "u1"))]
            rows.append((-1, chunk, _head(docs[on], null[on], np.append(0, np.cumsum(np.diff(edges)[on])), text, *local), *nothing))
            sent = np.flatnonzero(~gone)
            bucket = (x["h"][sent] & low).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            sent, bucket = sent[order], bucket[order]
            cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
            for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(sent)], strict=True):
                own = sent[lo:hi]
                doc = x["doc"][own]
                base = int(doc.min())
                wide = int(doc.max()) - base >> 32
                data = _join(np.array([base], "<i8"), (doc - base).astype("<i8" if wide else "<u4"), np.array([wide], "<i8"), x["snip"][own], *(x[c][own].astype("<u4") for c in ("more", "core0", "core1", "at")), *(x[c][own].astype("u1") for c in ("back0", "back1")))
                rows.append((int(bucket[lo]), chunk, data, *nothing))
        return _table(SENT, rows)

    return run


def _judge(group: pa.Table) -> pa.Table:
    """For each chunk its super strings that a smaller document holds too (state 0), and first holders' whose ranges may be shared (a bit for each range)."""
    bucket = group.column("bucket")[0].as_py()
    parts = []
    for d in group.column("data").to_pylist():
        base, doc, wide, *x = _split(d, "<i8", "raw", "<i8", "<u8", "<u4", "<u4", "<u4", "<u4", "u1", "u1")
        parts.append((np.frombuffer(doc, "<i8" if wide[0] else "<u4").astype(np.int64) + base[0], *x))
    doc, snip, more, core0, core1, at, back0, back1 = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.lexsort((doc, more, snip))
    first = np.append(True, (snip[order][1:] != snip[order][:-1]) | (more[order][1:] != more[order][:-1]))
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(first) - 1
    heads = order[first]
    settled = doc > doc[heads][number]
    state = np.zeros(len(doc), np.uint8)
    for j, core in enumerate((core0, core1)):
        _, inverse, times = np.unique(core[heads], return_inverse=True, return_counts=True)
        state |= ((times[inverse] > 1)[number] << j).astype(np.uint8)
    state[settled] = 0
    rows, begin = [], 0
    for chunk, p in zip(group.column("chunk").to_pylist(), parts, strict=True):
        own = np.arange(begin, begin + len(p[0]))
        begin += len(p[0])
        own = own[settled[own] | (state[own] > 0)]
        if len(own):
            rows.append((bucket, chunk, _join(at[own], back0[own], back1[own], state[own])))
    return _table(PLAIN, rows)


def _gather(group: pa.Table) -> pa.Table:
    """Results of a chunk's documents, or, where strings are open, the document with what goes already and its pieces."""
    chunk = group.column("chunk")[0].as_py()
    head, found = None, []
    for bucket, data in zip(group.column("bucket").to_pylist(), group.column("data").to_pylist(), strict=True):
        if bucket < 0:
            head = data
        else:
            found.append(_split(data, "<u4", "u1", "u1", "u1"))
    docs, null, edges, buf, *local = _unhead(head, "<u4", "u1", "u1")
    at, back0, back1 = (np.concatenate([x, *(f[k] for f in found)]).astype(np.int64) for k, x in enumerate(local))
    state = np.concatenate([np.zeros(len(local[0]), np.uint8), *(f[3] for f in found)])
    first, last = at - back0, at - back1
    n, gone = len(buf), state == 0
    going = _covered(n, first[gone], last[gone] + LENGTH)
    row = np.searchsorted(edges, at, side="right") - 1
    pieces: list[list[tuple]] = [[] for _ in docs]
    offsets = edges.tolist()
    # First and last starts of the runs of strings that go; no run crosses documents, as a text's last 49 bytes start none.
    runs = np.flatnonzero(np.diff(_covered(n, first[gone], last[gone] + 1).astype(np.int8), prepend=0, append=0)).reshape(-1, 2)
    border = np.searchsorted(runs[:, 0], edges)
    raw = buf.tobytes()
    for j, (lo, hi) in enumerate(RANGES):
        k = np.flatnonzero(state >> j & 1)
        a, b = np.maximum(first[k], at[k] - hi), np.minimum(last[k], at[k] - lo)
        k, a, b = k[a <= b], a[a <= b], b[a <= b]
        for r, x, core, end in zip(row[k].tolist(), a.tolist(), (at[k] - lo - a).tolist(), (b + LENGTH).tolist(), strict=True):
            pieces[r].append({"at": x - offsets[r], "core": core, "data": raw[x:end]})
    rows = []
    for r, (lo, hi) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
        if pieces[r]:
            rows.append((int(docs[r]), hi - lo, None, None, None, chunk, r, raw[lo:hi], (runs[border[r] : border[r + 1]] - [lo, lo + 1]).ravel().tolist(), pieces[r]))
        else:
            rows.append((*_result(int(docs[r]), buf[lo:hi], going[lo:hi]), chunk, r, None, None, None))
    return _table(OPEN, rows)


def classes(pieces: list[bytes], lane: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Piece, start in it, and class for every 50-byte string of the pieces, in the order of their lanes' suffix arrays; classes are of one lane."""
    sizes = np.array([len(p) for p in pieces])
    symbols = np.frombuffer(b"".join(p + b"\0" for p in pieces), np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    symbols = symbols.astype(np.int64) + 2
    symbols[ends] = 1
    close = np.append(lane[1:] != lane[:-1], True)
    symbols[ends[close]] = 0
    order = suffix_arrays(symbols, np.repeat(lane, sizes + 1))
    owner = np.repeat(np.arange(len(pieces)), sizes + 1)[order]
    start = order - (ends - sizes)[owner]
    ok = start <= sizes[owner] - LENGTH
    order, owner, start = order[ok], owner[ok], start[ok]
    views = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.uint8), LENGTH)[order]
    new = (views[1:] != views[:-1]).any(axis=1) | (lane[owner[1:]] != lane[owner[:-1]])
    return owner, start, np.cumsum(np.append(False, new))


HITS = "chunk long, row int, at int, mask int, string binary, root long, users array<struct<chunk: long, row: int, at: int, doc: long>>"


def _sort(block: int):
    """Rows of pieces come by core. Gives a mask of each piece's strings that a smaller document holds; for cores in several blocks each class with its users."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        user = pa.struct([("chunk", pa.int64()), ("row", pa.int32()), ("at", pa.int32()), ("doc", pa.int64())])
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int64(), pa.list_(user)]
        names = ["chunk", "row", "at", "mask", "string", "root", "users"]
        blocks: list[tuple[dict, bool]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            data = [p for members, _ in blocks for p in members]
            users = [u for members, _ in blocks for u in members.values()]
            lane = np.repeat(np.arange(len(blocks)), [len(members) for members, _ in blocks])
            split = np.array([s for _, s in blocks])[lane]
            roots = np.array([min(u)[0] for u in users], np.int64)
            owner, start, number = classes(data, lane)
            first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            least = np.minimum.reduceat(roots[owner], first)
            out = []
            hit = (least[number] < roots[owner]) & ~split[owner]
            masks = np.zeros(len(data), np.int64)
            np.bitwise_or.at(masks, owner[hit], 1 << start[hit])
            for k, own in enumerate(users):
                if not split[k]:
                    whole, mask = (1 << len(data[k]) - LENGTH + 1) - 1, int(masks[k])
                    for doc, chunk, row, at in own:
                        m = whole if doc > roots[k] else mask
                        if m:
                            out.append((chunk, row, at, m, None, None, None))
            for lo, hi in zip(first.tolist(), [*first[1:].tolist(), len(owner)], strict=True):
                if split[owner[lo]]:
                    string = data[owner[lo]][start[lo] : start[lo] + LENGTH]
                    own = [{"chunk": c, "row": r, "at": at + int(start[k]), "doc": d} for k in range(lo, hi) for d, c, r, at in users[owner[k]]]
                    out.append((None, None, None, None, string, int(least[number[lo]]), own))
            columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        def close(members: dict, more: bool) -> int:
            """The core's last block; one that a single document holds is dropped."""
            if not more and len({u[0] for own in members.values() for u in own}) == 1:
                return 0
            blocks.append((members, more))
            return sum(map(len, members))

        now, members, more, bytes_ = None, {}, False, 0
        for b in batches:
            for core, hot, data, *own in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if (core, hot) != now:
                    if members:
                        size += close(members, more)
                    now, members, more, bytes_ = (core, hot), {}, hot >= 0, 0
                elif bytes_ >= block and data not in members:
                    more = True
                    size += close(members, more)
                    members, bytes_ = {}, 0
                if data in members:
                    members[data].append(tuple(own))
                else:
                    members[data] = [tuple(own)]
                    bytes_ += len(data)
                if size >= BATCH:
                    yield flush()
                    blocks, size = [], 0
        if members:
            close(members, more)
        if blocks:
            yield flush()

    return run


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, 64):
            out = []
            for doc, text, gone, hits in zip(*(b.slice(lo, 64).column(i).to_pylist() for i in range(4)), strict=True):
                spans = np.array(gone or [], np.int64).reshape(-1, 2)
                ats = np.array([h["at"] for h in hits or []], np.int64)
                masks = np.array([h["mask"] for h in hits or []], np.int64)
                k, bit = np.nonzero(masks[:, None] >> np.arange(13) & 1)
                first = np.concatenate([spans[:, 0], ats[k] + bit])
                end = np.concatenate([spans[:, 1], ats[k] + bit]) + LENGTH
                out.append(_result(doc, np.frombuffer(text, np.uint8), _covered(len(text), first, end)))
            yield _table(FINAL, out).to_batches()[0]


def _exchange_minimizers(docs: DataFrame, bits: int) -> tuple[DataFrame, str]:
    """Results of documents that share no minimizer, chunks of the others, and their super strings by range."""
    sent = docs.mapInArrow(_send_minimizers(bits), PLAIN)
    again = sent.groupBy("bucket", F.when(F.col("bucket") < 0, F.col("chunk"))).applyInArrow(lambda t: t if t.column("bucket")[0].as_py() < 0 else _again(t), PLAIN)
    return cut(again.groupBy("chunk").applyInArrow(_send_supers(bits), SENT), "supers", True)


def _judged(second: DataFrame) -> DataFrame:
    """What is settled or open of each chunk's super strings."""
    return cut(second.where("bucket >= 0").select("bucket", "chunk", "data").groupBy("bucket").applyInArrow(_judge, PLAIN), "judged")


def _gathered(second: DataFrame, judged: DataFrame, final: list[str]) -> DataFrame:
    """Results of documents that have no open strings, and the others with their pieces."""
    done = second.where("bucket IS NULL").select(*final)
    heads = second.where("bucket = -1").select("bucket", "chunk", "data")
    gathered = judged.unionByName(heads).groupBy("chunk").applyInArrow(_gather, OPEN)
    return cut(gathered.unionByName(done, allowMissingColumns=True), "open")


def dedup(docs: DataFrame, block: int = BLOCK, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; block and hot bound a suffix array's bytes and a core's pieces in one task."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = range_bits(docs, 0.5)
    final = [f.split()[0] for f in FINAL.split(", ")]

    second, second_path = _exchange_minimizers(docs, bits)
    release(spark)
    judged = _judged(second)
    release(spark)
    state = _gathered(second, judged, final)
    del second
    discard(spark, second_path)
    release(spark)

    todo = state.where("text IS NOT NULL")
    each = todo.select("chunk", "row", F.col("doc_id").alias("doc"), F.explode("pieces").alias("p"))
    each = each.select(F.expr("substring(p.data, p.core + 1, " + str(CORE) + ")").alias("core"), F.col("p.data").alias("data"), "doc", "chunk", "row", F.col("p.at").alias("at"))
    heavy = each.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    each = each.join(heavy, "core", "left").withColumn("hot", F.when(F.col("n").isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64("data"), F.ceil(F.col("n") / hot)).cast("int")))
    dealt = each.select("core", "hot", "data", "doc", "chunk", "row", "at").repartition("core", "hot").sortWithinPartitions("core", "hot")
    hits = cut(dealt.mapInArrow(_sort(block), HITS), "hits")
    plain_hits = hits.where("string IS NULL").select("chunk", "row", "at", "mask")
    split = hits.where("string IS NOT NULL").select("string", "root", "users")
    roots = split.groupBy("string").agg(F.min("root").alias("least"))
    users = split.join(roots, "string").select("least", F.explode("users").alias("u")).where("u.doc > least").select("u.chunk", "u.row", "u.at", F.lit(1).alias("mask"))
    found = plain_hits.unionByName(users).groupBy("chunk", "row").agg(F.collect_list(F.struct("at", "mask")).alias("hits"))
    rest = todo.select("chunk", "row", "doc_id", "text", "gone").join(found, ["chunk", "row"], "left").select("doc_id", "text", "gone", "hits")
    return state.where("text IS NULL").select(*final).unionByName(rest.mapInArrow(_finish, FINAL))
