"""Secret scans: candidate strings, then a random forest that removes false positives.

Candidates are runs of at least MIN_LENGTH characters of base64 and identifiers that hold a digit or an upper-case letter or begin with an
issuer's prefix, values of at least five characters assigned to words such as password, and passwords in URLs (user:password@host).
The forest sees a candidate's length, its character transitions, its dictionary coverage, its prefix, its path and the words beside it. It is trained on the driver from labelled findings, at most MAX_FINDINGS of them (taken in the order of a hash of their values); the trees
are a few kilobytes. Scanning covers every text whole and shuffles nothing.

Defined cases: null and empty texts have no candidates; repeated rows are scanned each; a null source is an empty path; candidates don't overlap;
offsets count code points. redact() puts REDACTED for each secret and sets n_chars where it exists; texts without secrets stay as they are.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LENGTH, MAX_FINDINGS, THRESHOLD, REDACTED = 16, 20_000, 0.5, "[REDACTED]"
TREES, DEPTH, LEAF = 25, 8, 4
RUN = re.compile(rb"[A-Za-z0-9+/_\-]{16,}={0,2}")
ASSIGNED = re.compile(rb"(?i)(?:password|passwd|pwd|secret|token|api_?key)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([^\s\"'<>]{5,})")
LOGIN = re.compile(rb"://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")
PREFIXES = (b"AKIA", b"ASIA", b"ghp_", b"gho_", b"ghu_", b"ghs_", b"ghr_", b"github_pat_", b"glpat-", b"sk_live_", b"rk_live_", b"xoxb-", b"xoxp-", b"xoxa-", b"AIza", b"npm_")
#: Words beside a candidate that speak for a secret or for something else, and common parts of identifiers.
FOR = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "bearer", "credential", "access")
AGAINST = ("commit", "sha", "sha1", "sha256", "md5", "checksum", "uuid", "id", "version", "rev", "hash", "digest", "image", "page", "order", "tel", "card", "isbn", "http", "https", "www", "ref", "etag", "build")
PARTS = ("the", "and", "for", "with", "get", "set", "user", "name", "data", "file", "test", "page", "index", "item", "list", "main", "time", "date", "type", "value", "string", "number", "image", "example", "config", "class", "function", "return", "import", "version", "module", "message", "error", "server", "client", "table", "column", "order", "price", "total", "count", "width", "height")
FEATURES = 16
#: What stands after "password:" and the like without being one.
PLAIN = ("required", "string", "hidden", "optional", "expired", "invalid", "changed", "forgotten", "missing", "never", "please", "minimum", "letters", "secure", "none,", "null,", "example", "password", "secret", "changeme", "[REDACTED]", "${PASSWORD}", "********")


def _kind(c: int) -> int:
    return 0 if 48 <= c <= 57 else 1 if 97 <= c <= 102 else 2 if 103 <= c <= 122 else 3 if 65 <= c <= 90 else 4


_KINDS = [_kind(c) for c in range(256)]


def features(value: bytes, path: str, before: bytes, after: bytes) -> list[float]:
    n = len(value)
    kinds = [_KINDS[c] for c in value]
    share = Counter(kinds)
    moves = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    digit_moves = sum((a == 0) != (b == 0) for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    entropy = -sum(k / n * math.log2(k / n) for k in Counter(value).values())
    low = value.lower().decode("latin-1")
    covered = sum(len(p) for p in PARTS if p in low) / n
    near = re.findall(r"[a-z_0-9]+", before.lower().decode("latin-1"))[-3:]
    last = near[-1] if near else ""
    place = path.lower()
    return [
        n, moves, digit_moves, entropy, share[0] / n, (share[0] + share[1]) / n, share[3] / n, (share[1] + share[2]) / n, value.count(b"-") + value.count(b"/"), covered,
        sum(w in FOR or any(w.endswith(f) for f in FOR[:6]) for w in near), sum(w in AGAINST for w in near),
        float(last in FOR) + float(before.rstrip(b" \t\"'")[-1:] in (b"=", b":")), float("test" in place or "doc" in place or "example" in place), float(after[:1] in (b'"', b"'")),
        float(value.startswith(PREFIXES)),
    ]


def _password(r: random.Random, n: int) -> str:
    """Letters with a digit at least, as people choose and as generators make them."""
    chars = r.choice(["abcdefghijkmnopqrstuvwxyz", "abcdefghijkmnopqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789", "abcdefghijkmnopqrstuvwxyz0123456789!$%_-"])
    out = [r.choice(chars) for _ in range(n)]
    for k in r.sample(range(n), r.randint(1, max(1, n // 3))):
        out[k] = r.choice("0123456789")
    return "".join(out)


def _login(r: random.Random, word) -> str:
    return f"{r.choice(['postgres', 'mysql', 'mongodb', 'redis', 'amqp', 'https', 'http', 'ftp'])}://{r.choice(['admin', 'root', 'user', 'app', word()])}:"


def labelled_findings(n: int = 3000, seed: int = 20240229) -> list[tuple[bytes, str, bytes, bytes, int]]:
    """(value, path, text before, text after, 1 for a secret): findings in the formats that issuers publish, and look-alikes."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choice(chars) for _ in range(k))
    hexa, upper, b64, low, dig = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz", "0123456789"
    word = lambda: pick("etaoinshrdlu", r.randint(2, 9))
    path = lambda: r.choice(["src1", "src7", "app/main.py", "config.yml", "docs/readme.md", "tests/test_a.py", ""])
    out = []
    for _ in range(n):
        talk = " ".join(word() for _ in range(4)) + " "
        if r.random() < 0.5:
            kind, tail = r.randrange(10), None
            name = r.choice(["password", "token", "secret", "api_key", "access_token", "auth_token", "key"])
            join = r.choice(["=", " = \"", ": ", "=\"", " = '"])
            value, lead = [
                ("AKIA" + pick(upper, 16), talk), (pick(hexa, r.randint(16, 24)), talk + name + join), (pick(hexa, 40), talk + name + join), (pick(b64, r.randint(20, 44)), talk + name + join),
                ("ghp_" + pick(b64, 36), talk), ("sk_live_" + pick(b64, 24), talk), (pick(b64 + "+/", 40), talk + "aws_secret_access_key" + join),
                (r.choice(["AKIA" + pick(upper[:26], 16), "sk_live_" + pick(b64[:52], 24), "ghp_" + pick(b64[:52], 36)]), talk),
                (_password(r, r.randint(5, 14)), talk + r.choice(["password", "passwd", "pwd", "secret", "token"]) + join), (_password(r, r.randint(4, 20)), talk + _login(r, word)),
            ][kind]
            label, tail = 1, f"@{word()}.example.com/{word()} " if kind == 9 else None
        else:
            kind, tail = r.randrange(14), None
            value, lead = [
                (pick(dig, r.choice([16, 18, 20])), talk + r.choice(["", "card ", "order ", "tel "])), (f"{pick(hexa, 8)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 4)}-{pick(hexa, 12)}", talk + r.choice(["uuid ", "id ", ""])),
                (pick(hexa, 40), talk + r.choice(["commit ", "sha1 ", "rev "])), (pick(hexa, r.choice([32, 64])), talk + r.choice(["md5 ", "checksum ", "sha256: ", "digest "])),
                ("-".join(r.choice(PARTS) for _ in range(4)) + "-" + pick(dig, 3), talk), ("/".join(word() for _ in range(4)) + "/" + pick(dig, 5), talk + "https://www.example.com/"),
                (f"20{pick('012', 1)}{pick(dig, 1)}-0{r.randint(1, 9)}-1{pick(dig, 1)}T1{pick(dig, 1)}-{pick('012345', 1)}{pick(dig, 1)}-00", talk + r.choice(["date ", ""])), ("_".join(r.choice(PARTS) for _ in range(3)) + pick(dig, 2), talk),
                (word() + word() + word() + pick(dig, r.randint(1, 4)), talk),
                ("".join(word() for _ in range(4)).capitalize(), talk), ("".join(r.choice(PARTS).capitalize() for _ in range(r.randint(3, 6))), talk),
                (r.choice(["_", ""]).join(r.choice([r.choice(PARTS), word()]) for _ in range(4)).upper(), talk),
                (r.choice([r.choice(PLAIN), word() + r.choice(["", ",", "."])]), talk + r.choice(["password", "passwd", "pwd", "secret", "token"]) + r.choice([": ", ":", "="])), (r.choice(["password", "pass", "secret", "changeme", "${PASSWORD}", "****"]), talk + _login(r, word)),
            ][kind]
            label, tail = 0, f"@{word()}.example.com/{word()} " if kind == 13 else None
        if len(value) >= (8 if lead == talk else 4):
            out.append((value.encode(), path(), lead.encode(), (tail or (r.choice(['"', "'", " ", "\n"]) if label else " ")).encode() + talk.encode(), label))
    return out


class Forest:
    """Trees as arrays: feature, threshold, children, and the share of secrets in leaves."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        rng, self.trees = np.random.default_rng(seed), []
        for _ in range(TREES):
            rows = rng.integers(0, len(y), len(y))
            nodes: list[list[float]] = []
            self._grow(nodes, x[rows], y[rows], 0, rng)
            self.trees.append(np.array(nodes))

    def _grow(self, nodes: list, x: np.ndarray, y: np.ndarray, depth: int, rng) -> int:
        here = len(nodes)
        nodes.append([-1, 0, 0, 0, float(y.mean()) if len(y) else 0.0])
        if depth == DEPTH or len(y) < 2 * LEAF or y.min() == y.max():
            return here
        best = (1e18, -1, 0.0)
        for j in rng.permutation(x.shape[1])[: math.isqrt(x.shape[1]) + 1]:
            for t in np.unique(np.quantile(x[:, j], np.linspace(0.05, 0.95, 12))):
                left = x[:, j] <= t
                k = int(left.sum())
                if LEAF <= k <= len(y) - LEAF:
                    p, q = y[left].mean(), y[~left].mean()
                    cost = k * p * (1 - p) + (len(y) - k) * q * (1 - q)
                    best = min(best, (cost, int(j), float(t)))
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            lo = self._grow(nodes, x[left], y[left], depth + 1, rng)
            hi = self._grow(nodes, x[~left], y[~left], depth + 1, rng)
            nodes[here][:4] = [best[1], best[2], lo, hi]
        return here

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                f = t[at, 0].astype(np.int64)
                go = np.where(x[np.arange(len(x)), np.maximum(f, 0)] <= t[at, 1], t[at, 2], t[at, 3]).astype(np.int64)
                at = np.where(f >= 0, go, at)
            total += t[at, 4]
        return total / len(self.trees)


def train(findings: list[tuple[bytes, str, bytes, bytes, int]]) -> Forest:
    findings = sorted(findings, key=lambda f: (zlib.crc32(f[0]), f))[:MAX_FINDINGS]
    return Forest(np.array([features(*f[:4]) for f in findings], dtype=float), np.array([f[4] for f in findings], dtype=float))


@lru_cache(1)
def default_forest() -> Forest:
    return train(labelled_findings())


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Byte spans, in order and without overlap; a password in a URL wins over an assigned value around it, and that over a run inside it."""
    out = [m.span(1) for m in LOGIN.finditer(text)]
    inner = list(out)
    out += [(lo, hi) for lo, hi in (m.span(1) for m in ASSIGNED.finditer(text)) if not any(a < hi and lo < b for a, b in inner)]
    taken = sorted(out)
    for m in RUN.finditer(text):
        lo, hi = m.span()
        value = m.group()
        if (any(48 <= c <= 57 or 65 <= c <= 90 for c in value) or value.startswith(PREFIXES)) and not any(a < hi and lo < b for a, b in taken):
            out.append((lo, hi))
    return sorted(out)


def _judged(texts: list[bytes], paths: list[str], forest: Forest, threshold: float) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) in bytes for the candidates of each text that pass the forest or not."""
    spans = [candidates(t) for t in texts]
    rows = [features(t[a:b], p, t[max(0, a - 60) : a], t[b : b + 20]) for t, p, own in zip(texts, paths, spans, strict=True) for a, b in own]
    scores = iter(forest.predict(np.array(rows, dtype=float)).tolist() if rows else [])
    return [[(a, b, next(scores)) for a, b in own] for own in spans]


def _batches(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Findings: doc_id, start, length, score, secret."""
    forest = forest or default_forest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            texts = [(t or "").encode("utf-8", "replace") for t in b.column(1).to_pylist()]
            out: list[list] = [[] for _ in range(5)]
            for key, t, found in zip(b.column(0).to_pylist(), texts, _judged(texts, [p or "" for p in b.column(2).to_pylist()], forest, threshold), strict=True):
                for lo, hi, s in found:
                    for column, x in zip(out, (key, len(t[:lo].decode("utf-8", "replace")), len(t[lo:hi].decode("utf-8", "replace")), round(s, 6), s >= threshold), strict=True):
                        column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "start", "length", "score", "secret"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("source").cast("string")).mapInArrow(run, "doc_id long, start long, length long, score double, secret boolean")


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """The documents with their secrets replaced."""
    forest, names = forest or default_forest(), docs.columns
    at, src = names.index("text"), names.index("source") if "source" in names else None
    count = names.index("n_chars") if "n_chars" in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _batches(batches):
            texts = b.column(at).to_pylist()
            raw = [(t or "").encode("utf-8", "replace") for t in texts]
            paths = [p or "" for p in b.column(src).to_pylist()] if src is not None else [""] * len(raw)
            sizes = b.column(count).to_pylist() if count is not None else []
            for k, (t, found) in enumerate(zip(raw, _judged(raw, paths, forest, threshold), strict=True)):
                found = [f for f in found if f[2] >= threshold]
                if found:
                    cuts = [0, *(x for lo, hi, _ in found for x in (lo, hi)), len(t)]
                    texts[k] = REDACTED.join(t[a:b_].decode("utf-8", "replace") for a, b_ in zip(cuts[::2], cuts[1::2], strict=True))
                    if sizes:
                        sizes[k] = len(texts[k])
            columns = list(b.columns)
            columns[at] = pa.array(texts, b.schema.field(at).type)
            if count is not None:
                columns[count] = pa.array(sizes, b.schema.field(count).type)
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    return docs.mapInArrow(run, docs.schema)
