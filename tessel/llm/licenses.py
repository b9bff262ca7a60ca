"""License scans: a positional index of rare words over licence templates.

Words are runs of letters, digits and non-ASCII characters, A-Z lower-cased. A first pass counts in how many documents each word of the
templates occurs. Each file is looked up by the words of highest inverse document frequency that it holds; every posting (template, place) of
such a word fixes where the template would begin, and beginnings with votes from ANCHORS words are read in full. A template
is found where a mandatory phrase stands inside the span and the share of its words that are in place reaches MIN_COVER.
Besides these labels stand the base labels of fixed phrases.

Defined cases: null or blank texts have no words; places are counted in words from 0; the same label is given once; repeated rows are
judged one by one; overlapping places of a phrase all count. Whole texts are read; nothing is shuffled but the few word counts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_slices

PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: label: (notice, mandatory phrase)
TEMPLATES = {
    "apache-2.0": ("licensed under the apache license version 2 0", "apache license version 2 0"),
    "mit": ("released under the mit license", "mit license"),
    "mit-grant": ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission is hereby granted free of charge"),
    "gpl-3.0": ("this work is licensed under the gnu general public license version 3", "general public license version 3"),
    "gpl-2.0": ("this work is licensed under the gnu general public license version 2", "general public license version 2"),
    "lgpl": ("this library is licensed under the gnu lesser general public license", "lesser general public license"),
    "cc-by-4.0": ("licensed under cc by 4 0", "cc by 4 0"),
    "cc-by-sa-4.0": ("licensed under cc by sa 4 0", "cc by sa 4 0"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4 0", "cc by nc 4 0"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    "bsd": ("redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
}
#: Rarest words looked up in a file for each template, votes that a beginning needs, and the least share of words in place.
RAREST, ANCHORS, MIN_COVER = 3, 2, 0.6

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
VOCABULARY = sorted({w for notice, _ in TEMPLATES.values() for w in notice.split()})


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def document_counts(docs: DataFrame) -> tuple[dict[bytes, int], int]:
    """In how many documents each template word occurs, and the number of documents; as many rows as the templates have words."""
    own = {w.encode() for w in VOCABULARY}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = Counter(), 0
        for _, texts in text_slices(batches):
            for t in texts:
                seen.update(own.intersection(words_of(t)))
            n += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in seen)]), pa.array([n, *seen.values()], pa.int64())], ["word", "n"])

    rows = docs.select(F.lit(None).cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n")).collect()
    found = {r[0].encode(): r[1] for r in rows}
    return found, found.pop(b"", 0)


def index(counts: dict[bytes, int], total: int) -> tuple[dict[bytes, float], list[tuple[str, list[bytes], bytes]], dict[bytes, list[tuple[int, int]]]]:
    """Inverse document frequencies, templates, and the postings of each template's rarest words."""
    idf = {w.encode(): float(np.log((total + 1) / (counts.get(w.encode(), 0) + 1))) + 1 for w in VOCABULARY}
    templates = [(label, notice.encode().split(), b" " + phrase.encode() + b" ") for label, (notice, phrase) in TEMPLATES.items()]
    postings: dict[bytes, list[tuple[int, int]]] = {}
    for k, (_, ws, _) in enumerate(templates):
        for at, w in enumerate(ws):
            postings.setdefault(w, []).append((k, at))
    return idf, templates, postings


def places(ws: list[bytes], phrase: list[bytes]) -> list[int]:
    """All starts of the phrase among the words."""
    out, at = [], -1
    try:
        while True:
            at = ws.index(phrase[0], at + 1)
            if ws[at : at + len(phrase)] == phrase:
                out.append(at)
    except ValueError:
        return out


def match(ws: list[bytes], idf, templates, postings) -> dict[str, float]:
    """Labels and shares of the templates found in the words."""
    held: dict[bytes, list[int]] = {}
    for w in idf.keys() & set(ws):
        held[w] = []
    if len(held) < ANCHORS:
        return {}
    for at, w in enumerate(ws):
        if w in held:
            held[w].append(at)
    votes: Counter = Counter()
    by_template: dict[int, set[bytes]] = {}
    for w in held:
        for k, _ in postings[w]:
            by_template.setdefault(k, set()).add(w)
    for k, own in by_template.items():
        if not own.issuperset(templates[k][2].split()):  # the mandatory phrase can't stand in this file
            continue
        for w in sorted(own, key=lambda w: (-idf[w], w))[:RAREST]:
            for j, at in postings[w]:
                if j == k:
                    votes.update((k, p - at) for p in held[w])
    out: dict[str, float] = {}
    for (k, start), n in votes.items():
        label, notice, phrase = templates[k]
        if n >= min(ANCHORS, len(by_template[k])):
            lo = max(0, start)
            span = ws[lo : start + len(notice) + 2]
            if phrase in b" " + b" ".join(span) + b" ":
                whole = sum(idf[w] for w in notice)
                share = sum(idf[w] for at, w in enumerate(notice) if 0 <= start + at < len(ws) and ws[start + at] == w) / whole
                if share >= MIN_COVER:
                    out[label] = max(out.get(label, 0.0), round(share, 6))
    return out


def scan(docs: DataFrame, phrases: dict[str, str] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (1 for a base phrase, else the best share)."""
    found = index(*document_counts(docs))
    base = {p.encode(): label for p, label in (PHRASES if phrases is None else phrases).items()}
    rare = {p: p.split() for p in base}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in text_slices(batches):
            out: list[list] = [[] for _ in range(7)]
            for t in texts:
                ws = words_of(t)
                line = b" " + b" ".join(ws) + b" "
                at, labels = [], set()
                for p, label in base.items():
                    if b" " + p + b" " in line:
                        at += places(ws, rare[p])
                        labels.add(label)
                more = match(ws, *found)
                both = ",".join(sorted(labels)), ",".join(sorted(labels | more.keys()))
                for column, x in zip(out, (len(ws), len(at), min(at, default=None), max(at, default=None), *both, 1.0 if at else max(more.values(), default=0.0)), strict=True):
                    column.append(x)
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), *map(pa.array, out, kinds)], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")
