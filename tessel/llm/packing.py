"""Packing by concatenate and cut: token totals of partitions, prefix sums to global offsets, fixed windows with boundary records.

First pass: every task tokenises its documents and writes their ids with their offsets inside the task's run. The runs' totals, one
number for each, are summed in order on the driver. Second pass: every document's ids get their global place and are cut at
multiples of the window; a document that crosses a border gives a record on either side. No rows are shuffled.

Defined cases: a null or blank text has no ids but the closing one; repeated rows are packed each by itself; a null doc_id stays null; a long
text is cut like any other; no documents give no records. Only the last sequence may be short: it holds the rest of the stream.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_slices

WINDOW, END_ID = 2048, 1
#: Pieces of text in each of the two halves of what a worker remembers.
MEMORY = 250_000
MARK = "<|endoftext|>"
#: A single comma or full stop between an ASCII letter and white space.
_LETTER_STOP = re.compile(rb"(?<=[a-z])([,.])(?=[ \n])")
#: Lower-case letters of ASCII and Latin-1 in UTF-8: normalising leaves them as they are, and a run of them is one word of the vocabulary's model.
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+").fullmatch


def _byte_chars() -> dict[int, int]:
    """The characters by which byte-level models write bytes: printable ones stand for themselves, the others for 256 and up in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {b: 256 + k for k, b in enumerate(rest)}


_BYTE_CHARS = _byte_chars()


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Encoder:
    """Ids of texts as little-endian 32-bit bytes.

    The vocabulary drops white space and joins nothing across it, so a text's ids are those of its pieces between ASCII white space,
    one after another; pieces recur, and their ids are remembered. A comma or full stop after an ASCII letter is a piece of its own. New pieces are
    encoded together, with the vocabulary's closing token between them.
    """

    def __init__(self, vocabulary: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.mark, self.known, self.older = self.tokenizer.token_to_id(MARK), {}, {}

    def _alone(self, piece: bytes) -> bytes:
        return np.array(self.tokenizer.encode(piece.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _encode(self, pieces: list[bytes]) -> None:
        known = self.known
        plain = []
        tokenize = self.tokenizer.model.tokenize
        for w in pieces:
            if _LETTERS(w):
                known[w] = array("I", [t.id for t in tokenize(w.decode("latin-1").translate(_BYTE_CHARS))]).tobytes()
            elif b"<|" in w:  # may hold a special token
                known[w] = self._alone(w)
            else:
                plain.append(w)
        for lo in range(0, len(plain), 2048):
            part = plain[lo : lo + 2048]
            joined = f" {MARK} ".join([w.decode("utf-8", "replace") for w in part])
            ids = np.array(self.tokenizer.encode(joined, add_special_tokens=False).ids, dtype="<u4")
            cuts = np.flatnonzero(ids == self.mark)
            if len(cuts) != len(part) - 1:
                for w in part:
                    known[w] = self._alone(w)
                continue
            data, at = ids.tobytes(), 0
            for w, end in zip(part, [*cuts.tolist(), len(ids)], strict=True):
                known[w] = data[4 * at : 4 * end]
                at = end + 1

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        # A special token stands for itself in its own case only; where one may be, its piece keeps its letters.
        split = [[w if b"<|" in w else w.lower() for w in t.split()] if b"<|" in t else _LETTER_STOP.sub(rb" \1", t.lower()).split() for t in texts]
        new = set().union(*split).difference(self.known)
        if len(self.known) + len(new) > MEMORY:  # the older half goes, but for what is used again
            self.older, self.known = self.known, {}
            new = set().union(*split)
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        self._encode(list(new - again))
        find = self.known.__getitem__
        return [b"".join(map(find, ws)) for ws in split]


@lru_cache(1)
def encoder(vocabulary: str) -> Encoder:
    """One for each worker; what it remembers serves the worker's next tasks."""
    return Encoder(vocabulary)


def tokenise(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """doc_id, run (task), at (ids before it in its run), n and ids (16-bit if all fit, else 32-bit, little-endian)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, at, end = encoder(vocabulary), 0, np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        for keys, texts in text_slices(batches):
            ids = [x + end for x in encode(texts)]
            n = np.array([len(x) // 4 for x in ids], dtype=np.int64)
            starts = at + np.cumsum(n) - n
            at += int(n.sum())
            narrow = [np.frombuffer(x, "<u4") for x in ids]
            data = [x.astype("<u2").tobytes() if x.max() < 1 << 16 else x.tobytes() for x in narrow]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([part] * len(keys), pa.int64()), pa.array(starts), pa.array(n), pa.array(data, pa.binary())], ["doc_id", "run", "at", "n", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, run long, at long, n long, ids binary")


def pack(docs: DataFrame, vocabulary: str | None = None, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Records: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    tokens = cut(tokenise(docs, vocabulary or default_vocabulary(), end_id), "tokens")
    totals = sorted((r[0], r[1]) for r in tokens.groupBy("run").agg(F.sum("n")).collect())  # one row for each task of the first pass
    bases = dict(zip([r for r, _ in totals], np.cumsum([0, *(n for _, n in totals)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            for key, part, at, n, ids in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                ids = np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4").astype("<u4").tobytes()
                at, start = at + bases[part], 0
                while start < n:
                    place = at + start
                    length = min(window - place % window, n - start)
                    for column, x in zip(out, (key, start, length, ids[4 * start : 4 * (start + length)], n, place // window, place % window), strict=True):
                        column.append(x)
                    start += length
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary() if k == 3 else pa.int64()) for k, x in enumerate(out)], ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    return tokens.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
