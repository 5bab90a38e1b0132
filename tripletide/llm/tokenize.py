"""Byte-level BPE of the whole corpus in batched numpy merge rounds.

The vocabulary is a file of fixed size (50 256 ranks). A text is cut into words by the vocabulary's pattern; each distinct word of a
batch is encoded once. All words of a batch lie in one flat array of symbols; a round looks up the rank of
every neighbouring pair by binary search over the sorted pair keys, merges in each word its pair of lowest rank (the leftmost of
equals), and goes on with the words that still changed. Words seen before come from a bounded memory of the worker.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Where the public tokenizer files lie; every operator takes another path.
RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern that cuts text into words, as published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words that a Python worker remembers; it starts anew beyond that.
MEMORY = 400_000

NONE = np.int32(np.iinfo(np.int32).max)


class Merges:
    """Sorted keys of all pairs that merge, with their ranks; a token's id is its rank."""

    def __init__(self, data: bytes):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int64)
        keys, vals = [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                if left is not None and (right := ranks.get(token[cut:])) is not None:
                    keys.append(left << 20 | right)
                    vals.append(r)
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.vals = np.array(vals, dtype=np.int32)[order]

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        k = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, k), len(self.keys) - 1)
        return np.where(self.keys[at] == k, self.vals[at], NONE)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other; number of ids of each word)."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        sym = self.byte[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), n)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            same = word[1:] == word[:-1]
            r = np.full(len(sym), NONE, np.int32)
            if len(sym) > 1:
                r[:-1] = np.where(same, self.rank(sym[:-1], sym[1:]), NONE)
            starts = np.flatnonzero(np.r_[True, ~same])
            low = np.minimum.reduceat(r, starts)
            size = np.diff(np.r_[starts, len(sym)])
            done = np.repeat(low == NONE, size)
            if done.any():
                parts.append((word[done], sym[done]))
                keep = ~done
                sym, word, r = sym[keep], word[keep], r[keep]
                if not len(sym):
                    break
                starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
                low, size = low[low != NONE], np.diff(np.r_[starts, len(sym)])
            hit = r == np.repeat(low, size)
            # Of pairs that overlap ('aaa') only every other one, counted from the left, merges.
            if (hit[1:] & hit[:-1]).any():
                at = np.flatnonzero(hit)
                run = np.r_[True, np.diff(at) > 1]
                first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
                hit[at[(np.arange(len(at)) - first) % 2 == 1]] = False
            at = np.flatnonzero(hit)
            sym[at] = r[at]
            gone = np.zeros(len(sym), bool)
            gone[at + 1] = True
            sym, word = sym[~gone], word[~gone]
        if not parts:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        word, sym = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))


class Encoder:
    """Texts to ids, with a memory of words."""

    def __init__(self, data: bytes):
        import regex

        self.cut = regex.compile(PATTERN).findall
        self.merges = Merges(data)
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def batch(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, one after the other; number of ids of each text); none for null and empty texts."""
        if len(self.index) > MEMORY:
            self.clear()
        index, known = self.index, len(self.index)
        per = np.zeros(len(texts), np.int64)
        which: list[int] = []
        for i, t in enumerate(texts):
            if t:
                words = self.cut(t)
                per[i] = len(words)
                for w in words:
                    k = index.get(w)
                    if k is None:
                        k = index[w] = len(index)
                    which.append(k)
        if len(index) > known:
            new = [w.encode("utf-8", "replace") for w in list(index)[known:]]
            ids, n = self.merges.encode(new)
            self.flat, self.size = np.concatenate([self.flat, ids]), np.concatenate([self.size, n])
            self.start = np.cumsum(self.size) - self.size
        if not which:
            return np.zeros(0, np.int32), per
        w = np.array(which)
        n = self.size[w]
        ends = np.cumsum(n)
        ids = self.flat[np.repeat(self.start[w] - (ends - n), n) + np.arange(ends[-1])]
        of = np.repeat(np.arange(len(texts)), per)
        return ids, np.bincount(of, weights=n, minlength=len(texts)).astype(np.int64)


def _ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, path: str = RANKS_PATH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): token ids of every text, without special tokens.

    Null and empty texts have the empty list. Texts are taken whole; repeated rows are encoded like others; extra columns are ignored.
    The vocabulary (under 1 MB, fixed) goes to the executors once as a broadcast value.
    """
    spark = docs.sparkSession
    data = spark.sparkContext.broadcast(_ranks(path))
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(data.value)
        for b in batches:
            ids, n = enc.batch(b.column(1).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=[id_col, "ids"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    assert kind
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def count_tokens(docs: DataFrame, path: str = RANKS_PATH, text_col: str = "text") -> DataFrame:
    """All columns but the text, and ``n_tokens`` (bigint); 0 for null and empty texts."""
    data = docs.sparkSession.sparkContext.broadcast(_ranks(path))
    rest = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(data.value)
        for b in batches:
            _, n = enc.batch(b.column(len(rest)).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns[: len(rest)], pa.array(n)], names=[*rest, "n_tokens"])

    schema = T.StructType([docs.schema[c] for c in rest] + [T.StructField("n_tokens", T.LongType())])
    return docs.select(*rest, text_col).mapInArrow(run, schema)
