"""Filling containers of fixed capacity with texts measured in tokens.

Lengths fall into reciprocal-capacity classes: class i holds lengths in
(C/(i+1), C/i], so that any i of them fit into one container.  Each worker
fills the containers of every class with that fixed number of its own texts,
then tops up what is left over in them with texts of higher (shorter) classes.
Workers never need each other.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialise, ship_package

CAPACITY = 4096
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Tokens, and texts, for which there is one worker.
TOKENS_PER_WORKER, TEXTS_PER_WORKER = 16 << 20, 1 << 20


@lru_cache(maxsize=4)
def encoding(path: str):
    """The tokenizer of a vocabulary file of ranks; a bare file name is looked up among the public ones."""
    import public_tokenizers
    import tiktoken

    place = path if "/" in path else public_tokenizers.path(path)
    with open(place, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``(doc_id, n_tokens)`` of whole texts; a null text has no tokens. Strings of special tokens are ordinary text."""
    d = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(vocabulary).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=["doc_id", "n_tokens"])

    return d.mapInArrow(run, "doc_id long, n_tokens long")


def reciprocal_class(size: np.ndarray | int, capacity: int) -> np.ndarray | int:
    """The i with capacity/(i+1) < size <= capacity/i."""
    return capacity // size


class Shelf:
    """Unplaced texts of a worker by length; finds the longest that fits in constant time."""

    def __init__(self, sizes: np.ndarray):
        self.by_size: dict[int, list[int]] = {}
        for i in np.argsort(-sizes, kind="stable")[::-1].tolist():
            self.by_size.setdefault(int(sizes[i]), []).append(i)
        self.present = 0  # bit s is set while a text of length s is here
        for s in self.by_size:
            self.present |= 1 << s

    def longest(self, most: int) -> int:
        """The greatest length of at most ``most``, 0 if there is none."""
        return max(0, (self.present & ((1 << (most + 1)) - 1)).bit_length() - 1)

    def take(self, size: int) -> int:
        own = self.by_size[size]
        i = own.pop()
        if not own:
            self.present &= ~(1 << size)
        return i


def harmonic_fill(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Container number, place and offset of every size (1..capacity); containers are numbered from 0.

    Classes are worked from the longest texts down.  Class i opens containers of
    i of its texts each (the last one has fewer if the class runs out); what is
    left over in a container is topped up with the longest texts of shorter
    classes that fit.
    """
    n = len(sizes)
    bin_of, place, offset = np.empty(n, np.int64), np.empty(n, np.int64), np.empty(n, np.int64)
    shelf, bins = Shelf(sizes), 0
    while size := shelf.longest(capacity):
        cls = reciprocal_class(size, capacity)
        shortest = capacity // (cls + 1) + 1
        while (size := shelf.longest(capacity)) >= shortest:
            at = used = 0
            while at < cls and (size := shelf.longest(capacity)) >= shortest:  # the class's fixed count: always fits
                i = shelf.take(size)
                bin_of[i], place[i], offset[i] = bins, at, used
                at, used = at + 1, used + size
            while size := shelf.longest(capacity - used):
                i = shelf.take(size)
                bin_of[i], place[i], offset[i] = bins, at, used
                at, used = at + 1, used + size
            bins += 1
    return bin_of, place, offset


def pack_documents(df: DataFrame, doc_id: str, text: str, capacity: int = CAPACITY, vocabulary: str = VOCABULARY, workers: int | None = None) -> DataFrame:
    """``(doc_id, piece, token_start, n_tokens, container_id, place, token_offset)``: one row per text or piece of an oversized one.

    Only texts longer than ``capacity`` are split: into pieces of exactly
    ``capacity`` tokens, which fill a container each, and a rest that is packed
    like a text.  ``place`` numbers the texts of a container, ``token_offset`` is
    where one begins.  Null and empty texts have no tokens and come out with a
    null container.  There is a worker per TOKENS_PER_WORKER tokens unless their
    number is given.  Every row of ``df`` is a text of its own, copies and rows
    with equal or null ids too (their pieces bear the same id).  An empty table
    gives an empty result; other columns are ignored.
    """
    ship_package(df.sparkSession)
    # written down with a number per row: a task that runs again deals every text to the same worker
    counts = materialise(token_counts(df, doc_id, text, vocabulary).withColumn("row", F.monotonically_increasing_id()), "tokens")
    if workers is None:
        n, tokens = counts.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
        workers = max(1, math.ceil((tokens or 0) / TOKENS_PER_WORKER), math.ceil(n / TEXTS_PER_WORKER))
    names = ["doc_id", "piece", "token_start", "n_tokens", "container_id", "place", "token_offset"]

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["n_tokens", "doc_id"], ascending=[False, True], kind="stable")
        total = frame["n_tokens"].to_numpy()
        full, rest = total // capacity, total % capacity
        base = np.int64(frame["worker"].iloc[0]) << 40
        whole, own, none = np.repeat(np.arange(len(frame)), full), np.flatnonzero(rest), np.flatnonzero(total == 0)
        piece = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        bin_of, place, offset = harmonic_fill(rest[own], capacity)
        zero, gone = np.zeros(len(none), np.int64), pd.array([None] * len(none), "Int64")
        blocks = [
            (whole, piece, piece * capacity, np.full(len(whole), capacity), base + np.arange(len(whole)), np.zeros(len(whole), np.int64), np.zeros(len(whole), np.int64)),
            (own, full[own], full[own] * capacity, rest[own], base + len(whole) + bin_of, place, offset),
            (none, zero, zero, zero, gone, gone, gone),
        ]
        ids = frame["doc_id"].array.astype("Int64") if hasattr(frame["doc_id"].array, "astype") else frame["doc_id"]
        return pd.concat([pd.DataFrame(dict(zip(names, (ids[rows], *(pd.array(c, "Int64") for c in cols))))) for rows, *cols in blocks], ignore_index=True)

    # by the number of the row, so that copies with equal ids spread too
    dealt = counts.select("doc_id", "n_tokens", F.pmod(F.xxhash64("row"), F.lit(workers)).cast("int").alias("worker"))
    return dealt.groupBy("worker").applyInPandas(run, ", ".join(f"{n} long" for n in names))
