"""Token ids of whole texts under a public byte-level BPE vocabulary (problem 8).

Method: each pre-token's bytes form a doubly linked symbol list; a priority queue of merge ranks
gives the next pair to merge, entries made stale by earlier merges are skipped. Decoding
concatenates the vocabulary's byte strings. Pre-tokens repeat, so a task keeps those it has seen
(bounded). The vocabulary file is a parameter; the driver reads it and broadcasts its lines.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from guideloom.plans.ordering import batches

DEFAULT_FOLDER = "/opt/tokenizers"
LARGEST_VOCABULARY = 64 * 2**20  # bytes; a vocabulary file is broadcast only up to this size
KEPT_PRETOKENS = 200_000
LONGEST_KEPT = 64

# Fixed value: the public pre-token pattern of these rank files (white space by the Unicode property).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""


def vocabulary_path(name: str = "byte_bpe_50k") -> str:
    """Place of a rank file; the folder can be set by the environment."""
    return os.path.join(os.environ.get("GUIDELOOM_TOKENIZERS", DEFAULT_FOLDER), f"{name}.tiktoken")


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_bytes(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after = [*range(1, n), -1]
    before = list(range(-1, n - 1))
    queue = [(rank, i, i + 1, 2) for i in range(n - 1) if (rank := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(queue)
    while queue:
        _, i, j, size = heapq.heappop(queue)
        left, right = symbol[i], symbol[j]
        if left is None or right is None or after[i] != j or len(left) + len(right) != size:
            continue  # stale: one of the two was merged since
        symbol[i], symbol[j] = left + right, None
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            if (rank := ranks.get(symbol[i] + symbol[k])) is not None:
                heapq.heappush(queue, (rank, i, k, size + len(symbol[k])))
        h = before[i]
        if h >= 0 and (rank := ranks.get(symbol[h] + symbol[i])) is not None:
            heapq.heappush(queue, (rank, h, i, size + len(symbol[h])))
    return [ranks[s] for s in symbol if s is not None]


class _Kept(dict):
    """Ids of the pre-tokens seen so far, computed when first asked for; long ones are not kept."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> list[int]:
        ids = merge_bytes(piece.encode(), self.ranks)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= KEPT_PRETOKENS:
                self.clear()
            self[piece] = ids
        return ids


def encoder(ranks: dict[bytes, int]) -> Callable[[str], list[int]]:
    """A function from a text to its ids; special tokens' strings are ordinary text."""
    import regex

    find, ids_of = regex.compile(PATTERN).findall, _Kept(ranks).__getitem__
    return lambda text: list(chain.from_iterable(map(ids_of, find(text))))


def _broadcast_vocabulary(df: DataFrame, path: str):
    size = os.path.getsize(path)
    if size > LARGEST_VOCABULARY:
        raise ValueError(f"{path}: {size} bytes; a vocabulary may have {LARGEST_VOCABULARY}")
    return df.sparkSession.sparkContext.broadcast(Path(path).read_bytes())


def _mapped(df: DataFrame, key: str, text: str | Column, path: str, kind: T.DataType, make) -> DataFrame:
    vocabulary = _broadcast_vocabulary(df, path)
    rows = df.select(F.col(key).alias("key"), (F.col(text) if isinstance(text, str) else text).alias("value"))
    out = T.StructType([rows.schema["key"], T.StructField("out", kind)])
    schema = to_arrow_schema(out)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = None
        for batch in batches(it):
            if step is None:
                step = make(read_ranks(vocabulary.value))
            yield pa.RecordBatch.from_arrays([batch.column(0), step(batch.column(1), schema.field(1).type)], schema=schema)

    return rows.mapInArrow(run, out).withColumnRenamed("key", key)


def _encode_batches(ranks: dict[bytes, int]):
    encode = encoder(ranks)

    def step(texts: pa.Array, kind: pa.DataType) -> pa.Array:
        ids = [encode(t) if t else [] for t in texts.to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
        flat = np.fromiter(chain.from_iterable(ids), np.int32, int(offsets[-1]))
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)).cast(kind)

    return step


def _count_batches(ranks: dict[bytes, int]):
    encode = encoder(ranks)
    return lambda texts, kind: pa.array([len(encode(t)) if t else 0 for t in texts.to_pylist()], kind)


def _decode_batches(ranks: dict[bytes, int]):
    strings = {i: s for s, i in ranks.items()}
    return lambda ids, kind: pa.array([None if x is None else b"".join(strings[i] for i in x).decode("utf-8", "replace") for x in ids.to_pylist()], kind)


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """Columns key, ids: one row per row of df, also for repeated keys.

    Null and empty texts have an empty list. Whole texts are encoded, however long. An empty
    table gives no rows. Other columns are not read.
    """
    return _mapped(df, key, text, path or vocabulary_path(), T.ArrayType(T.IntegerType()), _encode_batches).withColumnRenamed("out", "ids")


def token_counts(df: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """Columns key, n_tokens: like token_ids, only the number; 0 for null and empty texts."""
    return _mapped(df, key, text, path or vocabulary_path(), T.LongType(), _count_batches).withColumnRenamed("out", "n_tokens")


def decoded_texts(df: DataFrame, key: str, ids: str, path: str | None = None) -> DataFrame:
    """Columns key, text: the texts of lists of ids; null for null."""
    return _mapped(df, key, ids, path or vocabulary_path(), T.StringType(), _decode_batches).withColumnRenamed("out", "text")
