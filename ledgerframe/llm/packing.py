"""Token-id output: documents encoded, split losslessly and packed into fixed-length rows by best-fit decreasing.

Each Spark task encodes its documents with a public byte-pair vocabulary, ends each with the separator id, and cuts those longer than a row
into pieces of row length, in order. Pieces of a task are gathered up to `batch_tokens` tokens and packed: longest first, each into the open row
with the least remaining room that still takes it, which a segment tree over capacities finds in logarithmic time. A packed row is
an id array (little-endian uint16 or uint32 as the vocabulary needs, padded with the separator), the cumulative segment lengths and the offsets at which positions restart at 0.
Rows of the ids stack to the packed matrix (`matrix`).

A task holds one batch of at most `batch_tokens` tokens and one document; batches depend on the task's rows alone, so a lost task is redone alike.

Defined cases. Null text: no tokens, no piece; empty text: the separator alone. Null doc_id: packed, listed as null. Repeated rows are packed each.
Empty table: no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .secrets import VOCABULARY, encoding

ROW_TOKENS, BATCH_TOKENS = 2048, 1 << 22
SCHEMA = "pack_id long, n_tokens int, n_segments int, ids binary, cu_seqlens array<int>, position_resets array<int>, doc_ids array<long>, pieces array<int>"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the pieces of each row. A segment tree over remaining capacities (1..capacity) tells the least one that fits."""
    size = 1 << capacity.bit_length()
    count = np.zeros(2 * size, dtype=np.int64).tolist()  # open rows below each node
    open_rows: list[list[int]] = [[] for _ in range(capacity + 1)]
    rows: list[list[int]] = []

    def add(room: int, by: int) -> None:
        node = room + size
        while node:
            count[node] += by
            node >>= 1

    def least(need: int) -> int:
        """Least room of at least need with an open row, or -1."""
        node = need + size
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < size:
                    node = 2 * node if count[2 * node] else 2 * node + 1
                return node - size
            node >>= 1
        return -1

    for i in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[i])
        room = least(need)
        if room < 0:
            rows.append([i])
            row, left = len(rows) - 1, capacity - need
        else:
            row = open_rows[room].pop()
            add(room, -1)
            rows[row].append(i)
            left = room - need
        if left:
            open_rows[left].append(row)
            add(left, 1)
    return rows


def _packed(ids: list[np.ndarray], owner: list[tuple[int, int]], row_tokens: int, separator: int, kind: np.dtype, number: int, in_order: bool) -> pa.RecordBatch:
    out = []
    rows = best_fit_decreasing(np.array([len(x) for x in ids]), row_tokens)
    for row in sorted(map(sorted, rows)) if in_order else rows:
        whole = np.full(row_tokens, separator, dtype=kind)
        lengths = [len(ids[i]) for i in row]
        ends = np.cumsum([0, *lengths]).astype(np.int32)
        whole[: ends[-1]] = np.concatenate([ids[i] for i in row])
        out.append((number + len(out), int(ends[-1]), len(row), whole.tobytes(), ends, ends[:-1], [owner[i][0] for i in row], [owner[i][1] for i in row]))
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.binary(), ints, ints, longs, ints)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])


def pack(docs: DataFrame, row_tokens: int = ROW_TOKENS, batch_tokens: int = BATCH_TOKENS, vocabulary: str = VOCABULARY, in_order: bool = False) -> DataFrame:
    """Packed rows (SCHEMA) of docs(doc_id, text). Piece p of a document holds its tokens from p * row_tokens on.

    in_order: pieces of a row and rows of a batch follow the rows of docs, so that by pack_id a document is out of its place by less than a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoding(vocabulary)
        separator = code.n_vocab
        kind = np.dtype("<u2" if separator < 1 << 16 else "<u4")
        ids: list[np.ndarray] = []
        owner: list[tuple[int, int]] = []
        total, number = 0, TaskContext.get().partitionId() << 33
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if text is None:
                    continue
                whole = np.append(np.array(code.encode_ordinary(text), dtype=kind), kind.type(separator))
                for p in range(0, len(whole), row_tokens):
                    ids.append(whole[p : p + row_tokens])
                    owner.append((doc, p // row_tokens))
                total += len(whole)
                if total >= batch_tokens:
                    yield (out := _packed(ids, owner, row_tokens, separator, kind, number, in_order))
                    ids, owner, total, number = [], [], 0, number + out.num_rows
        if ids:
            yield _packed(ids, owner, row_tokens, separator, kind, number, in_order)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def matrix(rows: list, row_tokens: int = ROW_TOKENS, wide: bool = False) -> np.ndarray:
    """The id matrix of collected packed rows."""
    return np.stack([np.frombuffer(r["ids"], dtype="<u4" if wide else "<u2") for r in rows]) if rows else np.empty((0, row_tokens), dtype="<u2")


def unpack(packed: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, piece, ids array<int>) of every segment: the way back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = "<u2" if encoding(vocabulary).n_vocab < 1 << 16 else "<u4"
        for batch in batches:
            owner, piece, ids = [], [], []
            for raw, ends, docs, parts in zip(*[batch.column(c).to_pylist() for c in ("ids", "cu_seqlens", "doc_ids", "pieces")], strict=True):
                whole = np.frombuffer(raw, dtype=kind).astype(np.int32)
                owner += docs
                piece += parts
                ids += [whole[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(owner, pa.int64()), pa.array(piece, pa.int32()), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "piece", "ids"])

    return packed.mapInArrow(run, "doc_id long, piece int, ids array<int>")


def write(packed: DataFrame, path: str) -> None:
    """Packed rows as Parquet, one row group row per packed row."""
    packed.write.mode("errorifexists").parquet(path)
