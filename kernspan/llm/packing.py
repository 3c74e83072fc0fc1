"""Cost-balanced packing of token sequences.

A document's cost is a linear plus a quadratic term of its tokens (attention). Its
full-length pieces are sequences of their own; the rest goes, longest first, to the
sequence of least cost that has room. Documents are dealt into shards by a hash, so
each task packs a bounded set and a shard leaves less than one sequence of padding.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernspan.llm.tokens import chunk_tokenizer, vocabulary_path

CAPACITY = 2048
END_ID = 1
#: documents a shard holds on average
SHARD_DOCS = 2_000
#: cost of n tokens: LINEAR * n + QUADRATIC * n * n
LINEAR, QUADRATIC = 1.0, 1.0 / 1024

_PIECES = "shard long, doc_id long, start long, length long, doc_tokens long, crc long, ids binary"
_PLACED = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long"
)
_OUT_ROWS = 512


def cost(length: int) -> float:
    return LINEAR * length + QUADRATIC * length * length


def pack(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) pieces for documents of ``lengths``.

    ``ceil(total / capacity)`` sequences are opened, which is the fewest possible.
    The longest rest is placed first, in the sequence of least cost with room for
    it (ties: the first); where none has room, it is cut to fill the one with most
    room and what is left waits for its turn.
    """
    n_seq = -(-sum(lengths) // capacity)
    room, load = np.full(n_seq, capacity), np.zeros(n_seq)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(n_seq)]
    waiting = [(-n, d, 0) for d, n in enumerate(lengths) if n]
    heapq.heapify(waiting)
    while waiting:
        n, d, start = heapq.heappop(waiting)
        n = -n
        fits = room >= n
        at = int(np.argmin(np.where(fits, load, np.inf)))
        if not fits[at]:
            at = int(np.argmax(room))
            heapq.heappush(waiting, (int(room[at]) - n, d, start + int(room[at])))
            n = int(room[at])
        out[at].append((d, start, n))
        room[at] -= n
        load[at] += cost(n)
    return out


def _tokenized(path: str, capacity: int, end_id: int):
    """Pieces of each document: whole sequences by their checksum, the rest with ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(path)
        tail = np.asarray([end_id], "<u4")
        names = [part.split()[0] for part in _PIECES.split(", ")]
        types = [pa.int64()] * 6 + [pa.binary()]
        rows: list[tuple] = []

        def flush():
            columns = zip(*rows, strict=True) if rows else [[]] * len(names)
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            shard, doc_id, text = (batch.column(n) for n in ("shard", "doc_id", "text"))
            for i in range(batch.num_rows):
                ids = np.concatenate([tokenizer.ids(text[i].as_py()), tail])
                n, key = len(ids), (shard[i].as_py(), doc_id[i].as_py())
                whole = n - n % capacity
                for start in range(0, whole, capacity):
                    crc = zlib.crc32(ids[start : start + capacity].tobytes())
                    rows.append((*key, start, capacity, n, crc, None))
                if n > whole:
                    rows.append((*key, whole, n - whole, n, None, ids[whole:].astype("<u2" if ids.max() < 65536 else "<u4").tobytes()))
                if len(rows) >= _OUT_ROWS:
                    yield flush()
        yield flush()

    return run


def _packed(capacity: int):
    """Places the pieces of one shard."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("start", "ascending")])
        col = {n: table.column(n).to_pylist() for n in table.column_names}
        shard = (col["shard"][0] or 0) << 32
        rest = [i for i, raw in enumerate(col["ids"]) if raw is not None]
        lengths = [col["length"][i] for i in rest]
        ids = [
            np.frombuffer(col["ids"][i], "<u2" if len(col["ids"][i]) == 2 * n else "<u4")
            for i, n in zip(rest, lengths, strict=True)
        ]
        rows, seq = [], 0
        for i, raw in enumerate(col["ids"]):
            if raw is None:
                rows.append((col["doc_id"][i], col["start"][i], capacity, col["crc"][i], col["doc_tokens"][i], shard + seq, 0))
                seq += 1
        for pieces in pack(lengths, capacity):
            offset = 0
            for d, start, n in pieces:
                i = rest[d]
                crc = zlib.crc32(ids[d][start : start + n].astype("<u4").tobytes())
                rows.append((col["doc_id"][i], col["start"][i] + start, n, crc, col["doc_tokens"][i], shard + seq, offset))
                offset += n
            seq += 1
        names = [part.split()[0] for part in _PLACED.split(", ")]
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows, strict=True), strict=True)})

    return run


def pack_documents(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    vocabulary: str | None = None,
    shard_docs: int = SHARD_DOCS,
) -> DataFrame:
    """One row per piece: where it lies in its document and in its sequence.

    Texts are tokenized whole, once. Pieces of a full sequence travel as a checksum,
    only the rest of a document with its ids. A null or empty text is its end id
    alone. A null doc_id is a document like any other; rows that repeat are packed
    each. Other columns are not read. An empty table gives no rows. Sequences are at
    most ``capacity`` long; per shard only the last ones may be short.
    """
    shards = max(1, -(-docs.count() // shard_docs))
    dealt = docs.select(
        F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(shards)).alias("shard"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text"),
    )
    pieces = dealt.mapInArrow(
        _tokenized(vocabulary or vocabulary_path(), capacity, end_id), _PIECES
    )
    return pieces.groupBy("shard").applyInArrow(_packed(capacity), _PLACED)
