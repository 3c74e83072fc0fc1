"""Substring deduplication by Rabin-Karp hashes of every window of words.

Tasks hash all windows of their documents, deal the hashes out by range, and each
range counts in which documents a hash occurs. What a document with a smaller id also
has goes back to the document's chunk, where repeated windows merge into intervals.
Hashes travel as sorted, packed blocks, so that a window costs about nine bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernspan.llm.tables import named_apart

WINDOW = 13
#: windows a task hashes before it deals them out
FLUSH_WINDOWS = 2_000_000
#: windows a range of hashes holds on average
RANGE_WINDOWS = 500_000
#: documents of a chunk on average
CHUNK_DOCS = 1_000
#: bytes of text per window, to size ranges; any value gives the same rows
BYTES_PER_WINDOW = 6

#: place of rows whose doc_id is null: behind all others
LAST = (1 << 63) - 1

_BYTE_BASE = 0x9E3779B97F4A7C15
_BYTE_INVERSE = pow(_BYTE_BASE, -1, 1 << 64)
_WORD_BASE = 0xD6E8FEB86659FD93
_BYTE_VALUES = np.random.default_rng(20).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, grown in doubling steps."""
    table = _powers.get(base)
    if table is None or len(table) < n:
        size = 1 << max(12, (n - 1).bit_length())
        table = np.ones(size, np.uint64)
        table[1:] = np.uint64(base)
        table = np.multiply.accumulate(table)
        if size <= 1 << 22:
            _powers[base] = table
    return table[:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def word_spans(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in UTF-8 bytes."""
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = ~_IS_SPACE[np.frombuffer(raw, np.uint8)]
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: the polynomial of its bytes, taken as a difference
    of two running sums and freed of its place in the text."""
    if not len(starts):
        return np.empty(0, np.uint64)
    values = _BYTE_VALUES[np.frombuffer(raw, np.uint8)] * _power_table(_BYTE_BASE, len(raw))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    # byte i weighs base^i; dividing by base^start leaves a function of the word alone
    words = (sums[ends] - sums[starts]) * _power_table(_BYTE_INVERSE, len(raw))[starts]
    return _mix(words + np.uint64(_WORD_BASE) * (ends - starts).astype(np.uint64))


def window_hashes(raw: bytes, starts: np.ndarray, ends: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """A 64-bit rolling hash of every ``width`` consecutive words: the polynomial of
    their hashes, a function of the words alone wherever they stand."""
    n = len(starts) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    words = word_hashes(raw, starts, ends)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(_WORD_BASE) + words[k : k + n]
    return _mix(out)


# ---------------------------------------------------------------------- packed blocks


def _planes(values: np.ndarray) -> bytes:
    """The bytes of unsigned numbers, most significant ones together: runs of zeros
    that the shuffle's compression removes."""
    return values.astype(">u8").view(np.uint8).reshape(len(values), 8).T.tobytes()


def _unplanes(raw: bytes) -> np.ndarray:
    n = len(raw) // 8
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, n).T).view(">u8").reshape(n).astype(np.uint64)


def pack_pairs(key: np.ndarray, doc: np.ndarray) -> bytes:
    """A block of (key, doc) with sorted keys: differences of keys, offsets of docs."""
    base = doc.min() if len(doc) else np.int64(0)
    steps = np.diff(key, prepend=np.uint64(0))
    offsets = doc.view(np.uint64) - np.asarray(base).astype(np.int64).view(np.uint64)
    return np.int64(base).tobytes() + _planes(steps) + _planes(offsets)


def unpack_pairs(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    base, half = np.frombuffer(raw[:8], np.int64).view(np.uint64)[0], (len(raw) - 8) // 2
    key = np.cumsum(_unplanes(raw[8 : 8 + half]), dtype=np.uint64)
    return key, (_unplanes(raw[8 + half :]) + base).view(np.int64)


def _rows_out(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    grp, chunk, blob = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(grp, pa.int64()), pa.array(chunk, pa.int64()), pa.array(blob, pa.binary())],
        ["grp", "chunk", "block"],
    )


def _chunk_of(doc: np.ndarray, chunks: int) -> np.ndarray:
    """The chunk of each document; ``_chunk_column`` says the same of a row."""
    return (_mix(doc.view(np.uint64) * np.uint64(_BYTE_BASE)) % np.uint64(chunks)).astype(np.int64)


def _by_chunk(key: np.ndarray, doc: np.ndarray, chunks: int) -> Iterator[tuple[int, bytes]]:
    chunk = _chunk_of(doc, chunks)
    order = np.lexsort((key, chunk))
    key, doc, chunk = key[order], doc[order], chunk[order]
    edges = np.flatnonzero(np.diff(chunk)) + 1
    for a, b in zip([0, *edges], [*edges, len(chunk)], strict=True):
        if b > a:
            yield int(chunk[a]), pack_pairs(key[a:b], doc[a:b])


def _later_owners(key: np.ndarray, doc: np.ndarray):
    """Sorted distinct (key, doc), and for each whether a smaller doc has the key."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    once = np.concatenate([[True], (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])])[: len(key)]
    key, doc = key[once], doc[once]
    later = np.concatenate([[False], key[1:] == key[:-1]])[: len(key)]
    return key, doc, later


def _hashed(width: int, bits: int, chunks: int, flush_windows: int):
    """Blocks of (hash, smallest doc) for each range of hashes.

    Windows that a smaller document of the same block has too are settled here: a
    passage of very many documents leaves a task once. They travel in groups of their
    own, numbered behind the ranges.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[np.ndarray] = []
        docs: list[np.ndarray] = []

        def flush() -> pa.RecordBatch | None:
            if not keys:
                return None
            key, doc, later = _later_owners(np.concatenate(keys), np.concatenate(docs))
            keys.clear()
            docs.clear()
            rows = [
                ((1 << bits) + chunk % (1 << bits), chunk, block)
                for chunk, block in _by_chunk(key[later], doc[later], chunks)
            ]
            key, doc = key[~later], doc[~later]
            top = (key >> np.uint64(64 - bits)).astype(np.int64)
            edges = np.searchsorted(top, np.arange((1 << bits) + 1))
            for r in range(1 << bits):
                a, b = edges[r], edges[r + 1]
                if b > a:
                    rows.append((r, -1, pack_pairs(key[a:b], doc[a:b])))
            return _rows_out(rows)

        held = 0
        for batch in batches:
            place, text = batch.column("place"), batch.column("text")
            for i in range(batch.num_rows):
                raw = (text[i].as_py() or "").encode("utf-8", "surrogatepass")
                hashes = window_hashes(raw, *word_spans(raw), width)
                if len(hashes):
                    keys.append(hashes)
                    docs.append(np.full(len(hashes), place[i].as_py(), np.int64))
                    held += len(hashes)
                if held >= flush_windows:
                    yield flush()
                    held = 0
        if keys:
            yield flush()

    return run


def _counted(chunks: int):
    """Of one range: the (hash, doc) pairs that a smaller document has too, by chunk."""

    def run(table: pa.Table) -> pa.Table:
        settled = [(c, b) for c, b in zip(table["chunk"].to_pylist(), table["block"].to_pylist(), strict=True) if c >= 0]
        open_ = [b for c, b in zip(table["chunk"].to_pylist(), table["block"].to_pylist(), strict=True) if c < 0]
        if open_:
            pairs = [unpack_pairs(b) for b in open_]
            key, doc, later = _later_owners(
                np.concatenate([k for k, _ in pairs]), np.concatenate([d for _, d in pairs])
            )
            settled += list(_by_chunk(key[later], doc[later], chunks))
        return pa.table(
            {
                "chunk": pa.array([c for c, _ in settled], pa.int64()),
                "block": pa.array([b for _, b in settled], pa.binary()),
            }
        )

    return run


# ---------------------------------------------------------------------------- removal


def removed_words(n_words: int, repeated: np.ndarray, width: int) -> np.ndarray:
    """A mask of the words inside maximal intervals of repeated windows."""
    edge = np.zeros(n_words + 1, np.int64)
    at = np.flatnonzero(repeated)
    edge[at] += 1
    np.add.at(edge, at + width, -1)
    return np.cumsum(edge[:-1]) > 0


def _without(raw: bytes, starts: np.ndarray, gone: np.ndarray) -> bytes:
    """The text with each removed word cut out, up to the start of the next word."""
    bounds = [*starts.tolist(), len(raw)]
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
    for a, b in zip(edges[::2], edges[1::2], strict=True):
        out.append(raw[at : bounds[a]])
        at = bounds[b]
    out.append(raw[at:])
    return b"".join(out)


def _cut(width: int, place: str, text: str, names: dict[str, str], columns: list[str]):
    """Documents of one chunk with their repeated windows taken out."""

    def run(docs: pa.Table, blocks: pa.Table) -> pa.Table:
        pairs = [unpack_pairs(b) for b in blocks["block"].to_pylist()]
        key = np.concatenate([k for k, _ in pairs]) if pairs else np.empty(0, np.uint64)
        doc = np.concatenate([d for _, d in pairs]) if pairs else np.empty(0, np.int64)
        order = np.argsort(doc, kind="stable")
        key, doc = key[order], doc[order]
        own = np.asarray(docs[place].to_pylist(), np.int64)
        low, high = np.searchsorted(doc, own, "left"), np.searchsorted(doc, own, "right")
        found: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "kept_text": []}
        for i in range(docs.num_rows):
            said = docs[text][i].as_py()
            raw = (said or "").encode("utf-8", "surrogatepass")
            starts, ends = word_spans(raw)
            gone = np.zeros(len(starts), bool)
            if high[i] > low[i]:
                hashes = window_hashes(raw, starts, ends, width)
                gone = removed_words(len(starts), np.isin(hashes, key[low[i] : high[i]]), width)
            words = raw.split()
            if gone.any():
                words = [words[k] for k in np.flatnonzero(~gone)]
                if "kept_text" in names:
                    said = _without(raw, starts, gone).decode("utf-8", "surrogatepass")
            found["n_words"].append(len(starts))
            found["n_removed"].append(int(gone.sum()))
            if "kept_sha256" in names:
                found["kept_sha256"].append(hashlib.sha256(b" ".join(words)).hexdigest())
            if "kept_text" in names:
                found["kept_text"].append(said)
        types = {"n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string(), "kept_text": pa.string()}
        out = {c: docs[c] for c in columns}
        for what, name in names.items():
            out[name] = pa.array(found[what], types[what])
        return pa.table(out)

    return run


def remove_repeats(
    docs: DataFrame,
    measures: dict[str, str],
    carried: list[str],
    width: int = WINDOW,
    flush_windows: int = FLUSH_WINDOWS,
) -> DataFrame:
    """``carried`` columns of every row with what is left of its ``text``.

    A word goes if a window of ``width`` words around it also starts in a document of
    smaller doc_id; windows are those of the input. ``measures`` names result columns
    for n_words, n_removed, kept_sha256 (of the kept words joined by a space) and
    kept_text (the text without the removed words and the white space behind them;
    unchanged, null too, if nothing is removed). Rows of null doc_id stand behind all
    others and do not remove from each other; rows that share a doc_id do not either.
    Equality of windows is that of 64-bit hashes. An empty table gives no rows.
    """
    place, chunk = named_apart(docs, "place", "chunk")
    n_docs, n_bytes = docs.agg(
        F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))
    ).first()
    ranges = max(8, n_bytes // BYTES_PER_WINDOW // RANGE_WINDOWS)
    bits, chunks = min(16, (ranges - 1).bit_length()), max(1, n_docs // CHUNK_DOCS)
    own = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))
    hashed = docs.select(own.alias("place"), "text").mapInArrow(
        _hashed(width, bits, chunks, flush_windows), "grp long, chunk long, block binary"
    )
    blocks = hashed.groupBy("grp").applyInArrow(_counted(chunks), "chunk long, block binary")
    kept = list(dict.fromkeys([*carried, "text"]))
    keyed = docs.select(*kept, own.alias(place))
    keyed = keyed.mapInArrow(_with_chunk(place, chunk, chunks), _schema(keyed, f"`{chunk}` long"))
    types = {"n_words": "long", "n_removed": "long", "kept_sha256": "string", "kept_text": "string"}
    added = ", ".join(f"`{name}` {types[what]}" for what, name in measures.items())
    return (
        keyed.groupBy(chunk)
        .cogroup(blocks.groupBy("chunk"))
        .applyInArrow(_cut(width, place, "text", measures, carried), _schema(docs.select(*carried), added))
    )


def _schema(df: DataFrame, added: str) -> str:
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [added])


def _with_chunk(place: str, name: str, chunks: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(_chunk_of(own, chunks))], [*batch.schema.names, name]
            )

    return run


# --------------------------------------------------------------------------- operator


def substring_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    measures = {m: m for m in ("n_words", "n_removed", "kept_sha256")}
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return remove_repeats(plain, measures, ["doc_id"])


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with the repeated passages cut out of ``text`` (and ``n_chars``, where
    there is one, counted anew for texts that changed). All rows and columns stay."""
    kept, gone = named_apart(docs, "kept_text", "n_removed")
    out = remove_repeats(docs, {"kept_text": kept, "n_removed": gone}, docs.columns)
    columns = {c: F.col(c) for c in docs.columns}
    columns["text"] = F.col(kept)
    if "n_chars" in columns:
        kind = docs.schema["n_chars"].dataType
        columns["n_chars"] = F.when(F.col(gone) > 0, F.length(kept).cast(kind)).otherwise(F.col("n_chars"))
    return out.select(*[c.alias(n) for n, c in columns.items()])
