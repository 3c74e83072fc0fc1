"""Cross-entropy difference: a target and a background n-gram model on one vocabulary.

Every distinct word and word pair has a count of its own, keyed by a 64-bit hash, so
that the models grow with the corpus and no task holds one. Documents are dealt into
chunks; a chunk sends its distinct keys with their counts to ranges of keys, as sorted
packed blocks; a range adds the blocks up and sends each of them back with the totals of
its keys; the chunk then scores its documents. A word or pair that is everywhere is one
entry a chunk. A document's score is its mean loss per word under the target model minus
that under the background model: the lower, the more it looks like the target.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kernspan.llm.substrings import _planes, _unplanes, word_hashes, word_spans

#: bits of the keys of words and of word pairs
WORD_BITS, PAIR_BITS = 64, 64
#: bytes of text in a chunk, and distinct pairs of all chunks in a range, on average
CHUNK_BYTES, RANGE_PAIRS = 8_000_000, 500_000
#: bytes of text per distinct pair of a chunk, to size ranges; any value gives the same rows
BYTES_PER_PAIR = 12
#: chunks that rows of one doc_id are spread over
ID_SALTS = 16
#: words that are scored at once
SLICE_WORDS = 100_000
#: weight of the word model in a pair's probability, and of the uniform one in a word's
PAIR_PRIOR, WORD_PRIOR = 4.0, 0.5

_START = np.uint64(0x2545F4914F6CDD1D)


@dataclass(frozen=True)
class Slots:
    """Keys of a text: of each word, of each word before it, of the pair of both. With
    fewer than 64 bits several words or pairs share a key."""

    word_bits: int = WORD_BITS
    pair_bits: int = PAIR_BITS

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw = (text or "").encode("utf-8", "surrogatepass").lower()
        hashes = word_hashes(raw, *word_spans(raw))
        before = np.concatenate([[_START], hashes[:-1]])[: len(hashes)]
        pair = (before * np.uint64(0x9E3779B97F4A7C15)) ^ (hashes * np.uint64(0xC2B2AE3D27D4EB4F))
        pair = (pair ^ (pair >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
        word_shift, pair_shift = np.uint64(64 - self.word_bits), np.uint64(64 - self.pair_bits)
        return (
            (hashes >> word_shift).astype(np.int64),
            (before >> word_shift).astype(np.int64),
            (pair >> pair_shift).astype(np.int64),
        )

    def bits(self, kind: int) -> int:
        return self.pair_bits if kind == 2 else self.word_bits


def losses(counts: list[np.ndarray], total: np.ndarray, vocabulary: float) -> np.ndarray:
    """-log p of each word after the one before it; a pair's probability leans on the
    word's, and a word's on the uniform one over ``vocabulary`` words. ``counts``: of
    each word, of the word before it with any successor (a text's start included), and
    of the pair; ``total``: all words counted."""
    singles, heads, pairs = counts
    single = (singles + WORD_PRIOR) / (total + WORD_PRIOR * vocabulary)
    # where keys are narrowed, a pair's count may exceed its head's
    return -np.log((pairs + PAIR_PRIOR * single) / (np.maximum(heads, pairs) + PAIR_PRIOR))


def _repeats(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each key occurs in its document, place by place."""
    _, where, n = np.unique((doc << 32) + key, return_inverse=True, return_counts=True)
    return n[where]


def _slices(sizes: np.ndarray):
    """(first, last) documents and (first, last) words of parts of a chunk of about
    ``SLICE_WORDS`` words; a document is in one part."""
    ends = np.cumsum(sizes)
    first, before = 0, 0
    while first < len(sizes):
        last = max(first + 1, int(np.searchsorted(ends, before + SLICE_WORDS, "right")))
        yield first, last, before, int(ends[last - 1])
        first, before = last, int(ends[last - 1])


# ----------------------------------------------------------------------------- tasks

_BLOCKS = "kind int, range int, chunk int, keys binary, target binary, background binary"
_TOTALS = "chunk int, kind int, range int, target binary, background binary, words array<double>"


def _targets(docs: pa.Table, said: pa.Table) -> list[bool]:
    """For each document of a chunk whether its id is among the chunk's target ids."""
    chosen = set(said["chosen"].to_pylist()) - {None}
    return [i in chosen for i in docs["id_text"].to_pylist()]


def _texts(docs: pa.Table, slots: Slots) -> tuple[np.ndarray, list[np.ndarray]]:
    """Words of each document, and the keys of each kind, document after document."""
    column = docs["text"]
    sizes = np.empty(docs.num_rows, np.int64)
    kinds: list[list[np.ndarray]] = [[], [], []]
    for i in range(docs.num_rows):
        keys = slots.of(column[i].as_py())
        sizes[i] = len(keys[0])
        for kind, own in zip(kinds, keys):
            kind.append(own)
    out = []
    for kind in kinds:
        out.append(np.concatenate([np.empty(0, np.int64), *kind]).view(np.uint64))
        kind.clear()
    return sizes, out


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order and the place of each key among them, in 32 bits."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    where = np.empty(len(keys), np.int32)
    where[order] = np.cumsum(new, dtype=np.int32) - 1
    return ranked[new], where


def _counted(slots: Slots, range_bits: tuple[int, int, int]):
    """Of one chunk: its distinct keys and their counts, a sorted block for each range."""

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        good = np.array(_targets(docs, said), bool)
        sizes, kinds = _texts(docs, slots)
        good = np.repeat(good, sizes)
        rows = []
        for kind in range(3 if docs.num_rows else 0):
            keys, where = _distinct(kinds[kind])
            kinds[kind] = None  # a kind at a time: a chunk has a million keys of each
            n = np.bincount(where, minlength=len(keys))
            target = np.bincount(where[good], minlength=len(keys))
            del where
            bits = min(range_bits[kind], slots.bits(kind))
            place = keys >> np.uint64(slots.bits(kind) - bits) if bits else np.zeros(len(keys), np.uint64)
            edges = [0, *(np.flatnonzero(np.diff(place)) + 1).tolist(), len(keys)]
            for a, b in zip(edges, edges[1:]):
                if b > a:
                    steps = np.diff(keys[a:b], prepend=np.uint64(0))
                    counts = [_planes(c[a:b].astype(np.uint64)) for c in (target, n)]
                    rows.append((kind, int(place[a]), docs["chunk"][0].as_py(), _planes(steps), *counts))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
        types = [pa.int32()] * 3 + [pa.binary()] * 3
        names = ["kind", "range", "chunk", "keys", "target", "background"]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)})

    return run


def _added(chunks: int):
    """Of one range: the totals of each block's keys, in its order, for the chunk it came
    from. Ranges of words also tell every chunk how many distinct words they have and how
    many words were counted."""

    def run(table: pa.Table) -> pa.Table:
        kind, place = table["kind"][0].as_py(), table["range"][0].as_py()
        sent = table["chunk"].to_pylist()
        blocks = [np.cumsum(_unplanes(b.as_py()), dtype=np.uint64) for b in table["keys"]]
        keys, where = np.unique(np.concatenate(blocks), return_inverse=True)
        totals = []
        for name in ("target", "background"):
            counts = np.concatenate([_unplanes(b.as_py()) for b in table[name]])
            # sums of doubles are exact below 2^53
            totals.append(np.bincount(where, weights=counts, minlength=len(keys)).astype(np.uint64))
        ends = np.cumsum([len(b) for b in blocks]).tolist()
        rows = [
            (chunk, *(_planes(t[where[a:b]]) for t in totals))
            for chunk, a, b in zip(sent, [0, *ends], ends)
        ]
        words = None
        if kind == 0:
            words = [float(len(keys)), *(float(t.sum()) for t in totals)]
            rows += [(chunk, b"", b"") for chunk in sorted(set(range(chunks)) - set(sent))]
        chunk, target, background = zip(*rows, strict=True)
        return pa.table(
            {
                "chunk": pa.array(chunk, pa.int32()),
                "kind": pa.array([kind] * len(rows), pa.int32()),
                "range": pa.array([place] * len(rows), pa.int32()),
                "target": pa.array(target, pa.binary()),
                "background": pa.array(background, pa.binary()),
                "words": pa.array([words] * len(rows), pa.list_(pa.float64())),
            }
        )

    return run


def _scored(slots: Slots):
    """Scores of one chunk's documents from the totals of its keys."""

    def run(docs: pa.Table, said: pa.Table) -> pa.Table:
        good = np.array(_targets(docs, said), bool)
        sizes, kinds = _texts(docs, slots)
        named, places = said["kind"].to_pylist(), said["range"].to_pylist()
        rows = sorted((k, r, i) for i, (k, r) in enumerate(zip(named, places, strict=True)) if k is not None)
        seen = [said["words"][i].as_py() for k, _, i in rows if k == 0]
        distinct, *totals = np.sum(seen, axis=0).tolist() if seen else [0.0, 0.0, 0.0]
        vocabulary = float(1 << slots.word_bits) if slots.word_bits < 64 else distinct
        tables = []
        for kind in range(3 if sizes.any() else 0):
            keys, where = _distinct(kinds[kind])
            kinds[kind] = None
            own = [i for k, _, i in rows if k == kind]
            counts = [
                np.concatenate([np.empty(0, np.uint64), *(_unplanes(said[name][i].as_py()) for i in own)])
                for name in ("target", "background")
            ]
            if len(counts[0]) != len(keys) or len(counts[1]) != len(keys):
                raise ValueError(f"{len(keys)} keys of a chunk, {len(counts[0])} totals")
            tables.append((where, counts))
        means = np.zeros((2, len(sizes)))
        for first, last, a, b in _slices(sizes) if tables else ():
            doc = np.repeat(np.arange(last - first), sizes[first:last])
            parts = [(where[a:b], counts) for where, counts in tables]
            again = [_repeats(doc, where) for where, _ in parts]
            # a text's own counts are taken off, as if the model had not seen it
            for m, own in enumerate((good, np.ones(len(sizes), bool))):
                own = own[first:last]
                less = [
                    counts[m][where].astype(float) - np.where(own[doc], n, 0)
                    for (where, counts), n in zip(parts, again)
                ]
                loss = losses(less, (totals[m] - own * sizes[first:last])[doc], vocabulary)
                means[m, first:last] = np.bincount(doc, loss, last - first) / np.maximum(sizes[first:last], 1)
        out = []
        for i, n in enumerate(sizes.tolist()):
            a, b = (float(x[i]) for x in means) if n else (None, None)
            out.append((n, a, b, a - b if n else None))
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        types = [pa.int64()] + [pa.float64()] * 3
        names = ["n_words", "target_loss", "background_loss", "score"]
        added = {n: pa.array(c, t) for n, c, t in zip(names, columns, types, strict=True)}
        return pa.table({"doc_id": docs["doc_id"]} | added)

    return run


# -------------------------------------------------------------------------- operator


def score(
    docs: DataFrame,
    target_ids: DataFrame,
    slots: Slots | None = None,
    chunk_bytes: int = CHUNK_BYTES,
    range_pairs: int = RANGE_PAIRS,
) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss and score of every row of ``docs``
    under models of its target documents (doc_id in ``target_ids``) and of all.

    Losses are means over a text's words, natural logarithm; A-Z are lower-cased. The
    models were counted on these rows, so a text's own counts are left out of both. The
    vocabulary is the distinct words of ``docs``. Counts are exact but for words or pairs
    of one 64-bit hash. A null text or one without words has n_words 0 and null losses
    and score. Rows that repeat are scored alike. Without target documents the target
    model is the uniform one. ``chunk_bytes`` and ``range_pairs`` do not change a result.
    """
    slots = slots or Slots()
    n_bytes = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    chunks = max(1, -(-n_bytes // chunk_bytes))
    pairs = (max(1, n_bytes // BYTES_PER_PAIR // range_pairs) - 1).bit_length()
    range_bits = (max(0, pairs - 2), max(0, pairs - 2), pairs)  # a chunk has far fewer words

    def chunk(of: Column) -> Column:
        return F.pmod(of, F.lit(chunks)).cast("int").alias("chunk")

    # a row without id is no target and goes anywhere; the ids go to each of their salts
    said, salt = F.xxhash64("text"), F.lit(ID_SALTS)
    id_text = F.col("doc_id").cast("string")
    own = F.coalesce(F.when(id_text.isNotNull(), F.xxhash64(id_text, F.pmod(said, salt))), said)
    dealt = docs.select("doc_id", id_text.alias("id_text"), "text", chunk(own)).groupBy("chunk")
    chosen = target_ids.select(F.col("doc_id").cast("string").alias("chosen")).where("chosen is not null").distinct()
    salted = chosen.select("chosen", F.explode(F.sequence(F.lit(0).cast("long"), salt.cast("long") - 1)).alias("salt"))
    targets = salted.select(chunk(F.xxhash64("chosen", "salt")), "chosen").distinct()
    # both cogroups read the documents from one exchange
    counts = dealt.cogroup(targets.groupBy("chunk")).applyInArrow(_counted(slots, range_bits), _BLOCKS)
    summed = counts.groupBy("kind", "range").applyInArrow(_added(chunks), _TOTALS)
    both = summed.unionByName(targets, allowMissingColumns=True)
    return dealt.cogroup(both.groupBy("chunk")).applyInArrow(
        _scored(slots),
        f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, target_loss double, "
        "background_loss double, score double",
    )


def score_against_good(docs: DataFrame, labels: DataFrame, slots: Slots | None = None) -> DataFrame:
    """Scores of ``docs`` with the documents labelled good (quality 1) as target; other
    columns are not read."""
    return score(docs, labels.where("quality = 1"), slots)
