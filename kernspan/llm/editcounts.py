"""Token counts that follow edits: segment trees over runs of pre-tokens.

A document is cut into leaves at places where a pre-token always begins. Two binary
trees hold the characters and the tokens below each node. An edit finds its leaves by
descending the first, re-encodes only these (and a neighbour whose boundary the edit
touches), and updates the sums on the paths to the root.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kernspan.llm.tables import named_apart
from kernspan.llm.tokens import ChunkTokenizer, chunk_tokenizer, vocabulary_path

#: pieces (words with the space before them) a new leaf holds
LEAF_PIECES = 32
#: a leaf of more characters than this many times the mean makes the tree grow anew
REGROW = 8

#: before a space that follows something else than white space begins a pre-token
_CUT = re.compile(r"(?<=\S) ")

TREE = "leaf_count int, char_sums array<int>, token_sums array<int>"
EDITS = "array<struct<at:int,removed:int,inserted:string>>"


def cut_leaves(text: str, pieces: int = LEAF_PIECES) -> list[str]:
    """The text in runs of ``pieces`` words; their concatenation is the text."""
    at = [m.start() for m in _CUT.finditer(text)][pieces - 1 :: pieces]
    bounds = [0, *at, len(text)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:], strict=False)] if text else []


def _sums(values: list[int]) -> list[int]:
    """A binary tree of sums: node i has the children 2i and 2i + 1, node 1 is the root."""
    width = 1
    while width < len(values):
        width *= 2
    tree = [0] * width + values + [0] * (width - len(values))
    for i in range(width - 1, 0, -1):
        tree[i] = tree[2 * i] + tree[2 * i + 1]
    return tree


class CountedText:
    """A document with its trees."""

    def __init__(self, tokenizer: ChunkTokenizer, leaves: list[str], chars: list[int], tokens: list[int]):
        self._tokenizer, self.leaves, self.chars, self.tokens = tokenizer, leaves, chars, tokens
        self.reencoded = 0

    @classmethod
    def build(cls, tokenizer: ChunkTokenizer, text: str) -> CountedText:
        leaves = cut_leaves(text)
        counts = [len(tokenizer.ids(leaf)) for leaf in leaves]
        return cls(tokenizer, leaves, _sums([len(leaf) for leaf in leaves]), _sums(counts))

    @classmethod
    def load(cls, tokenizer: ChunkTokenizer, text: str, count: int, chars: list[int], tokens: list[int]) -> CountedText:
        leaves, at, width = [], 0, len(chars) // 2
        for size in chars[width : width + count]:
            leaves.append(text[at : at + size])
            at += size
        return cls(tokenizer, leaves, list(chars), list(tokens))

    @property
    def n_tokens(self) -> int:
        return self.tokens[1]

    @property
    def n_chars(self) -> int:
        return self.chars[1]

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character (the last one at the end), and its start."""
        node, start, width = 1, 0, len(self.chars) // 2
        while node < width:
            node *= 2
            if position >= start + self.chars[node] and self.chars[node + 1]:
                start += self.chars[node]
                node += 1
        return node - width, start

    def _set(self, leaf: int, text: str, count: int) -> None:
        self.leaves[leaf] = text
        node = leaf + len(self.chars) // 2
        more_chars, more_tokens = len(text) - self.chars[node], count - self.tokens[node]
        while node:
            self.chars[node] += more_chars
            self.tokens[node] += more_tokens
            node //= 2

    def edit(self, at: int, removed: int, inserted: str) -> None:
        """Replace ``removed`` characters from ``at`` on; both are cut to the text."""
        at = min(max(at, 0), self.n_chars)
        removed = min(max(removed, 0), self.n_chars - at)
        if not removed and not inserted:
            return
        if not self.leaves:
            fresh = CountedText.build(self._tokenizer, inserted)
            self.leaves, self.chars, self.tokens = fresh.leaves, fresh.chars, fresh.tokens
            self.reencoded += len(inserted)
            return
        first, start = self._leaf_at(at)
        last, last_start = self._leaf_at(at + removed)
        # a boundary stands on the characters at both of its sides
        if at <= start and first:
            first, start = self._leaf_at(start - 1)
        end = last_start + len(self.leaves[last])
        if at + removed >= end and end < self.n_chars:
            last, _ = self._leaf_at(end)
        region = "".join(self.leaves[first : last + 1])
        region = region[: at - start] + inserted + region[at - start + removed :]
        self.reencoded += len(region)
        self._set(first, region, len(self._tokenizer.ids(region)))
        for leaf in range(first + 1, last + 1):
            if self.leaves[leaf]:
                self._set(leaf, "", 0)
        if len(region) > REGROW * max(256, self.n_chars // len(self.leaves)):
            # split the large leaf: counts of the others are kept
            leaves, counts, width = [], [], len(self.tokens) // 2
            for i, leaf in enumerate(self.leaves):
                parts = cut_leaves(leaf) if i == first else [leaf] * bool(leaf)
                leaves += parts
                counts += [len(self._tokenizer.ids(p)) for p in parts] if i == first else [self.tokens[width + i]] * bool(leaf)
            self.reencoded += len(region)
            self.leaves, self.chars, self.tokens = leaves, _sums([len(x) for x in leaves]), _sums(counts)


# ----------------------------------------------------------------------------- tasks


def _trees_of(path: str, text: str, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(path)
        for batch in batches:
            texts, built = batch.column(text), []
            for i in range(batch.num_rows):
                built.append(CountedText.build(tokenizer, texts[i].as_py() or ""))
            columns = _tree_columns(built)
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return run


def _tree_columns(built: list[CountedText]) -> list[pa.Array]:
    return [
        pa.array([len(b.leaves) for b in built], pa.int32()),
        pa.array([b.chars for b in built], pa.list_(pa.int32())),
        pa.array([b.tokens for b in built], pa.list_(pa.int32())),
    ]


def _edited(path: str, text: str, edits: str, names: list[str], added: list[str], keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = chunk_tokenizer(path)
        for batch in batches:
            texts, asked = batch.column(text), batch.column(edits)
            count, chars, tokens = (batch.column(n) for n in names)
            done, before = [], []
            for i in range(batch.num_rows):
                one = CountedText.load(
                    tokenizer, texts[i].as_py() or "", count[i].as_py(), chars[i].as_py(), tokens[i].as_py()
                )
                before.append(one.n_tokens)
                for e in asked[i].as_py() or []:
                    if e is not None:
                        one.edit(e["at"] or 0, e["removed"] or 0, e["inserted"] or "")
                done.append(one)
            fresh = dict(zip(names, _tree_columns(done), strict=True))
            if keep_text:
                fresh[text] = pa.array([d.text for d in done], pa.string())
            rest = [c for c in batch.schema.names if c not in (edits, text) or c == text and keep_text]
            measures = [
                pa.array(before, pa.int64()),
                pa.array([d.n_tokens for d in done], pa.int64()),
                pa.array([d.n_chars for d in done], pa.int64()),
                pa.array([d.reencoded for d in done], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(
                [*[fresh.get(c, batch.column(c)) for c in rest], *measures], [*rest, *added]
            )

    return run


# -------------------------------------------------------------------------- operator


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with leaf_count, char_sums and token_sums: the trees of its ``text``.

    ``token_sums[1]`` is the number of tokens. A null or empty text has no leaves and
    no tokens. All rows and columns stay; columns of these names must not exist.
    """
    names = ["leaf_count", "char_sums", "token_sums"]
    if named_apart(docs, *names) != names:
        raise ValueError(f"columns {names} are taken")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(
        _trees_of(vocabulary or vocabulary_path(), "text", names), f"{schema}, {TREE}"
    )


def apply_edits(
    trees: DataFrame, edits: str = "edits", keep_text: bool = True, vocabulary: str | None = None
) -> DataFrame:
    """Rows of ``count_tokens`` with the edits of column ``edits`` applied in turn.

    An edit (at, removed, inserted) is in characters of the text as the edits before it
    left it; places outside are cut to the text, nulls are 0 and the empty string, a
    null list has no edits. Text (if kept) and trees are those after the edits;
    n_tokens_before, n_tokens, n_chars and n_reencoded (characters encoded again)
    are added and the edits dropped.
    """
    names = ["leaf_count", "char_sums", "token_sums"]
    added = ["n_tokens_before", "n_tokens", "n_chars", "n_reencoded"]
    clash = [c for c in added if c in trees.columns]
    trees = trees.drop(*clash)
    left = [f for f in trees.schema.fields if f.name != edits and (keep_text or f.name != "text")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left)
    more = ", ".join(f"{n} long" for n in added)
    run = _edited(vocabulary or vocabulary_path(), "text", edits, names, added, keep_text)
    return trees.withColumn(edits, F.col(edits).cast(EDITS)).mapInArrow(run, f"{schema}, {more}")
