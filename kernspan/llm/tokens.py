"""Token ids of whole texts in tasks: a tokenizer per worker and a memory of chunks."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

import numpy as np

#: chunks a worker remembers; it starts anew beyond them
KNOWN_CHUNKS = 600_000
#: longer chunks are not remembered
KNOWN_CHARS = 48

_SPACE_PAIR = re.compile(r"\s ")
_CUT = re.compile(r"(?<!\s) ")
#: letters below this code point are letters in every Unicode version the libraries have
_SETTLED = "\u0590"
#: marks that form a pre-token of their own behind letters
_ENDS = frozenset(".,;:!?)]}")


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable
    Latin-1 for itself, the others in turn from code point 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _merge_ranks(path: str) -> dict[bytes, int] | None:
    """Token bytes to ids, if merges are in the order of ids, so that ids are ranks."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    if model.get("type") != "BPE":
        return None
    letters = _byte_letters()
    vocabulary = model["vocab"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    made = [vocabulary.get(a + b, -1) for a, b in merges]
    if made != sorted(made) or any(v < 0 for v in made[:1]):
        return None
    out = {}
    for token, number in vocabulary.items():
        if all(c in letters for c in token):
            out[bytes(letters[c] for c in token)] = number
    return out


class _Known(dict):
    """Chunk to the bytes of its ids; an unknown one is encoded and remembered."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self._encode = encode

    def __missing__(self, chunk: str) -> bytes:
        raw = self._encode(chunk)
        if len(chunk) <= KNOWN_CHARS:
            if len(self) >= KNOWN_CHUNKS:
                self.clear()
            self[chunk] = raw
        return raw


class ChunkTokenizer:
    """Ids of a byte-level BPE whose pre-tokens take at most one leading space.

    A pre-token never runs over a space that follows something else than white space,
    so a text may be cut before each such space and the ids of the parts joined. Parts
    recur, so most of them come from memory. A part of letters alone is one pre-token
    and goes straight to the merges. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._merged = self._ordinary = None
        ranks = _merge_ranks(path)
        if ranks:
            import public_tokenizers
            import tiktoken

            ids = sorted(set(range(max(ranks.values()) + 1)) - set(ranks.values()))
            coder = tiktoken.Encoding(
                "ranks",
                pat_str=public_tokenizers.PATTERN,
                mergeable_ranks=ranks,
                special_tokens={f"<|{i}|>": i for i in ids},
            )
            self._merged, self._ordinary = coder._core_bpe.encode_single_piece, coder.encode_ordinary
        self._marks: dict[str, bytes] = {}
        self._known = _Known(lambda chunk: self._encode(" " + chunk))

    def _encode(self, text: str) -> bytes:
        if self._ordinary is not None:
            word = text[1:]
            if word.isalpha() and text[0] == " " and (word.isascii() or max(word) < _SETTLED):
                return array("I", self._merged(text.encode())).tobytes()
            if text[-1:] in _ENDS and text[0] == " " and text[1:-1].isalpha():
                # letters and one mark: two pre-tokens
                return self._known[text[1:-1]] + self._mark(text[-1])
            if text.isascii():
                return array("I", self._ordinary(text)).tobytes()
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _mark(self, mark: str) -> bytes:
        if mark not in self._marks:
            self._marks[mark] = array("I", self._merged(mark.encode())).tobytes()
        return self._marks[mark]

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of one text (uint32); none for a null or empty text."""
        if not text:
            return np.empty(0, "<u4")
        parts = _CUT.split(text) if _SPACE_PAIR.search(text) else text.split(" ")
        first = self._encode(parts[0]) if parts[0] else b""
        return np.frombuffer(first + b"".join(map(self._known.__getitem__, parts[1:])), "<u4")


_loaded: dict[str, ChunkTokenizer] = {}


def chunk_tokenizer(path: str) -> ChunkTokenizer:
    """The tokenizer of this Python worker, which lives on between tasks."""
    if path not in _loaded:
        _loaded[path] = ChunkTokenizer(path)
    return _loaded[path]
