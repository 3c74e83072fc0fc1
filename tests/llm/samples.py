"""Small documents with every awkward case, and brute-force versions of operators."""

from __future__ import annotations

import random
import re
from collections import Counter

import xxhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: columns whose names the operators use inside
CLASHES = (
    "place chunk statistics own_id text_key leaf shard fp key component_id root node ids start "
    "is_target n_words domain range budget ahead edge score"
).split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    syllables = "the and ti on er ing ea ha or ou re ly ée ß ñ".split()
    words = ["".join(rng.choices(syllables, k=rng.randint(1, 3))) for _ in range(n)]
    return " ".join(w + rng.choice(["", "", "", ",", ".\n"]) for w in words)


def documents() -> list[tuple]:
    """Copies, near copies, shared passages, junk, nulls, empty, repeated and long rows."""
    long_text = prose(1, 6_000)
    passage = prose(2, 70)
    texts = {
        1: prose(10, 120),
        2: prose(10, 120),  # an exact copy of 1
        3: prose(10, 119) + " changed",
        4: f"{prose(11, 60)} {passage} {prose(12, 60)}",
        5: f"{prose(13, 30)} {passage} {prose(14, 90)}",
        6: None,
        7: "",
        8: " \n\t\x0b ",
        9: "one two",
        10: "again and again " * 60,
        11: long_text,
        12: "x" + long_text,
        13: "\n".join(["same line here"] * 5 + ["  ", "", "", prose(15, 80)]),
        14: " ".join(f"{w}###" for w in prose(16, 90).split()),
        15: prose(17, 13),
        16: prose(17, 13),
        17: prose(18, 12),
        18: prose(18, 12),
        19: "A B C a b c A b C a B c",
        20: "tail of odd  spaces \n\n and \u0085 more",
        21: "퟿ 🙂 中文 words <|endoftext|> 've",
    }
    rows = [
        (i, t, ("en", "fr", None)[i % 3], f"src{i % 4}" if i % 5 else None, len(t or ""))
        for i, t in texts.items()
    ]
    rows.append((None, prose(10, 120), "en", "src0", 1))
    rows.append((None, passage, None, "src1", 1))
    rows.append(rows[0])  # repeated as it is
    rows.append((3, prose(19, 80), "en", "src2", 1))  # an id that comes back
    rows += [(100 + i, prose(100 + i, 60 + i), "de", "src0", 0) for i in range(40)]
    return rows


def frame(spark, rows=None, clashes: bool = False):
    df = spark.createDataFrame(documents() if rows is None else rows, SCHEMA)
    if clashes:
        for name in CLASHES:
            from pyspark.sql import functions as F

            df = df.withColumn(name, F.lit("taken"))
    return df


def words(text) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def statistics(text) -> tuple:
    ws = words(text)
    lines = [line for line in (text or "").split("\n") if words(line)]
    grams = [tuple(ws[k : k + 3]) for k in range(len(ws) - 2)]
    found, covered = Counter(grams), set()
    for k, gram in enumerate(grams):
        if found[gram] > 1:
            covered |= {k, k + 1, k + 2}
    return (
        len(ws),
        sum(map(len, ws)),
        len(re.findall(r"[#*$%&|<>]", text or "")),
        len(lines) - len(set(lines)),
        len(covered),
    )


def base_failed(text) -> bool:
    n, _, _, _, repeated = statistics(text)
    return n < 50 or 100 * repeated > 50 * n


def without_repeats(rows: list[tuple], width: int = 13) -> list[list[bool]]:
    """For each (id, text): which words stay."""
    order = [(float("inf") if i is None else i) for i, _ in rows]
    owner: dict[tuple, float] = {}
    for place, (_, text) in zip(order, rows, strict=True):
        ws = words(text)
        for k in range(len(ws) - width + 1):
            gram = tuple(ws[k : k + width])
            owner[gram] = min(owner.get(gram, place), place)
    out = []
    for place, (_, text) in zip(order, rows, strict=True):
        ws, gone = words(text), set()
        for k in range(len(ws) - width + 1):
            if owner[tuple(ws[k : k + width])] < place:
                gone |= set(range(k, k + width))
        out.append([k not in gone for k in range(len(ws))])
    return out


def fingerprint(text) -> int:
    ws = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not ws:
        return 0
    shingles = [" ".join(ws[k : k + 3]) for k in range(max(1, len(ws) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(fps: list[int], reach: int = 2) -> list[int]:
    """For each fingerprint the index of the first one it is linked to."""
    parent = list(range(len(fps)))

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(fps):
        for j in range(i):
            if (a ^ fps[j]).bit_count() <= reach:
                low, high = sorted((find(i), find(j)))
                parent[high] = low
    return [find(i) for i in range(len(fps))]
