"""Plain NumPy versions of the math, by direct solves, for small fixtures."""

from __future__ import annotations

import hashlib
import math

import numpy as np


def uniform(row_id, seed, round_no=0, part=0):
    digest = hashlib.md5(f"{seed}:{round_no}:{row_id}".encode()).hexdigest()
    return int(digest[8 * part : 8 * part + 8], 16) / 4294967296


def gram(x, reg, lam, k):
    return k(x, x) + lam * np.diag(np.maximum(reg, 1e-12))


def leverages(x, reg, lam, y, k):
    cross = k(x, y)
    energy = np.einsum("ij,ij->j", cross, np.linalg.solve(gram(x, reg, lam, k), cross))
    return np.array([k(v[None], v[None])[0, 0] for v in y]) - energy


def projections(x, reg, lam, y, k):
    return np.linalg.solve(np.linalg.cholesky(gram(x, reg, lam, k)), k(x, y)).T


def linear(a, b):
    return a @ b.T


def cosine(a, b):
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    return unit(a) @ unit(b).T


def rbf(gamma):
    def k(a, b):
        gaps = a[:, None, :] - b[None, :, :]
        return np.exp(-gamma * (gaps**2).sum(axis=2))

    return k


def draw(ids, scores, seed, round_no, max_rows, beta=None, ascending=False):
    """Positions of the drawn rows, best first."""
    coins = np.array([uniform(i, seed, round_no) for i in ids])
    if beta is None:
        kept = coins <= np.minimum(scores, 1)
    else:
        stage = np.array([uniform(i, f"{seed}/stage", round_no) for i in ids])
        kept = (stage < beta) & (coins * beta <= scores)
    rank = np.round(scores, 9) * (1 if ascending else -1)
    order = sorted(np.flatnonzero(kept), key=lambda p: (rank[p], coins[p], ids[p]))
    return order[:max_rows]


def multi_space(ids, y, k, seed, max_rows, max_spaces, max_non_improv, max_rounds=None, sizes=None):
    """The whole multi-space selection: kept slots and the total per round."""
    n = len(ids)
    shrink = max(1, int(math.log(n) / math.log(2)))
    factor = math.log(12 * shrink * n / 0.9)
    norms = np.array([k(v[None], v[None])[0, 0] for v in y])

    def total_and_scores(slots, lam):
        each = [leverages(y[rows], reg, lam, y, k) for rows, reg in slots]
        least = np.min(each, axis=0)
        return least.sum(), least

    picked = draw(ids, norms * factor, seed, 0, max_rows)
    slots = [(picked, np.minimum(norms[picked] * factor, 1))]
    best_total, _ = total_and_scores(slots, 1.0)
    best, totals, misses, i = list(slots), [best_total], 0, 1
    while misses < max_non_improv and (max_rounds is None or i < max_rounds):
        lam = 1.0 / 2 ** min(i, shrink - 1)
        kept = list(slots)
        if len(kept) == max_spaces:
            gone = (i - 1) % (max_spaces - 1)
            kept[gone] = kept[-1]
            kept = kept[:-1]
        scores = total_and_scores(kept, lam)[1] * factor
        picked = draw(ids, scores, seed, i, max_rows)
        if sizes is not None:
            sizes.append(len(picked))
        if picked:
            slots = [*kept, (picked, np.minimum(scores[picked], 1))]
        total, _ = total_and_scores(slots, lam)
        if picked and total - best_total < -1:
            best, best_total, misses = list(slots), total, max(0, misses - 1)
        else:
            misses += 1
        totals.append(total)
        i += 1
    return [[ids[p] for p in rows] for rows, _ in best], totals
