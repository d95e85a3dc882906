"""Hashed character n-grams of whole texts, and logistic fits over them."""

from __future__ import annotations

import numpy as np

BITS = 20
SIZE = 1 << BITS
#: Characters of one block of texts.
BLOCK = 1 << 18
#: Entries of a fit that are worked on at once.
ENTRIES = 1 << 19


def blocks(texts: list):
    """(first text, code points, start and end of each text) for runs of about BLOCK characters. Lower case, white space and
    control characters as one blank each, a blank at either end; null is empty."""
    first, held, size = 0, [], 0
    for k, t in enumerate(texts):
        held.append(np.frombuffer(f" {(t or '').lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32))
        size += len(held[-1])
        if size >= BLOCK or k + 1 == len(texts):
            ends = np.cumsum([len(x) for x in held])
            points = np.maximum(np.concatenate(held), np.uint32(32))
            yield first, points, np.append(0, ends[:-1]), ends
            first, held, size = k + 1, [], 0


def buckets(points: np.ndarray, start: np.ndarray, end: np.ndarray, orders: tuple[int, ...]):
    """(bucket, text) of every n-gram that lies in one text, an array pair for each order."""
    text = np.repeat(np.arange(len(start), dtype=np.int32), end - start)
    left = (end[text] - np.arange(len(points))).astype(np.int32)  # characters from here to the text's end
    h = points * np.uint32(1)
    for n in range(2, max(orders) + 1):
        h = h[:-1] * np.uint32(0x01000193) + points[n - 1 :]
        if n in orders:
            x = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B + 2 * n)
            x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
            inside = left[: len(h)] >= n
            yield (x >> np.uint32(32 - BITS))[inside].astype(np.int32), text[: len(h)][inside]


def present(texts: list, orders: tuple[int, ...], chosen: np.ndarray | None = None):
    """(first text, texts, text, bucket) per block: each n-gram bucket of a text once, only those that ``chosen`` marks."""
    for first, points, start, end in blocks(texts):
        keys = []
        for bucket, text in buckets(points, start, end, orders):
            if chosen is not None:
                own = chosen[bucket]
                bucket, text = bucket[own], text[own]
            keys.append(text.astype(np.int64) << BITS | bucket)
        key = np.unique(np.concatenate(keys)) if keys else np.zeros(0, np.int64)
        yield first, len(start), key >> BITS, key & (SIZE - 1)


def row_sums(values: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    return np.bincount(row, values, minlength=rows)


def fit_logistic(row: np.ndarray, feature: np.ndarray, scale: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, l2: float = 1e-3, rounds: int = 60, history: int = 8, value: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic fit whose features are ``scale`` where present: L-BFGS on the mean loss plus l2/2 |w|^2.

    target: 0 or 1 per row; value: what an entry's feature is worth besides its scale, 1 if absent. The weights returned already
    hold the scale.
    """
    rows, k = len(target), len(scale)
    weight = np.full(rows, 1.0 / max(rows, 1)) if weight is None else weight / weight.sum()
    parts = [slice(at, at + ENTRIES) for at in range(0, len(row), ENTRIES)]
    x = lambda part: scale[feature[part]] if value is None else scale[feature[part]] * value[part]

    def loss(p: np.ndarray):
        z, grad = np.full(rows, p[k]), l2 * p
        for part in parts:
            z += row_sums(p[feature[part]] * x(part), row[part], rows)
        total = float(weight @ (np.logaddexp(0, z) - target * z)) + l2 / 2 * float(p[:k] @ p[:k])
        d = weight * (1 / (1 + np.exp(-np.clip(z, -500, 500))) - target)
        grad[k] = d.sum()
        for part in parts:
            grad[:k] += np.bincount(feature[part], d[row[part]] * x(part), minlength=k)
        return total, grad

    p = np.zeros(k + 1)
    now, grad = loss(p)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, y in reversed(pairs):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if pairs:
            s, y = pairs[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(pairs, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        step, slope = 1.0, float(grad @ q)
        while True:
            new = p - step * q
            after, grad_after = loss(new)
            if after <= now - 1e-4 * step * slope or step < 1e-8:
                break
            step /= 2
        s, y = new - p, grad_after - grad
        if float(s @ y) > 1e-12:
            pairs = [*pairs[1 - history :], (s, y)]
        done = abs(now - after) < 1e-7 * max(1.0, abs(now))
        p, now, grad = new, after, grad_after
        if done:
            break
    return p[:k] * scale, float(p[k])
