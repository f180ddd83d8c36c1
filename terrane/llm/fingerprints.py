"""Min-hash fingerprints of character shingles and the variants of their Hamming balls, batch-wise in numpy."""

from __future__ import annotations

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a sort key that number the text: fewer than 2 ** TEXT_BITS texts at once.
TEXT_BITS = 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def joined(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the position at which each begins (one more at the end)."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=at[1:])
    return c, at


def gram_hashes(c: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n characters that begin at each position (len(c) - n + 1 of them)."""
    m = len(c) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    c = c.astype(np.uint64)
    h = c[:m].copy()
    with np.errstate(over="ignore"):
        for k in range(1, n):
            h = h * _BASE + c[k : k + m]
    return mix(h)


def min_symbols(texts: list[str], n: int, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """(least, runner-up) hash per text and bin: one hash per shingle, the bin by its high bits; 0 where there is none.

    The runner-up is the symbol the bin would have without its least shingle.
    """
    c, at = joined(texts)
    h = gram_hashes(c, n)
    size = np.maximum(np.diff(at) - n + 1, 0)
    doc = np.repeat(np.arange(len(texts)), size)
    # positions of grams that lie in one text
    pos = np.arange(len(doc)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(at[:-1], size)
    h = h[pos] | np.uint64(1)
    # one sortable number: text, then bin and hash by the high bits of the hash
    # the same number of hash bits is kept whatever the number of texts, else symbols of two batches could not meet
    bits = TEXT_BITS
    if len(texts) >= 1 << bits:
        raise ValueError("too many texts at once")
    key = np.sort((doc.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))
    if len(key):
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
    body = (key << np.uint64(bits)) >> np.uint64(bits)
    # the bin: body * bins / 2 ** (64 - bits), from the high 32 bits
    slot = ((body >> np.uint64(32 - bits)) * np.uint64(bins)) >> np.uint64(32)
    cell = (key >> np.uint64(64 - bits)).astype(np.int64) * bins + slot.astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    least = np.zeros(len(texts) * bins, np.uint64)
    second = np.zeros(len(texts) * bins, np.uint64)
    least[cell[first]] = mix(body[first])
    after = first + 1
    ok = after < len(cell)
    ok[ok] = cell[after[ok]] == cell[first[ok]]
    second[cell[first[ok]]] = mix(body[after[ok]])
    return _filled(least.reshape(-1, bins), second.reshape(-1, bins))


def _filled(least: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An empty bin takes the symbols of the next full one to its right, marked with the distance."""
    n, bins = least.shape
    if not n or least.all():
        return least, second
    at = np.where(np.concatenate([least, least], axis=1) != 0, np.arange(2 * bins), 4 * bins)
    near = np.minimum.accumulate(at[:, ::-1], axis=1)[:, ::-1][:, :bins]
    far = (near - np.arange(bins)).astype(np.uint64)
    full = near < 2 * bins
    src = np.where(full, near % bins, 0)
    row = np.arange(n)[:, None]
    with np.errstate(over="ignore"):
        fill = lambda a: np.where(full, np.where(far == 0, a[row, src], mix(a[row, src] + far * _BASE)), np.uint64(0))
        return fill(least), fill(second)


def ball_keys(least: np.ndarray, second: np.ndarray, tables: int, width: int) -> np.ndarray:
    """Keys of all variants within half the radius (one replaced symbol) of each of `tables` fingerprints of `width` symbols.

    A symbol's replacement is its runner-up: two texts that differ by a shingle in a bin have the runner-up of one
    equal to the least of the other. With one replacement on either side, fingerprints at distance two meet.
    """
    n = len(least)
    with np.errstate(over="ignore"):
        place = mix(np.arange(1, tables * width + 1, dtype=np.uint64) * _BASE)
        a = mix(least + place).reshape(n, tables, width)
        b = mix(second + place).reshape(n, tables, width)
        whole = a.sum(2, dtype=np.uint64)
        keys = np.concatenate([whole[:, :, None], whole[:, :, None] - a + b], axis=2)
    return mix(keys).reshape(n, tables * (width + 1))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
