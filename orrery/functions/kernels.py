"""Vector kernels: NumPy matrices in, NumPy matrices out; no Spark here.

Vectors are rows. Everything is computed in double precision.
"""

from __future__ import annotations

import numpy as np

EPS = 1.9  # width of the error bound
#: Where the search for the best scale starts, as a share of its end, by extra bits.
RESCALE_START = (0.0, 0.15, 0.20, 0.52, 0.59, 0.71, 0.75, 0.77, 0.81)


# --- rotation


def sign_flips(width: int, seed: int, rounds: int = 4) -> np.ndarray:
    """(rounds, width) of +1 and -1, from a hash that SQL can compute as well."""
    x = np.arange(rounds * width, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 1)
    mask = np.uint64(0xFFFFFFFF)
    x = (x * np.uint64(2654435761)) & mask
    x = ((x ^ (x >> np.uint64(15))) * np.uint64(2246822519)) & mask
    return np.where((x >> np.uint64(16)) & np.uint64(1), -1.0, 1.0).reshape(rounds, width)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Walsh-Hadamard transform of each row, not scaled; the width is a power of two."""
    n, width = x.shape
    step = 1
    while step < width:
        x = x.reshape(n, width // (2 * step), 2, step)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, width)
        step *= 2
    return x


def rotate(x: np.ndarray, seed: int) -> np.ndarray:
    """A random rotation that keeps inner products: four rounds of sign flips and a Hadamard transform.

    Rows are padded with zeros to a multiple of 64. If that isn't a power of two, the transform takes the first and the
    last coordinates in turn, and sums and differences of the two halves follow each round.
    """
    n, dim = x.shape
    width = -(-dim // 64) * 64
    block = 1 << int(np.floor(np.log2(dim)))
    if not 64 <= block <= 2048:
        raise ValueError("the rotation takes 64 to 4095 dimensions")
    out = np.zeros((n, width))
    out[:, :dim] = x
    whole = block == width
    for turn, flips in enumerate(sign_flips(width, seed)):
        out = out * flips
        part = slice(0, block) if whole or turn % 2 == 0 else slice(width - block, width)
        out[:, part] = hadamard(out[:, part]) / np.sqrt(block)
        if not whole:
            a, b = out[:, : width // 2], out[:, width // 2 :]
            out = np.concatenate((a + b, a - b), axis=1)
    return out if whole else out * 0.25


def rotation_matrix(dim: int, seed: int) -> np.ndarray:
    """(dim, width): rotating is multiplying from the right."""
    return rotate(np.eye(dim), seed)


def orthonormal_matrix(dim: int, seed: int) -> np.ndarray:
    """A uniformly random rotation of width dim padded to 64, by QR of a Gaussian matrix."""
    width = -(-dim // 64) * 64
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((width, width)))
    return (q * np.sign(np.diag(r)))[:, :].T[:dim]


# --- codes


def _or_inf(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, np.inf, x)


def onebit(x: np.ndarray, c: np.ndarray | None, metric: str, prefix: int | None = None, certain: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Signs of the residuals to ``c`` and the factors add, rescale, error of estimates from them.

    ``c`` has a row for each row of ``x``, or is None for the origin. With a prefix, estimates see only the first ``prefix`` signs and extrapolate.
    The error holds with high probability; ``certain``: always, by Cauchy and Schwarz, but for ``estimate_slack``.
    """
    c = np.zeros_like(x) if c is None else c
    r = x - c
    width = r.shape[1]
    m = width if prefix is None else prefix
    bits = r > 0
    u = bits - 0.5
    norm2 = (r * r).sum(1)
    norm = np.sqrt(norm2)
    ru, cu = _or_inf((r * u).sum(1)), (c[:, :m] * u[:, :m]).sum(1)
    grow = 1.0 if prefix is None else width / m
    if prefix is None:
        uu = width / 4
        error = (np.sqrt(width - 1) if certain else EPS) * norm * np.sqrt(np.maximum(0.0, (norm2 * uu / ru**2 - 1) / (width - 1)))
    else:
        error = EPS * norm / np.sqrt(m)
    if metric == "l2":
        return bits, norm2 + 2 * norm2 * cu / ru * grow, -2 * norm2 / ru * grow, 2 * error
    return bits, 1 - (r * c).sum(1) + norm2 * cu / ru * grow, -norm2 / ru * grow, error


def unit_abs(r: np.ndarray) -> np.ndarray:
    """Absolute residuals of norm one; zero residuals stay zero."""
    norm = np.sqrt((r * r).sum(1, keepdims=True))
    return np.abs(r) / np.where(norm > 0, norm, 1.0)


RESCALE_CELLS = 1 << 20  # events that the search for the best scale holds at once


def best_rescale(a: np.ndarray, ex_bits: int) -> np.ndarray:
    """For each row the smallest scale t at which min(floor(t * a), top) + 1/2 points most nearly along ``a``."""
    out = np.zeros(len(a))
    step = max(1, RESCALE_CELLS // (a.shape[1] << ex_bits))
    for at in range(0, len(a), step):
        out[at : at + step] = _best_rescale(a[at : at + step], ex_bits)
    return out


def _best_rescale(a: np.ndarray, ex_bits: int) -> np.ndarray:
    """All rows at once: every (coordinate, level) is an event at t = level / coordinate; running sums in the order of t."""
    top = (1 << ex_bits) - 1
    n, width = a.shape
    peak = a.max(axis=1)
    live = peak > 0
    end = (top + 10) / np.where(live, peak, 1.0)
    start = end * RESCALE_START[ex_bits]
    levels = np.arange(1, top + 1)
    with np.errstate(divide="ignore"):
        t = (levels[None, None, :] / a[:, :, None]).reshape(n, -1)
    weight = np.repeat(a, top, axis=1)
    gain = np.tile(2.0 * levels, (n, width))
    first = t <= start[:, None]
    dot = a.sum(1) / 2 + np.where(first, weight, 0.0).sum(1)
    square = width / 4 + np.where(first, gain, 0.0).sum(1)
    later = ~first & (t < end[:, None])
    when = np.where(later, t, np.inf)
    order = np.argsort(when, axis=1, kind="stable")
    most = int(later.sum(1).max(initial=0))
    order = order[:, :most]
    when = np.take_along_axis(when, order, 1)
    some = np.isfinite(when)
    dots = dot[:, None] + np.cumsum(np.where(some, np.take_along_axis(weight, order, 1), 0.0), axis=1)
    squares = square[:, None] + np.cumsum(np.where(some, np.take_along_axis(gain, order, 1), 0.0), axis=1)
    last = some & np.concatenate((when[:, 1:] != when[:, :-1], np.ones((n, min(1, most)), bool)), axis=1)
    score = np.where(last, dots / np.sqrt(squares), -np.inf)
    score = np.concatenate(((dot / np.sqrt(square))[:, None], score), axis=1)
    times = np.concatenate((start[:, None], when), axis=1)
    return np.where(live, times[np.arange(n), score.argmax(axis=1)], 0.0)


def constant_rescale(width: int, ex_bits: int, seed: int, samples: int = 100) -> float:
    """Mean best scale of random directions: the faster variant's scale for all vectors."""
    a = unit_abs(np.random.default_rng(seed).standard_normal((samples, width)))
    return float(best_rescale(a, ex_bits).mean())


def levels_at(a: np.ndarray, t: np.ndarray, ex_bits: int) -> np.ndarray:
    """The largest level k with k / a <= t; borders are decided by that division."""
    top = (1 << ex_bits) - 1
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.minimum(np.floor(a * t[:, None]), top)
        k -= (k > 0) & (k / a > t[:, None])
        k += (k < top) & (a > 0) & ((k + 1) / a <= t[:, None])
    return k.astype(np.int64)


def ex_codes(x: np.ndarray, c: np.ndarray | None, ex_bits: int, metric: str, scale: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Extra-bit codes of residuals to ``c`` (None: the origin) and their factors add, rescale; ``scale`` skips the search for the best one."""
    c = np.zeros_like(x) if c is None else c
    r = x - c
    a = unit_abs(r)
    if scale is None:
        k = levels_at(a, best_rescale(a, ex_bits), ex_bits)
    else:
        k = np.minimum(np.floor(a * scale + 1e-5), (1 << ex_bits) - 1).astype(np.int64)
    along = ((k + 0.5) * a).sum(1)
    inverse = np.where(along > 0, 1 / np.where(along > 0, along, 1.0), 1.0)
    code = np.where(r < 0, (1 << ex_bits) - 1 - k, k)
    w = code + (r >= 0) * float(1 << ex_bits) - ((1 << ex_bits) - 0.5)
    norm2 = (r * r).sum(1)
    norm, rw, cw = np.sqrt(norm2), _or_inf((r * w).sum(1)), (c * w).sum(1)
    if metric == "l2":
        return code, norm2 + 2 * norm2 * cw / rw, -2 * norm * inverse
    return code, 1 - (r * c).sum(1) + norm2 * cw / rw, -norm * inverse


def split_codes(code: np.ndarray, bits: np.ndarray, ex_bits: int, resident: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole codes (sign and extra bits) in two: the top ``resident`` bits, which stay in memory, and the others."""
    whole = code + bits.astype(np.int64) * (1 << ex_bits)
    rest = ex_bits + 1 - resident
    if not 1 <= resident <= ex_bits + 1:
        raise ValueError("the resident bits are 1 to all")
    return whole >> rest, whole & ((1 << rest) - 1)


def resident_factors(x: np.ndarray, c: np.ndarray, top: np.ndarray, resident: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Factors add, rescale, error of estimates from the top bits alone: the code's exact product with the residual scales it."""
    r = x - c
    w = top - ((1 << resident) - 1) / 2
    norm2, rw, cw, ww = (r * r).sum(1), _or_inf((r * w).sum(1)), (c * w).sum(1), (w * w).sum(1)
    error = EPS * np.sqrt(norm2) * np.sqrt(np.maximum(0.0, (norm2 * ww / rw**2 - 1) / (x.shape[1] - 1)))
    if metric == "l2":
        return norm2 + 2 * norm2 * cw / rw, -2 * norm2 / rw, 2 * error
    return 1 - (r * c).sum(1) + norm2 * cw / rw, -norm2 / rw, error


def scalar_quantize(x: np.ndarray, bits: int, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Full codes of vectors, and delta and low value that give them back: code * delta + low."""
    ex = bits - 1
    a = unit_abs(x)
    k = levels_at(a, best_rescale(a, ex), ex)
    code = np.where(x < 0, (1 << ex) - 1 - k, k) + (x >= 0) * (1 << ex)
    u = code - ((1 << ex) - 0.5)
    norm, size, dot = np.sqrt((x * x).sum(1)), np.sqrt((u * u).sum(1)), (x * u).sum(1)
    cos = np.where(norm > 0, dot / np.where(norm > 0, norm * size, 1.0), 1.0)
    delta = norm / size * {"reconstruction": cos, "unbiased": 1 / cos, "plain": 1.0}[kind]
    return code, delta, -delta * ((1 << ex) - 0.5)


# --- estimates: rows are points, columns are queries


def onebit_estimate(bits, add, rescale, error, q, q_add, q_err, prefix=None):
    """Estimated distances and their lower bounds."""
    m = bits.shape[1] if prefix is None else prefix
    dot = bits[:, :m].astype(float) @ q[:, :m].T - q[:, :m].sum(1) / 2
    est = add[:, None] + q_add + rescale[:, None] * dot
    return est, est - error[:, None] * q_err


def estimate_slack(add: np.ndarray, rescale: np.ndarray, q: np.ndarray, c: np.ndarray) -> float:
    """What rounding may put estimates, and distances beside them, off by."""
    width = q.shape[1]
    most = lambda x: float(np.abs(x).max(initial=0.0))
    length = np.sqrt((q * q).sum(1).max(initial=0.0)) + np.sqrt((c * c).sum()) + most(rescale) * np.sqrt(width)
    return float(16 * (width + 8) * np.finfo(float).eps * (length**2 + most(rescale) * np.abs(q).sum(1).max(initial=0.0) + most(add)))


def ex_estimate(bits, code, add, rescale, q, q_add, ex_bits):
    """Distances from signs and extra bits."""
    dot = (bits.astype(float) * (1 << ex_bits) + code) @ q.T - ((1 << (ex_bits + 1)) - 1) / 2 * q.sum(1)
    return add[:, None] + q_add + rescale[:, None] * dot


def ex_lower(dist, error, q_err, ex_bits):
    """Lower bounds of distances from all bits: the one-bit error shrinks by two with each extra bit."""
    return dist - error[:, None] * q_err / (1 << ex_bits)


def query_terms(q: np.ndarray, c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """What queries add to estimates at a centroid: distance terms and error scale."""
    gap = np.sqrt(((q - c) ** 2).sum(1))
    return (gap**2 if metric == "l2" else -(q @ c)), gap


def distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """(points, queries) by a matrix product: squared L2 around the queries' mean, or 1 - inner product.

    Off by ``slack`` at most; where order among near-ties or an exact zero matters, use ``nearest``, ``smallest`` or ``paired``.
    """
    if metric == "ip":
        return 1 - x @ q.T
    middle = q.mean(axis=0) if len(q) else 0.0
    x, q = x - middle, q - middle
    d = x @ q.T
    d *= -2
    d += (x * x).sum(1)[:, None]
    d += (q * q).sum(1)
    return np.maximum(d, 0.0, out=d)


def slack(x: np.ndarray, q: np.ndarray) -> float:
    """What ``distances`` may be off by."""
    size = (np.sqrt((x * x).sum(1).max(initial=0.0)) + 2 * np.sqrt((q * q).sum(1).max(initial=0.0))) ** 2
    return float(8 * (x.shape[1] + 8) * np.finfo(float).eps * (size + 1))


def paired(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """Row by row: squared L2 of the differences, or 1 - inner product. Equal pairs give equal values, wherever they stand."""
    if metric == "ip":
        return 1 - np.einsum("ij,ij->i", x, q)
    d = x - q
    return np.einsum("ij,ij->i", d, d)


TILE = 2048


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``x`` the first of the nearest rows of ``c`` by squared L2, and that distance.

    A product of matrices in tiles finds those that may be nearest; only they are compared exactly.
    """
    best, dist = np.zeros(len(x), dtype=np.int64), np.zeros(len(x))
    for at in range(0, len(x), TILE):
        some = x[at : at + TILE]
        edge = np.full(len(some), np.inf)
        tiles = []
        for to in range(0, len(c), TILE):
            d = distances(some, c[to : to + TILE], "l2")
            edge = np.minimum(edge, d.min(axis=1))
            tiles.append((to, d) if len(c) <= TILE else (to, None))
        edge = (edge + 2 * slack(some, c))[:, None]
        rows, cols = [], []
        for to, d in tiles:
            i, j = np.nonzero((distances(some, c[to : to + TILE], "l2") if d is None else d) <= edge)
            rows.append(i)
            cols.append(j + to)
        i, j = np.concatenate(rows), np.concatenate(cols)
        exact = _in_parts(some, i, c, j, "l2")
        order = np.lexsort((j, exact, i))
        first = order[np.flatnonzero(np.diff(i[order], prepend=-1))]
        best[at : at + TILE], dist[at : at + TILE] = j[first], exact[first]
    return best, dist


def _in_parts(x: np.ndarray, i: np.ndarray, q: np.ndarray, j: np.ndarray, metric: str) -> np.ndarray:
    step = max(1, (1 << 20) // max(1, x.shape[1]))
    found = [paired(x[i[at : at + step]], q[j[at : at + step]], metric) for at in range(0, len(i), step)]
    return np.concatenate(found) if found else np.zeros(0)


def smallest(ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int, metric: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k nearest rows of ``x`` by (distance, id): rows of ``q``, rows of ``x`` and distances, query by query."""
    out = []
    for at in range(0, len(q), TILE):
        some = q[at : at + TILE]
        d = distances(x, some, metric)
        if len(x) > k:
            edge = np.partition(d, k - 1, axis=0)[k - 1] + 2 * slack(x, some)
            i, j = np.nonzero(d <= edge)
        else:
            i, j = (a.ravel() for a in np.indices(d.shape))
        exact = _in_parts(x, i, some, j, metric)
        order = np.lexsort((ids[i], exact, j))
        j = j[order]
        keep = np.arange(len(j)) - np.searchsorted(j, j) < k
        out.append((j[keep] + at, i[order][keep], exact[order][keep]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))


def quantize_queries(q: np.ndarray, bits: int = 4) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Whole numbers of ``bits`` bits for each query's coordinates, with delta and low that give them back, rounded to nearest."""
    low, high = q.min(axis=1), q.max(axis=1)
    delta = (high - low) / ((1 << bits) - 1)
    code = np.floor((q - low[:, None]) / np.where(delta > 0, delta, 1.0)[:, None] + 0.5)
    return np.clip(code, 0, (1 << bits) - 1).astype(np.int64), delta, low


def small_query_estimate(bits, add, rescale, error, q, q_add, q_err, query_bits: int = 4):
    """``onebit_estimate`` from queries of a few bits a coordinate: sums of whole numbers, scaled back once for each pair."""
    code, delta, low = quantize_queries(q, query_bits)
    ones = bits.astype(np.int64)
    dot = delta * (ones @ code.T) + low * ones.sum(1)[:, None] - (delta * code.sum(1) + low * q.shape[1]) / 2
    est = add[:, None] + q_add + rescale[:, None] * dot
    return est, est - error[:, None] * q_err


def pack_codes(code: np.ndarray, ex_bits: int) -> np.ndarray:
    """(rows, width) of codes to (rows, width * ex_bits / 8) bytes: each coordinate's bits in turn, high bits first."""
    bits = np.unpackbits(code.astype(np.uint8)[:, :, None], axis=2)[:, :, 8 - ex_bits :]
    return np.packbits(bits.reshape(len(code), -1), axis=1)


def unpack_codes(packed: np.ndarray, width: int, ex_bits: int) -> np.ndarray:
    bits = np.unpackbits(packed, axis=1)[:, : width * ex_bits].reshape(len(packed), width, ex_bits)
    return bits @ (1 << np.arange(ex_bits - 1, -1, -1))


def norm_cancellation(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """(points, queries): digits lost where squared L2 comes from norms and a product: its terms over its value."""
    d = distances(x, q, "l2")
    terms = (x * x).sum(1)[:, None] + (q * q).sum(1)
    return terms / np.maximum(d, np.finfo(float).tiny)
