"""Signal kernels in numpy, for one regularly sampled series each. They run in Arrow batches, one group a series."""

from __future__ import annotations

import functools

import numpy as np

# --- filters ------------------------------------------------------------------------------------------------------


@functools.lru_cache(64)
def butterworth(hz: float | tuple[float, float], rate: float, kind: str, order: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital Butterworth filter: analogue prototype, frequency transform, bilinear transform."""
    poles = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    warp = 2 * rate * np.tan(np.pi * np.atleast_1d(np.asarray(hz, float)) / rate)
    if kind == "low":
        p, z, gain = poles * warp[0], np.zeros(0, complex), warp[0] ** order
    elif kind == "high":
        p, z, gain = warp[0] / poles, np.zeros(order, complex), float(np.real(1 / np.prod(-poles)))
    else:
        width, mid2 = warp[1] - warp[0], warp[0] * warp[1]
        half = poles * width / 2
        root = np.sqrt(half**2 - mid2 + 0j)
        p, z, gain = np.r_[half + root, half - root], np.zeros(order, complex), width**order
    k = 2 * rate
    gain = gain * np.real(np.prod(k - z) / np.prod(k - p))
    zd = np.r_[(k + z) / (k - z), -np.ones(len(p) - len(z))]
    return np.real(gain * np.poly(zd)), np.real(np.poly((k + p) / (k - p)))


@functools.lru_cache(64)
def _blocks(b: tuple, a: tuple, block: int = 64) -> tuple[np.ndarray, ...]:
    """The matrices of a filter's response, over a block, to its input and to the state."""
    n = max(len(a), len(b)) - 1
    b, a = np.r_[b, np.zeros(n + 1 - len(b))] / a[0], np.r_[a, np.zeros(n + 1 - len(a))] / a[0]
    step = np.zeros((n, n))
    step[:, 0] = -a[1:]
    step[:-1, 1:] = np.eye(n - 1)
    feed = b[1:] - a[1:] * b[0]
    powers = [np.eye(n)]
    for _ in range(block):
        powers.append(step @ powers[-1])
    out_state = np.array([p[0] for p in powers[:block]])
    impulse = np.r_[b[0], out_state[:-1] @ feed]
    lag = np.arange(block)[:, None] - np.arange(block)[None, :]
    lower = np.where(lag >= 0, impulse[np.abs(lag)], 0.0)
    carry = np.array([powers[block - 1 - j] @ feed for j in range(block)]).T
    return b, step, feed, out_state, lower, carry, powers[block]


def _filtered(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Direct form II transposed, by blocks: each block is a matrix product."""
    block = 64
    b, step, feed, out_state, lower, carry, power = _blocks(tuple(b), tuple(a), block)
    y = np.empty(len(x))
    whole = len(x) - len(x) % block
    for s in range(0, whole, block):
        part = x[s : s + block]
        y[s : s + block] = lower @ part + out_state @ state
        state = power @ state + carry @ part
    if rest := len(x) - whole:
        y[whole:] = lower[:rest, :rest] @ x[whole:] + out_state[:rest] @ state
    return y


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero phase: forwards and backwards over the series with odd extensions at both ends, each run starting from its steady state."""
    n = max(len(a), len(b))
    pad = min(3 * n, len(x) - 1)
    if pad < 1:
        return x.copy()
    whole = np.r_[2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]
    order = n - 1
    companion = np.zeros((order, order))
    full_a, full_b = np.r_[a, np.zeros(n - len(a))] / a[0], np.r_[b, np.zeros(n - len(b))] / a[0]
    companion[:, 0] = -full_a[1:]
    companion[:-1, 1:] = np.eye(order - 1)
    rest = np.linalg.solve(np.eye(order) - companion, full_b[1:] - full_a[1:] * full_b[0])
    there = _filtered(b, a, whole, rest * whole[0])
    back = _filtered(b, a, there[::-1], rest * there[-1])[::-1]
    return back[pad : pad + len(x)]


def settling(rate: float, hz: float | tuple[float, float], kind: str, order: int = 2, share: float = 1e-13) -> int:
    """Samples after which less than a share of a filter's response is left."""
    slowest = np.abs(np.roots(butterworth(hz, rate, kind, order)[1])).max()
    return int(np.ceil(np.log(share) / np.log(min(slowest, 1 - 1e-12))))


def pass_filter(x: np.ndarray, rate: float, hz: float | tuple[float, float], kind: str, order: int = 2) -> np.ndarray:
    """Missing values at the ends are filled for the filter and missing again after it; those inside are interpolated."""
    known = ~np.isnan(x)
    if known.sum() < 2:
        return np.full(len(x), np.nan)
    at = np.arange(len(x))
    y = filtfilt(*butterworth(hz, rate, kind, order), np.interp(at, at[known], x[known]))
    y[~known] = np.nan
    return y


# --- spectra ------------------------------------------------------------------------------------------------------


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def tukey(n: int, share: float = 0.25) -> np.ndarray:
    at = np.arange(n + 1) / n
    edge = share / 2
    w = np.ones(n + 1)
    low, high = at < edge, at > 1 - edge
    w[low] = 0.5 * (1 + np.cos(np.pi * (at[low] / edge - 1)))
    w[high] = 0.5 * (1 + np.cos(np.pi * ((at[high] - 1) / edge + 1)))
    return w[:-1]


def segments_power(x: np.ndarray, rate: float, size: int, overlap: int, window: np.ndarray, detrend: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(frequencies, segment centres in s, one-sided power density of each segment)."""
    size = min(size, len(x))
    window = window[:size] if len(window) >= size else hann(size)
    parts = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(1, size - overlap)]
    if detrend:
        parts = parts - parts.mean(axis=1, keepdims=True)
    power = np.abs(np.fft.rfft(parts * window, axis=1)) ** 2 / (rate * (window**2).sum())
    power[:, 1 : None if size % 2 else -1] *= 2
    starts = np.arange(len(parts)) * max(1, size - overlap)
    return np.fft.rfftfreq(size, 1 / rate), (starts + size / 2) / rate, power


def welch(x: np.ndarray, rate: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean power density of half-overlapping Hann segments, each without its mean."""
    size = min(size, len(x))
    f, _, p = segments_power(x, rate, size, size // 2, hann(size))
    return f, p.mean(axis=0)


def decibels(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return 10 * np.log10(x)


def simpson(y: np.ndarray, dx: float) -> float:
    """Simpson's rule; of an even number of samples the last interval takes the cubic correction."""
    n = len(y)
    if n < 2:
        return 0.0
    if n == 2:
        return float(dx * (y[0] + y[1]) / 2)
    m = n if n % 2 else n - 1
    total = dx / 3 * (y[0] + 4 * y[1 : m - 1 : 2].sum() + 2 * y[2 : m - 2 : 2].sum() + y[m - 1])
    return float(total if n % 2 else total + dx * (5 * y[-1] + 8 * y[-2] - y[-3]) / 12)


def band_power(x: np.ndarray, rate: float, bands: dict[str, tuple[float, float]], size: int, total: bool = True) -> dict[str, float]:
    f, p = welch(x, rate, size)
    step = f[1] - f[0] if len(f) > 1 else 1.0
    out = {k: simpson(p[(f >= lo) & (f <= hi)], step) for k, (lo, hi) in bands.items()}
    return out | ({"total": simpson(p, step)} if total else {})


def wavelet(x: np.ndarray, rate: float, freqs: np.ndarray, cycles: float = 5.0) -> np.ndarray:
    """Magnitudes of a Morlet transform, a row a frequency."""
    out = np.empty((len(freqs), len(x)))
    for k, f in enumerate(freqs):
        width = cycles / (2 * np.pi * f)
        t = np.arange(-4 * width, 4 * width + 1 / rate, 1 / rate)
        kern = np.exp(2j * np.pi * f * t) * np.exp(-(t**2) / (2 * width**2))
        kern /= np.sqrt(width * rate * np.sqrt(np.pi))
        whole = np.convolve(x, kern, "full")
        out[k] = np.abs(whole[len(kern) // 2 : len(kern) // 2 + len(x)])
    return out


def analytic(x: np.ndarray) -> np.ndarray:
    """The analytic signal: negative frequencies removed, positive ones doubled."""
    n = len(x)
    gain = np.zeros(n)
    gain[0] = 1
    gain[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        gain[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * gain)


# --- peaks --------------------------------------------------------------------------------------------------------


def local_maxima(x: np.ndarray) -> np.ndarray:
    """Samples above both neighbours; of a plateau its middle."""
    if len(x) < 3:
        return np.zeros(0, int)
    edge = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    last = np.r_[edge[1:], len(x)] - 1
    inner = np.arange(1, len(edge) - 1)
    up = inner[(x[edge[inner]] > x[edge[inner - 1]]) & (x[edge[inner]] > x[edge[inner + 1]])]
    return (edge[up] + last[up]) // 2


def prominences(x: np.ndarray, peaks: np.ndarray, span: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How far each peak stands out from the higher of the two lowest points before higher ground; and where these are."""
    if span is None:
        left, right = _base(x, peaks), len(x) - 1 - _base(x[::-1], len(x) - 1 - peaks[::-1])[::-1]
        return x[peaks] - np.maximum(x[left], x[right]), left, right
    half = max(1, (span | 1) // 2)
    out, left, right = np.empty(len(peaks)), np.empty(len(peaks), int), np.empty(len(peaks), int)
    for k, p in enumerate(peaks):
        a, b = max(0, p - half), min(len(x), p + half + 1)
        higher = np.flatnonzero(x[a:p] > x[p])
        lo = a + higher[-1] + 1 if len(higher) else a
        higher = np.flatnonzero(x[p + 1 : b] > x[p])
        hi = p + 1 + higher[0] if len(higher) else b
        left[k] = p - int(np.argmin(x[lo : p + 1][::-1]))
        right[k] = p + int(np.argmin(x[p:hi]))
        out[k] = x[p] - max(x[left[k]], x[right[k]])
    return out, left, right


def _base(x: np.ndarray, peaks: np.ndarray) -> np.ndarray:
    """The lowest place between each peak and higher ground before it, the nearest of equal ones.

    One pass over all maxima with a stack of falling heights: a maximum takes over the lowest place of those that it rises above.
    """
    if not len(peaks):
        return np.zeros(0, int)
    tops = np.unique(np.r_[0, local_maxima(x), peaks])
    found = np.zeros(len(tops), int)
    stack: list[int] = []  # positions in tops, heights fall from the bottom up
    for k, p in enumerate(tops.tolist()):
        before = int(tops[k - 1]) if k else 0
        low = p - int(np.argmin(x[before : p + 1][::-1]))  # the valley just before
        while stack and x[tops[stack[-1]]] <= x[p]:
            other = found[stack.pop()]
            if x[other] < x[low]:
                low = int(other)
        found[k] = low
        stack.append(k)
    return found[np.searchsorted(tops, peaks)]


def widths(x: np.ndarray, peaks: np.ndarray, prom: tuple[np.ndarray, np.ndarray, np.ndarray], share: float = 0.5) -> np.ndarray:
    """Width at a share of the prominence below each peak, interpolated."""
    out = np.empty(len(peaks))
    for k, (p, depth, lo, hi) in enumerate(zip(peaks, *prom, strict=True)):
        level = x[p] - depth * share
        i = p
        while i > lo and x[i] > level:
            i -= 1
        a = i + (level - x[i]) / (x[i + 1] - x[i]) if x[i] < level else float(i)
        i = p
        while i < hi and x[i] > level:
            i += 1
        b = i - (level - x[i]) / (x[i - 1] - x[i]) if x[i] < level else float(i)
        out[k] = b - a
    return out


def find_peaks(x: np.ndarray, height: float | None = None, distance: int | None = None, prominence: float | None = None, width: float | None = None, span: int | None = None) -> dict[str, np.ndarray]:
    """idx, height, prominence and width of peaks. Of two closer than `distance` the higher one stays."""
    peaks = local_maxima(x)
    if height is not None:
        peaks = peaks[x[peaks] >= height]
    if distance and distance > 1 and len(peaks):
        kept = np.ones(len(peaks), bool)
        for k in np.argsort(x[peaks], kind="stable")[::-1]:
            if kept[k]:  # those that stay are apart, so that each place is passed twice at most
                kept[np.searchsorted(peaks, peaks[k] - distance, "right") : k] = False
                kept[k + 1 : np.searchsorted(peaks, peaks[k] + distance)] = False
        peaks = peaks[kept]
    prom = prominences(x, peaks, span)
    if prominence is not None:
        some = prom[0] >= prominence
        peaks, prom = peaks[some], tuple(v[some] for v in prom)
    wide = widths(x, peaks, prom)
    some = wide >= width if width is not None else np.ones(len(peaks), bool)
    return {"idx": peaks[some], "height": x[peaks[some]], "prominence": prom[0][some], "width": wide[some]}


# --- sequences ----------------------------------------------------------------------------------------------------


def best_path(t0: np.ndarray, t1: np.ndarray, score: np.ndarray, ahead: int = 1000) -> np.ndarray:
    """Of candidate pairs (t0, t1, score) those of the heaviest chain in which both numbers rise: an order-preserving matching.

    Each pair follows on the best chain over earlier t0 and t1, at most `ahead` places of t1 back, from a maximum tree over t1.
    """
    if not len(score):
        return np.zeros(0, int)
    order = np.lexsort((-t1, t0))
    if len(score) <= 24:
        return _short_path(t0.tolist(), t1.tolist(), score.tolist(), order.tolist())
    places, at = np.unique(t1, return_inverse=True)
    size = 1 << max(1, int(len(places)).bit_length())
    best, who = np.zeros(2 * size), np.full(2 * size, -1)
    total, before = np.zeros(len(score)), np.full(len(score), -1)
    k = 0
    while k < len(order):
        end = k
        while end < len(order) and t0[order[end]] == t0[order[k]]:
            end += 1
        for i in order[k:end]:  # all of one t0 ask before any of them is entered
            lo, hi, most, prior = max(0, at[i] - ahead) + size, at[i] + size, 0.0, -1
            while lo < hi:
                if lo & 1:
                    if best[lo] > most:
                        most, prior = best[lo], who[lo]
                    lo += 1
                if hi & 1:
                    hi -= 1
                    if best[hi] > most:
                        most, prior = best[hi], who[hi]
                lo >>= 1
                hi >>= 1
            total[i], before[i] = most + score[i], prior
        for i in order[k:end]:
            node = at[i] + size
            while node and total[i] > best[node]:
                best[node], who[node] = total[i], i
                node >>= 1
        k = end
    out, i = [], int(np.argmax(total))
    while i >= 0 and total[int(i)] > 0:
        out.append(int(i))
        i = before[int(i)]
    return np.array(out[::-1], int)


def _short_path(t0: list, t1: list, score: list, order: list) -> np.ndarray:
    """The same for a few pairs, each compared with all before it."""
    total, before = {}, {}
    for k, i in enumerate(order):
        most, prior = 0.0, -1
        for j in order[:k]:
            if total[j] > most and t0[j] < t0[i] and t1[j] < t1[i]:
                most, prior = total[j], j
        total[i], before[i] = most + score[i], prior
    out, i = [], max(order, key=lambda j: (total[j], -j))
    while i >= 0 and total[i] > 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], int)


def merge_sandwiched(start: np.ndarray, stop: np.ndarray, cat: np.ndarray, max_length: float = np.inf, only=None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows between two of one other category take that category and merge with touching ones of it, pass after pass until none is left.

    In a pass all sandwiched windows are relabelled at once, as they stood before it. Touching ones of one category merge even if none is sandwiched.
    """
    while len(cat):
        hit = np.zeros(len(cat), bool)
        hit[1:-1] = (cat[:-2] == cat[2:]) & (cat[1:-1] != cat[2:]) & (stop[1:-1] - start[1:-1] < max_length)
        if only is not None:
            hit &= np.isin(cat.astype(str), np.atleast_1d(only))
        new = cat.copy()
        new[:-1][hit[:-1]] = cat[1:][hit[:-1]]
        first = np.r_[True, (new[1:] != new[:-1]) | (start[1:] > stop[:-1])]
        at = np.flatnonzero(first)
        start, stop, merged = start[at], np.maximum.reduceat(stop, at), new[at]
        last = not hit.any() or len(merged) == len(cat) and (merged == cat).all()
        cat = merged
        if last:
            break
    return start, stop, cat


def pulse_trains(start: np.ndarray, length: np.ndarray, max_interval: float, precision: float) -> np.ndarray:
    """A number for each pulse's train. A new one begins with another pulse length, after a long interval, or where the interval changes."""
    out = np.zeros(len(start), int)
    expected = np.nan
    for i in range(1, len(start)):
        gap = start[i] - start[i - 1]
        fresh = abs(length[i] - length[i - 1]) > precision or gap > max_interval or (not np.isnan(expected) and abs(gap - expected) > precision)
        out[i] = out[i - 1] + fresh
        expected = np.nan if fresh else gap
    return out
