"""SQL of the signal kernels, written out as sums and recursions over samples: the queries' twins for the test tables.

Each function gives further tables of a WITH, from a table of samples (trace_idx, i, v) with i from 0 and a rate of 1000 Hz.
"""

from __future__ import annotations

import math

SAMPLES = ", xs AS (SELECT trace_idx, time::BIGINT AS i, value AS v FROM tr)"


def hann(i: str, n: int) -> str:
    return f"(0.5 - 0.5 * cos(2 * pi() * {i} / {n}))"


def segments(src: str, size: int, overlap: int, out: str, part: str = "trace_idx") -> str:
    """out(part, seg, k, freq, p): one-sided power densities of Hann segments without their mean, for each of `part`."""
    step, power = size - overlap, sum((0.5 - 0.5 * math.cos(2 * math.pi * i / size)) ** 2 for i in range(size))
    scale = f"CASE WHEN k = 0 OR (k = {size // 2} AND {size} % 2 = 0) THEN 1 ELSE 2 END"
    return f"""
, {out}_n AS (SELECT {part}, max(i) + 1 AS n FROM {src} GROUP BY {part}),
{out}_s AS (SELECT {part}, unnest(range(0, (n - {size}) // {step} + 1)) AS seg FROM {out}_n),
{out}_x AS (SELECT {part}, seg, i - seg * {step} AS j, v - avg(v) OVER (PARTITION BY {part}, seg) AS v FROM {out}_s JOIN {src} USING ({part}) WHERE i BETWEEN seg * {step} AND seg * {step} + {size - 1}),
{out}_d AS (SELECT {part}, seg, k, sum(v * {hann('j', size)} * cos(2 * pi() * j * k / {size})) AS c, sum(v * {hann('j', size)} * sin(2 * pi() * j * k / {size})) AS s
    FROM {out}_x, (SELECT unnest(range(0, {size // 2 + 1})) AS k) GROUP BY {part}, seg, k),
{out} AS (SELECT {part}, seg, k, k * 1000.0 / {size} AS freq, (c * c + s * s) / {1000.0 * power!r}::DOUBLE * {scale} AS p FROM {out}_d)"""


def simpson_weights(n: int) -> list[float]:
    """Of n equally spaced samples, in units of their distance; with an even number the last interval has the cubic correction."""
    if n < 3:
        return [0.5] * n if n == 2 else [0.0] * n
    m = n if n % 2 else n - 1
    w = [(1 if i in (0, m - 1) else 4 if i % 2 else 2) / 3 for i in range(m)]
    if n != m:
        w.append(0.0)
        for k, x in ((-1, 5), (-2, 8), (-3, -1)):
            w[k] += x / 12
    return w


def bands(src: str, size: int, named: dict[str, tuple[float, float]], out: str, part: str = "trace_idx") -> str:
    """out(part, band, power) from mean densities src(part, k, p)."""
    step = 1000.0 / size
    inside = {b: [k for k in range(size // 2 + 1) if lo <= k * step <= hi] for b, (lo, hi) in named.items()} | {"total": list(range(size // 2 + 1))}
    rows = ", ".join(f"('{b}', {k}, {w * step!r})" for b, ks in inside.items() for k, w in zip(ks, simpson_weights(len(ks)), strict=True))
    return f", {out} AS (SELECT {part}, band, sum(p * w) AS power FROM {src} JOIN (VALUES {rows}) AS q(band, k, w) USING (k) GROUP BY {part}, band)"


def coefficients(kind: str, hz) -> tuple[list[float], list[float]]:
    """Of a second-order Butterworth filter: in closed form, or for a band from its two pairs of poles."""
    if kind in ("low", "high"):
        k = math.tan(math.pi * hz / 1000.0)
        norm = 1 / (1 + math.sqrt(2) * k + k * k)
        b = [k * k * norm, 2 * k * k * norm, k * k * norm] if kind == "low" else [norm, -2 * norm, norm]
        return b, [1.0, 2 * (k * k - 1) * norm, (1 - math.sqrt(2) * k + k * k) * norm]
    # s -> (s^2 + w0^2) / (B s) in 1 / (s^2 + sqrt(2) s + 1), then s = (1 - z) / (1 + z) on tangents
    lo, hi = (math.tan(math.pi * f / 1000.0) for f in hz)
    w, q = lo * hi, hi - lo
    analogue = [1.0, math.sqrt(2) * q, 2 * w + q * q, math.sqrt(2) * q * w, w * w]  # from s^4 down
    times = lambda x, y: [sum(x[i] * y[n - i] for i in range(len(x)) if 0 <= n - i < len(y)) for n in range(len(x) + len(y) - 1)]

    def to_z(down: list[float]) -> list[float]:
        total = [0.0] * 5
        for power, c in zip(range(4, -1, -1), down, strict=True):
            term = [c]
            for _ in range(power):
                term = times(term, [1.0, -1.0])
            for _ in range(4 - power):
                term = times(term, [1.0, 1.0])
            total = [x + y for x, y in zip(total, term, strict=True)]
        return total

    a, b = to_z(analogue), to_z([0.0, 0.0, q * q, 0.0, 0.0])
    return [x / a[0] for x in b], [x / a[0] for x in a]


def filtered(src: str, kind: str, hz, out: str) -> str:
    """out(trace_idx, i, v): forwards and backwards with odd extensions, each run from its steady state."""
    b, a = coefficients(kind, hz)
    order = len(a) - 1
    pad, gain = 3 * (order + 1), sum(b) / sum(a)
    rest = [sum(b[j] - a[j] * gain for j in range(k + 1, order + 1)) for k in range(order)]

    def passed(name: str, of: str) -> str:
        state = [f"s{k}" for k in range(order)]
        y = lambda prior: f"({b[0]!r} * e.v + {prior}0)"
        first = {s: f"{r!r} * e.v" for s, r in zip(state, rest, strict=True)}
        y0 = f"({b[0]!r} * e.v + {first['s0']})"
        nxt = lambda yy, prior: [f"{b[k + 1]!r} * e.v - ({a[k + 1]!r}) * {yy}" + (f" + {prior(k + 1)}" if k + 1 < order else "") for k in range(order)]
        begin = ", ".join(f"{x} AS {s}" for x, s in zip(nxt(y0, lambda k: first[f"s{k}"]), state, strict=True))
        again = ", ".join(nxt(y("f.s"), lambda k: f"f.s{k}"))
        return f", {name}(trace_idx, j, y, {', '.join(state)}) AS (SELECT e.trace_idx, e.j, {y0}, {begin.replace(' AS s', ' AS t')} FROM {of} e WHERE e.j = 0 UNION ALL SELECT e.trace_idx, e.j, {y('f.s')}, {again} FROM {name} f JOIN {of} e ON e.trace_idx = f.trace_idx AND e.j = f.j + 1)"

    return f"""
, {out}_n AS (SELECT trace_idx, max(i) AS z, arg_min(v, i) AS a, arg_max(v, i) AS b FROM {src} GROUP BY trace_idx),
{out}_e AS (SELECT trace_idx, {pad} - i AS j, 2 * a - v AS v FROM {src} JOIN {out}_n USING (trace_idx) WHERE i BETWEEN 1 AND {pad}
    UNION ALL SELECT trace_idx, {pad} + i, v FROM {src} UNION ALL SELECT trace_idx, {pad} + 2 * z - i, 2 * b - v FROM {src} JOIN {out}_n USING (trace_idx) WHERE i BETWEEN z - {pad} AND z - 1){passed(out + '_f', out + '_e')},
{out}_r AS (SELECT trace_idx, z + {2 * pad} - j AS j, y AS v FROM {out}_f JOIN {out}_n USING (trace_idx)){passed(out + '_b', out + '_r')},
{out} AS (SELECT trace_idx, z + {pad} - j AS i, y AS v FROM {out}_b JOIN {out}_n USING (trace_idx) WHERE z + {pad} - j BETWEEN 0 AND z)"""


def peaks(src: str, out: str, height: float | None = None, distance: int | None = None) -> str:
    """out(trace_idx, i, v, prominence, width) of the maxima of src, no plateaus; of two closer than `distance` the higher one stays."""
    high = f"AND v >= {height}" if height is not None else ""
    sql = f", {out}_m AS (SELECT trace_idx, i, v FROM (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS n FROM {src} WINDOW w AS (PARTITION BY trace_idx ORDER BY i)) WHERE v > p AND v > n {high})"
    of = f"{out}_m"
    if distance:
        sql += f""", {out}_o AS (SELECT *, row_number() OVER (PARTITION BY trace_idx ORDER BY v DESC, i DESC) AS r FROM {of}),
{out}_g(trace_idx, r, kept) AS (SELECT trace_idx, r, [i] FROM {out}_o WHERE r = 1
    UNION ALL SELECT o.trace_idx, o.r, CASE WHEN len(list_filter(g.kept, lambda x: abs(x - o.i) < {distance})) = 0 THEN list_append(g.kept, o.i) ELSE g.kept END FROM {out}_g g JOIN {out}_o o ON o.trace_idx = g.trace_idx AND o.r = g.r + 1),
{out}_k AS (SELECT trace_idx, i, v FROM {of} JOIN (SELECT trace_idx, unnest(arg_max(kept, r)) AS i FROM {out}_g GROUP BY trace_idx) USING (trace_idx, i))"""
        of = f"{out}_k"
    return sql + f""", {out}_h AS (SELECT p.trace_idx, p.i, p.v, coalesce(max(s.i) FILTER (s.i < p.i AND s.v > p.v), -1) AS lo, coalesce(min(s.i) FILTER (s.i > p.i AND s.v > p.v), 1000000) AS hi FROM {of} p JOIN {src} s USING (trace_idx) GROUP BY ALL),
{out}_q AS (SELECT h.trace_idx, h.i, h.v, min(s.v) FILTER (s.i < h.i) AS x, min(s.v) FILTER (s.i > h.i) AS y, arg_min(s.i, s.v) FILTER (s.i < h.i) AS a, arg_min(s.i, s.v) FILTER (s.i > h.i) AS b FROM {out}_h h JOIN {src} s ON s.trace_idx = h.trace_idx AND s.i > lo AND s.i < hi GROUP BY h.trace_idx, h.i, h.v),
{out}_p AS (SELECT trace_idx, i, v, a, b, v - greatest(x, y) AS prominence, v - (v - greatest(x, y)) / 2 AS level FROM {out}_q),
{out}_s AS (SELECT *, lag(v) OVER w AS prv, lead(v) OVER w AS nxt FROM {src} WINDOW w AS (PARTITION BY trace_idx ORDER BY i)),
{out}_w AS (SELECT p.trace_idx, p.i, p.v, prominence, level, max(s.i) FILTER (s.i < p.i AND s.v <= level) AS l, arg_max(s.v, s.i) FILTER (s.i < p.i AND s.v <= level) AS lv, arg_max(s.nxt, s.i) FILTER (s.i < p.i AND s.v <= level) AS ln,
    min(s.i) FILTER (s.i > p.i AND s.v <= level) AS r, arg_min(s.v, s.i) FILTER (s.i > p.i AND s.v <= level) AS rv, arg_min(s.prv, s.i) FILTER (s.i > p.i AND s.v <= level) AS rp
    FROM {out}_p p JOIN {out}_s s ON s.trace_idx = p.trace_idx AND s.i BETWEEN a AND b GROUP BY p.trace_idx, p.i, p.v, prominence, level),
{out} AS (SELECT trace_idx, i, v, prominence, (r - (level - rv) / (rp - rv)) - (l + (level - lv) / (ln - lv)) AS width FROM {out}_w)"""


def hilbert(src: str, n: int, out: str) -> str:
    """out(trace_idx, i, re, im): the analytic signal of n (even) samples without their mean, by its kernel of odd lags."""
    return f"""
, {out}_c AS (SELECT trace_idx, i, v - avg(v) OVER (PARTITION BY trace_idx) AS v FROM {src}),
{out} AS (SELECT a.trace_idx, a.i, a.v AS re, sum(CASE WHEN (a.i - b.i) % 2 <> 0 THEN b.v * 2.0 / {n} / tan(pi() * (a.i - b.i) / {n}) ELSE 0 END) AS im FROM {out}_c a JOIN {out}_c b USING (trace_idx) GROUP BY ALL)"""


def wavelet(src: str, freqs: list[float], out: str, cycles: float = 5.0) -> str:
    """out(trace_idx, i, freq, v): magnitudes of a Morlet transform; the kernel's samples begin four widths before its middle."""
    rows = []
    for f in freqs:
        width = cycles / (2 * math.pi * f)
        size = math.ceil((8 * width + 0.001) / 0.001)
        rows.append(f"({f!r}::DOUBLE, {width!r}::DOUBLE, {size})")
    return f"""
, {out}_f(freq, width, size) AS (VALUES {', '.join(rows)}),
{out}_k AS (SELECT freq, m, -4 * width + m / 1000.0 AS t, exp(-power(m / 1000.0 - 4 * width, 2) / (2 * width * width)) / sqrt(width * 1000.0 * sqrt(pi())) AS g, size // 2 AS half FROM (SELECT *, unnest(range(0, size)) AS m FROM {out}_f)),
{out} AS (SELECT a.trace_idx, a.i, k.freq, sqrt(power(sum(b.v * g * cos(2 * pi() * k.freq * t)), 2) + power(sum(b.v * g * sin(2 * pi() * k.freq * t)), 2)) AS v FROM {src} a JOIN {src} b USING (trace_idx) JOIN {out}_k k ON k.m = half + a.i - b.i GROUP BY a.trace_idx, a.i, k.freq)"""
