"""Times are doubles in milliseconds. Column functions for units, text, clocks and sampling rates."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND, MINUTE, HOUR, DAY = 1000.0, 60_000.0, 3_600_000.0, 86_400_000.0
SCALES = {"milliseconds": 1.0, "seconds": SECOND, "minutes": MINUTE, "hours": HOUR, "days": DAY}


def ms(days: float = 0, hours: float = 0, minutes: float = 0, seconds: float = 0, milliseconds: float = 0) -> float:
    """A duration in ms."""
    return days * DAY + hours * HOUR + minutes * MINUTE + seconds * SECOND + milliseconds


def scale_of(scale: str | float) -> float:
    return SCALES[scale] if isinstance(scale, str) else float(scale)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ms_round(value: Column | str, scale: str | float = "milliseconds", decimals: int = 0) -> Column:
    """Half to even, as a multiple of the scale."""
    s = scale_of(scale)
    x = _col(value) / F.lit(s)
    return (F.rint(x) if decimals == 0 else F.bround(x, decimals)) * F.lit(s)


def ms_floor(value: Column | str, scale: str | float = "milliseconds") -> Column:
    s = scale_of(scale)
    return F.floor(_col(value) / F.lit(s)).cast("double") * F.lit(s)


def ms_ceil(value: Column | str, scale: str | float = "milliseconds") -> Column:
    s = scale_of(scale)
    return F.ceil(_col(value) / F.lit(s)).cast("double") * F.lit(s)


def ms_remainder(value: Column | str, scale: str | float = "days") -> Column:
    """What is left over the last multiple of the scale; never negative."""
    return _col(value) - ms_floor(value, scale)


def ms_to_str(value: Column | str, plus_sign: bool = False, strip: bool = True, show_days: bool = False) -> Column:
    """[+|-][Dd ]HH:MM[:SS[.mmm]]; hours go past 24 unless days are shown."""
    v = _col(value)
    size = F.abs(v)
    whole = F.floor(size / SECOND)
    part = F.floor(size - whole * SECOND).cast("int")
    days = F.floor(size / DAY) if show_days else F.lit(0)
    hours = F.floor(size / HOUR) - days * 24
    minutes, seconds = F.pmod(F.floor(size / MINUTE), F.lit(60)), F.pmod(whole, F.lit(60))
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit("+" if plus_sign else ""))
    head = F.format_string("%02d:%02d", hours.cast("long"), minutes.cast("long"))
    secs = F.format_string(":%02d", seconds.cast("long"))
    if strip:
        secs = F.when((seconds == 0) & (part == 0), F.lit("")).otherwise(secs)
    frac = F.when(part > 0, F.format_string(".%03d", part)).otherwise(F.lit(""))
    day = F.when(days > 0, F.format_string("%dd ", days.cast("long"))).otherwise(F.lit("")) if show_days else F.lit("")
    return F.when(v.isNotNull(), F.concat(sign, day, head, secs, frac))


TIME_TEXT = r"^\s*(?:(\d+)d)?\s*(?:(\d{1,2}):(\d{2})(?::(\d{2})(?:\.(\d{1,3}))?)?)?"


def str_to_ms(text: Column | str) -> Column:
    """The reading of [Dd ]HH:MM[:SS[.mmm]]. Text without any of it is null; it never becomes a time."""
    t = _col(text)
    part = lambda k: F.regexp_extract(t, TIME_TEXT, k)
    number = lambda c: F.when(c == "", F.lit(0.0)).otherwise(c.try_cast("double"))
    total = number(part(1)) * DAY + number(part(2)) * HOUR + number(part(3)) * MINUTE + number(part(4)) * SECOND + number(F.when(part(5) == "", F.lit("")).otherwise(F.rpad(part(5), 3, "0")))
    return F.when(F.trim(part(0)) != "", total)


def epoch_ms(ts: Column | str, epoch: str = "2024-01-01 00:00:00") -> Column:
    """Zone-free milliseconds since an epoch of a timestamp without zone."""
    name = ts if isinstance(ts, str) else None
    if name is None:
        raise TypeError("give the column's name")
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'{epoch}', {name}) / 1000.0D")


def since_day_time(ts: str, hour: float = 0) -> Column:
    """ms from HH:00 of a timestamp's own day; negative before it."""
    return F.expr(f"timestampdiff(MICROSECOND, cast(cast({ts} as date) as timestamp_ntz), {ts}) / 1000.0D") - F.lit(hour * HOUR)


def solar_offset(ts: str) -> Column:
    return since_day_time(ts, 0)


def circ_offset(ts: str) -> Column:
    """Circadian time starts at 07:00."""
    return since_day_time(ts, 7)


def to_clock(time: Column | str, offset: Column | str) -> Column:
    """A recording's time on a clock whose zero lies `offset` before the recording's."""
    return _col(time) + _col(offset)


def from_clock(time: Column | str, offset: Column | str) -> Column:
    return _col(time) - _col(offset)


@dataclass(frozen=True)
class SamplingRate:
    """A rate in Hz, above zero."""

    hz: float

    def __post_init__(self):
        if not self.hz > 0:
            raise ValueError("a sampling rate is above zero")

    @classmethod
    def from_period(cls, period_ms: float) -> SamplingRate:
        return cls(1000.0 / period_ms)

    @property
    def period(self) -> float:
        return 1000.0 / self.hz

    def stride(self, load_hz: float) -> int:
        return round(self.hz / load_hz)

    def match_load_hz(self, load_hz: float | None, thresh: float | None = None) -> float:
        """The nearest rate that a whole stride gives; with `thresh`, an error if that is further away."""
        if load_hz is None:
            return self.hz
        found = self.hz / max(1, self.stride(load_hz))
        if thresh is not None and abs(found - load_hz) > thresh:
            raise ValueError(f"{load_hz} Hz can't be had from {self.hz} Hz")
        return found

    def divides(self, hz: float) -> bool:
        ratio = self.hz / hz
        return abs(ratio - round(ratio)) <= 1e-8 + 1e-5 * abs(round(ratio))

    def ms_to_idcs(self, time: Column | str) -> Column:
        return F.rint(F.lit(self.hz) * _col(time) / 1000.0).cast("long")

    def idcs_to_ms(self, idx: Column | str) -> Column:
        return _col(idx) / F.lit(self.hz) * 1000.0

    def adjusted(self) -> SamplingRate:
        """The rate whose period has nine decimals."""
        return SamplingRate.from_period(round(self.period, 9))

    def whole_periods(self, length: Column | str) -> Column:
        return F.rint(_col(length) / F.lit(self.period)) * F.lit(self.period)
