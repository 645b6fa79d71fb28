"""A single interval as a value on the driver, in ms: the parameter of crops and loads."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from datetime import timedelta

from .timeunits import DAY, HOUR, MINUTE, SCALES, SECOND


@dataclass(frozen=True, order=True)
class Win:
    start: float
    stop: float

    @classmethod
    def around(cls, ref: float, pre: float = 0, post: float = 0) -> Win:
        return cls(ref + pre, ref + post)

    @classmethod
    def centred_on(cls, ref: float, duration: float) -> Win:
        return cls(ref - duration / 2, ref + duration / 2)

    @property
    def length(self) -> float:
        return self.stop - self.start

    @property
    def mid(self) -> float:
        return (self.start + self.stop) / 2

    @property
    def is_empty(self) -> bool:
        return self.stop <= self.start

    def before(self, duration: float, offset: float = 0) -> Win:
        return Win(self.start - offset - duration, self.start - offset)

    def after(self, duration: float, offset: float = 0) -> Win:
        return Win(self.stop + offset, self.stop + offset + duration)

    def quantile_time(self, q: float) -> float:
        return self.start + q * self.length

    def relative_time(self, t: float) -> float:
        return (t - self.start) / self.length

    def contains(self, t: float) -> bool:
        """Edges included."""
        return self.start <= t <= self.stop

    def contained_in(self, other: Win, fully: bool = True) -> bool:
        return other.start <= self.start and self.stop <= other.stop if fully else self.overlaps(other)

    def overlaps(self, other: Win) -> bool:
        """Touching edges don't overlap."""
        return self.stop > other.start and other.stop > self.start

    def change(self, pre: float = 0, post: float = 0) -> Win:
        return Win(self.start + pre, self.stop + post)

    def shift(self, by: float) -> Win:
        return self.change(by, by)

    def shift_to_fit(self, other: Win) -> Win:
        """Moved into another one, which must be as long."""
        if other.length < self.length:
            raise ValueError("it doesn't fit")
        return self.shift(max(0.0, other.start - self.start) - max(0.0, self.stop - other.stop))

    def clip(self, other: Win) -> Win:
        into = lambda t: min(max(t, other.start), other.stop)
        return Win(into(self.start), into(self.stop))

    def subtract(self, other: Win) -> tuple[Win, Win]:
        """What lies before and after another one; either may be empty."""
        return Win(self.start, min(self.stop, other.start)), Win(max(self.start, other.stop), self.stop)

    def grid(self, step: float) -> list[float]:
        """From start, a step apart, the stop included."""
        return [self.start + i * step for i in range(math.floor(self.length / step + 0.5) + 1)]

    def split(self, length: float) -> list[Win]:
        edges = self.grid(length)
        return [Win(a, b) for a, b in zip(edges, edges[1:], strict=False)]

    def take_centred(self, most: float) -> Win:
        return Win.centred_on(self.mid, min(most, self.length))

    def rounded(self, scale: float, how: str = "round") -> Win:
        """round, floor, ceil, floor_ceil (outwards) or ceil_floor (inwards)."""
        f = {"round": round, "floor": math.floor, "ceil": math.ceil}
        a, b = how.split("_") if "_" in how else (how, how)
        return Win(f[a](self.start / scale) * scale, f[b](self.stop / scale) * scale)

    def samples(self, stored_hz: float, load_hz: float | None = None) -> slice:
        """The sample numbers inside, and the stride that a lower rate takes."""
        stride = 1 if load_hz is None else round(stored_hz / load_hz)
        return slice(round(self.start * stored_hz / 1000), round(self.stop * stored_hz / 1000), stride)

    # --- text and other units ---

    @classmethod
    def from_str(cls, text: str) -> Win:
        """`a - b`, with times as [Dd ]HH:MM[:SS[.mmm]]."""
        parts = re.split(r"\s+-\s+", text.strip())
        if len(parts) != 2:
            raise ValueError(f"not a window: {text}")
        return cls(*(text_to_ms(p) for p in parts))

    def to_str(self, plus_sign: bool = False, show_days: bool = True) -> str:
        return f"{ms_to_text(self.start, plus_sign, show_days)} - {ms_to_text(self.stop, plus_sign, show_days)}"

    def assert_positive(self) -> Win:
        if self.length < 0:
            raise ValueError(f"a window ends before it begins: {self}")
        return self

    def in_units(self, scale: str = "seconds") -> Win:
        return Win(self.start / SCALES[scale], self.stop / SCALES[scale])

    def timedeltas(self) -> tuple[timedelta, timedelta]:
        return timedelta(milliseconds=self.start), timedelta(milliseconds=self.stop)

    def centered(self, duration: float, q: float = 0.5) -> Win:
        return Win.centred_on(self.quantile_time(q), duration)

    def shrink(self, duration: float) -> Win:
        return self.change(duration, -duration)

    def expand(self, duration: float) -> Win:
        return self.change(-duration, duration)


def text_to_ms(text: str) -> float:
    """The reading of [+|-][Dd ]HH:MM[:SS[.mmm]]."""
    m = re.fullmatch(r"([+-])?(?:(\d+)d)?\s*(?:(\d+):(\d{2})(?::(\d{2})(?:\.(\d{1,3}))?)?)?", text.strip())
    if not m or not any(m.groups()[1:]):
        raise ValueError(f"not a time: {text}")
    sign, days, hours, minutes, seconds, part = m.groups()
    total = float(days or 0) * DAY + float(hours or 0) * HOUR + float(minutes or 0) * MINUTE + float(seconds or 0) * SECOND + float((part or "0").ljust(3, "0"))
    return -total if sign == "-" else total


def ms_to_text(value: float, plus_sign: bool = False, show_days: bool = True) -> str:
    size = math.floor(abs(value))
    days, rest = divmod(size, int(DAY)) if show_days else (0, size)
    hours, rest = divmod(rest, int(HOUR))
    minutes, rest = divmod(rest, int(MINUTE))
    seconds, part = divmod(rest, int(SECOND))
    sign = "-" if value < 0 else "+" if plus_sign else ""
    return f"{sign}{f'{days}d ' if days else ''}{hours:02d}:{minutes:02d}:{seconds:02d}" + (f".{part:03d}" if part else "")
