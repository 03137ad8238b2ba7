"""Instants in microseconds since 1970 UTC from numbers of unknown unit and from text of many shapes.

Text is reduced to a shape mask (digit -> 9, letter -> A, the rest as it is). A mask is compiled to a
parser once per worker; the parser then converts all texts of that mask together, as a byte matrix.
Wall clocks go through transition tables built per zone from the installed, versioned zone database.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from datetime import datetime, timedelta, timezone
from functools import lru_cache
from importlib import resources
from zoneinfo import TZPATH, ZoneInfo

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

US = 1_000_000
#: Largest magnitude read as seconds, milliseconds, microseconds; beyond are nanoseconds.
UNIT_LIMITS = (100_000_000_000, 100_000_000_000_000, 100_000_000_000_000_000)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
UTC_NAMES = ("utc", "gmt", "ut", "z")
_ZONE_NAME = re.compile(r"[A-Za-z0-9_+-]+(/[A-Za-z0-9_+-]+)*")
#: Years covered by a zone's table, and by the longer one for wall clocks outside; the calendar repeats after 400 years, and
#: before the first year local mean time holds.
NEAR, FAR, CYCLE_S, TABLE_STEP_DAYS = (1970, 2060), (1850, 2460), 146_097 * 86_400, 3


# ---------------------------------------------------------------------------------------------
# numbers (stay in the JVM)


def integer_us(x: Column) -> Column:
    """Microseconds from a whole number of seconds, milliseconds, microseconds or nanoseconds; NULL unless > 0."""
    s, ms, us = UNIT_LIMITS
    return (
        F.when((x > 0) & (x < s), x * F.lit(US).cast("long"))
        .when((x > 0) & (x < ms), x * F.lit(1000).cast("long"))
        .when((x > 0) & (x < us), x)
        .when(x > 0, F.call_function("div", x, F.lit(1000).cast("long")))
        .cast("long")
    )


def integer_is_us(x: Column) -> Column:
    return (x >= UNIT_LIMITS[1]) & (x < UNIT_LIMITS[2])


def double_us(x: Column) -> Column:
    """Nearest microsecond of a DOUBLE in seconds (or, by magnitude, finer); NULL for null, NaN, infinite or <= 0.

    Whole and fractional part are scaled apart, so that the product loses no digit.
    """
    s, ms, us = (float(v) for v in UNIT_LIMITS)
    known = x.isNotNull() & ~F.isnan(x) & (x > 0) & (x < 9.0e18)

    def scaled(factor: int) -> Column:
        whole = F.floor(x)
        return whole * F.lit(factor).cast("long") + F.floor((x - whole) * F.lit(float(factor)) + F.lit(0.5))

    return F.when(
        known,
        F.when(x < s, scaled(US)).when(x < ms, scaled(1000)).when(x < us, F.floor(x + 0.5)).otherwise(F.floor(x / 1000.0 + 0.5)),
    ).cast("long")


# ---------------------------------------------------------------------------------------------
# zones


def zone_version() -> str:
    """Version of the zone database the tables are built from: that of the package `tzdata`, else of the system."""
    try:
        import tzdata

        return str(tzdata.IANA_VERSION)
    except ImportError:
        for root in TZPATH:
            try:
                with open(f"{root}/tzdata.zi") as f:
                    return f.readline().rpartition(" ")[2].strip()
            except OSError:
                continue
        return "unknown"


def _zone(name: str) -> ZoneInfo:
    """The zone from the same database as `zone_version`; what Python itself prefers may be another."""
    if not _ZONE_NAME.fullmatch(name):
        raise ValueError(name)
    try:
        import tzdata  # noqa: F401
    except ImportError:
        return ZoneInfo(name)
    with resources.files("tzdata").joinpath("zoneinfo", *name.split("/")).open("rb") as f:
        return ZoneInfo.from_file(f, key=name)


class ZoneTable:
    """Transitions of one zone: offset[i] and abbr[i] hold from instant at[i-1] (seconds) to at[i]."""

    def __init__(self, at: list[int], offsets: list[int], abbrs: list[str]):
        self.offset = np.array(offsets, dtype=np.int64)
        self.abbr = abbrs
        at_ = np.array(at, dtype=np.int64)
        before, after = self.offset[:-1], self.offset[1:]
        self.at = at_
        self.late = at_ + after  # wall clock from which the later reading uses the new offset
        self.early = at_ + np.maximum(before, after)  # the same for the earlier reading

    @staticmethod
    def of(name: str, wall: np.ndarray) -> ZoneTable | None:
        """The table of a zone that reaches these wall clocks."""
        low, high = ((y - 1970) * 31_556_952 for y in (NEAR[0], NEAR[1] - 1))
        return zone_table(name, len(wall) > 0 and (wall.min() < low + 172_800 or wall.max() > high))

    def instants(self, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Later and earlier instant (seconds) of wall clocks; a skipped one takes the offset before the change."""
        given = wall
        wall = _within(wall)
        later = wall - self.offset[np.searchsorted(self.late, wall, side="right")]
        earlier = wall - self.offset[np.searchsorted(self.early, wall, side="right")]
        return later + (given - wall), earlier + (given - wall)

    def by_abbreviation(self, name: str, wall: np.ndarray) -> np.ndarray | None:
        """Instants of wall clocks marked with an abbreviation of this zone: the offset it last meant by then."""
        periods = [i for i, a in enumerate(self.abbr) if a.lower() == name]
        if not periods:
            return None
        starts = np.array([self.late[i - 1] if i else np.iinfo(np.int64).min for i in periods], dtype=np.int64)
        at = np.maximum(np.searchsorted(starts, _within(wall) + 86_400, side="right") - 1, 0)
        return wall - self.offset[np.array(periods)[at]]


def _within(wall: np.ndarray) -> np.ndarray:
    """Wall clocks beyond the longer table, moved back by whole cycles of the calendar."""
    end = (FAR[1] - 1 - 1970) * 31_556_952
    return wall - np.maximum(0, -((end - wall) // CYCLE_S)) * CYCLE_S


@lru_cache(maxsize=700)
def zone_table(name: str, far: bool = False) -> ZoneTable | None:
    try:
        zone = _zone(name)
    except Exception:  # unknown or malformed key
        return None

    def state(t: int) -> tuple[int, str]:
        d = datetime.fromtimestamp(t, timezone.utc).astimezone(zone)
        return int((d.utcoffset() or timedelta()).total_seconds()), d.tzname() or ""

    first, last = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (FAR if far else NEAR))
    t, now = first, state(first)
    at, offsets, abbrs = [], [now[0]], [now[1]]
    while t < last:
        nxt = t + TABLE_STEP_DAYS * 86_400
        while (there := state(nxt)) != now:
            low, high = t, nxt
            while high - low > 1:
                mid = (low + high) // 2
                low, high = (mid, high) if state(mid) == now else (low, mid)
            now = state(high)
            at.append(high), offsets.append(now[0]), abbrs.append(now[1])
            t = high
            if there == now:
                break
        t = nxt
    return ZoneTable(at, offsets, abbrs)


# ---------------------------------------------------------------------------------------------
# shape masks

_TAIL = r"(?P<tail> ?(?:A|[+-]99(?::?99)?|AAA[+-]99:?99(?: \(.*\))?|A{2,5}|A[A0-9/_+\-9]*/[A/_+\-9]*))?"
_CLOCK = r"(?P<H>99):(?P<M>99)(?::(?P<S>99)(?:[.,](?P<f>9+))?)?"
_SHAPES = [
    re.compile(r"(?P<y>9999)-(?P<m>99)-(?P<d>99)(?P<sep>A| )" + _CLOCK + _TAIL),
    re.compile(r"(?P<y>9999)(?P<m>99)(?P<d>99)(?P<sep>A)(?P<H>99)(?P<M>99)(?P<S>99)(?:[.,](?P<f>9+))?" + _TAIL),
    re.compile(r"(?P<a>99)/(?P<b>99)/(?P<y>9999) " + _CLOCK + r"(?: (?P<ap>AA))?"),
    re.compile(r"(?P<d>99)\.(?P<m>99)\.(?P<y>9999) " + _CLOCK + _TAIL),
    re.compile(r"(?:AAA, )?(?P<d>99?) (?P<mon>AAA) (?P<y>9999) " + _CLOCK + _TAIL),
    re.compile(r"AAA (?P<mon>AAA) (?P<d>99?) (?P<y>9999) " + _CLOCK + _TAIL),
]
_NUMBER = re.compile(r"(?P<n>9{1,19})(?:\.(?P<f>9+))?")
_OFFSET = re.compile(rb" ?(?:[A-Za-z]{3})?([+-])(\d\d):?(\d\d)?(?: \(.*\))?")


def _int(block: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    out = np.zeros(len(block), dtype=np.int64)
    for i in range(*span):
        out = out * 10 + (block[:, i].astype(np.int64) - 48)
    return out


def _fraction_us(block: np.ndarray, span: tuple[int, int]) -> np.ndarray:
    """Microseconds of a decimal fraction; further digits are cut."""
    a, b = span
    out = np.zeros(len(block), dtype=np.int64) if a < 0 else _int(block, (a, min(b, a + 6)))
    return out * 10 ** (6 - max(0, min(b, a + 6) - a)) if a >= 0 else out


def _words(block: np.ndarray, span: tuple[int, int]) -> tuple[list[bytes], np.ndarray]:
    """Distinct values of a column of bytes and each row's index among them."""
    part = np.ascontiguousarray(block[:, span[0] : span[1]])
    values, index = np.unique(part.view(f"S{span[1] - span[0]}").ravel(), return_inverse=True)
    return [bytes(v) for v in values], index.ravel()


def _days(y: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Days since 1970-01-01 in the proleptic Gregorian calendar."""
    first = (y - 1970).astype("datetime64[Y]").astype("datetime64[M]") + (np.clip(m, 1, 12) - 1)
    return first.astype("datetime64[D]").astype(np.int64) + d - 1


def _month_length(y: np.ndarray, m: np.ndarray) -> np.ndarray:
    lengths = np.array([31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31])[np.clip(m, 1, 12) - 1]
    return lengths + ((m == 2) & (y % 4 == 0) & ((y % 100 != 0) | (y % 400 == 0)))


Parser = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _numbers(span: dict[str, tuple[int, int]]) -> Parser:
    def parse(block, zones, day_first, own):
        n = _int(block, span["n"])
        s, ms, us = UNIT_LIMITS
        out = np.where(n < s, n * US, np.where(n < ms, n * 1000, np.where(n < us, n, n // 1000)))
        if span["f"][0] >= 0:
            part = _fraction_us(block, span["f"])
            out = out + np.where(n < s, part, np.where(n < ms, part // 1000, 0))
        return out, n > 0

    return parse


def _calendar(span: dict[str, tuple[int, int]]) -> Parser:
    def has(k: str) -> bool:
        return span.get(k, (-1, -1))[0] >= 0

    def parse(block, zones, day_first, own):
        y, H, M = (_int(block, span[k]) for k in ("y", "H", "M"))
        S = _int(block, span["S"]) if has("S") else np.zeros(len(block), dtype=np.int64)
        ok = np.ones(len(block), dtype=bool)
        if has("sep") and span["sep"][1] > span["sep"][0]:
            ok &= np.isin(block[:, span["sep"][0]], list(b"Tt "))
        if has("a"):
            a, b = _int(block, span["a"]), _int(block, span["b"])
            # the client's order; where none is known, the one the numbers allow, else month first
            first = np.where(day_first >= 0, day_first > 0, a > 12)
            d, m = np.where(first, a, b), np.where(first, b, a)
        else:
            d = _int(block, span["d"])
            if has("mon"):
                names, index = _words(block, span["mon"])
                known = [MONTHS.index(n) + 1 if (n := v.decode("latin1").lower()) in MONTHS else 0 for v in names]
                m = np.array(known, dtype=np.int64)[index]
            else:
                m = _int(block, span["m"])
        if has("ap"):
            half = block[:, span["ap"][0]] | 32
            ok &= np.isin(half, list(b"ap")) & ((block[:, span["ap"][0] + 1] | 32) == ord("m")) & (H >= 1) & (H <= 12)
            H = H % 12 + 12 * (half == ord("p"))
        ok &= (y >= 1) & (m >= 1) & (m <= 12) & (d >= 1) & (d <= _month_length(y, m)) & (H < 24) & (M < 60) & (S < 60)
        wall = _days(y, m, d) * 86_400 + H * 3600 + M * 60 + S
        part = _fraction_us(block, span["f"]) if has("f") else np.zeros(len(block), dtype=np.int64)
        tails, tail = _words(block, span["tail"]) if has("tail") else ([b""], np.zeros(len(block), dtype=np.int64))
        zone_names, zone = np.unique(zones, return_inverse=True)
        out = np.zeros(len(block), dtype=np.int64)
        for i, text in enumerate(tails):
            for j, client in enumerate(zone_names):
                at = np.flatnonzero((tail == i) & (zone == j))
                if len(at):
                    later, earlier = _resolve(text, str(client), wall[at])
                    if later is None:
                        ok[at] = False
                        continue
                    later, earlier = later * US + part[at], earlier * US + part[at]
                    out[at] = np.where((own[at] > 0) & (later > own[at]), earlier, later)
        return out, ok

    return parse


def _resolve(tail: bytes, client: str, wall: np.ndarray) -> tuple[np.ndarray | None, np.ndarray | None]:
    """Later and earlier instants of wall clocks, by the text behind them, else by the client's zone, else UTC."""
    if m := _OFFSET.fullmatch(tail):
        h, mi = int(m[2]), int(m[3] or 0)
        if h > 18 or mi > 59:
            return None, None
        at = wall - (1 if m[1] == b"+" else -1) * (h * 3600 + mi * 60)
        return at, at
    name = tail.decode("latin1").strip()
    if not name:
        table = ZoneTable.of(client or "UTC", wall) or ZoneTable.of("UTC", wall)
        return table.instants(wall)
    if "/" in name:
        table = ZoneTable.of(name, wall)
        return table.instants(wall) if table else (None, None)
    table = ZoneTable.of(client, wall) if client else None
    at = table.by_abbreviation(name.lower(), wall) if table and len(name) > 1 else None
    if at is None and name.lower() in UTC_NAMES:
        at = wall
    return at, at


@lru_cache(maxsize=4096)
def parser_of(mask: str) -> Parser | None:
    """The parser of a shape mask, or None for shapes that name no instant."""
    if m := _NUMBER.fullmatch(mask):
        return _numbers({"n": m.span("n"), "f": m.span("f")})
    for shape in _SHAPES:
        if m := shape.fullmatch(mask):
            return _calendar({k: m.span(k) for k in m.re.groupindex})
    return None


def parse_batch(text: pa.Array, zone: pa.Array, day_first: pa.Array, own_us: pa.Array) -> pa.Array:
    """Arrow kernel: texts (with each row's client zone, date order and own stamp) to microseconds or NULL."""
    n = len(text)
    out, ok = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    text = pc.utf8_trim_whitespace(text.cast(pa.large_string()))
    # the name of the zone behind an offset says nothing more, in whatever language and length
    text = pc.replace_substring_regex(text, r"(?s)([A-Za-z]{3}[+-][0-9]{2}:?[0-9]{2}) \(.*\)$", r"\1")
    mask = pc.replace_substring_regex(pc.replace_substring_regex(text, r"[A-Za-z]", "A"), r"[0-9]", "9").dictionary_encode()
    codes = mask.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    zones = zone.fill_null("").to_numpy(zero_copy_only=False).astype(str)
    order = day_first.cast(pa.int8()).fill_null(-1).to_numpy(zero_copy_only=False)
    own = own_us.fill_null(0).to_numpy(zero_copy_only=False)
    by = np.argsort(codes, kind="stable")
    edges = np.searchsorted(codes[by], np.arange(len(mask.dictionary) + 1))
    for code, shape in enumerate(mask.dictionary.to_pylist()):
        parser = parser_of(shape) if len(shape) < 200 else parser_of.__wrapped__(shape)
        if parser is None or not shape:
            continue
        at = by[edges[code] : edges[code + 1]]
        joined = "".join(text.take(pa.array(at)).to_pylist()).encode("latin1")
        block = np.frombuffer(joined, dtype=np.uint8).reshape(len(at), len(shape))
        out[at], ok[at] = parser(block, zones[at], order[at], own[at])
    return pa.array(out, mask=~ok, type=pa.int64())


def text_us(text: Column, zone: Column, day_first: Column, own_us: Column) -> Column:
    """Column form of `parse_batch`; one Arrow batch at a time, never row by row."""
    version = zone_version()

    @F.arrow_udf("long")
    def convert(t: pa.Array, z: pa.Array, d: pa.Array, o: pa.Array) -> pa.Array:
        if zone_version() != version:
            raise RuntimeError(f"zone tables {zone_version()} on this worker, {version} on the driver")
        return parse_batch(t, z, d, o)

    return convert(text, zone.cast("string"), day_first.cast("boolean"), own_us.cast("long"))
