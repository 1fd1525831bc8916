"""Versioned zone transition tables.

A zone is two sorted arrays: the UTC second at which an offset begins, and the
offset in seconds. They are made once on the driver, from the compiled zone
files of one release, and shipped as a whole, so that every executor converts
by the same release whatever its own machine has installed.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field
from datetime import datetime, timezone
from importlib import resources
from pathlib import Path
from zoneinfo import TZPATH, ZoneInfo, available_timezones

import numpy as np

#: Rules without an end are written out up to this year. They go by the calendar
#: alone, so a later year is read as one before it of the same calendar.
LAST_YEAR = 2100
_LAST = int(datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
_FIRST = -(2**62)


@dataclass
class ZoneTables:
    """``zones``: name to (starts, offsets), both int64."""

    version: str
    zones: dict[str, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    def utc_of_wall(self, zone: str, wall: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTC seconds of wall-clock seconds, and how many instants show that
        wall clock: 0 in a gap, 2 in an overlap, 1 otherwise."""
        starts, offsets = self.zones[zone]
        if (late := wall >= _LAST).any():
            shift = np.zeros_like(wall)
            shift[late] = _to_known_years(wall[late])
            utc, hits = self.utc_of_wall(zone, wall - shift)
            return utc + shift, hits
        ends = np.append(starts[1:], 2**62)
        first = np.searchsorted(starts, wall - 100_000, "right") - 1
        last = np.searchsorted(starts, wall + 100_000, "right") - 1
        utc, hits = np.zeros_like(wall), np.zeros(len(wall), "int8")
        for step in range(int((last - first).max(initial=0)) + 1):
            at = np.minimum(first + step, last)
            instant = wall - offsets[at]
            fits = (first + step <= last) & (instant >= starts[at]) & (instant < ends[at])
            utc = np.where(fits, instant, utc)
            hits += fits
        return utc, hits


def _to_known_years(wall: np.ndarray) -> np.ndarray:
    """Seconds by which each wall clock is later than the same time of the same
    day in a year before ``LAST_YEAR`` whose calendar is alike, of which any 28
    years have all."""
    years = (wall // 86400).astype("datetime64[D]").astype("datetime64[Y]").astype("int64") + 1970
    first = lambda y: int(np.datetime64(f"{y:04d}-01-01", "D").astype("int64"))
    shape = lambda y: ((first(y) + 4) % 7, first(y + 1) - first(y))
    known = {shape(y): y for y in range(LAST_YEAR - 28, LAST_YEAR)}
    by_year = {y: 86400 * (first(y) - first(known[shape(y)])) for y in np.unique(years).tolist()}
    return np.array([by_year[y] for y in years.tolist()], "int64")


def _file(name: str) -> bytes | None:
    for root in TZPATH:
        if (path := Path(root, name)).is_file():
            return path.read_bytes()
    try:
        return resources.files("tzdata.zoneinfo").joinpath(*name.split("/")).read_bytes()
    except (ModuleNotFoundError, OSError):
        return None


def release() -> str:
    """Release of the zone files that ``load`` reads."""
    for root in TZPATH:
        if (path := Path(root, "tzdata.zi")).is_file():
            return path.open().readline().split()[-1]
    try:
        import tzdata

        return tzdata.IANA_VERSION
    except ModuleNotFoundError:
        return "unknown"


def _rule_times(rule: bytes, zone: ZoneInfo) -> tuple[np.ndarray, np.ndarray]:
    """The rule at the end of a zone file goes on for ever; its changes from
    2024 on are found by asking week by week and halving where they lie."""
    offset_at = lambda t: int(datetime.fromtimestamp(t, timezone.utc).astimezone(zone).utcoffset().total_seconds())
    low, end = (int(datetime(y, 1, 1, tzinfo=timezone.utc).timestamp()) for y in (2024, LAST_YEAR))
    starts, offsets, now = [], [], offset_at(low)
    while low < end:
        high = low + 7 * 86400
        if (then := offset_at(high)) != now:
            a, b = low, high
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (mid, b) if offset_at(mid) == now else (a, mid)
            starts.append(b)
            offsets.append(then)
            now = then
        low = high
    return np.array(starts, "int64"), np.array(offsets, "int64")


def _by_rule(rule: bytes, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Zones of one rule, of which there are few, share its times."""
    if rule not in _RULES:
        _RULES[rule] = _rule_times(rule, ZoneInfo(name))
    return _RULES[rule]


_RULES: dict[bytes, tuple[np.ndarray, np.ndarray]] = {}


def _transitions(name: str) -> tuple[np.ndarray, np.ndarray] | None:
    raw = _file(name)
    if raw is None or raw[:4] != b"TZif":
        return None
    counts = struct.unpack(">6l", raw[20:44])
    at = 44
    if raw[4:5] >= b"2":  # the second block has 64-bit times
        isut, isstd, leap, times, types, chars = counts
        at += times * 5 + types * 6 + chars + leap * 8 + isstd + isut
        counts = struct.unpack(">6l", raw[at + 20 : at + 44])
        at, wide = at + 44, 8
    else:
        wide = 4
    _, _, _, times, types, _ = counts
    starts = np.frombuffer(raw, f">i{wide}", times, at).astype("int64")
    kinds = np.frombuffer(raw, "u1", times, at + times * wide)
    infos = [struct.unpack(">lbb", raw[i : i + 6]) for i in range(at + times * (wide + 1), at + times * (wide + 1) + types * 6, 6)]
    offsets = np.array([infos[0][0]] + [infos[k][0] for k in kinds], "int64")
    starts = np.append([_FIRST], starts)
    rule = raw.rstrip(b"\n").rpartition(b"\n")[2]
    if b"," in rule:
        more_starts, more_offsets = _by_rule(rule, name)
        keep = starts < more_starts[0]
        starts, offsets = np.append(starts[keep], more_starts), np.append(offsets[keep], more_offsets)
    return starts, offsets


def load(names: list[str] | None = None) -> ZoneTables:
    """Tables of the named zones; of all zones of the release by default.
    Their number, some 600, is bounded by the release. Unknown names are
    left out."""
    known = available_timezones()
    wanted = known if names is None else known & {n for n in names if n}
    return ZoneTables(release(), {n: t for n in sorted(wanted) if (t := _transitions(n)) is not None})
