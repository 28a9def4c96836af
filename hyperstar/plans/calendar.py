"""Relative time. Words become paths of numbers on the driver, so plans hold literals that prune partitions and row groups."""

from __future__ import annotations

import calendar as _days
import re
from datetime import datetime, timedelta
from zoneinfo import ZoneInfo

from ..errors import ArgumentError
from ..model import Hierarchy

#: Weekdays, and units from fine to coarse.
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "year")
PATH_UNITS = ("year", "quarter", "month", "day", "hour", "minute", "weekday")

_FINE = re.compile(r"(\d*)([a-z]+?)s?(ago|forward)\Z")
_WHOLE = re.compile(r"(last|next)(\d*)([a-z]+?)s?\Z")


def hierarchy_units(hierarchy: Hierarchy) -> list[str]:
    """The calendar units of a hierarchy's levels, by their roles."""
    units = []
    for level in hierarchy.levels:
        role = level.role or (level.name if level.name in PATH_UNITS else None)
        if role is None:
            raise ArgumentError(f"level '{level.name}' of hierarchy '{hierarchy.name}' has no calendar role")
        if role not in PATH_UNITS:
            raise ArgumentError(f"unknown calendar role '{role}' of level '{level.name}'")
        units.append(role)
    return units


def add_units(time: datetime, unit: str, n: int) -> datetime:
    """``n`` units later; days beyond a month's end become its last day."""
    if unit in ("second", "minute", "hour", "day", "week"):
        return time + timedelta(**{f"{unit}s": n})
    months = {"month": 1, "quarter": 3, "year": 12}.get(unit)
    if months is None:
        raise ArgumentError(f"unknown unit of time '{unit}'")
    year, month = divmod(time.year * 12 + time.month - 1 + months * n, 12)
    return time.replace(year=year, month=month + 1, day=min(time.day, _days.monthrange(year, month + 1)[1]))


class Calendar:
    def __init__(self, first_weekday: int | str = 0, timezone: str | None = None, now: datetime | None = None):
        """``now`` fixes the present, for tests and reports of the past."""
        if isinstance(first_weekday, str):
            if first_weekday.lower() not in WEEKDAYS:
                raise ArgumentError(f"unknown weekday '{first_weekday}'")
            first_weekday = WEEKDAYS.index(first_weekday.lower())
        if not 0 <= int(first_weekday) <= 6:
            raise ArgumentError("weekdays go from 0 to 6")
        self.first_weekday, self.zone, self._now = int(first_weekday), ZoneInfo(timezone) if timezone else None, now

    def now(self) -> datetime:
        return self._now or datetime.now(self.zone).replace(tzinfo=None)

    def path(self, time: datetime, units: list[str] | Hierarchy) -> list[int]:
        found = []
        for unit in hierarchy_units(units) if isinstance(units, Hierarchy) else units or []:
            if unit == "quarter":
                found.append((time.month - 1) // 3 + 1)
            elif unit == "weekday":
                found.append((time.weekday() - self.first_weekday) % 7)
            elif unit in PATH_UNITS:
                found.append(getattr(time, unit))
            else:
                raise ArgumentError(f"unknown calendar unit '{unit}'")
        return found

    def now_path(self, units) -> list[int]:
        return self.path(self.now(), units)

    def truncate(self, time: datetime, unit: str) -> datetime:
        """The start of the unit that ``time`` is in."""
        if unit not in UNITS:
            raise ArgumentError(f"unknown unit of time '{unit}'")
        at = UNITS.index(unit)
        zero = {k: 0 for k, least in (("microsecond", 0), ("second", 1), ("minute", 2), ("hour", 3)) if at >= least}
        time = time.replace(**zero)
        if unit == "week":
            return time - timedelta(days=(time.weekday() - self.first_weekday) % 7)
        if unit == "month":
            return time.replace(day=1)
        if unit == "quarter":
            return time.replace(month=(time.month - 1) // 3 * 3 + 1, day=1)
        return time.replace(month=1, day=1) if unit == "year" else time

    def since_period_start(self, period: str, unit: str, time: datetime | None = None) -> int:
        """Whole units from the start of the period to ``time``."""
        time = time or self.now()
        seconds = {"day": 86400, "hour": 3600, "minute": 60, "second": 1}
        if unit not in seconds:
            raise ArgumentError(f"unknown unit of a period '{unit}'")
        return int((time - self.truncate(time, period)).total_seconds()) // seconds[unit]

    def named_relative_path(self, reference: str, units, date: datetime | None = None) -> list[int]:
        """The path of today, yesterday, tomorrow, [N]unit(s)ago, [N]unit(s)forward, last[N]unit(s) or next[N]unit(s); the last two go to the start of the unit first."""
        date = date or self.now()
        near = {"today": 0, "yesterday": -1, "tomorrow": 1}
        if reference in near:
            date += timedelta(days=near[reference])
        elif m := _FINE.match(reference):
            date = add_units(date, m[2], int(m[1] or 1) * (-1 if m[3] == "ago" else 1))
        elif m := _WHOLE.match(reference):
            date = add_units(self.truncate(date, m[3]), m[3], int(m[2] or 1) * (-1 if m[1] == "last" else 1))
        else:
            raise ArgumentError(f"unknown relative time '{reference}'")
        return self.path(date, units)

    def convert(self, dimension, hierarchy: Hierarchy, path: list) -> list:
        """A path of one word of relative time as numbers; any other path as it is."""
        if len(path) != 1 or not isinstance(path[0], str):
            return path
        try:
            return self.named_relative_path(path[0], hierarchy_units(hierarchy))
        except ArgumentError:
            return path
