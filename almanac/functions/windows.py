"""Date windows of a search, in civil time: presets, named weekdays and custom ranges. All ends are instants in UTC."""

from __future__ import annotations

from datetime import date, datetime, time, timedelta, timezone
from zoneinfo import ZoneInfo

from almanac.functions.timefn import ZONE

Window = tuple[datetime, datetime]
FRIDAY, MONDAY = 4, 0
EVENING, SMALL_HOURS = 17, 3
PRESETS = ("tonight", "today", "tomorrow", "this-weekend", "this-week")
TIMES_OF_DAY = ("morning", "afternoon", "evening", "night")
WEEKDAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _at(day: date, hour: int, zone: str) -> datetime:
    return datetime.combine(day, time(hour), ZoneInfo(zone)).astimezone(timezone.utc)


def _window(now: datetime, first: date, hour: int, last: date, until: int, zone: str) -> Window:
    """From ``hour`` of ``first``, but not before now, to ``until`` of ``last``."""
    return max(now.astimezone(timezone.utc), _at(first, hour, zone)), _at(last, until, zone)


def preset(name: str, now: datetime, zone: str = ZONE) -> Window:
    """The window of one of PRESETS at the aware instant ``now``.

    Before three in the morning, tonight is what is left of the night before. From Friday to Sunday, this weekend is the
    one that has begun. This week ends with Sunday.
    """
    local = now.astimezone(ZoneInfo(zone))
    today = local.date()
    day = lambda k: today + timedelta(days=k)
    if name == "today":
        return _window(now, today, 0, day(1), 0, zone)
    if name == "tomorrow":
        return _window(now, day(1), 0, day(2), 0, zone)
    if name == "tonight":
        return _window(now, today, 0, today, SMALL_HOURS, zone) if local.hour < SMALL_HOURS else _window(now, today, EVENING, day(1), SMALL_HOURS, zone)
    if name == "this-weekend":
        to_friday = FRIDAY - today.weekday()
        return _window(now, day(to_friday), EVENING, day(to_friday + 3), 0, zone)
    if name == "this-week":
        return _window(now, today, 0, day(7 - today.weekday()), 0, zone)
    raise ValueError(f"no preset is named {name!r}")


def weekday(name: str, now: datetime, night: bool = False, zone: str = ZONE) -> Window:
    """The next such day, today included; at night from five in the afternoon to three."""
    today = now.astimezone(ZoneInfo(zone)).date()
    first = today + timedelta(days=(WEEKDAYS.index(name) - today.weekday()) % 7)
    return _window(now, first, EVENING if night else 0, first + timedelta(days=1), SMALL_HOURS if night else 0, zone)


def day_or_none(value: str | None) -> date | None:
    try:
        return date.fromisoformat(value or "")
    except ValueError:
        return None


def schedule(now: datetime, days: int, zone: str = ZONE) -> tuple[str, str]:
    """The local day of ``now`` and the one ``days`` later, as ISO text."""
    today = now.astimezone(ZoneInfo(zone)).date()
    return today.isoformat(), (today + timedelta(days=days)).isoformat()


def custom(first: str | None, last: str | None, zone: str = ZONE) -> Window | None:
    """Whole days from ``first`` to ``last`` (ISO); None if either is no day or they are in the wrong order."""
    a, b = day_or_none(first), day_or_none(last)
    return (_at(a, 0, zone), _at(b + timedelta(days=1), 0, zone)) if a and b and a <= b else None


def choose(phrase: Window | None, named: Window | None, custom_range: Window | None) -> Window | None:
    """A phrase in the text wins over a preset, and that over a range."""
    return phrase or named or custom_range
