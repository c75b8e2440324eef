"""What a search text says about dates, time of day and price; one text a request, so this runs on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime

from almanac.functions import windows

_DAY = f"({'|'.join(windows.WEEKDAYS)})"
_TIME = f"({'|'.join(windows.TIMES_OF_DAY)})"


@dataclass(frozen=True)
class Understood:
    text: str
    window: windows.Window | None = None
    time_of_day: str | None = None
    free: bool = False


# the first rule that the text meets is the only one taken: a day with its time, a preset, a day, a time
_RULES = [
    (rf"{_DAY}\s+{_TIME}", lambda m, now: (windows.weekday(m[1], now, m[2] == "night"), m[2])),
    *[(name.replace("-", " "), lambda m, now, name=name: (windows.preset(name, now), None)) for name in ("this-weekend", "this-week", "tonight", "today", "tomorrow")],
    (_DAY, lambda m, now: (windows.weekday(m[1], now), None)),
    (_TIME, lambda m, now: (None, m[1])),
]


def _without(text: str, found: re.Match) -> str:
    return text[: found.start()] + text[found.end() :]


def parse_text(raw: str, now: datetime) -> Understood:
    """The text without what it says of price (the word free) and date, and what that is."""
    price = re.search(r"\bfree\b", raw, re.IGNORECASE)
    text = _without(raw, price) if price else raw
    window = time_of_day = None
    for pattern, read in _RULES:
        if found := re.search(rf"\b{pattern}\b", text, re.IGNORECASE):
            lowered = re.search(rf"\b{pattern}\b", text.lower())
            window, time_of_day = read(lowered or found, now)
            text = _without(text, found)
            break
    return Understood(" ".join(text.split()), window, time_of_day, bool(price))
