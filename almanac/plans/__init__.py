"""Queries over the driver's tables; importing the others registers their sets."""

from almanac.plans import more as more
from almanac.plans import third as third
from almanac.plans import kept as kept
from almanac.plans import sourced as sourced
