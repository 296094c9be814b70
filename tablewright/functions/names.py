"""Result names and configuration ids."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Sequence
from itertools import chain, combinations

from pyspark.sql import Column
from pyspark.sql import functions as F


def n_way(items: Sequence, ways: Sequence[int]) -> Iterator[tuple]:
    """All combinations of the given sizes, in order."""
    return chain.from_iterable(combinations(items, n) for n in ways)


def part(name: Column, index: int) -> Column:
    """The index-th part of a name, from 0; null beyond its end."""
    return F.get(F.split(name, "/"), F.lit(index))


def short_id(value) -> str:
    """The first four hex digits of the SHA-224 of a value's JSON with sorted keys."""
    return hashlib.sha224(json.dumps(value, sort_keys=True).encode()).hexdigest()[:4]
