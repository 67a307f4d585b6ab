"""Waits, costs and excerpts: bounded amounts computed from a row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def retry_delay(attempt: Column, retry_after: Column, most: int = 3) -> Column:
    """Seconds to wait before the next attempt, the longer of a doubling wait and the server's; null at the last attempt.

    ``retry_after`` is text in seconds; anything else, and a negative number, says nothing.
    """
    asked = F.when(retry_after.rlike(r"^\s*\d+(?:\.\d+)?\s*$"), F.trim(retry_after).cast("double"))
    wait = F.pow(F.lit(2.0), attempt)
    return F.when(attempt < most, F.when(asked > wait, asked).otherwise(wait))


def request_cost(characters: Column, input_price: float, output_price: float, most_output: int) -> Column:
    """Millionths of the price unit that a request may cost: a token for four characters in, all tokens allowed out."""
    return F.greatest(F.lit(1), F.floor(characters / 4)) * input_price + F.lit(most_output * output_price)


def excerpt_start(text: Column, identity: Column, most: int = 9_000, before: int = 1_500) -> Column:
    """Where, from 0, an excerpt of ``most`` characters starts that has the identity's first mention near its beginning."""
    at = F.when(F.length(identity) > 0, F.instr(F.lower(text), F.lower(identity)) - 1).otherwise(-1)
    start = F.greatest(at - before, F.lit(0))
    end = F.least(F.length(text), start + most)
    return F.when((F.length(text) <= most) | (at < 0), 0).otherwise(F.greatest(end - most, F.lit(0)))


def excerpt(text: Column, identity: Column, most: int = 9_000, before: int = 1_500) -> Column:
    """The excerpt itself, blanks collapsed; the whole text if it is no longer."""
    flat = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    return flat.substr(excerpt_start(flat, identity, most, before) + 1, F.lit(most))
