"""Substring and wildcard search by trigrams: what a text must contain is looked up, what is found is verified.

A declaration has a posting for each distinct trigram of its lower-cased names, full name and work place. A query's literal runs
of three characters and more give trigrams that every match has, so ids that have all of them are the candidates, and
:func:`serving.filtered` decides among their rows: nothing is lost and nothing is added. Queries without such a run, with
an escape, or with characters whose lower case is not one character of its own, are answered by the plain scan.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .features import ID
from .serving import name

GRAM = 3
FIELDS = ("firstname", "middlename", "lastname", "work_place")


def grams(text: Column) -> Column:
    """The distinct trigrams of a lower-cased text; none of null or short ones."""
    low = F.lower(F.coalesce(text, F.lit("")))
    places = F.when(F.length(low) >= GRAM, F.sequence(F.lit(1), F.length(low) - GRAM + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(low, i, F.lit(GRAM))))


def postings(profile: DataFrame, only: list[str] | None = None) -> DataFrame:
    """(gram, declaration_id), each pair once. ``only``: no postings but of these."""
    every = F.array_distinct(F.flatten(F.array(*[grams(F.col(c)) for c in FIELDS], grams(name()))))
    every = F.filter(every, lambda g: g.isin(only)) if only is not None else every
    return profile.select(ID, F.explode(every).alias("gram")).select("gram", ID)


def needed(query: str, wildcard: bool = True) -> list[str]:
    """Trigrams that every match of the query has; none where the index can't tell."""
    if "\\" in query or any(len(c.lower()) != 1 or c in "Σσς" for c in query):
        return []
    runs = re.split("[%_]", query.lower()) if wildcard else [query.lower()]
    return sorted({run[i : i + GRAM] for run in runs for i in range(len(run) - GRAM + 1)})


def candidates(found: DataFrame, n: int) -> DataFrame:
    """Postings of ``n`` trigrams -> the ids that have all of them."""
    return found.groupBy(ID).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == n).select(ID)
