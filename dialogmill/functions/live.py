"""Small functions of the live session: sources, settings, glossary answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialogmill.functions import text as t


# fixed values: the answers and definitions of glossary terms, around the term and its definition
ANSWER = ("I would describe ", " as ", " I would then connect it to a concrete production example, explain the tradeoffs, and mention how I would validate the decision in practice.")
UNDEFINED = " is an important concept in software engineering interviews."
DEFINITION = " is a software engineering concept frequently discussed in technical interviews. It should be explained with practical usage, tradeoffs, and production impact."


def source_score(ident: Column, name: Column) -> Column:
    """How likely an audio source is a whole screen, by its id and name."""
    low = F.lower(name)
    hit = lambda test, n: F.when(test, n).otherwise(0)
    return hit(F.lower(ident).startswith("screen:"), 40) + hit(low.contains("entire screen"), 30) + hit(low.contains("screen"), 20) + hit(low.contains("display"), 12) - hit(low.contains("window"), 10)


def clamped_ms(c: Column, low: int, high: int) -> Column:
    """Rounded half up and held within the bounds."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(c + 0.5)))


def one_of(c: Column, values: list[str], default: str) -> Column:
    return F.when(c.isin(values), c).otherwise(default)


def glossary_answer(term: Column, definition: Column) -> Column:
    known = t.normalize(definition)
    known = F.when(known == "", F.concat(term, F.lit(UNDEFINED))).otherwise(known)
    return F.concat(F.lit(ANSWER[0]), term, F.lit(ANSWER[1]), known, F.lit(ANSWER[2]))


def definition(term: Column) -> Column:
    """A definition of a term that no seed defines."""
    return F.concat(term, F.lit(DEFINITION))
