"""Small building blocks shared by the column functions.

Text work stays inside one row: a text is split into an array, the array is sorted or
filtered with Spark's higher-order functions, and joined again. Nothing is exploded, so
cleaning and parsing add no shuffle however large the table is, and a very long text costs
n log n in its own row only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as white space.
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# Below 256 they are listed one by one, which the regex engine looks up in one table; beyond, one range
# turns most characters away.
SPACE = (
    r"[\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0"
    r"[\u1680-\u3000&&[\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]]]"
)

# The look-ahead turns ordinary ASCII letters away before the wide class is tried.
SPACE_RUN = rf"(?![!-~]){SPACE}++"
NON_BLANK_SPACE = SPACE.replace(r"\x20", "")
OTHER_SPACE = NON_BLANK_SPACE.replace(r"\n", "")
LINE_SPACE = SPACE.replace(r"\n", "")


def col_of(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it several times in ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE_CHARS))


def strip_value(c: Column) -> Column:
    """``strip`` for a column that is cheap to read: where both ends are printable ASCII characters
    nothing is searched for."""
    last = F.substring(c, -1, 1)
    clean = (c >= "!") & (c < "\x7f") & (last >= "!") & (last < "\x7f")
    return F.when(clean, c).otherwise(strip(c))


def words(c: Column) -> Column:
    """White-space separated tokens without empty ones.

    A text whose only white space is blanks and line feeds, as most have, is split at single blanks,
    which takes no regular expression.
    """
    blank = F.replace(c, F.lit("\n"), F.lit(" "))
    pieces = F.when(c.rlike(OTHER_SPACE), F.split(c, SPACE_RUN)).otherwise(F.split(blank, " "))
    return F.array_remove(pieces, "")


def lines(c: Column) -> Column:
    return F.split(strip_value(c), "\n")


def count_if(c: Column) -> Column:
    """Number of rows for which ``c`` holds, 0 for none."""
    return F.count_if(F.coalesce(c, F.lit(False)))


def any_contains(c: Column, needles: Iterable[str]) -> Column:
    found = F.lit(False)
    for n in needles:
        found = found | F.contains(c, F.lit(n))
    return found


def ratio(num: Column, den: Column, empty: float | None = 0.0) -> Column:
    """``num / den`` as double; ``empty`` where the denominator is 0 or null."""
    safe = num.cast("double") / F.nullif(den.cast("double"), F.lit(0.0))
    return safe if empty is None else F.coalesce(safe, F.lit(empty))


def is_in(c: Column, values: Iterable[str]) -> Column:
    vals = list(values)
    return c.isin(*vals) if vals else F.lit(False)
