"""Text and array column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The white space characters of Unicode and the four ASCII separators.
SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
          "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# The same as a pattern, for use with (?U).
SPACE = r"[\s\x1c-\x1f]"


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.btrim(text, F.lit(SPACES))


def last_n(items: Column, n: int) -> Column:
    """The last ``n`` elements of an array, all of them if there are fewer."""
    return F.slice(items, F.greatest(F.size(items) - F.lit(n - 1), F.lit(1)), n)


def lines(messages: Column, label) -> Column:
    """``label(sender): message`` lines of an array of messages."""
    return F.array_join(
        F.transform(messages, lambda m: F.concat(label(m["sender"]), F.lit(": "), m["message"])),
        "\n")


def blank_to(text: Column, default: str) -> Column:
    """Null or empty text becomes ``default``."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))
