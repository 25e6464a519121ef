"""Text expressions. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed pattern: the path segment of a post's URL that names its author.
URL_HANDLE = r"twitter\.com/([^/]+)/status"
#: Fixed pattern: a term.
TERM = "[a-zàâçéèêëîïôûùüÿñæœ]{3,}"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def handle(c: Column | str) -> Column:
    """A handle without the white space around it and leading ``@``, lower-cased. NULL stays NULL; nothing left gives NULL."""
    bare = F.regexp_replace(_col(c), r"^[\s\p{Z}]*@*|[\s\p{Z}]+$", "")
    return F.nullif(F.lower(bare), F.lit(""))


def url_handle(c: Column | str, pattern: str = URL_HANDLE) -> Column:
    """The raw handle in a URL; NULL for NULL and for URLs of other shapes."""
    return F.nullif(F.regexp_extract(_col(c), pattern, 1), F.lit(""))


def text_key(c: Column | str) -> Column:
    """128 bits that stand for a text where rows of equal texts are matched."""
    return F.unhex(F.md5(_col(c)))


def letters_digits(c: Column | str) -> Column:
    """The value without all but Unicode letters and numbers, lower-cased. NULL stays NULL."""
    return F.lower(F.regexp_replace(_col(c), r"[^\p{L}\p{N}]+", ""))
