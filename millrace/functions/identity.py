"""Canonical names of network hosts and of code repositories, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?U)^[\s\x{FEFF}\x{200B}]+|[\s\x{FEFF}\x{200B}]+$"


def strip(c: Column) -> Column:
    """Without white space of any kind at either end; null stays null."""
    return F.regexp_replace(c, _EDGE, "")


def _found(text: Column, pattern: str) -> Column:
    """First group of the pattern, null where it is empty; the array has the expression evaluated once."""
    return F.try_element_at(F.filter(F.array(F.regexp_extract(text, pattern, 1)), lambda x: x != ""), F.lit(1))


_SPACE = r"[\s\x{FEFF}\x{200B}]*"
_HOST = rf"(?sU)^{_SPACE}(?:(?:[a-z][a-z0-9+.\-]*:)?//)?(?:[^/?#\\]*@)?([^/?#\\@]*?)\.*(?::\d*)?\.*{_SPACE}(?:[/?#\\].*)?$"
# A site before owner and name: with a scheme, as user@site:, or as a first of three parts that holds a dot.
_SITE = r"(?:(?:git\+)?[a-z][a-z0-9+.\-]*://[^/]*/+|[^/@:]+@[^/:]+:/*|[^/]+\.[^/]+/(?=[^/]+/[^/]))?"
_REPO = rf"(?sU)^{_SPACE}/*{_SITE}/*([^/?#\s][^/?#]*?(?:/[^/?#]+?)?)(?:\.git)*(?:/[^?#]*)?(?:[?#].*)?{_SPACE}$"


def host_name(c: Column) -> Column:
    """Bare lower-case host: no scheme, user, port, path, query or final dot; blank gives null."""
    return _found(F.lower(c), _HOST)


def repo_name(c: Column) -> Column:
    """Lower-case ``owner/name``: no site, scheme, ``.git`` or further path; blank gives null."""
    return _found(F.lower(c), _REPO)
