"""Web pages as text."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql.types import StringType
from pyspark.sql import Column, functions as F

# Elements whose text is dropped, and elements whose end tag ends a line.
DROPPED = ("script", "style", "nav", "header", "footer")
LINE_END = ("p", "br", "div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "tr")

_REST = r"(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*>"
#: What is no text, in order: comments and declarations, literal elements with what is in them (they
#: end where their own end tag stands), end tags of lines, borders of dropped spans, all other tags.
#: Two control characters stand for the borders until the spans are cut out.
_OFF, _ON = "\x02", "\x01"
STEPS = (
    ("[\x01\x02]", ""),
    (r"(?s)<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>", ""),
    (r"(?is)<script" + _REST + r".*?(?:</script\s*>|$)", _ON),
    (r"(?is)<style" + _REST + r".*?(?:</style\s*>|$)", _ON),
    (r"(?i)</(?:" + "|".join(LINE_END) + r")\s*>", "\n"),
    (r"(?i)</(?:" + "|".join(DROPPED) + r")\s*>", _ON),
    (r"(?i)<(?:" + "|".join(DROPPED) + ")" + _REST, _OFF),
    (r"</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>", ""),
)


@F.pandas_udf(StringType())
def _entities(text: pd.Series) -> pd.Series:
    return text.map(lambda t: html.unescape(t) if "&" in t else t, na_action="ignore")


def without_tags(page: Column) -> Column:
    """The text of a page with its entities as they stand. A dropped span goes from the start tag of a
    dropped element to the next end tag of any of them; the line ends in it count."""
    for pattern, by in STEPS:
        page = F.regexp_replace(page, pattern, by)
    spans = F.split(page, _OFF, -1)
    at = lambda s: F.instr(s, _ON)
    kept = lambda s: F.when(at(s) > 0, F.substr(s, at(s) + 1)).otherwise(F.lit(""))
    dark = lambda s: F.regexp_replace(F.substring_index(s, _ON, 1), r"[^\n]+", "")
    return F.replace(F.array_join(F.transform(spans, lambda s, i: F.when(i == 0, s).otherwise(F.concat(dark(s), kept(s)))), ""), F.lit(_ON), F.lit(""))


def html_text(page: str | Column) -> Column:
    """Text of a page: stripped lines that are not blank. Null stays null, an empty page is empty text.
    Tags are cut by column functions; only the entities of what is left go through Python."""
    lines = F.split(_entities(without_tags(F.col(page) if isinstance(page, str) else page)), "\n", -1)
    bare = F.transform(lines, lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    return F.array_join(F.filter(bare, lambda s: s != ""), "\n")


def url_project(url: Column) -> Column:
    """Project id of a web address: its authority with dashes for dots; null unless http or https."""
    return F.when(F.lower(F.parse_url(url, F.lit("PROTOCOL"))).isin("http", "https"), F.replace(F.parse_url(url, F.lit("AUTHORITY")), F.lit("."), F.lit("-")))


def url_path(url: Column) -> Column:
    """The path under which a page is kept: the address's path without query; ``/`` for none."""
    p = F.parse_url(url, F.lit("PATH"))
    return F.when(F.coalesce(p, F.lit("")) == "", F.lit("/")).otherwise(p)
