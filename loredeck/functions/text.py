"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def has(column: Column | str, keyword: str) -> Column:
    """Whether the keyword is a substring, whatever the case."""
    c = F.col(column) if isinstance(column, str) else column
    return F.lower(F.coalesce(c, F.lit(""))).contains(keyword.lower())


def occurrences(column: Column | str, keyword: str) -> Column:
    """Occurrences, not overlapping, of the keyword, whatever the case."""
    c = F.lower(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit("")))
    return ((F.length(c) - F.length(F.replace(c, F.lit(keyword.lower()), F.lit("")))) / F.lit(len(keyword))).cast("long")


def escape_like(text: str) -> str:
    """Text for a LIKE pattern in which it stands for itself."""
    return text.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")


def trigrams(column: Column | str) -> Column:
    """Number of three-character tokens of a text."""
    return F.greatest(F.length(F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))) - 2, F.lit(0))


def content_hash(column: str) -> Column:
    """First 16 hexadecimal digits of the SHA-256, null for empty text."""
    return F.when(F.col(column) != "", F.substring(F.sha2(F.col(column), 256), 1, 16))


def truncated(column: str, most: int) -> Column:
    return F.substring(F.col(column), 1, most)


def strip_html(column: str) -> Column:
    """Markup to text: scripts and styles go, cells become bars, entities characters, blanks one space."""
    c = F.col(column)
    for pattern, put in (
        (r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>", " "),
        (r"(?i)</t[dh]>", " | "),
        (r"(?i)<br\s*/?>|</p>|</div>|</li>|</tr>|</h[1-6]>", "\n"),
        (r"<[^>]+>", " "),
    ):
        c = F.regexp_replace(c, pattern, put)
    for entity, put in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(put))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\s*\n\s*", "\n"))


STRIP_HTML_SQL = r"""trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>', ' ', 'g'), '(?i)</t[dh]>', ' | ', 'g'),
  '(?i)<br\s*/?>|</p>|</div>|</li>|</tr>|</h[1-6]>', chr(10), 'g'), '<[^>]+>', ' ', 'g'),
  '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '[ \t]+', ' ', 'g'), '\s*\n\s*', chr(10), 'g'))"""


def guarded_csv(column: Column) -> Column:
    """A field that no spreadsheet takes for a formula."""
    return F.when(F.substring(column, 1, 1).isin("=", "+", "-", "@"), F.concat(F.lit("'"), column)).otherwise(column)


def log_field(column: Column) -> Column:
    """A field that can't end a pipe-delimited log field or line."""
    return F.replace(F.replace(F.replace(column, F.lit("|"), F.lit("｜")), F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))


def normal_path(column: Column) -> Column:
    """Lower-case path with single slashes and none at the end."""
    return F.lower(F.regexp_replace(F.regexp_replace(column, r"[\\/]+", "/"), "/$", ""))
