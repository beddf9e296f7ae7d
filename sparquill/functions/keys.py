"""Column expressions shared by the log queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AD_HOC = "adhoc:"
#: Costs from here on mark plans with a disabled operator; they are no estimates.
DISABLED_COST = 1e9
#: Longest duration that can be true, in ms.
LONGEST_MS = 86_400_000.0


def query_key(query_id: Column | str = "query_id", sql_text: Column | str = "sql_text") -> Column:
    """The query_id, or 'adhoc:' and the MD5 of the statement with its white space made even."""
    qid, text = (F.col(c) if isinstance(c, str) else c for c in (query_id, sql_text))
    even = F.regexp_replace(F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", ""), r"\s+", " ")
    return F.coalesce(qid, F.concat(F.lit(AD_HOC), F.md5(even)))


def is_duration(ms: Column) -> Column:
    """Not null, finite, above zero and no longer than a day."""
    return F.coalesce((ms > 0) & (ms <= LONGEST_MS), F.lit(False))


def selector(column: Column | str = "selector_used") -> Column:
    """A selector's name without case and surrounding blanks."""
    return F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
