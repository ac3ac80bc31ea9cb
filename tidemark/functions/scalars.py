"""Scalar expressions. Each takes and returns Columns, so that everything stays inside generated code."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _c(x: ColumnLike) -> Column:
    return F.col(x) if isinstance(x, str) else x


def truthy(x: ColumnLike) -> Column:
    """A string, or NULL where it is missing or empty."""
    return F.nullif(_c(x).cast("string"), F.lit(""))


def or_else(*xs: ColumnLike) -> Column:
    """The first that is neither missing nor empty; the last as it is."""
    return F.coalesce(*[truthy(x) for x in xs[:-1]], _c(xs[-1]).cast("string"))


def record_id(x: ColumnLike) -> Column:
    """A record's id as text; a missing id is the text None."""
    return F.coalesce(_c(x).cast("string"), F.lit("None"))


def cents(x: ColumnLike) -> Column:
    """An amount as a whole number of cents, which every engine writes alike."""
    return F.round(_c(x) * 100).cast("bigint")


def truncated(x: ColumnLike, n: int) -> Column:
    """The first n characters."""
    return F.left(_c(x), F.lit(n))


def iso_date(x: ColumnLike) -> Column:
    """yyyy-MM-dd HH:mm:ss of an ISO date or time. The offset is dropped, not applied; fractions are cut.

    Missing or empty is NULL, and what is no date stays as it is (so do week dates).
    """
    text = truthy(x)
    bare = F.regexp_replace(text, r"(Z|[+-]\d{2}:?\d{2}(:?\d{2})?)$", "")
    bare = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$|^\d{8}$"), text).otherwise(bare)
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)?$"
    seconds = F.regexp_replace(F.regexp_replace(bare, r"[.,]\d+$", ""), " ", "T")
    full = (
        F.when(bare.rlike(r"^\d{8}$"), F.concat(F.substring(bare, 1, 4), F.lit("-"), F.substring(bare, 5, 2), F.lit("-"), F.substring(bare, 7, 2), F.lit("T00:00:00")))
        .when(~bare.rlike(shape), F.lit(None))
        .otherwise(F.concat(seconds, F.substring(F.lit("T00:00:00"), F.length(seconds) - 9, 99)))
    )
    stamp = F.try_to_timestamp(full, F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    return F.coalesce(F.date_format(stamp, "yyyy-MM-dd HH:mm:ss"), text)


def stamp(x: ColumnLike) -> Column:
    """yyyy-MM-ddTHH:mm:ssZ of a UTC timestamp."""
    return F.date_format(_c(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def file_stamp(x: ColumnLike) -> Column:
    """yyyyMMdd_HHmmss of a UTC timestamp."""
    return F.date_format(_c(x), "yyyyMMdd_HHmmss")


def trimmed_url(x: ColumnLike) -> Column:
    """Without the slashes at its end."""
    return F.regexp_replace(_c(x), "/+$", "")


def capitalized(x: ColumnLike) -> Column:
    """First character upper, all others lower."""
    return F.concat(F.upper(F.left(_c(x), F.lit(1))), F.lower(F.substring(_c(x), 2, 2**31 - 1)))


def license_ok(x: ColumnLike) -> Column:
    """An empty key is open mode; any other needs eight characters."""
    return F.coalesce(F.length(_c(x)), F.lit(0)).isin(0) | (F.length(_c(x)) >= 8)


def fingerprint(x: ColumnLike) -> Column:
    """Name-based UUID (version 5, DNS namespace) of a text."""
    # Fixed value: the DNS namespace of name-based UUIDs.
    namespace = "6ba7b8109dad11d180b400c04fd430c8"
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(_c(x), "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    return F.concat_ws(
        "-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12),
    )


def xml_envelope(action: ColumnLike, entity: ColumnLike, voucher: ColumnLike) -> Column:
    """Import envelope for the accounting target, with what it is about in a comment; values are not escaped."""
    # The envelope's parts before and behind the comment.
    head = (
        "<ENVELOPE><HEADER><TALLYREQUEST>Import Data</TALLYREQUEST></HEADER>"
        "<BODY><IMPORTDATA><REQUESTDESC><REPORTNAME>Vouchers</REPORTNAME>"
        "<STATICVARIABLES><SVCURRENTCOMPANY>Default</SVCURRENTCOMPANY></STATICVARIABLES>"
        '</REQUESTDESC><REQUESTDATA><TALLYMESSAGE xmlns:UDF="TallyUDF">'
    )
    tail = "</TALLYMESSAGE></REQUESTDATA></IMPORTDATA></BODY></ENVELOPE>"
    return F.concat(F.lit(head), F.lit("<!-- "), F.concat_ws(" ", action, entity, voucher), F.lit(" -->"), F.lit(tail))


def scheduler_state(running: ColumnLike, paused: ColumnLike) -> Column:
    """paused before active; stopped where neither holds."""
    yes = lambda x: F.coalesce(_c(x), F.lit(False))
    return F.when(yes(paused), "paused").when(yes(running), "active").otherwise("stopped")


def basename(x: ColumnLike) -> Column:
    return F.element_at(F.split(_c(x), "/"), -1)


def megabytes(x: ColumnLike) -> Column:
    return F.round(_c(x) / (1024 * 1024), 2)


def interval_minutes(x: ColumnLike) -> Column:
    """At least one minute."""
    return F.greatest(F.lit(1), _c(x))


def get_or(counts: ColumnLike, key: str, default: int = 0) -> Column:
    """A map's value, or the default."""
    return F.coalesce(F.try_element_at(_c(counts), F.lit(key)), F.lit(default))


def sync_failed(entity: ColumnLike, record: ColumnLike, error: ColumnLike) -> Column:
    """What is said of a record that could not be pushed."""
    return F.concat(F.lit("Failed to sync "), _c(entity), F.lit(" "), _c(record), F.lit(": "), _c(error))


def routed(name: ColumnLike, aliases: dict[str, str], unknown: str = "all") -> Column:
    """The entity that a job's name stands for, in any case; unknown names stand for all."""
    lowered = F.lower(F.coalesce(_c(name), F.lit("")))
    return functools.reduce(lambda case, item: case.when(lowered == item[0], item[1]), aliases.items(), F.when(F.lit(False), "")).otherwise(unknown)
