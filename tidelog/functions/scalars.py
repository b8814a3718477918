"""Scalar functions on keys, ids and statuses, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def namespaced(table_id: Column, key: Column) -> Column:
    """Physical key of a run that mixes tables: the table's id, a dot, the key."""
    return F.concat(table_id.cast("string"), F.lit("."), key)


def table_of(physical: Column) -> Column:
    """Table id before the first dot; null where there is none or it is no number."""
    return F.when(F.instr(physical, ".") > 0, F.substring_index(physical, ".", 1).try_cast("long"))


def key_of(physical: Column) -> Column:
    """What follows the first dot (keys may hold dots of their own)."""
    at = F.instr(physical, ".")
    return F.when(at > 0, F.substr(physical, at + 1))


def last_segment(name: Column, separator: str = "-") -> Column:
    """The part of a name after the last separator."""
    return F.substring_index(name, separator, -1)


def job_name(job_type: Column, job_id: Column) -> Column:
    return F.concat_ws("-", job_type, job_id.cast("string"))


def job_id_of(name: Column) -> Column:
    """The number that ends a job's name, null where it is none."""
    return last_segment(name).try_cast("long")


def parsed_or(value: Column, default: int) -> Column:
    """A non-negative number of a setting, else the default."""
    n = value.try_cast("int")
    return F.when(n >= 0, n).otherwise(default)


def method_of(path: Column) -> Column:
    """Method of a /service/method path."""
    return F.split_part(path, F.lit("/"), F.lit(3))


def url_decoded(text: Column) -> Column:
    """Text with its percent signs resolved; as it is where they are not well-formed."""
    return F.coalesce(F.try_url_decode(text), text)


# Names of the status codes, in order.
STATUS_NAMES = (
    "Ok", "Cancelled", "Unknown", "InvalidArgument", "DeadlineExceeded", "NotFound", "AlreadyExists", "PermissionDenied", "ResourceExhausted",
    "FailedPrecondition", "Aborted", "OutOfRange", "Unimplemented", "Internal", "Unavailable", "DataLoss", "Unauthenticated",
)
# Codes that are the client's doing.
CLIENT_CODES = (1, 3, 5, 6, 7, 9, 11, 16)


def status_name(code: Column) -> Column:
    known = F.element_at(F.array(*[F.lit(x) for x in STATUS_NAMES]), (F.greatest(F.least(code, F.lit(len(STATUS_NAMES) - 1)), F.lit(0)) + 1).cast("int"))
    return F.when(code.between(0, len(STATUS_NAMES) - 1), known).otherwise("Unknown")


def status_category(code: Column) -> Column:
    """ok, client_error or server_error (also for codes that are not known)."""
    return F.when(code == 0, "ok").when(code.isin(*CLIENT_CODES), "client_error").otherwise("server_error")
