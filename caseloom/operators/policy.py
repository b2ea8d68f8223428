"""Row policies: which rows an actor sees and what may be done with them.

Every function returns a Column, so the predicate reaches the scan.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def scope(owner: Column, department: Column, *, user: object = None, own_department: object = None) -> Column:
    """Rows of one owner, of one department, or all."""
    if user is not None:
        return owner == F.lit(user)
    return department == F.lit(own_department) if own_department is not None else F.lit(True)


def active(status: Column, deleted: Column, cancelled: object) -> Column:
    """Neither deleted nor cancelled; an unknown status counts as active."""
    return deleted.isNull() & ~status.eqNullSafe(F.lit(cancelled))


def in_trash(deleted: Column, status: Column, cancelled_by_self: Column, cancelled: object, *, citizen: bool) -> Column:
    """Trash holds deleted rows; citizens also see what an administrator cancelled."""
    seen = deleted.isNotNull()
    return seen | (status.eqNullSafe(F.lit(cancelled)) & ~F.coalesce(cancelled_by_self, F.lit(False))) if citizen else seen


def not_self_cancelled(cancelled_by: Column, owner: Column) -> Column:
    """Hide rows whose canceller is their owner, unknown values compared as values."""
    return ~(cancelled_by.eqNullSafe(owner) & cancelled_by.isNotNull())


def provenance(source_file: Column) -> Column:
    """``file`` if a file is named, else ``user``; blanks name none."""
    return F.when(F.nullif(F.trim(source_file), F.lit("")).isNull(), "user").otherwise("file")


def optional(column: Column, value: object) -> Column:
    """Equality that a null parameter turns off."""
    return F.lit(True) if value is None else column == F.lit(value)


def view_status(in_departments: Column, has_reply: Column, status: Column, done: object) -> Column:
    """unassigned, waiting, answered or closed: the first that holds."""
    return F.when(~in_departments, "unassigned").when(status.eqNullSafe(F.lit(done)), "closed").when(has_reply, "answered").otherwise("waiting")


def masked(status: Column, cancelled: object, column: Column, mask: str) -> Column:
    return F.when(status.eqNullSafe(F.lit(cancelled)), F.lit(mask)).otherwise(column)


def can_manage(role: str, actor_department: object, department: Column, deleted: Column) -> Column:
    """Administrators manage all; staff their own department and unassigned trash."""
    if role == "admin":
        return F.lit(True)
    return F.coalesce(department == F.lit(actor_department), F.lit(False)) | (deleted.isNotNull() & department.isNull()) if role == "staff" else F.lit(False)


def in_force(start: Column, end: Column, as_of: object) -> Column:
    """Whether a date lies in a range with open ends."""
    day = F.lit(as_of).cast("date")
    return (start.isNull() | (start <= day)) & (end.isNull() | (end >= day))
