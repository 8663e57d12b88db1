"""Column-level validators and the error-array engine (all JVM built-ins).

A validator returns a struct column ``(is_valid, error_msg[, parsed_value])`` so
it composes inside any projection; untrusted text is parsed with ``try_cast``
behind a strict pattern, never with a failing cast, so one bad row never aborts
a batch.  ``errors_of`` turns ordered (condition, message) pairs into an array
of messages: a NULL condition is "no error" (three-valued logic kept).
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and vocabularies that must equal the reference's.
EMAIL_PATTERN = r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}$"
PHONE_PATTERN = r"^\+?1?\d{9,15}$"
AMOUNT_PATTERN = r"^\.?\d+(\.\d+)?$"
DATE_PATTERN = r"^\d{4}-(0[1-9]|1[0-2])-(0[1-9]|[12]\d|3[01])$"
AR_STATUSES = ("Pending", "Paid", "Overdue", "Returned", "Partially Returned", "Partially Paid")
AP_STATUSES = ("Pending", "Partial", "Paid", "Overdue")
ACTION_TYPES = ("Purchase", "Sale", "Sale Return", "Purchase Return", "Transfer")
CHART_TYPES = ("Asset", "Liability", "Equity", "Revenue", "Expense", "Contra Revenue", "Contra Asset",
               "Contra Liability", "Contra Equity", "Contra Expense")
AUDIT_OPERATIONS = ("INSERT", "UPDATE", "DELETE")

# numeric text accepted by a SQL numeric parse (sign, digits, point, exponent)
_DECIMAL_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"
PARSED_DECIMAL = "decimal(38,10)"


def c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _result(ok: Column, msg: Column, parsed: Column | None = None) -> Column:
    fields = [ok.alias("is_valid"), msg.alias("error_msg")]
    if parsed is not None:
        fields.append(parsed.alias("parsed_value"))
    return F.struct(*fields)


def validate_email(col: str | Column) -> Column:
    x = c(col)
    empty = x.isNull() | (x == "")
    bad = ~x.rlike(EMAIL_PATTERN)
    return _result(F.when(empty | bad, False).otherwise(True),
                   F.when(empty, "Email cannot be empty").when(bad, "Invalid email format").otherwise(""))


def validate_phone(col: str | Column) -> Column:
    x = c(col)
    empty = x.isNull() | (x == "")
    bad = ~x.rlike(PHONE_PATTERN)
    return _result(F.when(empty, True).when(bad, False).otherwise(True),
                   F.when(empty, "").when(bad, "Invalid phone format").otherwise(""))


def parse_decimal(col: str | Column) -> Column:
    x = c(col)
    return F.when(x.rlike(_DECIMAL_TEXT), F.trim(x).try_cast(PARSED_DECIMAL))


def parse_int(col: str | Column) -> Column:
    x = c(col)
    return F.when(x.rlike(_INTEGER_TEXT), F.trim(x).try_cast("int"))


def validate_decimal_amount(col: str | Column) -> Column:
    v = parse_decimal(col)
    bad = v.isNull()
    neg = v < 0
    return _result(F.when(bad | neg, False).otherwise(True),
                   F.when(bad, F.concat(F.lit("Invalid decimal format: "), c(col)))
                    .when(neg, "Amount cannot be negative").otherwise(""),
                   F.when(bad | neg, F.lit(None).cast(PARSED_DECIMAL)).otherwise(v))


def validate_integer_quantity(col: str | Column) -> Column:
    v = parse_int(col)
    bad = v.isNull()
    nonpos = v <= 0
    return _result(F.when(bad | nonpos, False).otherwise(True),
                   F.when(bad, F.concat(F.lit("Invalid integer format: "), c(col)))
                    .when(nonpos, "Quantity must be greater than 0").otherwise(""),
                   F.when(bad | nonpos, F.lit(None).cast("int")).otherwise(v))


def validate_date(col: str | Column, as_of: str) -> Column:
    v = c(col).try_cast("date")
    bad = v.isNull()
    future = v > F.lit(as_of).cast("date")
    return _result(F.when(bad | future, False).otherwise(True),
                   F.when(bad, F.concat(F.lit("Invalid date format: "), c(col)))
                    .when(future, "Date cannot be in the future").otherwise(""),
                   F.when(bad | future, F.lit(None).cast("date")).otherwise(v))


def validate_invoice_due_dates(invoice: str | Column, due: str | Column) -> Column:
    bad = F.coalesce(c(invoice) > c(due), F.lit(False))
    return _result(~bad, F.when(bad, "Invoice date cannot be after due date").otherwise(""))


def is_overdue(due: str | Column, as_of: str) -> Column:
    return c(due) < F.lit(as_of).cast("date")


def errors_of(checks: Iterable[tuple[Column, str]]) -> Column:
    """Ordered array of messages whose condition is TRUE (NULL counts as no error)."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(msg)) for cond, msg in checks]))


def joined(errors: Column, sep: str = "; ") -> Column:
    return F.array_join(errors, sep)
