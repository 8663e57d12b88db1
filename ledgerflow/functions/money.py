"""Money and ledger-side column helpers (all JVM built-ins, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)
TOTAL = T.DecimalType(18, 2)


def zero() -> Column:
    """Money zero (built per call: worker processes import this module without a session)."""
    return F.lit(0).cast(MONEY)


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def debit(amount: str | Column = "amount", journal: str | Column = "journal") -> Column:
    """Amount on the debit side (journal flag TRUE), else 0."""
    return F.when(col(journal), col(amount)).otherwise(zero())


def credit(amount: str | Column = "amount", journal: str | Column = "journal") -> Column:
    """Amount on the credit side (journal flag FALSE), else 0."""
    return F.when(~col(journal), col(amount)).otherwise(zero())


def signed(amount: str | Column = "amount", journal: str | Column = "journal") -> Column:
    """Debit-positive signed amount."""
    return F.when(col(journal), col(amount)).otherwise(-col(amount))


def total(c: Column) -> Column:
    """Sum of a money column with a fixed result type in every engine."""
    return F.sum(c).cast(TOTAL)


def as_total(c: Column) -> Column:
    return c.cast(TOTAL)


def cents_to_money(c: str | Column) -> Column:
    return (col(c).cast(T.DecimalType(20, 0)) / 100).cast(TOTAL)
