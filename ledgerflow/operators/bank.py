"""B — bank reconciliation over all (account, statement date) keys at once.

Balances "as of" a statement date are cumulative sums: journal legs and bank
rows are first reduced to one row per (account, day) (partial aggregation, so
the size is bounded by days, not by rows), then a running sum per account is
read at each statement date.  Matching bank rows to ledger legs is tiered:

* a tier matches rows and legs of one account whose amounts differ by a fixed number of cents; the
  greedy "earliest unused eligible leg" has a closed form over counts by date: with ``N_g`` bank
  rows up to statement date g and ``P_g`` legs dated on or before it, ``K_g = N_g + min(0,
  min_{h<=g}(P_h - N_h))`` legs are used after g, and the r-th row of the date takes leg
  ``K_{g-1} + r`` if that is at most ``K_g``.  Rows are ranked within their date only and the counts
  have one row per date, so a common amount never meets whole in one task;
* the exact tier comes first, an equi join over all amounts at once;
* near amounts are matched in rounds of mutual best choice between amounts, not rows.  A bank amount
  and a leg amount of one account are a candidate pair if they are within the tolerance and a leg is
  dated in time for a row; each amount chooses the nearest partner (one below before one above), and
  pairs that choose each other are matched at once by the same closed form.  That is the greedy
  order of the pairs by distance, so the matches are those of one tier after the other, cent by
  cent, but the rounds follow how choices depend on each other, not the tolerance.  Candidates meet
  in a band join on buckets as wide as the round's reach; only one row per amount takes part in it, and
  the reach is chosen from counts by cell so that each amount meets a few candidates, however dense
  the amounts are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.intervals import as_of
from ..functions.money import MONEY, TOTAL
from ..session import ensure_checkpoint_dir


def signed_bank(bank_tx: DataFrame) -> DataFrame:
    return bank_tx.withColumn("signed_amount", F.when(F.col("transaction_type") == "CREDIT", F.col("amount"))
                              .otherwise(-F.col("amount")))


def monthly_statements(bank_tx: DataFrame) -> DataFrame:
    """One statement per account and month end; closing = running sum of signed bank rows."""
    s = signed_bank(bank_tx).withColumn("statement_date", F.last_day("transaction_date"))
    m = s.groupBy("account_id", "statement_date").agg(F.sum("signed_amount").alias("_net"))
    w = Window.partitionBy("account_id").orderBy("statement_date")
    closing = F.sum("_net").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return m.select(
        F.concat(F.col("account_id").cast("string"), F.lit("-"), F.date_format("statement_date", "yyyyMM")).alias("statement_id"),
        "account_id", "statement_date", (closing - F.col("_net")).cast(TOTAL).alias("opening_balance"),
        closing.cast(TOTAL).alias("closing_balance"))


def _asof_sum(daily: DataFrame, points: DataFrame, key: str, value: str, out: str) -> DataFrame:
    """For each (key, date) point: Σ value of daily rows with date ≤ point date (per key)."""
    d = daily.select(key, "date", F.col(value).alias("_v"), F.lit(0).alias("_tag"))
    p = points.select(key, "date", F.lit(None).cast(daily.schema[value].dataType).alias("_v"), F.lit(1).alias("_tag"))
    w = Window.partitionBy(key).orderBy("date", "_tag").rowsBetween(Window.unboundedPreceding, 0)
    u = d.unionByName(p).withColumn(out, F.coalesce(F.sum("_v").over(w), F.lit(0)))
    return u.where(F.col("_tag") == 1).select(key, "date", out)


def bank_reconciliation(accounts: DataFrame, statements: DataFrame, journals: DataFrame,
                        bank_tx: DataFrame) -> DataFrame:
    """Per (account, statement date): statement, book, outstanding checks, deposits in transit,
    reconciled balance, difference and status (0 → RECONCILED, |d| < 100 → Minor, else Major)."""
    acct = accounts.select("account_id", "account_number", "bank_name", "chart_id")
    legs = (journals.join(acct.select("account_id", "chart_id"), "chart_id")
            .groupBy("account_id", "date").agg(F.sum(F.when(F.col("journal"), F.col("amount"))
                                                     .otherwise(-F.col("amount"))).alias("_net")))
    bank_daily = bank_tx.groupBy("account_id", F.col("transaction_date").alias("date")).agg(
        F.sum(F.when(F.col("transaction_type") == "DEBIT", F.col("amount")).otherwise(0)).alias("_deb"),
        F.sum(F.when(F.col("transaction_type") == "CREDIT", F.col("amount")).otherwise(0)).alias("_cre"))
    totals = bank_daily.groupBy("account_id").agg(F.sum("_deb").alias("_tdeb"), F.sum("_cre").alias("_tcre"))
    pts = statements.select("account_id", F.col("statement_date").alias("date"))
    book = _asof_sum(legs, pts, "account_id", "_net", "book_balance")
    deb = _asof_sum(bank_daily.select("account_id", "date", "_deb"), pts, "account_id", "_deb", "_deb_to")
    cre = _asof_sum(bank_daily.select("account_id", "date", "_cre"), pts, "account_id", "_cre", "_cre_to")
    s = (statements.select("account_id", F.col("statement_date").alias("date"), "closing_balance")
         .join(acct, "account_id", "left").join(book, ["account_id", "date"], "left")
         .join(deb, ["account_id", "date"], "left").join(cre, ["account_id", "date"], "left")
         .join(totals, "account_id", "left"))
    book_b = F.coalesce(F.col("book_balance"), F.lit(0)).cast(TOTAL)
    checks = (F.coalesce(F.col("_tdeb"), F.lit(0)) - F.coalesce(F.col("_deb_to"), F.lit(0))).cast(TOTAL)
    deposits = (F.coalesce(F.col("_tcre"), F.lit(0)) - F.coalesce(F.col("_cre_to"), F.lit(0))).cast(TOTAL)
    reconciled = (book_b - checks + deposits).cast(TOTAL)
    diff = (F.col("closing_balance") - reconciled).cast(TOTAL)
    status = (F.when(diff == 0, "RECONCILED").when(F.abs(diff) < 100, "VARIANCE (Minor)")
               .otherwise("VARIANCE (Major)"))
    return s.select("account_id", "account_number", "bank_name", F.col("date").alias("statement_date"),
                    F.col("closing_balance").alias("statement_balance"), book_b.alias("book_balance"),
                    checks.alias("outstanding_checks"), deposits.alias("deposits_in_transit"),
                    reconciled.alias("reconciled_balance"), diff.alias("difference"), status.alias("status"))


def bank_reconciliation_detail(accounts: DataFrame, statements: DataFrame, bank_tx: DataFrame,
                               journals: DataFrame, transactions: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """Report sections per (account, statement): opening balance, the statement's signed bank
    rows, and the signed legs on the account's chart up to the statement date.

    ``keys`` (account_id, statement_date) names the requested statements and is applied to every
    input first; without it the report covers all statements, whose leg section repeats each leg
    for every later statement."""
    if keys is not None:
        keys = keys.select("account_id", "statement_date").distinct()
        statements = statements.join(keys, ["account_id", "statement_date"], "left_semi")
        bank_tx = (bank_tx.withColumn("statement_date", F.last_day("transaction_date"))
                   .join(keys, ["account_id", "statement_date"], "left_semi").drop("statement_date"))
        accounts = accounts.join(keys.select("account_id").distinct(), "account_id", "left_semi")
    st = statements.select("statement_id", "account_id", "statement_date", "opening_balance")
    opening = st.select("account_id", "statement_date", F.lit(1).alias("section_no"),
                        F.lit("BANK STATEMENT").alias("section"), F.lit("Opening Balance").alias("item_description"),
                        F.lit(None).cast(TOTAL).alias("bank_amount"), F.col("opening_balance").cast(TOTAL).alias("book_amount"),
                        F.lit("STATEMENT").alias("status"), F.lit("Beginning balance from bank").alias("reconciliation_notes"),
                        F.col("statement_date").alias("item_date"))
    b = signed_bank(bank_tx).withColumn("statement_date", F.last_day("transaction_date"))
    bank = b.select("account_id", "statement_date", F.lit(2).alias("section_no"), F.lit("BANK TRANSACTION").alias("section"),
                    F.concat(F.lit("Bank transaction "), F.col("bank_trans_id").cast("string")).alias("item_description"),
                    F.col("signed_amount").cast(TOTAL).alias("bank_amount"), F.lit(None).cast(TOTAL).alias("book_amount"),
                    F.lit("BANK").alias("status"),
                    F.concat(F.lit("From bank statement: "), F.col("bank_trans_id").cast("string")).alias("reconciliation_notes"),
                    F.col("transaction_date").alias("item_date"))
    # legs up to each statement date: a range condition on an equi-keyed join (account)
    legs = journals.join(accounts.select("account_id", "chart_id"), "chart_id") \
                   .join(transactions.select("transaction_id", "description"), "transaction_id", "left")
    lj = legs.join(st.select("account_id", "statement_date"), "account_id").where(F.col("date") <= F.col("statement_date"))
    book = lj.select("account_id", "statement_date", F.lit(3).alias("section_no"), F.lit("JOURNAL ENTRY").alias("section"),
                     F.col("description").alias("item_description"), F.lit(None).cast(TOTAL).alias("bank_amount"),
                     F.when(F.col("journal"), F.col("amount")).otherwise(-F.col("amount")).cast(TOTAL).alias("book_amount"),
                     F.lit("MATCHED").alias("status"), F.lit("Matched to GL").alias("reconciliation_notes"),
                     F.col("date").alias("item_date"))
    return opening.unionByName(bank).unionByName(book)


def leg_statements(accounts: DataFrame, statements: DataFrame, journals: DataFrame, transactions: DataFrame) -> DataFrame:
    """Every cash leg once, with the first statement that shows it: a leg is on that statement and on all later ones.

    The compact form of the detail report's journal section, whose rows grow with legs times statements.
    ``account_id, journal_id, description, book_amount, item_date, first_statement_date`` (null: not on a statement yet)."""
    line = Window.partitionBy("account_id").orderBy("statement_date")
    since = statements.select("account_id", "statement_date").distinct().withColumn("_after", F.lag("statement_date").over(line))
    since = since.select("account_id", F.coalesce(F.date_add("_after", 1), F.lit("0001-01-01").cast("date")).alias("_from"),
                         F.date_add("statement_date", 1).alias("_upto"), F.col("statement_date").alias("first_statement_date"))
    legs = (journals.join(accounts.select("account_id", "chart_id"), "chart_id")
            .join(transactions.select("transaction_id", "description"), "transaction_id", "left")
            .select("account_id", "journal_id", "description",
                    F.when(F.col("journal"), F.col("amount")).otherwise(-F.col("amount")).cast(TOTAL).alias("book_amount"), F.col("date").alias("item_date")))
    return as_of(legs, since, ["account_id"], "item_date", "_from", "_upto", ["first_statement_date"])


def _cents(c) -> F.Column:
    return (c * 100).cast("long")


def match_tier(bank_rows: DataFrame, legs: DataFrame, shift: int = 0) -> DataFrame:
    """Bank rows and legs of one account with leg amount = row amount + ``shift`` cents.

    ``bank_rows``: bank_trans_id, account_id, statement_date, transaction_date, amt (signed
    cents).  ``legs``: journal_id, account_id, date, amt (signed cents).
    Returns matches (bank_trans_id, journal_id, matched_amount)."""
    return match_keyed(bank_rows.withColumn("_key", F.col("amt") + shift), legs.withColumn("_key", F.col("amt")))


def match_keyed(bank_rows: DataFrame, legs: DataFrame) -> DataFrame:
    """Bank rows and legs that share account and ``_key``: each row in order takes the earliest unused leg in time."""
    key = ["account_id", "_key"]
    b = bank_rows.select("bank_trans_id", "account_id", "statement_date", "transaction_date", "amt", "_key")
    l = legs.select("journal_id", "account_id", "date", "_key")
    by_date = (b.groupBy(*key, F.col("statement_date").alias("date")).agg(F.count(F.lit(1)).alias("_n"))
               .withColumns({"_c": F.lit(0).cast("long"), "_tag": F.lit(1)}))
    leg_dates = (l.groupBy(*key, "date").agg(F.count(F.lit(1)).alias("_c"))
                 .withColumns({"_n": F.lit(0).cast("long"), "_tag": F.lit(0)}))
    line = Window.partitionBy(*key).orderBy("date", "_tag")  # legs of a date count for statements of that date
    upto = line.rowsBetween(Window.unboundedPreceding, 0)
    u = by_date.unionByName(leg_dates).withColumns({"_p": F.sum("_c").over(upto), "_m": F.sum("_n").over(upto)})
    u = u.withColumn("_k", F.col("_m") + F.least(F.lit(0), F.min(F.when(F.col("_tag") == 1, F.col("_p") - F.col("_m"))).over(upto)))
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    u = u.withColumn("_k0", F.coalesce(F.max(F.when(F.col("_tag") == 1, F.col("_k"))).over(before), F.lit(0)))
    used = u.where((F.col("_tag") == 1) & (F.col("_k") > F.col("_k0"))).select(*key, F.col("date").alias("statement_date"), "_k", "_k0")
    ranked = b.withColumn("_r", F.row_number().over(Window.partitionBy(*key, "statement_date").orderBy("transaction_date", "bank_trans_id")))
    hits = (ranked.join(used, [*key, "statement_date"]).withColumn("_at", F.col("_k0") + F.col("_r")).where(F.col("_at") <= F.col("_k"))
            .select("bank_trans_id", "amt", *key, "_at"))
    starts = u.where(F.col("_tag") == 0).select(*key, "date", (F.col("_p") - F.col("_c")).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*key, "date").orderBy("journal_id"))
    numbered = (l.withColumn("_r", own).join(starts, [*key, "date"])
                .select("journal_id", *key, (F.col("_before") + F.col("_r")).alias("_at")))
    return hits.join(numbered, [*key, "_at"]).select(
        "bank_trans_id", "journal_id", (F.col("amt").cast("decimal(20,0)") / 100).cast(MONEY).alias("matched_amount"))


def match_inputs(bank_tx: DataFrame, journals: DataFrame, accounts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Signed-cent bank rows and the ledger legs on each account's chart."""
    br = signed_bank(bank_tx).select("bank_trans_id", "account_id", "transaction_date",
                                     F.last_day("transaction_date").alias("statement_date"),
                                     _cents(F.col("signed_amount")).alias("amt"))
    lg = journals.join(accounts.select("account_id", "chart_id"), "chart_id").select(
        "journal_id", "account_id", "date",
        _cents(F.when(F.col("journal"), F.col("amount")).otherwise(-F.col("amount"))).alias("amt"))
    return br, lg


def best_pairs(bank_rows: DataFrame, legs: DataFrame, tolerance: int) -> DataFrame:
    """account_id, _bank, _leg: amounts (cents) within ``tolerance`` that are each other's nearest partner in time."""
    wide = tolerance + 1
    b = (bank_rows.groupBy("account_id", F.col("amt").alias("_bank")).agg(F.max("statement_date").alias("_last"))
         .withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda i: F.floor(F.col("_bank") / wide) + i))))
    l = (legs.groupBy("account_id", F.col("amt").alias("_leg")).agg(F.min("date").alias("_first"))
         .withColumn("_bucket", F.floor(F.col("_leg") / wide)))
    off = F.col("_leg") - F.col("_bank")
    near = (b.join(l, ["account_id", "_bucket"]).where((F.abs(off) <= tolerance) & (F.col("_first") <= F.col("_last")))
            .select("account_id", "_bank", "_leg", F.struct(F.abs(off).alias("far"), (off > 0).alias("above")).alias("_off")))
    of_bank = near.groupBy("account_id", "_bank").agg(F.min(F.struct("_off", "_leg")).alias("_x")).select("account_id", "_bank", "_x._leg")
    of_leg = near.groupBy("account_id", "_leg").agg(F.min(F.struct("_off", "_bank")).alias("_x")).select("account_id", "_leg", "_x._bank")
    return of_bank.join(of_leg, ["account_id", "_bank", "_leg"])


#: Candidate pairs that a round may compare for each amount, on average.
CROWD = 8


def _near_cells(bank_rows: DataFrame, legs: DataFrame, tolerance: int) -> tuple[DataFrame, DataFrame, int, int]:
    """Per account and cell of ``tolerance`` + 1 cents: the earliest leg (for rows) and the latest row (for legs) in reach.

    Also the candidate pairs of amounts within reach of a cell, and the amounts, both as estimates."""
    cell = F.floor(F.col("amt") / (tolerance + 1)).alias("_cell")
    around = F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)).alias("_cell")
    count = F.approx_count_distinct("amt").alias("_n")
    b = bank_rows.groupBy("account_id", cell).agg(count, F.max("statement_date").alias("_last")).checkpoint()
    l = legs.groupBy("account_id", cell).agg(count, F.min("date").alias("_first")).checkpoint()
    of_rows = (l.select("account_id", "_n", "_first", around).groupBy("account_id", "_cell")
               .agg(F.sum("_n").alias("_near"), F.min("_first").alias("_first")))
    of_legs = b.select("account_id", "_last", around).groupBy("account_id", "_cell").agg(F.max("_last").alias("_last"))
    live = b.join(of_rows, ["account_id", "_cell"]).where(F.col("_first") <= F.col("_last"))
    pairs, amounts = live.agg(F.sum(F.col("_n") * F.col("_near")), F.sum(F.col("_n") + F.col("_near"))).first()
    return of_rows.drop("_near"), of_legs, int(pairs or 0), int(amounts or 0)


def match_near(bank_rows: DataFrame, legs: DataFrame, tolerance: int) -> DataFrame:
    """Matches within ``tolerance`` cents, in rounds; ends when no bank amount has a partner left.

    A round looks as far as ``CROWD`` candidates for each amount allow, so its work grows with the amounts, not with
    their square: two amounts that are each other's nearest within a shorter reach are so within any longer one.
    The reach grows as rows are used up, to the whole tolerance in the end.  Rows and legs that have nothing in time
    within the tolerance leave the rounds at once."""
    spark = bank_rows.sparkSession
    ensure_checkpoint_dir(spark)
    found = spark.createDataFrame([], f"bank_trans_id {bank_rows.schema['bank_trans_id'].dataType.simpleString()}, "
                                      f"journal_id {legs.schema['journal_id'].dataType.simpleString()}, matched_amount {MONEY.simpleString()}")
    cell, reach, least = F.floor(F.col("amt") / (tolerance + 1)), 0, 1  # the reach never shrinks
    while True:
        if reach < tolerance:
            of_rows, of_legs, crowd, amounts = _near_cells(bank_rows, legs, tolerance)
            if crowd == 0:
                return found
            reach = min(tolerance, max(least, tolerance * CROWD * amounts // crowd))
            least = reach
            # a row without a date is not decided here but among those of its amount
            bank_rows = (bank_rows.withColumn("_cell", cell).join(of_rows, ["account_id", "_cell"])
                         .where((F.col("_first") <= F.col("statement_date")) | F.col("statement_date").isNull()).select(*bank_rows.columns))
            legs = (legs.withColumn("_cell", cell).join(of_legs, ["account_id", "_cell"])
                    .where((F.col("date") <= F.col("_last")) | F.col("date").isNull()).select(*legs.columns))
        pairs = best_pairs(bank_rows, legs, reach).checkpoint()
        if pairs.isEmpty():
            if reach == tolerance:
                return found
            least = reach * 4
            continue
        b = bank_rows.join(pairs.select("account_id", F.col("_bank").alias("amt"), F.col("_leg").alias("_key")), ["account_id", "amt"])
        l = legs.join(pairs.select("account_id", F.col("_leg").alias("amt"), F.col("_leg").alias("_key")), ["account_id", "amt"])
        new = match_keyed(b, l).checkpoint()
        found = found.unionByName(new)
        bank_rows = bank_rows.join(new.select("bank_trans_id"), "bank_trans_id", "left_anti").checkpoint()
        legs = legs.join(new.select("journal_id"), "journal_id", "left_anti").checkpoint()


def auto_match_bank(bank_tx: DataFrame, journals: DataFrame, accounts: DataFrame, statements: DataFrame,
                    tolerance: float = 0.01) -> dict[str, DataFrame]:
    """Match each bank row to one unused leg of its account (|signed difference| ≤ tolerance, leg
    dated on or before the row's statement date); any tolerance of whole cents.

    Returns {"matches": ..., "headers": one IN_PROGRESS reconciliation per statement with its
    balances and counts}."""
    tol = int(round(tolerance * 100))
    ensure_checkpoint_dir(bank_tx.sparkSession)
    br, lg = match_inputs(bank_tx, journals, accounts)
    matches = match_tier(br, lg).checkpoint()
    if tol > 0:
        left_b = br.join(matches.select("bank_trans_id"), "bank_trans_id", "left_anti").checkpoint()
        left_l = lg.join(matches.select("journal_id"), "journal_id", "left_anti").checkpoint()
        matches = matches.unionByName(match_near(left_b, left_l, tol))
    done = br.join(matches.select("bank_trans_id", F.lit(1).alias("_hit")), "bank_trans_id", "left")
    counts = done.groupBy("account_id", "statement_date").agg(
        F.count("_hit").alias("matched_count"), F.count_if(F.col("_hit").isNull()).alias("unmatched_count"))
    balances = bank_reconciliation(accounts, statements, journals, bank_tx)
    headers = (balances.join(counts, ["account_id", "statement_date"], "left")
               .select("account_id", F.col("statement_date").alias("reconciliation_date"), "statement_balance", "book_balance",
                       F.lit("IN_PROGRESS").alias("status"), F.coalesce("matched_count", F.lit(0)).alias("matched_count"),
                       F.coalesce("unmatched_count", F.lit(0)).alias("unmatched_count")))
    return {"matches": matches, "headers": headers}


def outstanding_items(bank_tx: DataFrame, matches: DataFrame) -> DataFrame:
    """Bank rows without a match, typed CHECK (DEBIT) or DEPOSIT (CREDIT)."""
    un = bank_tx.join(matches.select("bank_trans_id"), "bank_trans_id", "left_anti")
    return un.select("bank_trans_id", "account_id", "transaction_date", "amount",
                     F.when(F.col("transaction_type") == "DEBIT", "CHECK").otherwise("DEPOSIT").alias("item_type"),
                     F.lit("OUTSTANDING").alias("status"))
