"""Statement lines to transactions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.values import amount_of, day_month, flow_of

#: Words of a line that tells what happened, and those that say which way the money went.
ACTION_WORDS = ("paid to", "received from", "money sent to", "debited", "credited", "transfer to", "money received", "refund", "cashback", "upi ref no", "paid", "sent to")
RECEIVED_WORDS = ("received", "credited", "cashback", "refund")
PAID_WORDS = ("paid", "debited", "sent to", "transfer to")
INDICATORS = ("statement", "upi", "paid to", "received from", "balance", "transaction", "passbook", "paytm", "bank", "ref no")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def detect_statements(lines: DataFrame) -> DataFrame:
    """(statement_id, score, is_statement) for (statement_id, line_no, text): two of ten indicators in the first 200 lines.

    The lines of each statement are counted in the order of ``line_no``, whatever numbers those are; each statement has a row.
    """
    low = F.lower("text")
    place = F.row_number().over(Window.partitionBy("statement_id").orderBy(F.asc_nulls_last("line_no"), "text"))
    found = lines.withColumn("_place", place).where(F.col("_place") <= 200).groupBy("statement_id").agg(*[F.max(F.contains(low, F.lit(w))).alias(f"i{k}") for k, w in enumerate(INDICATORS)])
    score = reduce(lambda a, b: a + b, [F.col(f"i{k}").cast("int") for k in range(len(INDICATORS))])
    return found.select("statement_id", score.alias("score"), (score >= 2).alias("is_statement"))


def transactions(lines: DataFrame, default_year: int) -> DataFrame:
    """(statement_id, date, time, description, type, category, amount) from (statement_id, line_no, text).

    A line that begins with a day and a month opens a transaction. Within it the last time and amount win, and the first type
    and category; the description is what follows the last time that has text, else the first action line. Lines before the first
    date and transactions without an amount are left out.
    """
    rows = lines.withColumn("text", F.trim("text")).where("text <> ''")
    t, low = F.col("text"), F.lower("text")
    is_date = t.rlike(r"^\d{1,2}\s+[A-Za-z]{3,}")
    header = F.regexp_extract(t, r"'(\d{2})", 1)
    by = Window.partitionBy("statement_id")
    year = F.min(F.when((F.col("line_no") <= 50) & (header != ""), F.struct("line_no", header.alias("y")))).over(by)["y"]
    rows = rows.withColumns({
        "_year": F.coalesce(F.concat(F.lit("20"), year), F.lit(str(default_year))),
        "_g": F.sum(is_date.cast("int")).over(by.orderBy("line_no")),
    }).where("_g > 0")
    time = F.regexp_extract(t, r"\d{1,2}:\d{2}\s*(?:AM|PM)", 0)
    rest = F.trim(F.regexp_extract(t, r"\d{1,2}:\d{2}\s*(?:AM|PM)(.*)$", 1))
    body = ~is_date
    action = body & has_any(low, ACTION_WORDS)
    word_type = F.when(action & has_any(low, RECEIVED_WORDS), "received").when(action & has_any(low, PAID_WORDS), "paid")
    rs = body & F.contains(low, F.lit("rs."))
    amount = F.when(rs, amount_of(t))
    kind = F.coalesce(word_type, F.when(amount.isNotNull(), flow_of(t)))
    tag = F.when(body, F.regexp_extract(t, r"#\s*([A-Za-z\s]+)", 1))
    first = lambda v, ok: F.min_by(v, F.when(ok, F.col("line_no")))
    last = lambda v, ok: F.max_by(v, F.when(ok, F.col("line_no")))
    out = rows.groupBy("statement_id", "_g").agg(
        first(day_month(t, F.col("_year")), is_date).alias("date"), last(time, body & (time != "")).alias("time"),
        F.coalesce(last(rest, body & (time != "") & (rest != "")), first(t, action)).alias("description"),
        first(kind, kind.isNotNull()).alias("type"), first(F.trim(tag), tag != "").alias("category"), last(amount, amount.isNotNull()).alias("amount"),
    )
    return finalise(out.where("amount is not null").drop("_g"))


def finalise(txns: DataFrame) -> DataFrame:
    """Missing types from the sign, Uncategorized, empty descriptions."""
    return txns.withColumns({
        "description": F.coalesce("description", F.lit("")), "category": F.coalesce("category", F.lit("Uncategorized")),
        "type": F.coalesce("type", F.when(F.col("amount") < 0, "paid").otherwise("received")),
    })
