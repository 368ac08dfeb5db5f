"""Mail threads from their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.enrich import first_seen
from docloom.functions.mail import addresses, clean_body, decode_base64url, header, iso_date
from docloom.functions.text import ustrip


def assemble(messages: DataFrame) -> DataFrame:
    """One row for each thread of ``(thread_id, pos, sender, recipients array, subject, date, body, labels array)``.

    Subject, sender, recipients and date are the first message's; labels are
    distinct in the order of first appearance; the body has a From and Date
    head over each message that is not blank.
    """
    own = F.struct("pos", "sender", "recipients", "subject", "date", "body", "labels")
    grouped = messages.groupBy("thread_id").agg(F.array_sort(F.collect_list(own)).alias("m"))
    filled = F.filter("m", lambda x: ustrip(F.coalesce(x["body"], F.lit(""))) != "")
    parts = F.transform(filled, lambda x: F.concat(F.lit("From: "), F.coalesce(x["sender"], F.lit("")), F.lit("\nDate: "), F.coalesce(x["date"], F.lit("")), F.lit("\n\n"), x["body"]))
    first = F.col("m")[0]
    return grouped.select(
        "thread_id", first["subject"].alias("subject"), first["sender"].alias("sender"), first["recipients"].alias("recipients"), first["date"].alias("date"),
        first_seen(F.transform("m", lambda x: F.coalesce(x["labels"], F.array().cast("array<string>")))).alias("labels"),
        F.array_join(parts, "\n\n---\n\n").alias("body"), F.size("m").alias("n_messages"),
    )


def parse_messages(raw: DataFrame, is_html: bool = False) -> DataFrame:
    """Message rows for :func:`assemble` from ``(thread_id, pos, headers, plain, html, internal_ms, labels)``.

    Bodies are base64url parts; plain ones win over HTML ones, and quoted mail
    is cut from each message before the thread is put together.
    """
    join = lambda c: F.array_join(F.transform(c, decode_base64url), "\n")
    plain, html = join("plain"), join("html")
    body = F.when(plain != "", clean_body(plain, is_html)).otherwise(clean_body(html, True))
    to = F.concat(addresses(header("headers", "To")), addresses(header("headers", "Cc")))
    return raw.select(
        "thread_id", "pos", header("headers", "From").alias("sender"), to.alias("recipients"), header("headers", "Subject").alias("subject"),
        iso_date(header("headers", "Date"), F.col("internal_ms")).alias("date"), body.alias("body"), "labels",
    )


def from_sender(threads: DataFrame, mailbox: str) -> DataFrame:
    return threads.where(F.contains(F.lower("sender"), F.lit(mailbox.lower())))
