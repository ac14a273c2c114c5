"""Message stores: mail bodies, and the joins that make rows of exported chat and mail tables.

The stores are exported to Parquet or read by JDBC; functions here take their tables as DataFrames. Rows come
after a cursor, in the order of the key (keyset pages), so that a page never scans what was read before.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "message_id string, subject string, sender string, recipients array<string>, copied array<string>, body string, defects int"
#: Seconds from 1970 to 2001, from which Apple's stores count.
APPLE_EPOCH = 978_307_200


def _decoded(raw: bytes | None) -> dict | None:
    """One message; an emlx file has its length in the first line and a property list after the message."""
    import email
    import email.header
    import email.policy
    import re
    from email.utils import getaddresses

    if raw is None:
        return None
    first, _, rest = raw.partition(b"\n")
    if re.fullmatch(rb"\s*\d+\s*", first):
        raw = rest[: int(first)]
    m = email.message_from_bytes(raw, policy=email.policy.compat32.clone(raise_on_defect=False))
    said = lambda name: [str(email.header.make_header(email.header.decode_header(str(v)))) for v in m.get_all(name, [])]
    defects = 0

    def safe(name):
        nonlocal defects
        try:
            return said(name)
        except (LookupError, ValueError):
            defects += 1
            return [str(v) for v in m.get_all(name, [])]

    def shown(kind):
        """Text of the leaves of a type that aren't attachments; bytes that don't decode become U+FFFD."""
        nonlocal defects
        out = []
        for part in m.walk():
            if part.get_content_type() == kind and part.get_content_disposition() != "attachment":
                data = part.get_payload(decode=True) or b""
                try:
                    out.append(data.decode(part.get_content_charset() or "utf-8", "replace"))
                except LookupError:
                    defects += 1
                    out.append(data.decode("utf-8", "replace"))
        return "\n".join(out).replace("\r\n", "\n").strip()

    import html

    marked = re.sub(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", "", shown("text/html"))
    plain = shown("text/plain") or html.unescape(re.sub(r"(?s)<[^>]*>", "", re.sub(r"(?i)<(br|/p|/div|/tr|/li)\b[^>]*>", "\n", marked))).strip()
    addresses = lambda name: [a.lower() for _, a in getaddresses(safe(name)) if a]
    one = lambda name: next(iter(safe(name)), None)
    return {
        "message_id": one("message-id"), "subject": one("subject"), "sender": next(iter(addresses("from")), None),
        "recipients": addresses("to"), "copied": addresses("cc"), "body": plain, "defects": defects + len(m.defects),
    }


def decode_mail(raw: Column) -> Column:
    """A struct of headers and plain body of RFC 5322 or emlx bytes; null for null, empty fields for none."""
    @F.pandas_udf(PARTS)
    def run(batch: pd.Series) -> pd.DataFrame:
        names = [f.split()[0] for f in PARTS.split(", ")]
        return pd.DataFrame([_decoded(x) or dict.fromkeys(names) for x in batch], columns=names).astype({"defects": "Int32"})

    return F.when(raw.isNotNull(), run(raw))


def apple_time(nanoseconds: Column) -> Column:
    """Timestamp of nanoseconds (or, in old stores, seconds) since 2001."""
    seconds = F.when(F.abs(nanoseconds) > 10**11, nanoseconds / 10**9).otherwise(nanoseconds)
    return F.timestamp_micros(((seconds + APPLE_EPOCH) * 10**6).cast("long"))


def chat_messages(message: DataFrame, handle: DataFrame, chat_join: DataFrame, chat: DataFrame, after: int = 0) -> DataFrame:
    """Rows past the cursor with their sender, thread and the thread's number of members' messages.

    ``message``: row_id, handle_id, date, is_from_me, text; ``handle``: row_id, address; ``chat_join``: message_id,
    chat_id; ``chat``: row_id, guid. A message in several chats goes to the least chat id; one in none has no thread.
    """
    new = message.where(F.col("row_id") > after)
    placed = chat_join.groupBy(F.col("message_id").alias("row_id")).agg(F.min("chat_id").alias("chat_id"))
    sizes = chat_join.groupBy("chat_id").agg(F.count("*").alias("thread_messages"))
    senders = handle.select(F.col("row_id").alias("handle_id"), "address")
    threads = chat.select(F.col("row_id").alias("chat_id"), F.col("guid").alias("thread"))
    rows = new.join(placed, "row_id", "left").join(senders, "handle_id", "left").join(threads, "chat_id", "left").join(sizes, "chat_id", "left")
    sender = F.when(F.col("is_from_me") == 1, "me").otherwise(F.col("address"))
    return rows.select("row_id", apple_time(F.col("date")).alias("ts"), sender.alias("sender"), "thread", F.coalesce("thread_messages", F.lit(0)).alias("thread_messages"), "text")


def mail_messages(message: DataFrame, address: DataFrame, subject: DataFrame, mailbox: DataFrame, recipient: DataFrame, after: int = 0) -> DataFrame:
    """Rows past the cursor with sender, subject, folder, and recipients by position (type 0 to, 1 cc).

    ``message``: row_id, sender, subject, mailbox, date; ``recipient``: message, address, type, position.
    """
    new = message.where(F.col("row_id") > after)
    names = address.select(F.col("row_id").alias("address"), F.col("address").alias("name"))
    who = recipient.join(names, "address").groupBy(F.col("message").alias("row_id"))
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("type") == kind, F.struct("position", "name")))), lambda p: p["name"])
    to = who.agg(listed(0).alias("to"), listed(1).alias("cc"))
    rows = new.join(names.select(F.col("address").alias("sender"), F.col("name").alias("from")), "sender", "left")
    rows = rows.join(subject.select(F.col("row_id").alias("subject"), F.col("subject").alias("title")), "subject", "left")
    rows = rows.join(mailbox.select(F.col("row_id").alias("mailbox"), F.col("url").alias("folder")), "mailbox", "left").join(to, "row_id", "left")
    none = F.array().cast("array<string>")
    return rows.select("row_id", F.timestamp_seconds("date").alias("ts"), "from", F.col("title").alias("subject"), "folder", F.coalesce("to", none).alias("to"), F.coalesce("cc", none).alias("cc"))


def session_messages(message: DataFrame, session: DataFrame, member: DataFrame, after: int = 0) -> DataFrame:
    """Rows past the cursor of ``message``: pk, session, member, parent, from_me, date, text.

    The sender is the group's member, else the session's other side; the quoted text is the parent's.
    """
    new = message.where(F.col("pk") > after)
    quoted = message.select(F.col("pk").alias("parent"), F.col("text").alias("quoted"))
    rows = new.join(quoted, "parent", "left").join(session.select(F.col("pk").alias("session"), "jid"), "session", "left")
    rows = rows.join(member.select(F.col("pk").alias("member"), F.col("jid").alias("member_jid")), "member", "left")
    sender = F.when(F.col("from_me") == 1, "me").otherwise(F.coalesce("member_jid", "jid"))
    return rows.select("pk", apple_time(F.col("date")).alias("ts"), F.col("jid").alias("thread"), sender.alias("sender"), "text", "quoted")


def address_book(record: DataFrame, phone: DataFrame, mail: DataFrame) -> DataFrame:
    """(name, handle, kind) for each phone number and address of a record (pk, first, last, organisation)."""
    full = F.nullif(F.trim(F.concat_ws(" ", "first", "last")), F.lit(""))
    names = record.select(F.col("pk").alias("owner"), F.coalesce(full, "organisation").alias("name"))
    handles = phone.select("owner", F.col("number").alias("handle"), F.lit("phone").alias("kind"))
    handles = handles.unionByName(mail.select("owner", F.lower("address").alias("handle"), F.lit("email").alias("kind")))
    return names.join(handles, "owner").select("name", "handle", "kind").distinct()


def turns(rows: DataFrame) -> DataFrame:
    """(session, turn, user, assistant) of session logs ``session, seq, role, text``: each user row opens a turn.

    Assistant rows up to the next user row are joined by line breaks; those before the first user row are turn 0.
    """
    w = Window.partitionBy("session").orderBy("seq")
    numbered = rows.withColumn("turn", F.sum((F.col("role") == "user").cast("int")).over(w))
    said = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("seq", "text")))), lambda p: p["text"])
    return numbered.groupBy("session", "turn").agg(F.array_join(said("user"), "\n").alias("user"), F.array_join(said("assistant"), "\n").alias("assistant"))
