"""Admission rules of each source, as one ordered CASE.

A rule is (condition, decision, reason, score); the first that holds wins. Columns that a source's
rows lack are taken as null, and a null condition doesn't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memloom.functions.text import SPACE

FIELDS = {
    "text": "string", "sender": "string", "from_me": "boolean", "kind": "string", "subtype": "string", "peer_type": "string", "media": "string",
    "forwarded_from": "string", "ttl": "long", "edited": "boolean", "starred": "boolean", "duplicate": "boolean", "subject": "string",
    "mailbox": "string", "list_id": "string", "auto_submitted": "string", "precedence": "string", "return_path": "string", "body": "string",
    "operator": "boolean", "bot": "boolean", "suggested": "double", "seconds": "double", "title": "string", "assistant_text": "string",
    "seen_before": "boolean", "before_text": "string", "commits": "long", "paired": "boolean",
}

# One-time codes, regulatory footers and addresses that nobody reads.
CODE = "(?i)(verification|security|one[- ]time|login|passcode|otp)[^0-9]{0,40}[0-9]{4,10}|[0-9]{4,10} is your [a-z ]{0,40}code"
FOOTER = "(?i)(reply|text|txt) stop|msg ?& ?data rates|stop to (end|opt)"
NOREPLY = "(?i)(no-?reply|do-?not-?reply|mailer-daemon)"
TAPBACKS = tuple(str(k) for k in range(2000, 2005))
LIFECYCLE = ("channel_join", "channel_leave", "channel_topic", "channel_purpose", "channel_name", "channel_archive")

PASS, DROP, REDACT = "PASS", "DROP", "REDACT_DROP"


def _c(name: str) -> Column:
    return F.col(name)


def _blank(name: str) -> Column:
    return F.coalesce(F.regexp_replace(_c(name), SPACE, ""), F.lit("")) == ""


def _length(name: str = "text") -> Column:
    return F.length(F.regexp_replace(F.coalesce(_c(name), F.lit("")), f"^{SPACE}|{SPACE}$", ""))


def _by_length(cliff: int, long: float, short: float) -> Column:
    return F.when(_length() >= cliff, long).otherwise(short)


def rules() -> dict[str, list[tuple[Column, str, str | None, Column | float]]]:
    """The rules of each source in order; the last of each holds always."""
    always, text, me = F.lit(True), _c("text"), F.coalesce("from_me", F.lit(False))
    shortcode = _c("sender").rlike("^[0-9]{3,6}$")
    return {
        "imessage": [
            (_c("kind").isin(*TAPBACKS), DROP, "tapback", 0.0),
            (_c("sender").rlike("^(urn:biz:|BIZ:)"), DROP, "business_handle", 0.0),
            (_c("bot"), DROP, "bot_message", 0.0),
            (text.rlike(CODE) & ~me, REDACT, "otp_strict", 0.0),
            (shortcode & text.rlike(FOOTER), DROP, "shortcode_full", 0.0),
            (shortcode, PASS, "shortcode_redacted_kept", 0.3),
            (text.rlike(FOOTER) & ~me, DROP, "a2p_regulatory_footer", 0.0),
            (text.rlike("^ *https?://[^ ]+ *$"), PASS, "url_only", 0.35),
            (_blank("text"), DROP, "placeholder", 0.0),
            (always, PASS, None, _by_length(25, 0.85, 0.4)),
        ],
        "mail": [
            (_c("mailbox").rlike("(?i)(junk|spam|trash)"), DROP, "junk_mailbox", 0.0),
            (_c("list_id").isNotNull(), DROP, "list_mail", 0.0),
            (_c("auto_submitted").rlike("(?i)^auto-"), DROP, "auto_submitted", 0.0),
            (_c("precedence").rlike("(?i)^(bulk|junk|list)$"), DROP, "bulk_precedence", 0.0),
            (_c("sender").rlike(NOREPLY) | _c("return_path").rlike(NOREPLY), DROP, "noreply_sender", 0.0),
            (_c("subject").rlike("(?i)^(automatic reply|out of office|auto:)"), DROP, "autoreply_subject", 0.0),
            (_c("subject").rlike(r"^\[[^\]]+\] *$"), DROP, "bracket_noise", 0.0),
            (text.rlike(CODE), REDACT, "otp", 0.0),
            (_length() < 2, DROP, "placeholder_residual", 0.0),
            (always, PASS, None, _by_length(200, 0.85, 0.4)),
        ],
        "telegram": [
            (_c("sender").rlike("(?i)bot$"), DROP, "bot_message", 0.0),
            (_c("forwarded_from").rlike("(?i)bot$"), DROP, "bot_forward", 0.0),
            (_c("ttl").between(1, 7 * 86400) & ~me, DROP, "ephemeral", 0.0),
            (_c("media").isin("voice", "video_note") & _blank("text"), DROP, "media_only", 0.0),
            (_c("media").isin("sticker", "animation") & _blank("text"), DROP, "sticker", 0.0),
            ((_c("peer_type") == "channel") & _c("forwarded_from").isNotNull() & ~me, DROP, "channel_forward_echo", 0.0),
            ((_c("peer_type") == "channel") & ~me, DROP, "channel_broadcast", 0.0),
            (_c("edited"), PASS, None, F.greatest(F.lit(0.45), _by_length(64, 0.8, 0.5))),
            (always, PASS, None, _by_length(64, 0.8, 0.5)),
        ],
        "slack": [
            (_c("duplicate") & (_length() >= 30), DROP, "cross_source_duplicate", 0.0),
            (_c("bot"), DROP, "bot_message", 0.0),
            (_c("sender") == "USLACKBOT", DROP, "slackbot", 0.0),
            (_c("subtype").isin(*LIFECYCLE), DROP, "lifecycle", 0.0),
            (_c("subtype").isin("thread_broadcast", "file_share") & _blank("text"), DROP, "empty_share", 0.0),
            ((_c("subtype") == "message_changed") & (_blank("text") | text.eqNullSafe(_c("before_text"))), DROP, "noop_edit", 0.0),
            (_blank("text") & _c("media").isNull(), DROP, "empty", 0.0),
            (always, PASS, None, _by_length(25, 0.8, 0.45)),
        ],
        "whatsapp": [
            (_c("duplicate") & (_length() >= 25), DROP, "cross_source_duplicate", 0.0),
            (_c("kind") == "reaction", DROP, "reaction", 0.0),
            (_c("peer_type") == "broadcast", DROP, "broadcast", 0.0),
            (text.eqNullSafe(_c("sender")) & text.isNotNull(), DROP, "identifier_placeholder", 0.0),
            (_c("kind").isin("call", "system"), DROP, "low_signal_type", 0.0),
            (_c("media").isNotNull() & _blank("text"), DROP, "media_no_caption", 0.0),
            (text.rlike(CODE), REDACT, "otp", 0.0),
            (_length() < 2, DROP, "placeholder", 0.0),
            (_c("starred"), PASS, None, 0.9),
            (always, PASS, None, _by_length(25, 0.8, 0.45)),
        ],
        "git-log": [
            (_c("operator") & ~F.coalesce("bot", F.lit(False)), PASS, None, F.greatest(F.lit(0.7), F.coalesce("suggested", F.lit(0.0)))),
            (_c("suggested") == 0.1, PASS, "upstream_only", 0.1),
            (_c("subject").rlike("(?i)^initial commit: .{26,}"), PASS, None, F.greatest(F.lit(0.55), F.coalesce("suggested", F.lit(0.0)))),
            (_c("subject").rlike("(?i)^initial commit"), DROP, "initial_commit", 0.0),
            (_c("subject").rlike("(?i)^merge ") & _blank("body"), DROP, "merge_only", 0.0),
            (_c("bot"), DROP, "bot_author", 0.0),
            (_c("duplicate"), DROP, "content_duplicate", 0.0),
            (always, PASS, None, F.when(_blank("body"), 0.5).otherwise(0.85)),
        ],
        "github-events": [
            (_c("kind").isin("WatchEvent", "ForkEvent"), DROP, "low_signal_type", 0.0),
            (_c("bot"), DROP, "bot_actor", 0.0),
            (_c("kind").isin("CreateEvent", "DeleteEvent") & _c("paired"), PASS, "branch_lifecycle_paired", 0.3),
            (_c("kind").isin("CreateEvent", "DeleteEvent"), DROP, "branch_lifecycle", 0.0),
            ((_c("kind") == "PushEvent") & _c("duplicate"), DROP, "duplicate_of_git_log", 0.0),
            ((_c("kind") == "PushEvent") & (_c("commits") == 0) & _c("operator"), PASS, "empty_push_own", 0.1),
            ((_c("kind") == "PushEvent") & (_c("commits") == 0), DROP, "empty_push", 0.0),
            (always, PASS, None, 0.7),
        ],
        "codex-cli": [
            (_blank("text") & _blank("assistant_text"), DROP, "empty", 0.0),
            (_c("seen_before"), PASS, "prompt_replay", 0.15),
            (always, PASS, None, F.when(_length() + _length("assistant_text") >= 64, 0.85).otherwise(0.55)),
        ],
        "chat-transcript": [
            (_blank("text") & _blank("assistant_text"), DROP, "empty_turn", 0.0),
            (_c("duplicate"), DROP, "cross_source_duplicate", 0.0),
            (always, PASS, None, F.when(_length() + _length("assistant_text") >= 64, 0.85).otherwise(0.55)),
        ],
        "screentime": [
            (_c("kind") == "discoverability", DROP, "discoverability", 0.0),
            ((_c("kind") == "notification") & _blank("title") & _blank("text"), DROP, "empty_notification", 0.0),
            ((_c("kind") == "usage") & (_c("seconds") < 5), DROP, "micro_burst", 0.0),
            (_c("duplicate"), DROP, "cross_source_duplicate", 0.0),
            (always, PASS, None, F.when(_c("seconds") < 30, 0.2).when(_c("seconds") < 120, 0.35).when(_c("seconds") < 600, 0.5).otherwise(0.65)),
        ],
    }


def admit(rows: DataFrame) -> DataFrame:
    """Adds decision, reason and structural_score by ``source``; an unknown source passes."""
    lacking = {name: F.lit(None).cast(kind) for name, kind in FIELDS.items() if name not in rows.columns}
    verdict = lambda d, r, s: F.struct(F.lit(d).alias("decision"), F.lit(r).cast("string").alias("reason"), (s if isinstance(s, Column) else F.lit(s)).cast("double").alias("structural_score"))
    made = None
    for source, listed in rules().items():
        for holds, decision, reason, score in listed:
            when = (F.col("source") == source) & holds
            made = F.when(when, verdict(decision, reason, score)) if made is None else made.when(when, verdict(decision, reason, score))
    full = rows.withColumns(lacking) if lacking else rows
    return full.withColumn("v", made.otherwise(verdict(PASS, "unknown_source", 0.5))).select(*rows.columns, "v.*")


def counters(admitted: DataFrame) -> DataFrame:
    """(source, decision, reason, n)."""
    return admitted.groupBy("source", "decision", "reason").agg(F.count("*").alias("n"))


def quarantine(admitted: DataFrame) -> DataFrame:
    """What an operator may want back: all that is not passed, with a checksum of its text to verify on restore."""
    return admitted.where(F.col("decision") != PASS).withColumn("checksum", F.sha2(F.coalesce("text", F.lit("")), 256))


def restore(held: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows asked back whose checksum still holds."""
    sound = held.where(F.sha2(F.coalesce("text", F.lit("")), 256) == F.col("checksum"))
    return sound.join(ids.select("id").distinct(), "id", "left_semi").drop("decision", "reason", "structural_score", "checksum")
