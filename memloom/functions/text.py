"""Text expressions, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memloom.config import STOP_WORDS

#: White space as an explicit class, so that other engines agree.
SPACE = r"[ \t\n\r\f\v]+"

# Shapes of secrets, in the order of replacement, and the label that replaces each.
SECRETS = (
    ("openai_sk_proj", "sk-proj-[A-Za-z0-9_-]{20,}"),
    ("openai_sk", "sk-[A-Za-z0-9]{20,}"),
    ("gcp_ya29", "ya29[.][A-Za-z0-9_-]{20,}"),
    ("gcp_aiza", "AIza[A-Za-z0-9_-]{35,60}"),
    ("github_pat", "(?:ghp|gho|ghs|ghr)_[A-Za-z0-9_]{36,}"),
    ("aws_access_key_id", "(?:AKIA|ASIA)[A-Z0-9]{16,20}"),
    ("slack_token", "(?:xox[bpa](?:pp)?|xapp)-[A-Za-z0-9-]{10,}"),
    ("stripe_live_key", "(?:sk|pk)_live_[A-Za-z0-9]{16,}"),
    ("anthropic_sk_ant", "sk-ant-[A-Za-z0-9_-]{20,}"),
    ("openrouter_sk_or_v1", "sk-or-v1-[A-Za-z0-9_-]{20,}"),
    ("jwt", "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]+"),
)


def tokens(text: Column) -> Column:
    """Lower-case ASCII word tokens without stop words."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9_]+"), lambda t: (t != "") & ~t.isin(STOP_WORDS))


def normalised(text: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(text, f"^{SPACE}|{SPACE}$", ""), SPACE, " "))


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("c:"), F.sha2(normalised(text), 256))


#: What stands in any of the shapes; of a text without it nothing else is looked at.
SECRET_SIGNS = "sk-|ya29[.]|AIza|gh[posr]_|AKIA|ASIA|xox[bpa]|xapp|_live_|eyJ"


def redact(text: Column) -> Column:
    """Secrets as their labels. A shape counts only where no letter, digit, underscore or hyphen stands before it."""
    made = text
    for name, shape in SECRETS:
        made = F.regexp_replace(made, f"(?<![A-Za-z0-9_-]){shape}", f"[REDACTED:{name}]")
    return F.when(text.rlike(SECRET_SIGNS), made).otherwise(text)


def short_hash(prefix: str, value: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(value, 256), 1, 12))
