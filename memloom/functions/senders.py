"""Who or what a handle is by its shape, which paths hold an operator's work, which rows have nothing to say, and hashes of templates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Local parts of addresses that stand for a role.
ROLE_PARTS = (
    "noreply donotreply do-not-reply no-reply notification notifications notify alert alerts updates update news newsletter mailer mailer-daemon bounce bounces "
    "automailer auto system daemon support help helpdesk info hello contact team sales billing accounts admin administrator webmaster postmaster hostmaster abuse "
    "security marketing careers jobs feedback service services membership orders order receipts invoice invoices"
).split()
# Names of automatic actors, folders of foreign code, and bundles of the system and those of its applications.
BOT_NAMES = r"dependabot(?:\[bot\])?|renovate(?:\[bot\])?|renovate-bot|github-actions(?:\[bot\])?|copilot(?:\[bot\])?|web-flow|pr-bot|claude\[bot\]|gpt-engineer-app\[bot\]"
VENDOR_FOLDERS = "node_modules vendor third_party external submodules .cache build dist .venv target __pycache__".split()
SYSTEM_BUNDLES = (
    "com.apple.controlcenter com.apple.notificationcenterui com.apple.dock com.apple.finder.system com.apple.systemuiserver com.apple.WindowManager com.apple.loginwindow "
    "com.apple.spotlight com.apple.coreservices com.apple.systempreferences com.apple.preference. com.apple.PowerChime com.apple.ScreenTime com.apple.universalaccessAuthWarn com.apple.weather.menu"
).split()
APP_BUNDLES = "com.apple.iWork. com.apple.dt.Xcode com.apple.Safari com.apple.MobileSMS com.apple.mail com.apple.Notes com.apple.Music com.apple.Maps com.apple.Terminal com.apple.ScriptEditor".split()

_EDGE = r"^\s+|\s+$"


def _false(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, _EDGE, "")


def is_shortcode(handle: Column) -> Column:
    """Three to six digits, apart from the signs that numbers are written with."""
    bare = _bare(handle)
    digits = F.regexp_replace(bare, r"[\s()+\-.]", "")
    return _false(~bare.contains("@") & ~bare.rlike("^(?i)[a-z]+:") & digits.rlike("^[0-9]{3,6}$"))


def is_business(handle: Column) -> Column:
    """A handle of a business messaging service."""
    low = F.lower(_bare(handle))
    return _false(low.rlike("^urn:biz|^urn:business") | low.rlike(r"@(?:.*[.])?(?:rcs|rbm)\b") | low.rlike("@r(?:bm|cs)[.]"))


def is_role(address: Column) -> Column:
    """An address whose local part, without what follows a plus, names a role; also in parts, or with a tail that has a digit."""
    at = F.instr(address, "@")
    local = F.regexp_replace(F.lower(_bare(F.substring(address, F.lit(1), at - 1))), r"(?<=.)\+.*$", "")
    tokens = F.filter(F.split(local, "[._-]"), lambda t: t != "")
    joined = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(tokens) - 1)), lambda k: F.struct(F.array_join(F.slice(tokens, F.lit(1), k), "").alias("head"), F.array_join(F.slice(tokens, k + 1, F.greatest(F.lit(0), F.size(tokens) - k)), "").alias("tail")))
    tailed = (F.size(tokens) >= 2) & F.exists(joined, lambda x: x["head"].isin(*ROLE_PARTS) & x["tail"].rlike("[0-9]"))
    return _false((at > 1) & (local.isin(*ROLE_PARTS) | F.regexp_replace(local, "[._-]", "").isin(*ROLE_PARTS) | tailed))


def sender_kind(*handles: Column) -> Column:
    """``service`` if any of a sender's handles is a business's, a role's or a shortcode; else null."""
    found = F.lit(False)
    for test in (is_business, is_role, is_shortcode):
        for h in handles:
            found = found | test(h)
    return F.when(found, "service")


def is_bot(actor: Column) -> Column:
    """A known automatic actor, as a name or an address, also behind a number and a plus; any ``[bot]@``."""
    whole = f"^(?i)(?:{BOT_NAMES})(?:@.*)?$"
    # The local part is what stands before the first at sign, if anything does.
    local = F.regexp_extract(actor, "^([^@]+)@", 1)
    return _false(actor.rlike(whole) | actor.rlike(r"(?i)\[bot\]@") | local.rlike(rf"^(?i)(?:[0-9]+\+)?(?:{BOT_NAMES})$"))


def has_vendor_folder(path: Column) -> Column:
    return _false(F.arrays_overlap(F.split(path, r"[\\/]"), F.array(*[F.lit(v) for v in VENDOR_FOLDERS])))


def _starts(value: Column, names: list[str]) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | value.startswith(n)
    return found


def is_system_bundle(bundle: Column) -> Column:
    return _false(~_starts(bundle, APP_BUNDLES) & _starts(bundle, SYSTEM_BUNDLES))


def path_verdict(path: Column, repository: Column, allowed: list[str], own_commits: Column) -> Column:
    """(operator, reason, action) of a path: foreign folders and system bundles are dropped, repositories read only downgraded.

    ``own_commits`` says whether the operator committed there; where it is null nothing is known and the row passes.
    """
    verdict = lambda operator, reason, action: F.struct(F.lit(operator).alias("operator"), F.lit(reason).alias("reason"), F.lit(action).alias("action"))
    return (
        F.when(F.coalesce(path, F.lit("")) == "", verdict(False, "unknown", "PASS"))
        .when(has_vendor_folder(path), verdict(False, "vendor_skip", "DROP"))
        .when(is_system_bundle(path), verdict(False, "system_bundle", "DROP"))
        .when(_false((repository != "") & repository.isin(*allowed)), verdict(False, "allowlist_override", "DOWNGRADE"))
        .when(own_commits, verdict(True, "classified_operator", "PASS"))
        .when(~own_commits, verdict(False, "no_operator_commits", "DOWNGRADE"))
        .otherwise(verdict(False, "unknown", "PASS"))
    )


def content_free(fields: list[tuple[Column, T.DataType]], metadata: list[tuple[Column, T.DataType]]) -> Column:
    """Whether all declared texts are blank and all metadata is missing, false, nought, blank or an empty list; without fields never."""
    if not fields:
        return F.lit(False)
    empty = F.lit(True)
    for c, kind in fields:
        empty = empty & (F.coalesce(_bare(c), F.lit("")) == "" if isinstance(kind, T.StringType) else c.isNull())
    for c, kind in metadata:
        if isinstance(kind, T.StringType):
            empty = empty & (F.coalesce(_bare(c), F.lit("")) == "")
        elif isinstance(kind, T.BooleanType):
            empty = empty & ~F.coalesce(c, F.lit(False))
        elif isinstance(kind, T.NumericType):
            empty = empty & (F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0)) == 0)
        elif isinstance(kind, T.ArrayType):
            empty = empty & (F.coalesce(F.size(c), F.lit(0)) <= 0)
        else:
            empty = empty & c.isNull()
    return empty


def template_hash(text: Column) -> Column:
    """A 32-bit hash of the trimmed lower-case text in base 36; ``0`` for an empty or null one. Characters count by their code points."""
    codes = F.filter(F.split(F.lower(_bare(text)), ""), lambda c: c != "")
    hashed = F.aggregate(codes, F.lit(5381).cast("long"), lambda h, c: (h * 33 + F.ascii(c)).bitwiseAND(0xFFFFFFFF))
    return F.when(F.coalesce(text, F.lit("")) == "", "0").otherwise(F.lower(F.conv(hashed.cast("string"), 10, 36)))
