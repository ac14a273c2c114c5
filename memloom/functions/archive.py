"""Rich message bodies in the typed-stream form: the text out of the bytes, by expressions over their hex digits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The header, the mark before the text with the bytes that may stand before it, and the most bytes of a body.
HEADER = "040B" + b"streamtyped".hex().upper()
MARK, FRAMES = "012B", "84|95"
MOST_BYTES = 1 << 20
STATES = ("ok", "empty", "oversized", "header", "no_start", "length", "out_of_bounds", "not_utf8")


def _number(digits: Column, n: int) -> Column:
    """An unsigned little-endian number of n bytes."""
    return sum((F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("long") * (1 << (8 * k)) for k in range(n)), F.lit(0).cast("long"))


def typed_stream(body: Column) -> Column:
    """(text, state): the text where the state is ``ok``, else null and what is wrong with the bytes; null bytes are ``empty``.

    After the header comes, at whole bytes, the first mark that follows a frame's byte; then the text's length (one byte below 81, or
    two after 81, or four after 82 or FF) and its bytes, which must be UTF-8. What follows isn't read.
    """
    digits = F.hex(body)
    started = digits.rlike(f"^{HEADER}(?:..)*?(?:{FRAMES}){MARK}")
    found = F.regexp_extract(digits, f"^{HEADER}(?:..)*?(?:{FRAMES}){MARK}(.*)$", 1)
    first = F.conv(F.substring(found, 1, 2), 16, 10).cast("long")
    wide = F.when(first < 0x81, 0).when(first == 0x81, 2).when(first.isin(0x82, 0xFF), 4)
    size = F.when(wide == 0, first).when(wide == 2, _number(F.substring(found, 3, 4), 2)).when(wide == 4, _number(F.substring(found, 3, 8), 4))
    begin = 3 + 2 * wide
    held = F.length(found) >= 2 + 2 * wide
    raw = F.unhex(F.substr(found, begin, (2 * F.least(size, F.lit(MOST_BYTES))).cast("int")))
    text = F.try_validate_utf8(raw.cast("string"))
    state = (
        F.when(F.coalesce(F.length(body), F.lit(0)) == 0, "empty").when(F.length(body) > MOST_BYTES, "oversized").when(~digits.startswith(HEADER), "header")
        .when(~started, "no_start").when(F.coalesce(wide.isNull() | ~held | (size <= 0), F.lit(True)), "length")
        .when(begin - 1 + 2 * size > F.length(found), "out_of_bounds").when(text.isNull(), "not_utf8").otherwise("ok")
    )
    return F.struct(F.when(state == "ok", text).alias("text"), state.alias("state"))


def decode_bodies(rows: DataFrame, body: str = "body") -> DataFrame:
    """Adds ``decoded``: text and state of the column's bytes."""
    return rows.withColumn("decoded", typed_stream(F.col(body)))


def decode_counts(decoded: DataFrame) -> DataFrame:
    """(state, n) of ``decode_bodies``, a row for each state that occurs."""
    return decoded.groupBy(F.col("decoded.state").alias("state")).agg(F.count("*").alias("n"))
