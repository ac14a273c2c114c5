"""Who is who: people from shared identifiers, and addresses that may be the operator's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memloom.operators import graph
from memloom.session import written

OPERATOR = "person:operator"


def identifier(raw: Column) -> Column:
    """``kind:value`` of a handle: email in lower case, phone as digits with a plus; null for neither."""
    bare = F.trim(raw)
    digits = F.regexp_replace(bare, "[^0-9]", "")
    phone = bare.rlike(r"^\+?[0-9 ().\-]+$") & F.length(digits).between(7, 15)
    return F.when(bare.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"), F.concat(F.lit("email:"), F.lower(bare))).when(phone, F.concat(F.lit("phone:+"), digits))


def people(members: DataFrame, own: DataFrame) -> DataFrame:
    """(member, person) of ``members``: member, identifier; a member with several identifiers has several rows.

    Members that share an identifier, by any chain, are one person, named by the hash of the least member;
    those linked to an identifier in ``own`` (identifier) are the operator. A null identifier links nothing.
    """
    node = lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    known = members.where("member is not null").select(node("m:", F.col("member")).alias("a"), node("i:", F.col("identifier")).alias("i")).distinct()
    group = graph.components(known.select("a", F.coalesce("i", "a").alias("b")))
    mine = own.select(node("i:", F.col("identifier")).alias("id")).distinct().withColumn("mine", F.lit(True))
    marked = group.join(mine, "id", "left")
    label = F.when(F.startswith("id", F.lit("m:")), F.substring("id", 3, 1 << 30))
    named = marked.groupBy("component").agg(F.min(label).alias("least"), F.bool_or(F.coalesce("mine", F.lit(False))).alias("mine"))
    minted = F.concat(F.lit("person:"), F.substring(F.sha1("least"), 1, 12))
    person = named.select("component", F.when(F.col("mine"), OPERATOR).otherwise(minted).alias("person"))
    return group.withColumn("member", label).where("member is not null").join(person, "component").select("member", "person")


def aliases(mail: DataFrame, registered: DataFrame, least_rows: int = 50, least_share: float = 0.5) -> DataFrame:
    """(address, total_rows, direct_rows, sole_direct_rows, account_share, dominant) of addresses not registered.

    ``mail``: account, to, cc (arrays of addresses), direct, outbound, junk; null flags are false. A row that came in,
    isn't junk and has no copy is solely direct if nobody else but registered addresses got it. An address dominates
    an account of enough rows if it stands on enough of them.
    """
    names = [F.coalesce(c, F.array().cast("array<string>")).alias(c) for c in ("to", "cc")]
    rows = mail.select("account", *names, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("direct", "outbound", "junk")])
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "mail")  # written, so that a row keeps its number
    named = rows.withColumn("address", F.explode(F.array_union("to", "cc"))).where("address is not null")
    each = named.join(registered.select("address").where("address is not null").distinct(), "address", "left_anti")
    # Addresses that aren't registered decide who else got the row; a window holds one row's addresses.
    direct_to = F.array_contains("to", F.col("address"))
    others = F.count_if(direct_to).over(Window.partitionBy("row"))
    each = each.withColumns({"others": others, "direct_to": direct_to})
    sole = F.col("direct") & ~F.col("outbound") & ~F.col("junk") & (F.size("cc") == 0) & (F.col("others") == 1) & F.col("direct_to")
    part = each.groupBy("address", "account").agg(F.count("*").alias("n"), F.count_if("direct").alias("d"), F.count_if(sole).alias("s"))
    accounts = rows.where("account is not null").groupBy("account").agg(F.count("*").alias("rows"))
    share = F.try_divide(F.col("n"), F.col("rows"))
    strong = (F.col("rows") >= least_rows) & (share >= least_share)
    return part.join(accounts, "account", "left").groupBy("address").agg(
        F.sum("n").alias("total_rows"), F.sum("d").alias("direct_rows"), F.sum("s").alias("sole_direct_rows"),
        F.coalesce(F.max(share), F.lit(0.0)).alias("account_share"), F.coalesce(F.bool_or(strong), F.lit(False)).alias("dominant"),
    )


def reply_contacts(mail: DataFrame, least: int = 1) -> DataFrame:
    """(address, n): who was written to in at least so many outbound messages of ``message, outbound, to``."""
    sent = mail.where("outbound").select("message", F.explode(F.array_distinct("to")).alias("address"))
    return sent.groupBy("address").agg(F.count_distinct("message").alias("n")).where(F.col("n") >= least)
