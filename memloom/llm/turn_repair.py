"""Repair of a conversation's structure by error-correcting Earley parsing.

The grammar of roles is S -> (nothing) | P | s P, P -> T | P T, T -> u a. Its error productions keep a row (cost 0),
give it the other role (1), delete it (2) or insert an empty turn (5). A chart item is a rule with a dot and the chart
where the rule began; it retains the least (cost, audit), where the audit has the initial of each edit.
Of items with the same rule and dot the least is kept, whichever chart they began in: the grammar is regular, so what may
follow depends on rule and dot alone, and a chart has at most a dozen items however long the conversation is.
"""

from __future__ import annotations

import itertools
import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: (left side, right side); lower case are role initials.
GRAMMAR = (("S", ""), ("S", "P"), ("S", "sP"), ("P", "T"), ("P", "PT"), ("T", "ua"))
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
INSERTED = {"u": "user", "a": "assistant"}
#: From any item what another may do later is had by inserting a turn pair and deleting one system row at most; a dearer item never wins.
SPREAD = 2 * INSERT + DELETE
LEGAL = frozenset(("su", "ua", "au"))
SPACE = r"[\x20\x09-\x0D]"
FAULTS = ("none", "blank", "duplicate", "truncated")
#: Rows after which a chart's common beginning of audits is set aside.
FLUSH = 512
#: Conversations of up to so many rows are looked up by their rows' signs before they are parsed.
KNOWN_ROWS, KNOWN = 24, 50_000


@dataclass(frozen=True)
class Row:
    """What the parser sees of a row: the role's initial, whether it must go, and whether it ends too early."""

    initial: str
    must_go: bool = False
    truncated: bool = False


class Chart:
    """Items by (rule, dot): (cost, audit, the items that waited in the chart where the rule began, each with its own such chart)."""

    def __init__(self):
        self.items: dict[tuple[int, int], tuple[int, str, dict]] = {}

    def offer(self, key: tuple[int, int], cost: int, audit: str, began: dict) -> bool:
        old = self.items.get(key)
        if old is not None and old[:2] <= (cost, audit):
            return False
        self.items[key] = (cost, audit, began)
        return True

    def close(self) -> Chart:
        """Predict, complete and insert until no item gets cheaper."""
        here: dict = {}
        todo = list(self.items)
        while todo:
            key = todo.pop()
            rule, dot = key
            cost, audit, began = self.items[key]
            left, right = GRAMMAR[rule]
            made = []
            if dot == len(right):  # complete: what waited for the rule's left side goes on
                made = [((r, d + 1), cost, audit, b) for (r, d), b in began.items() if GRAMMAR[r][1][d] == left]
            elif right[dot].isupper():  # predict
                made = [((r, 0), cost, audit, here) for r, (name, _) in enumerate(GRAMMAR) if name == right[dot]]
                if key not in here:  # rules that began and ended in this chart go on from this item, too
                    todo += [(r, d) for (r, d), v in self.items.items() if v[2] is here and d == len(GRAMMAR[r][1])]
                here[key] = began
            elif right[dot] in INSERTED:
                made = [((rule, dot + 1), cost + INSERT, audit + "I", began)]
            todo += [key for key, *value in made if self.offer(key, *value)]
        return self

    def read(self, row: Row) -> Chart:
        """The next chart: each item deletes the row, or keeps or reroles it where a role stands after its dot."""
        after = Chart()
        for (rule, dot), (cost, audit, began) in self.items.items():
            after.offer((rule, dot), cost + DELETE, audit + "D", began)
            role = GRAMMAR[rule][1][dot : dot + 1]
            if row.must_go or not role.islower():
                continue
            more = cost + (TRUNCATED if row.truncated else 0)
            if role == row.initial:
                after.offer((rule, dot + 1), more, audit + "K", began)
            elif role in INSERTED:
                after.offer((rule, dot + 1), more + REROLE, audit + "R", began)
        return after.close().pruned()

    def pruned(self) -> Chart:
        most = min(v[0] for v in self.items.values()) + SPREAD
        self.items = {k: v for k, v in self.items.items() if v[0] <= most}
        return self

    def settled(self) -> str:
        """Take off what all audits begin with."""
        head = os.path.commonprefix([v[1] for v in self.items.values()])
        if head:
            self.items = {k: (c, a[len(head) :], b) for k, (c, a, b) in self.items.items()}
        return head

    def complete(self) -> tuple[int, str]:
        return min((c, a) for (r, d), (c, a, _) in self.items.items() if GRAMMAR[r][0] == "S" and d == len(GRAMMAR[r][1]))


def start() -> Chart:
    chart = Chart()
    for r, (name, _) in enumerate(GRAMMAR):
        if name == "S":
            chart.offer((r, 0), 0, "", {})
    return chart.close()


class Parser:
    """Reads a conversation's rows one by one; memory is its audit's."""

    def __init__(self):
        self.chart, self.heads, self.n = start(), [], 0

    def read(self, row: Row) -> None:
        self.chart = self.chart.read(row)
        self.n += 1
        if self.n % FLUSH == 0:
            self.heads.append(self.chart.settled())

    def repair(self) -> tuple[int, str]:
        """The least cost and, of the audits that have it, the least in ASCII order."""
        cost, audit = self.chart.complete()
        return cost, "".join(self.heads) + audit


def parse(rows) -> tuple[int, str]:
    parser = Parser()
    for row in rows:
        parser.read(row)
    return parser.repair()


def repaired(rows, audit: str):
    """(role, text) of each turn that the audit leaves, from (role, text) of the rows; roles of edits follow from their places."""
    rows, at, shift = iter(rows), 0, 0
    for edit in audit:
        if edit == "D":
            next(rows)
            continue
        place = "ua"[(at - shift) % 2]
        if edit == "I":
            yield INSERTED[place], ""
        else:
            role, text = next(rows)
            if edit == "R":
                role = INSERTED[place]
            elif at == 0 and role[:1] == "s":
                shift = 1
            yield role, text
        at += 1


def damage(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, dropped) after each row's damage by crc32 of ``conv_id:turn`` modulo 20.

    0 drops the row (``dropped``, so that its conversation stays known), 1 empties its text, 2 takes out its ``[.!?]``, 3 repeats it, 4
    makes it the user's. Null roles and texts, and nulls in the key, are one space; repeated rows are damaged alike.
    """
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), blank("role").alias("role"), blank("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]+", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), times.alias("again")).drop("again")


def sign(initial: str, fault: int) -> str:
    """A letter for what the parser sees of a row, so that a short conversation is one string."""
    return chr(97 + 4 * (1 + "sua".find(initial if initial in ("s", "u", "a") else "?")) + fault)


ROWS = {sign(i, f): Row(i, f in (1, 2), f == 3) for i in "sua?" for f in range(len(FAULTS))}


class _Conversation:
    """Counts and the parse of one conversation, row by row."""

    def __init__(self):
        self.low = self.high = self.before = None
        self.turns = self.illegal = 0
        self.counts = [0] * len(FAULTS)
        self.signs: list[str] = []
        self.parser: Parser | None = None

    def add(self, turn: int | None, initial: str, fault: int) -> None:
        if turn is not None and turn != self.high:  # turns come in order
            self.turns += 1
            self.low, self.high = turn if self.low is None else self.low, turn
        self.illegal += self.before is not None and self.before + initial not in LEGAL
        self.before = initial
        self.counts[fault] += 1
        self.signs.append(sign(initial, fault))
        if len(self.signs) > KNOWN_ROWS:
            self._parse()

    def _parse(self) -> None:
        self.parser = self.parser or Parser()
        for c in self.signs:
            self.parser.read(ROWS[c])
        self.signs.clear()

    def result(self, known: dict) -> tuple:
        if self.parser:
            self._parse()
            told = self.parser.repair()
        else:
            signs = "".join(self.signs)
            told = known.get(signs) or parse(ROWS[c] for c in signs)
            if len(known) < KNOWN:
                known[signs] = told
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, *self.counts[1:], self.illegal, *told


def _rows(batches):
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _batches(results, schema):
    import pyarrow as pa

    results = iter(results)
    while part := list(itertools.islice(results, 1024)):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*part, strict=True), schema, strict=True)], schema=schema)


_NUMBERS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _parsed(batches):
    """Rows come by conversation, turn, role and digest; a row for each conversation goes out."""
    import pyarrow as pa

    known: dict[str, tuple[int, str]] = {}

    def results():
        for conv, rows in itertools.groupby(_rows(batches), lambda r: r[0]):
            now = _Conversation()
            for _, turn, initial, fault, dropped in rows:
                if not dropped:
                    now.add(turn, initial, fault)
            yield conv, *now.result(known)

    yield from _batches(results(), pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in _NUMBERS), ("audit", pa.string())]))


def _digested(batches):
    """Rows come by conversation: its parse, then its rows in order; the parse goes out with the repaired rows' digest."""
    import hashlib

    import pyarrow as pa

    def results():
        for conv, rows in itertools.groupby(_rows(batches), lambda r: r[0]):
            _, told, _, _ = next(rows)
            digest, mark = hashlib.sha256(), b""
            for role, text in repaired(((role, text) for _, _, role, text in rows), told["audit"]):
                digest.update(mark + f"{role}:{text}".encode())
                mark = b"\n"
            yield conv, *(told[n] for n in _NUMBERS), told["audit"], digest.hexdigest()

    yield from _batches(results(), pa.schema([("conv_id", pa.int64()), *((n, pa.int64()) for n in _NUMBERS), ("audit", pa.string()), ("repaired_sha256", pa.string())]))


def repair(damaged: DataFrame) -> DataFrame:
    """Per conversation of ``damage``: gaps, blank, duplicate, truncated, illegal, cost, audit and repaired_sha256.

    Rows stand by turn (nulls first), then role and the text's digest. A row with an empty role can't be kept as it is;
    null conv_ids are one conversation; a conversation whose rows are all dropped has zeros, an empty audit and the digest of
    nothing. An empty table gives no rows. Two passes: the parse reads a few bytes a row, the digest streams the texts; both hold
    an audit at most, but a conversation's rows pass through one task, since its digest is sequential.
    """
    text = F.col("text")
    rows = damaged.select("conv_id", "turn", "role", "text", "dropped", F.unhex(F.md5(text.cast("binary"))).alias("digest"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "digest", "dropped").orderBy(F.col("turn").asc_nulls_first())) > 1
    blank = ~text.rlike(rf"[^{SPACE[1:]}")
    last = F.substring(F.rtrim(text, F.lit(" \t\n\x0b\f\r")), -1, 1)
    light = rows.select("conv_id", "turn", "role", "digest", "dropped", blank.alias("is_blank"), (~last.isin(".", "!", "?")).alias("cut_off"))
    fault = F.when(F.col("is_blank"), 1).when(F.col("again"), 2).when(F.col("cut_off"), 3).otherwise(0)
    light = light.withColumn("again", again).select("conv_id", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"), "dropped")
    order = ["turn", "role", "digest"]
    numbers = ", ".join(f"{n} long" for n in _NUMBERS)
    dealt = light.repartition("conv_id").sortWithinPartitions("conv_id", *order)
    told = dealt.select("conv_id", "turn", "initial", "fault", "dropped").mapInArrow(_parsed, f"conv_id long, {numbers}, audit string")
    heads = told.select("conv_id", F.struct(*_NUMBERS, "audit").alias("told"), *(F.lit(None).cast(k).alias(c) for c, k in (("turn", "long"), ("role", "string"), ("digest", "binary"), ("text", "string"))))
    bodies = rows.where("not dropped").select("conv_id", F.lit(None).cast(heads.schema["told"].dataType).alias("told"), *order, "text")
    both = heads.unionByName(bodies).withColumn("body", F.col("told").isNull())
    streamed = both.repartition("conv_id").sortWithinPartitions("conv_id", "body", *order)
    return streamed.select("conv_id", "told", "role", "text").mapInArrow(_digested, f"conv_id long, {numbers}, audit string, repaired_sha256 string")
