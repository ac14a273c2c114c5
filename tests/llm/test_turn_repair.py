"""Turn repair against all edit sequences, and whole conversations against plain Python."""

import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import types as T

from memloom.llm import turn_repair as tr

SCHEMA = "conv_id long, turn long, role string, text string, audit string, dropped string"
GOOD = re.compile(r"(s?(ua)+)?")


def brute(rows):
    """Least (cost, audit) over all edits; rows are (initial, must_go, truncated)."""
    best = None
    edits = [("D", None), ("K", None), ("R", "u"), ("R", "a")]
    for chosen in itertools.product(edits, repeat=len(rows)):
        if any(r[1] and c[0] != "D" for r, c in zip(rows, chosen)):
            continue
        base = sum({"D": 2, "K": 0, "R": 1}[c[0]] + 5 * (r[2] and c[0] != "D") for r, c in zip(rows, chosen))
        for n in range(4):
            for spots in itertools.combinations_with_replacement(range(len(rows) + 1), n):
                for kinds in itertools.product("ua", repeat=n):
                    roles, audit = [], []
                    for k in range(len(rows) + 1):
                        for s, i in zip(spots, kinds):
                            if s == k:
                                roles.append(i)
                                audit.append("I")
                        if k < len(rows):
                            c = chosen[k]
                            audit.append(c[0])
                            roles += [] if c[0] == "D" else [rows[k][0] if c[0] == "K" else c[1]]
                    if GOOD.fullmatch("".join(roles)):
                        found = (base + 5 * n, "".join(audit))
                        best = found if best is None or found < best else best
    return best


def test_least_cost_and_audit():
    rng = random.Random(3)
    for _ in range(80):
        rows = [(rng.choice("suuaaax"), rng.random() < 0.15, rng.random() < 0.3) for _ in range(rng.randint(0, 4))]
        assert tr.parse(tr.Row(*r) for r in rows) == brute(rows), rows


def plain(rows):
    """Dynamic program over the automaton's places, on whole conversations: place 0 nothing, 1 after s, 2 after u, 3 after a."""
    best = {0: (0, "")}

    def insert(b):
        for _ in range(3):
            for q, (c, a) in list(b.items()):
                to = {0: 2, 1: 2, 2: 3, 3: 2}[q]
                b[to] = min(b.get(to, (10**9, "")), (c + 5, a + "I"))
        return b

    best = insert(best)
    for initial, must_go, cut in rows:
        new = {}
        for q, (c, a) in best.items():
            ways = [(q, c + 2, "D")]
            if not must_go:
                want, to = {0: ("u", 2), 1: ("u", 2), 2: ("a", 3), 3: ("u", 2)}[q]
                ways.append((to, c + 5 * cut, "K") if initial == want else (to, c + 1 + 5 * cut, "R"))
                if q == 0 and initial == "s":
                    ways.append((1, c + 5 * cut, "K"))
            for to, cost, e in ways:
                new[to] = min(new.get(to, (10**9, "")), (cost, a + e))
        best = insert(new)
    return min(best[q] for q in (0, 3) if q in best)


def test_long_conversations_keep_few_items():
    rng = random.Random(5)
    for _ in range(3000):
        rows = [(rng.choice("ssuaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(0, 25))]
        assert tr.parse(tr.Row(*r) for r in rows) == plain(rows), rows
    rows = [(rng.choice("suaua"), rng.random() < 0.1, rng.random() < 0.2) for _ in range(3000)]
    parser = tr.Parser()
    for r in rows:
        parser.read(tr.Row(*r))
        assert len(parser.chart.items) <= 14
    assert parser.repair() == plain(rows)
    assert max(len(v[1]) for v in parser.chart.items.values()) < 1000


def damaged(rows):
    for conv, turn, role, text, *_ in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        for _ in range(0 if kind == 0 else 2 if kind == 3 else 1):
            yield conv, turn, role, text


def expected(rows):
    convs = {r[0]: [] for r in rows}
    for r in damaged(rows):
        convs[r[0]].append(r)
    for conv, found in convs.items():
        found.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        seen, signs, counts = set(), [], [0, 0, 0]
        for _, _, role, text in found:
            bare = text.strip(" \t\n\x0b\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            signs.append((role[:1], fault in (0, 1), fault == 2))
        turns = [r[1] for r in found if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(signs))
        cost, audit = plain(signs)
        left, rest, fixed = [], iter(found), "".join(audit)
        for e in fixed:
            if e == "D":
                next(rest)
                continue
            row = None if e == "I" else next(rest)
            left.append((e, row))
        shift = 1 if left and left[0][0] == "K" and left[0][1][2][:1] == "s" else 0
        told = []
        for k, (e, row) in enumerate(left):
            role = ("user", "assistant")[(k - shift) % 2]
            told.append(f"{role}:" if e == "I" else f"{role if e == 'R' else row[2]}:{row[3]}")
        yield conv, gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(told).encode()).hexdigest()


def held(spark, rows):
    made = tr.repair(tr.damage(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)))
    assert made.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, made.collect()), key=str) == sorted(expected(rows), key=str)


def test_conversations(spark):
    rng = random.Random(11)
    texts = ["Yes. ", "no", "Ok!", "", " \n", "why?\t", "ä.", None, "a.b", "x" * 50_000]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 12)):
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "system", "tool", "", None, "assistant", "user"]), rng.choice(texts)))
    held(spark, rows + rows[:5])


def test_one_conversation_has_most_rows(spark):
    rng = random.Random(2)
    held(spark, [(7 if k % 3 else k, k, rng.choice(["user", "assistant"]), rng.choice(["Yes.", "No", "Why?"]) + str(k) * (k % 2)) for k in range(3000)])


def test_no_rows_left_and_no_table(spark):
    gone = next(t for t in range(1000) if zlib.crc32(f"5:{t}".encode()) % 20 == 0)
    held(spark, [(5, gone, "user", "Hello.")])
    empty = tr.repair(tr.damage(spark.createDataFrame([], SCHEMA)))
    assert empty.collect() == [] and isinstance(empty.schema["cost"].dataType, T.LongType)


def test_query_on_the_tables(spark):
    from memloom.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_turn_repair"](spark, sf).collect())) == sorted(expected(rows))
