"""Vector codes against plain Python integers."""

import hashlib
import math

import duckdb
import numpy as np

from memloom.llm import vector_codes as vc
from memloom.llm.queries import ORACLE_SQL, QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, code string, part string"


def plain(rows, entries=256, rounds=4):
    """(vec_id, code, error, label_error, digest) of each kept row, by Python's integers."""
    kept = [(i, [math.floor(1024 * float(x)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(kept[0][1]) // 4 if kept else 0
    cut = lambda v, p: v[p * w : (p + 1) * w]
    dist = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    books = [[cut(v, p) for _, v, _ in kept[:entries]] for p in range(4)]
    near = lambda x, book: min(range(len(book)), key=lambda e: (dist(x, book[e]), e))
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(cut(v, p), book), []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*groups[e])] if e in groups else book[e] for e in range(len(book))]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    told = [(i, lab, *zip(*((e := near(cut(v, p), books[p]), dist(cut(v, p), books[p][e])) for p in range(4)))) for i, v, lab in kept]
    by = {}
    for _, lab, _, d in told:
        by[lab] = by.get(lab, 0) + sum(d)
    return sorted(((i, "".join(f"{e:02x}" for e in es), sum(d), by[lab], digest) for i, lab, es, d in told), key=str)


def held(spark, rows, **how):
    made = vc.compress(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)).collect()
    assert sorted(map(tuple, made), key=str) == plain(rows, **how)


def test_nearest_is_exact():
    rng = np.random.default_rng(1)
    for width in (1, 2, 3, 4, 8, 12, 16, 64):
        for spread in (2, 300, 1 << 20):
            book = vc.Book(rng.integers(-spread, spread, (50, width)))
            book.entries[7] = book.entries[3]
            book = vc.Book(book.entries)
            x = np.concatenate((rng.integers(-spread, spread, (300, width)), book.entries))
            at, d, full = book.nearest(x)
            want = ((x[:, None] - book.entries[None]) ** 2).sum(2)
            assert (at == want.argmin(1)).all() and (d == want.min(1)).all()
            assert full <= want.size


def test_bounds_leave_few_entries():
    """Of clustered vectors, most entries go by their segment means, at any level."""
    rng = np.random.default_rng(2)
    middle = rng.integers(-2000, 2000, (256, 16))
    x = middle[rng.integers(0, 256, 2000)] + rng.integers(-60, 60, (2000, 16))
    _, _, full = vc.Book(middle).nearest(x)
    assert full < 0.25 * len(x) * 256


def test_odd_vectors(spark):
    rng = np.random.default_rng(4)
    good = [(k, [float(v) for v in np.float32(rng.normal(size=8))], int(k % 3) if k % 5 else None) for k in range(300)]
    odd = [(900, None, 1), (901, [1.0, None] * 4, 1), (902, [float("nan")] * 8, 1), (903, [float("inf")] + [0.0] * 7, 2), (None, [0.5] * 8, None)]
    held(spark, good + odd + good[5:9] + [(k, [0.25] * 8, 0) for k in range(1000, 1200)])
    held(spark, good[:3])
    held(spark, [(1, [3.0e8, -3.0e8, 1.0, 2.0], 1), (2, [3.0e8, 1.0e8, 0.0, 2.0], 1), (3, [0.0] * 4, 2)])


def test_lengths_that_cannot_be_coded(spark):
    rows = [(1, [1.0] * 4, 1), (2, [1.0] * 5, 1), (3, [], 1), (4, [2.0] * 4, 1)]
    made = {r["vec_id"]: r for r in vc.compress(spark.createDataFrame([(*r, "", "") for r in rows], SCHEMA)).collect()}
    assert made[2]["code"] is None and made[3]["error"] is None and made[4]["code"] == "01010101" and made[1]["label_error"] == 0
    for first in ([1.0] * 5, []):
        made = vc.compress(spark.createDataFrame([(1, first, 1, "", "")], SCHEMA)).collect()
        assert [(r["code"], r["error"]) for r in made] == [(None, None)]
    assert vc.compress(spark.createDataFrame([], SCHEMA)).collect() == []


def test_sql_and_brute_force_agree(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    told = con.execute(ORACLE_SQL["op11_vector_codes"]).fetchall()
    made = [tuple(r) for r in QUERIES["op11_vector_codes"](spark, sf).collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(made) == sorted(told) == sorted(plain(rows))
