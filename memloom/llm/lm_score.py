"""A log-bilinear neural language model, trained by noise-contrastive estimation.

Tokens fall into a bounded number of classes: the most frequent words and the end
have one each, any other word that of its ending. The classes of the last words, each
scaled by the weights of its position, add up to a vector; its products with the
classes' vectors, normalised over all classes, give P(class | words before), and a word
within a class goes by its count. Every training token is an example. Each task makes
its minibatches of numpy products against sampled noise, from the same start, and the
tasks' parameters are averaged by their tokens between passes. Texts are then scored
in batches of products.
"""

from __future__ import annotations

import zlib
from uuid import uuid4

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_path, slices, written

#: Words with a class of their own, and classes of endings. Class 0 is the end.
FREQUENT, ENDINGS = 511, 512
CLASSES = 1 + FREQUENT + ENDINGS
#: Words whose counts every executor holds; the counts of all others are joined.
HELD_WORDS = 200_000
#: Words before that the model sees, length of the vectors.
CONTEXT, DIM = 4, 32
#: Passes over all training tokens, tokens in a minibatch, noise tokens drawn for it, rate of the steps.
PASSES, BATCH, NOISE, RATE = 1, 512, 64, 0.3
#: Averages of a pass, and tokens of a round that a task has at least.
ROUNDS, TASK_TOKENS = 8, 1_000_000
#: Parameters travel in rows of this many: sums over a task's or several tasks' tokens, with the tokens.
BLOCK = 4096
#: Squared gradients that each parameter begins with.
PAST = 1e-2
_SUMS_DDL = "block int, part int, n double, total array<double>"


def _words(texts):
    import pyarrow.compute as pc

    from .tokenizing import word_codes

    return word_codes(pc.ascii_split_whitespace(pc.ascii_lower(texts)))


def _present(words, codes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and offsets without the empty words that white space at a text's edges leaves."""
    import pyarrow.compute as pc

    empty = np.flatnonzero(pc.equal(words, "").to_numpy(zero_copy_only=False))
    if not len(empty):
        return codes, at
    keep = codes != empty[0]
    return codes[keep], np.concatenate(([0], np.cumsum(keep)))[at]


def _places(words, among) -> np.ndarray:
    """Place of each word in an Arrow array of others, -1 where it lacks the word."""
    import pyarrow.compute as pc

    return pc.fill_null(pc.index_in(words, value_set=among.cast(words.type)), -1).to_numpy(zero_copy_only=False)


def classes_of(words, shortlist: dict[str, int]) -> np.ndarray:
    """Classes of a list or an Arrow array of words; an ending is hashed once, however many words have it."""
    import pyarrow as pa
    import pyarrow.compute as pc

    words = words if isinstance(words, pa.Array) else pa.array(words, pa.string())
    ends = pc.utf8_slice_codeunits(words, -3).dictionary_encode()
    hashed = np.array([1 + FREQUENT + zlib.crc32(e.encode()) % ENDINGS for e in ends.dictionary.to_pylist()], np.int64)
    own = np.array([*shortlist.values(), 0], np.int64)[_places(words, pa.array(list(shortlist), pa.string()))]
    return np.where(own > 0, own, hashed[ends.indices.to_numpy(zero_copy_only=False)])


def _count_words(batches):
    """(word, count) of each slice; the empty word stands for the ends."""
    import pyarrow as pa

    for batch in slices(batches):
        words, codes, at = _words(batch.column(0))
        codes, at = _present(words, codes, at)
        n = np.bincount(codes, minlength=len(words))
        some = np.flatnonzero(n)
        word = pa.concat_arrays([words.take(pa.array(some)), pa.array([""])])
        yield pa.record_batch([word, pa.array(np.append(n[some], batch.num_rows))], ["word", "c"])


def _line(kind: np.ndarray, codes, at) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token with the end of each text, and the texts' numbers of tokens; kind has the class of each word."""
    return np.insert(kind.astype(np.int16)[codes], at[1:], 0), np.diff(at) + 1


def _contexts(line: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The line and the classes before each token, nearest first; ends stand before a text."""
    since = np.arange(len(line)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = np.zeros((len(line), CONTEXT), np.int16)
    for i in range(CONTEXT):
        before[i + 1 :, i] = np.where(since[i + 1 :] > i, line[: len(line) - i - 1], 0)
    return line, before


def _examples(words, codes, at, shortlist) -> tuple[np.ndarray, np.ndarray]:
    """Class of each token with the end of each text, and the classes before it."""
    return _contexts(*_line(classes_of(words, shortlist), codes, at))


def _lines(shortlist: Broadcast):
    """Each text as the bytes of its classes, two a token."""

    def run(batches):
        import pyarrow as pa

        for batch in slices(batches):
            words, codes, at = _words(batch.column(0))
            line, sizes = _line(classes_of(words, shortlist.value), *_present(words, codes, at))
            ends = np.concatenate(([0], np.cumsum(sizes) * 2)).astype(np.int32)
            yield pa.record_batch([pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(line)])], ["line"])

    return run


def _class_sums(shortlist: Broadcast):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            made = classes_of(batch.column(0), shortlist.value)
            c = batch.column(1).to_numpy()
            total, n = np.bincount(made, c + 1, CLASSES), np.bincount(made, c, CLASSES)
            some = np.flatnonzero(total)
            yield pa.record_batch([pa.array(some), pa.array(total[some]), pa.array(n[some])], ["class", "total", "n"])

    return run


def start(n: np.ndarray, dim: int = DIM, context: int = CONTEXT, seed: int = 7) -> dict[str, np.ndarray]:
    """Parameters before training: vectors of contexts Q and of classes R, weights of positions C, biases b of the classes' counts n."""
    rng = np.random.default_rng(seed)
    q = (n + 1) / (n.sum() + len(n))
    return {
        "Q": rng.normal(0, 0.1, (len(n), dim)).astype(np.float32),
        "R": rng.normal(0, 0.1, (len(n), dim)).astype(np.float32),
        "C": np.full((context, dim), 0.5, np.float32),
        "b": np.log(q).astype(np.float32),
    }


def _cells(rows: int, columns: int) -> np.ndarray:
    """The number of each cell. Two neighbouring columns, where there are such, are one cell: a complex number."""
    columns //= 1 + (columns % 2 == 0)
    return np.arange(rows * columns).reshape(rows, columns)


def _row_sums(cells: np.ndarray, rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values by row, zero for other rows."""
    kind = values.dtype if cells.shape[1] == values.shape[-1] else np.result_type(values.dtype, np.complex64)
    made = np.zeros(cells.size, kind)
    np.add.at(made, cells.take(rows, axis=0).ravel(), values.view(kind).ravel())
    return made.view(values.dtype).reshape(len(cells), -1)


class Nce:
    """Noise-contrastive steps on one task's tokens, with steps scaled by past gradients (Adagrad).

    The score of class w after context u is s(u, w) = sum over positions i of (C_i * Q[u_i]) . R_w + b_w. With
    s' = sigmoid(s - log(k q)) a step raises log s'(u, w) of each token and log(1 - s'(u, v)) of the k
    noise classes v that a minibatch shares, drawn by the unigram model q.
    """

    def __init__(self, p: dict[str, np.ndarray], q: np.ndarray, seed: int, rate: float = RATE, noise: int = NOISE, past: dict[str, np.ndarray] | None = None):
        self.p = {k: v.copy() for k, v in p.items()}
        self.past = {k: v.copy() for k, v in past.items()} if past else {k: np.full_like(v, PAST) for k, v in p.items()}
        self.rng, self.rate, self.noise = np.random.default_rng(seed), rate, noise
        self.edges = np.cumsum(q) / q.sum()
        self.log_kq = np.log(noise * q).astype(np.float32)
        self.cells = {k: _cells(*p[k].shape) for k in ("Q", "R")}

    def _move(self, name: str, rows, grad: np.ndarray) -> None:
        # rows is a slice, so these are views. All rows move at once: those without a slope stay where they are.
        p, past = self.p[name][rows], self.past[name][rows]
        by = grad * grad
        past += by
        np.sqrt(past, out=by)
        np.divide(grad, by, out=by)
        by *= self.rate
        p += by

    def step(self, w: np.ndarray, u: np.ndarray) -> None:
        p, (n, places) = self.p, u.shape
        v = np.minimum(np.searchsorted(self.edges, self.rng.random(self.noise), "right"), len(self.edges) - 1).astype(w.dtype)
        before, rows = u.T.ravel(), np.concatenate((w, v))
        seen = p["Q"].take(before, axis=0).reshape(places, n, -1)
        h = np.einsum("itj,ij->tj", seen, p["C"])
        near = p["R"].take(rows, axis=0)
        true, false = near[:n], near[n:]
        over = (p["b"] - self.log_kq).take(rows)
        # The logistic function of x is (1 + tanh(x / 2)) / 2; the mean over the minibatch is in the factors.
        up = (1 - np.tanh((np.einsum("ij,ij->i", h, true) + over[:n]) / 2)) / (2 * n)
        down = h @ false.T
        down += over[n:]
        down *= 0.5
        np.tanh(down, out=down)
        down += 1
        down *= -0.5 / n
        g = down @ false
        true *= up[:, None]
        g += true
        # The vectors have been used; their place takes the slopes.
        np.multiply(h, up[:, None], out=true)
        np.matmul(down.T, h, out=false)
        slopes = np.einsum("tj,itj->ij", g, seen)
        np.multiply(p["C"][:, None], g, out=seen)
        every = slice(None)
        self._move("R", every, _row_sums(self.cells["R"], rows, near))
        self._move("b", every, np.bincount(rows, np.concatenate((up, np.ones_like(up) @ down)), len(p["b"])).astype(up.dtype))
        self._move("C", every, slopes)
        self._move("Q", every, _row_sums(self.cells["Q"], before, seen))

    def learn(self, w: np.ndarray, u: np.ndarray, size: int = BATCH) -> None:
        order = self.rng.permutation(len(w))
        for i in range(0, len(order), size):
            some = order[i : i + size]
            self.step(w.take(some), u.take(some, axis=0))


def _sums(rows: list[list]):
    import pyarrow as pa

    kinds = {"block": pa.int32(), "part": pa.int32(), "n": pa.float64(), "total": pa.list_(pa.float64())}
    return pa.record_batch([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def _learn(model: Broadcast, turn: int):
    def run(batches):
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        m, tokens = model.value, 0
        nce = Nce(m["p"], m["q"], seed=[turn, task], past=m["past"])
        for batch in slices(batches, 1 << 20):  # minibatches are drawn from half a million tokens, which stay in the cache
            raw = batch.column(0)
            sizes = np.diff(np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]) // 2
            line = np.frombuffer(b"".join(raw.to_pylist()), np.int16)
            nce.learn(*_contexts(line, sizes))
            tokens += len(line)
        if tokens:
            flat = np.concatenate([x[k].ravel() for x in (nce.p, nce.past) for k in sorted(x)]).astype(np.float64) * tokens
            parts = [flat[i : i + BLOCK] for i in range(0, len(flat), BLOCK)]
            yield _sums([[i, task % 256, float(tokens), x] for i, x in enumerate(parts)])

    return run


def _add(batches):
    """Sums by block of a task's rows."""
    sums: dict[int, list] = {}
    for batch in batches:
        for block, part, n, total in zip(*(c.to_pylist() for c in batch.columns[:3]), batch.column(3), strict=True):
            more = total.values.to_numpy(zero_copy_only=False)
            _, _, n0, old = sums.get(block, (0, 0, 0.0, 0.0))
            sums[block] = [block, part, n0 + n, old + more]
    if sums:
        yield _sums(list(sums.values()))


def train(learnt: DataFrame, p: dict[str, np.ndarray], q: np.ndarray, shortlist: dict[str, int], passes: int = PASSES, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Parameters after passes over all training texts, each in rounds: a round's tasks start from p, and their results are averaged by tokens.

    A text's round goes by its hash. The texts are written once as classes, by round, and a round's files are merged until a
    task has TASK_TOKENS, so that little data is learnt in few tasks however it was divided. A task's steps depend on its rows and its
    number alone; past gradients go on from round to round with the parameters. Only sums of parameters meet, in blocks,
    by part of the tasks and then over all; the driver gets one row for each block. Without a token p stays.
    """
    spark = learnt.sparkSession
    lines = learnt.mapInArrow(_lines(spark.sparkContext.broadcast(shortlist)), "line binary")
    path = fresh_path(spark, "lines")
    lines.withColumn("round", F.pmod(F.xxhash64("line"), F.lit(rounds)).cast("int")).write.partitionBy("round").parquet(path)
    coded = spark.read.schema("line binary, round int").parquet(path)
    tokens = {r["round"]: r["n"] for r in coded.groupBy("round").agg((F.sum(F.length("line")) / 2).cast("long").alias("n")).collect()}
    past = {k: np.full_like(v, PAST) for k, v in p.items()}
    for turn in range(passes * rounds):
        n = tokens.get(turn % rounds, 0)
        if not n:
            continue
        model = spark.sparkContext.broadcast({"p": p, "q": q, "past": past})
        own = coded.where(F.col("round") == turn % rounds).select("line").coalesce(-(-n // TASK_TOKENS))
        made = own.mapInArrow(_learn(model, turn), _SUMS_DDL)
        for keys in (("block", "part"), ("block",)):
            made = made.repartition(*keys).mapInArrow(_add, _SUMS_DDL)
        rows = sorted(made.toArrow().to_pylist(), key=lambda r: r["block"])
        flat, at, new = np.concatenate([np.array(r["total"]) / r["n"] for r in rows]).astype(np.float32), 0, []
        for old in (p, past):
            new.append({})
            for k in sorted(old):
                new[-1][k] = flat[at : at + old[k].size].reshape(old[k].shape)
                at += old[k].size
        p, past = new
    return p


def log_probabilities(p: dict[str, np.ndarray], u: np.ndarray) -> np.ndarray:
    """log10 P(w | u) of all classes for each row of u: one product, each row normalised."""
    h = sum(c * p["Q"][u[:, i]] for i, c in enumerate(p["C"]))
    s = h @ p["R"].T + p["b"]
    s -= s.max(1, keepdims=True)
    return (s - np.log(np.exp(s).sum(1, keepdims=True))) / np.float32(np.log(10))


def score_tables(p: dict[str, np.ndarray]) -> tuple[np.ndarray, ...]:
    """What one place adds to the scores: products S_i of all classes, less their row maxima, and these; the first has the biases. Exp of the former, too."""
    products = np.stack([(c * p["Q"]) @ p["R"].T for c in p["C"]])
    products[0] += p["b"]
    top = products.max(2)
    products -= top[:, :, None]
    return products, top, np.exp(products)


def token_scores(tables: tuple[np.ndarray, ...], w: np.ndarray, u: np.ndarray, rows: int = 64) -> np.ndarray:
    """log10 P(w | u) of each token. The norm's terms, exp of a sum over places, are products of the places' rows.

    Tokens are taken by the classes at their first two places. The first one's row goes into the last product
    for all tokens that share it. Tokens whose products get too small take the sum of the scores itself.
    """
    products, _, factors = tables
    n, places = u.shape
    order = np.lexsort((u[:, 1], u[:, 0]))
    u, w = u.take(order, axis=0).T.astype(np.intp), w.take(order).astype(np.intp)
    own, norm = np.zeros(n), np.empty(n, np.float32)
    for table, x in zip(products, u, strict=True):
        own += table.ravel().take(x * table.shape[1] + w)
    made, more = (np.empty((rows, products.shape[2]), np.float32) for _ in range(2))
    edges = np.flatnonzero(np.diff(u[0], prepend=-1, append=-1))
    for start_, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        first = factors[0, u[0, start_]]
        for i in range(start_, end, rows):
            j = min(i + rows, end)
            x, y = made[: j - i], more[: j - i]
            factors[1].take(u[1, i:j], axis=0, out=x, mode="clip")
            for k in range(2, places):
                factors[k].take(u[k, i:j], axis=0, out=y, mode="clip")
                np.multiply(x, y, out=x)
            np.matmul(x, first, out=norm[i:j])
    for i in np.flatnonzero(norm < 1e-25):
        s = sum(products[k, u[k, i]] for k in range(places)).astype(np.float64)
        own[i], norm[i] = own[i] - s.max(), np.exp(s - s.max()).sum()
    made = np.empty(n)
    made[order] = (own - np.log(norm, dtype=np.float64)) / np.log(10)
    return made


_tables: dict[str, tuple] = {}


def _score(model: Broadcast):
    def run(batches):
        import pyarrow as pa

        m = model.value
        if m["key"] not in _tables:
            _tables.clear()
            _tables[m["key"]] = score_tables(m["p"]), pa.array(m["words"], pa.string())
        scores, held = _tables[m["key"]]
        log_total = np.log10(m["n"] + m["v"] + 1)
        within = -np.log10(m["class_total"] + 1)  # the one is for words that training lacks
        for batch in slices(batches):
            words, codes, at = _words(batch.column(2))
            codes, at = _present(words, codes, at)
            kind = classes_of(words, m["shortlist"])
            c = np.append(m["counts"], -1)[_places(words, held)]
            log_c = np.where(c >= 0, np.log10(np.maximum(c, 0) + 1), 0)
            inner = np.where(kind > FREQUENT, log_c + within[kind], 0)
            step = token_scores(scores, *_contexts(*_line(kind, codes, at)))
            ends = at[1:] + np.arange(1, len(at))  # each text has one end more
            total = lambda x, edges: np.diff(np.concatenate(([0], np.cumsum(x)))[edges])
            n = np.diff(at) + 1
            score = total(step, np.concatenate(([0], ends))) + total(inner[codes], at)
            end_c = m["ends"]
            base = total(log_c[codes], at) + np.log10(end_c + 1) - n * log_total
            known = total((c > 0)[codes], at) + (end_c > 0)
            # The words whose counts are not held here, with their number in each text.
            rare = np.flatnonzero((c < 0)[codes])
            text = np.searchsorted(at, rare, "right") - 1
            both, times = np.unique(text * max(1, len(words)) + codes[rare], return_counts=True)
            offsets = np.concatenate(([0], np.cumsum(np.bincount(both // max(1, len(words)), minlength=batch.num_rows)))).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(offsets), x) for x in (words.take(pa.array(both % max(1, len(words)))), pa.array(times))]
            # A rare word outside the shortlist takes log10(c + 1) in both scores once its count is joined.
            columns = [*batch.columns[:2], pa.array(n), pa.array(known), pa.array(base), pa.array(score), *lists]
            yield pa.record_batch(columns, ["row", "id", "n_tokens", "known", "base", "score", "words", "times"])

    return run


def _frequent(named: DataFrame) -> tuple[list[str], np.ndarray]:
    """The HELD_WORDS most frequent words (all, if there are fewer) and their counts; of equal counts the first by spelling.

    A histogram of the counts' logarithms gives the step that the bound falls into. What lies above
    comes whole, and of that step the first words in order, so no task sorts more than its own words.
    """
    step = F.floor(F.log2("c") * 32).cast("int")
    sizes = sorted(((r["step"], r["n"]) for r in named.groupBy(step.alias("step")).agg(F.count("*").alias("n")).collect()), reverse=True)
    last, held = -1, 0
    for k, n in sizes:
        if held + n > HELD_WORDS:
            last = k
            break
        held += n
    found = named.where(step > last)
    if last >= 0:
        found = found.unionByName(named.where(step == last).orderBy(F.desc("c"), "word").limit(HELD_WORDS - held))
    found = found.toArrow()
    rows = sorted(zip(found["word"].to_pylist(), found["c"].to_pylist(), strict=True), key=lambda r: (-r[1], r[0]))
    return [r[0] for r in rows], np.array([r[1] for r in rows], np.int64)


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held_fold: int = 2) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Texts whose crc32 of the id modulo ``folds`` is ``held_fold`` are scored but not learnt from; a
    null id is learnt from. Null text is empty: one end token. Repeated rows are learnt and scored
    each. Without training texts every word is unknown. Counts come from all training tokens, and
    all of them are examples for the model; the counts of words grow with the corpus and stay in a table.
    """
    spark = docs.sparkSession
    sc = spark.sparkContext
    fold = F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(folds))
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.coalesce(fold == held_fold, F.lit(False)).alias("held_out"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    )
    learnt = rows.where("not held_out").select("text")
    counts = written(learnt.mapInArrow(_count_words, "word string, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    ends = next((r["c"] for r in counts.where("word = ''").collect()), 0)
    named = counts.where("word <> ''")
    words, word_counts = _frequent(named)
    shortlist = sc.broadcast({w: i + 1 for i, w in enumerate(words[:FREQUENT])})
    totals, n_class = np.zeros(CLASSES), np.zeros(CLASSES)
    n_class[0] = ends
    sums = named.mapInArrow(_class_sums(shortlist), "class long, total double, n double").groupBy("class").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    for r in sums.collect():
        totals[r["class"]], n_class[r["class"]] = r["total"], r["n"]
    model = sc.broadcast(
        {
            "key": uuid4().hex,
            "p": train(learnt, start(n_class), (n_class + 1) / (n_class.sum() + CLASSES), shortlist.value),
            "words": words,
            "counts": word_counts,
            "shortlist": shortlist.value,
            "class_total": totals,
            "ends": ends,
            "n": n,
            "v": v,
        }
    )
    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "id", "text")
    scored = written(
        keyed.mapInArrow(_score(model), "row long, id long, n_tokens long, known long, base double, score double, words array<string>, times array<long>"),
        "scored",
    )
    rare = scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("x")).select("row", F.col("x.words").alias("word"), F.col("x.times").alias("times"))
    more = (
        rare.join(named, "word")
        .groupBy("row")
        .agg(F.sum("times").alias("more_known"), F.sum(F.col("times") * F.log10(F.col("c") + 1)).alias("more"))
    )
    zero = F.lit(0)
    return scored.drop("words", "times").join(more, "row", "left").select(
        F.col("id").alias("doc_id"),
        F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(folds)) == held_fold, F.lit(False)).alias("held_out"),
        "n_tokens",
        (F.col("known") + F.coalesce("more_known", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"),
    )
