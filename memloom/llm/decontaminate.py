"""Benchmark decontamination with one Aho-Corasick automaton.

Items and documents are normalised alike: A-Z to lower case, words of letters,
digits and any non-ASCII bytes. An item's windows are its runs of 13 words (a
shorter item is one window). Words are numbered, and the automaton of all windows
runs over word numbers: it scans each document once; hits are spans of words, and
if asked for of characters of the original text.
"""

from __future__ import annotations

import hashlib
from uuid import uuid4

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, text_rows, written

#: Upper bound of the windows of one automaton, about 1 KB each in a worker; more take several scans.
BLOCK_WINDOWS = 200_000
WINDOW = 13

#: Word bytes to lower case, all others to a space. Bytes of 0x80 and more are word bytes.
_WORDS = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)

#: What is known of a row between scans: its words, the merged spans of words that are hit, and the items that hit it.
STATE = (
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.LongType())),
)
SPANS = "array<struct<first_word:long,last_word:long,first_char:long,end_char:long>>"


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_WORDS).split()


def windows(line: str, size: int = WINDOW) -> list[str]:
    """The windows of a line of words, two letters a word."""
    return [line[i : i + 2 * size] for i in range(0, max(1, len(line) - 2 * size + 1), 2)] if line else []


def build_automaton(items: list[tuple[int, str]], size: int = WINDOW):
    """(letters of the words, automaton of the windows), with (number of words, ids of the items that have it) for each.

    None without windows. A word's number is written with two letters of separate alphabets, whose sizes
    are the root of the vocabulary's: an automaton's step searches the letters that go on from a state.
    """
    import ahocorasick

    words = [(item, words_of(text)) for item, text in items]
    number = {w: n for n, w in enumerate(dict.fromkeys(w for _, line in words for w in line))}
    base = int(len(number) ** 0.5) + 1
    letters = {w: chr(0x100 + n // base) + chr(0x4000 + n % base) for w, n in number.items()}
    ids: dict[str, list[int]] = {}
    for item, line in words:
        for w in set(windows("".join([letters[x] for x in line]), size)):
            ids.setdefault(w, []).append(item)
    if not ids:
        return None
    found = ahocorasick.Automaton()
    while ids:
        w, of = ids.popitem()
        found.add_word(w, (len(w) // 2, tuple(dict.fromkeys(of))))
    found.make_automaton()
    return letters, found


def merged(spans) -> list[tuple[int, int]]:
    """Spans (first, last) that overlap or touch as one, in order."""
    out: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], last))
        else:
            out.append((first, last))
    return out


def scan(text: str, automaton) -> tuple[int, list[tuple[int, int]], set[int]]:
    """Number of words, merged spans (first word, last word) of the occurrences of windows, and the items that have such a window."""
    words = words_of(text)
    if not words or automaton is None:
        return len(words), [], set()
    letters, found = automaton
    get = letters.get
    line = "".join([get(w, "\0\0") for w in words])
    spans, windows_met = [], {}
    for end, (n, ids) in found.iter(line):
        spans.append((end // 2 - n + 1, end // 2))
        windows_met[id(ids)] = ids  # a window's ids are one tuple, so each window counts once
    return len(words), merged(spans), set().union(*windows_met.values())


def char_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points (start, end) in the original text of spans of words."""
    raw = np.frombuffer(text.encode(), np.uint8)
    word = np.frombuffer(text.encode().translate(_WORDS), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([0], word.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    return [(int(points[starts[a]]), int(points[ends[b]])) for a, b in spans]


_built: dict[tuple, object] = {}


def _automaton(items: Broadcast, size: int):
    """Built once in each Python worker."""
    key, rows = items.value
    if (key, size) not in _built:
        _built.clear()
        _built[key, size] = build_automaton(rows, size)
    return _built[key, size]


def _shared(sc, items: list[tuple[int, str]]) -> Broadcast:
    return sc.broadcast((uuid4().hex, items))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, size: int):
    """The items in blocks of at most BLOCK_WINDOWS windows, one block at a time; a longer item is cut between windows.

    Items come to the driver row by row, and only the block in hand stays there.
    """
    block, held = [], 0
    for r in text_rows(benchmark, id_col, text_col).where(F.col("id").isNotNull()).toLocalIterator():
        words, at = words_of(r["text"]), 0
        while at < len(words):
            n = min(max(1, len(words) - size + 1 - at), BLOCK_WINDOWS - held)
            block.append((r["id"], b" ".join(words[at : at + n + size - 1]).decode()))
            held, at = held + n, at + n
            if held >= BLOCK_WINDOWS:
                yield block
                block, held = [], 0
            if at + size > len(words):
                break
    yield block


def _scanned(items: Broadcast, size: int, text_field: str, finish=None):
    """Adds to each ``row``'s state what a block of items finds in its text; ``finish`` makes the last scan's result of it."""

    def run(batches):
        import pyarrow as pa

        automaton = _automaton(items, size)
        span = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
        for batch in slices(batches):
            rows = batch.column("row")
            texts = rows.field(rows.type.get_field_index(text_field)).to_pylist()
            before = [c.to_pylist() for c in batch.columns[2:]] if batch.num_columns > 1 else ([[]] * len(texts), [[]] * len(texts))
            counts, spans, ids = [], [], []
            for text, old_spans, old_ids in zip(texts, *before, strict=True):
                n, found, of = scan(text or "", automaton)
                counts.append(n)
                spans.append(merged([*((x["first"], x["last"]) for x in old_spans), *found]))
                ids.append(sorted(of.union(old_ids)))
            if finish:
                yield finish(rows, texts, counts, spans, ids)
            else:
                made = [[{"first": a, "last": b} for a, b in x] for x in spans]
                yield pa.record_batch([rows, pa.array(counts, pa.int64()), pa.array(made, span), pa.array(ids, pa.list_(pa.int64()))], ["row", "n_words", "spans", "items"])

    return run


def _scans(rows: DataFrame, benchmark: DataFrame, text_field: str, item_id: str, size: int, finish, schema) -> DataFrame:
    """The rows (one column, ``row``) through one scan a block of items, the last of which gives ``schema``; between scans they lie in the shared folder.

    Each row carries its own state, so that it is judged alike however many blocks there are.
    """
    sc = rows.sparkSession.sparkContext
    blocks = _blocks(benchmark, item_id, "text", size)
    now = next(blocks)
    state = T.StructType([rows.schema["row"], *STATE])
    for after in blocks:
        if after:
            rows = written(rows.mapInArrow(_scanned(_shared(sc, now), size, text_field), state), "decontaminate")
            now = after
    return rows.mapInArrow(_scanned(_shared(sc, now), size, text_field, finish), schema)


def _named(docs: DataFrame, doc_id: str, text_col: str) -> DataFrame:
    return text_rows(docs, doc_id, text_col).select(F.struct("id", "text").alias("row"))


def _is_hit(n_words: int, spans: list[tuple[int, int]], share: int) -> tuple[int, bool]:
    n = sum(b - a + 1 for a, b in spans)
    return n, n > 0 and share * n >= n_words


def find_hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """Per document row: id, n_words, ``spans`` (what windows cover, merged, by words and by characters of the text) and ``items`` (ids, sorted).

    Each block of items costs one scan. Rows with nothing have empty arrays.
    """

    def finish(rows, texts, counts, spans, ids):
        import pyarrow as pa

        names = ["first_word", "last_word", "first_char", "end_char"]
        told = [[dict(zip(names, (*w, *c), strict=True)) for w, c in zip(s, char_spans(t or "", s), strict=True)] if s else [] for t, s in zip(texts, spans, strict=True)]
        kinds = [pa.int64(), pa.list_(pa.struct([(n, pa.int64()) for n in names])), pa.list_(pa.int64())]
        return pa.record_batch([rows.field(0), *(pa.array(c, k) for c, k in zip((counts, told, ids), kinds, strict=True))], ["id", "n_words", "spans", "items"])

    return _scans(_named(docs, doc_id, text_col), benchmark, "text", item_id, size, finish, f"id long, n_words long, spans {SPANS}, items array<long>")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", item_id: str = "item_id", text_col: str = "text", size: int = WINDOW, share: int = 20) -> DataFrame:
    """Per document row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document is contaminated if one word in ``share`` or more stands inside an occurrence
    of a window. Null and empty texts have no words and are clean; items without words have
    no window; items without an id are passed over; repeated rows give repeated results.
    """

    def finish(rows, texts, counts, spans, ids):
        import pyarrow as pa

        hit = [_is_hit(n, s, share) for n, s in zip(counts, spans, strict=True)]
        digests = [hashlib.sha256(",".join(sorted(map(str, x))).encode()).hexdigest() for x in ids]
        columns = (counts, [h[0] for h in hit], [len(x) for x in ids], digests, [h[1] for h in hit])
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
        names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
        return pa.record_batch([rows.field(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return _scans(_named(docs, doc_id, text_col), benchmark, "text", item_id, size, finish, schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", size: int = WINDOW, share: int = 20) -> DataFrame:
    """The rows of ``docs``, all columns, that are not contaminated; null and empty texts stay.

    Each row is judged by its own text: rows that repeat an id or have none, too. There is no shuffle.
    """

    def finish(rows, texts, counts, spans, ids):
        import pyarrow as pa

        clean = pa.array([not _is_hit(n, s, share)[1] for n, s in zip(counts, spans, strict=True)], pa.bool_())
        return pa.record_batch([rows.filter(clean)], ["row"])

    whole = docs.select(F.struct("*").alias("row"))
    return _scans(whole, benchmark, text_col, "item_id", size, finish, whole.schema).select("row.*")
