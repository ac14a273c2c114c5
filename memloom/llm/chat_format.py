"""Conversations as one marked-up byte string each, assembled column by column.

A turn is ``### role: text</turn>`` and a line end. Inside roles and texts a
backslash doubles, and one is put into ``##`` and ``</turn>`` (in roles also
before ``:``), so no mark can occur there and dropping the backslashes gives the
text back. The loss mask covers exactly the escaped texts of assistant turns.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

OPEN, COLON, CLOSE = b"### ", b": ", b"</turn>\n"
#: A longer conversation goes on in further parts, cut between turns.
PART_BYTES = 4 << 20
#: Bytes that are scattered at once.
SCATTERED = 1 << 17
SCHEMA = "conv_id long, part int, formatted binary, loss_start array<long>, loss_end array<long>"

_HEADER = re.compile(rb"### ((?:[^\\:]++|\\.)*+): ", re.S)
_ESCAPED = re.compile(rb"\\(.)", re.S)


def unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(rb"\1", raw)


def _escaped(column, role: bool):
    import pyarrow.compute as pc

    column = pc.fill_null(column, "")
    steps = [("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")] + [(":", "\\:")] * role
    for mark, safe in steps:
        column = pc.replace_substring(column, mark, safe)
    return column


def _bytes_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Data and the rows' offsets in it, as numpy views of the Arrow buffers."""
    import pyarrow as pa

    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _scatter(out: np.ndarray, at: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> None:
    """Copy row i of ``data`` to ``out[at[i]:]``.

    Short rows go by scatter indices, in groups of SCATTERED bytes at most so that the indices stay
    small; a row that alone is longer goes as one run.
    """
    first = 0
    while first < len(at):
        end = max(first + 1, int(np.searchsorted(offsets, offsets[first] + SCATTERED, "right")) - 1)
        lo, hi = offsets[first], offsets[end]
        if end == first + 1:
            out[at[first] : at[first] + hi - lo] = data[lo:hi]
        else:
            out[np.repeat(at[first:end] - offsets[first:end], np.diff(offsets[first : end + 1])) + np.arange(lo, hi)] = data[lo:hi]
        first = end


def assemble(roles, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The formatted turns in one buffer, the turns' offsets, and where each text starts and ends."""
    role, role_at = _bytes_of(_escaped(roles, True))
    text, text_at = _bytes_of(_escaped(texts, False))
    n_role, n_text = np.diff(role_at), np.diff(text_at)
    size = len(OPEN) + n_role + len(COLON) + n_text + len(CLOSE)
    ends = np.cumsum(size)
    starts = ends - size
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    text_start = starts + len(OPEN) + n_role + len(COLON)
    for mark, at in ((OPEN, starts), (COLON, text_start - len(COLON)), (CLOSE, text_start + n_text)):
        out[at[:, None] + np.arange(len(mark))] = np.frombuffer(mark, np.uint8)
    _scatter(out, starts + len(OPEN), role, role_at)
    _scatter(out, text_start, text, text_at)
    return out, np.append(starts, len(out)), text_start, text_start + n_text


def _format(batches):
    """Rows come sorted; a conversation may go on in the next batch, so its last part waits."""
    import pyarrow as pa
    import pyarrow.compute as pc

    names = ["conv_id", "part", "formatted", "loss_start", "loss_end"]

    def parts(table, part: int, last: bool):
        """Rows of whole parts, and the rows left with the number of the part that they begin."""
        buf, at, lo, hi = assemble(table["role"].combine_chunks(), table["text"].combine_chunks())
        conv = table["conv_id"].combine_chunks()
        ids = conv.fill_null(0).to_numpy(zero_copy_only=False)
        null = pc.is_null(conv).to_numpy(zero_copy_only=False)
        new = np.flatnonzero((np.diff(ids) != 0) | (np.diff(null.astype(np.int8)) != 0)) + 1
        mine = pc.fill_null(pc.equal(table["role"].combine_chunks(), "assistant"), False).to_numpy(zero_copy_only=False)
        rows, cuts = [], [0, *new.tolist(), len(ids)]
        left = len(ids)
        for first, end in zip(cuts, cuts[1:], strict=False):
            while first < end:
                stop = int(np.searchsorted(at, at[first] + PART_BYTES, "right")) - 1
                stop = min(max(stop, first + 1), end)
                if stop == end and end == len(ids) and not last:
                    left = first
                    break
                under = np.flatnonzero(mine[first:stop]) + first
                rows.append((None if null[first] else int(ids[first]), part, (at[first], at[stop]), lo[under] - at[first], hi[under] - at[first]))
                part, first = part + 1, stop
            else:
                part = 0
        if rows:
            whole = pa.py_buffer(buf)
            spans = [r[2] for r in rows]
            offsets = np.array([s[0] for s in spans] + [spans[-1][1]], np.int64)
            made = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), whole]).cast(pa.binary())
            columns = [
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.int32()),
                made,
                pa.array([r[3] for r in rows], pa.list_(pa.int64())),
                pa.array([r[4] for r in rows], pa.list_(pa.int64())),
            ]
            return pa.record_batch(columns, names), table.slice(left), part
        return None, table.slice(left), part

    held, part = None, 0
    for batch in slices(batches):
        table = pa.Table.from_batches([batch])
        if held is not None and held.num_rows:
            table = pa.concat_tables([held, table])
        if table.num_rows:
            made, held, part = parts(table, part, False)
            if made is not None:
                yield made
    if held is not None and held.num_rows:
        made, _, _ = parts(held, part, True)
        yield made


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, part, formatted, loss_start, loss_end): a row a conversation, or parts of 4 MB.

    Turns stand in order of turn, then role and text; null roles and texts are empty, null
    conv_ids form one conversation, and repeated rows are repeated turns. The loss spans are
    byte ranges of ``formatted``. Parts of a conversation follow each other in one partition,
    so memory does not grow with a conversation. Other columns are ignored; no rows, no result.
    """
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(_format, SCHEMA)


def read_turns(formatted: bytes):
    """(role, text, where the escaped text starts and ends) of each turn of a part."""
    at = 0
    while at < len(formatted):
        head = _HEADER.match(formatted, at)
        if not head:
            raise ValueError(f"no turn at byte {at}")
        end = formatted.find(CLOSE, head.end())
        if end < 0:
            raise ValueError("a turn has no end")
        yield unescape(head[1]), unescape(formatted[head.end() : end]), head.end(), end
        at = end + len(CLOSE)


def _read_back(batches):
    import hashlib

    import pyarrow as pa

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    now, rows = None, []

    def close():
        conv, n, turns, chars, loss, whole = now
        rows.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), whole))

    for batch in batches:
        for conv, part, raw, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if part == 0:
                if now:
                    close()
                now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            now[5] += len(raw.decode())
            for role, text, _, _ in read_turns(raw):
                now[1] += 1
                now[2].update(role + b"\n" + text + b"\n")
            for start, end in zip(lo, hi, strict=True):
                text = unescape(raw[start:end])
                now[3] += len(text.decode())
                now[4].update(text)
        if rows:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
    if now:
        close()
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_back(formatted: DataFrame) -> DataFrame:
    """A row a conversation of what its formatted bytes and loss mask hold.

    Takes the result of ``format_conversations`` as it is, parts in order.
    """
    return formatted.select("conv_id", "part", "formatted", "loss_start", "loss_end").mapInArrow(
        _read_back,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )
