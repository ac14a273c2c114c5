"""Bytes as PNG images in binary columns, and back.

A payload is stored as the samples of an 8-bit RGB image of 64 pixels a row
(192 bytes), deflated and cut into IDAT chunks, each with its CRC. The reader
tests every chunk's CRC and the zlib checksum, undoes the five row filters in
numpy, and hashes the low frequencies of a cosine transform.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from .common import text_rows

SIGNATURE = b"\x89PNG\r\n\x1a\n"
WIDTH, CHANNELS = 64, 3
STRIDE = WIDTH * CHANNELS
IDAT_BYTES = 1 << 16
_GRID, _LOW = 32, 8
#: Rows handed to Arrow at a time, by their bytes.
_BATCH_BYTES = 8 << 20


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """PNG of a payload whose length is a positive multiple of 192.

    Each row takes the filter, of None, Sub and Up, with the least sum of absolute differences.
    """
    rows = np.frombuffer(payload, np.uint8).reshape(-1, STRIDE)
    sub = rows.copy()
    sub[:, CHANNELS:] -= rows[:, :-CHANNELS]
    up = rows.copy()
    up[1:] -= rows[:-1]
    cost = [np.abs(x.view(np.int8).astype(np.int16)).sum(1) for x in (rows, sub, up)]
    kind = np.argmin(cost, axis=0).astype(np.uint8)
    image = np.empty((len(rows), STRIDE + 1), np.uint8)
    image[:, 0] = kind
    image[:, 1:] = np.where((kind == 0)[:, None], rows, np.where((kind == 1)[:, None], sub, up))
    data = zlib.compress(image.tobytes(), level)
    parts = [SIGNATURE, _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0))]
    parts += [_chunk(b"IDAT", data[i : i + IDAT_BYTES]) for i in range(0, len(data), IDAT_BYTES)]
    return b"".join([*parts, _chunk(b"IEND", b"")])


def _unfilter(image: np.ndarray, stride: int, bpp: int) -> np.ndarray:
    kinds, out = image[:, 0], image[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown row filter")
    sub = kinds == 1
    if sub.any():
        out[sub] = np.cumsum(out[sub].reshape(-1, stride // bpp, bpp), axis=1, dtype=np.uint8).reshape(-1, stride)
    # Rows that need the row above, in order; a run of Up rows is one running sum.
    row, n = 0, len(out)
    while row < n:
        if kinds[row] < 2:
            row += 1
        elif kinds[row] == 2:
            others = np.flatnonzero(kinds[row:] != 2)
            stop = row + int(others[0]) if len(others) else n
            before = out[row - 1] if row else np.zeros(stride, np.uint8)
            out[row:stop] = before + np.cumsum(out[row:stop], axis=0, dtype=np.uint8)
            row = stop
        else:
            _slow_row(out, row, kinds[row], bpp)
            row += 1
    return out


def _slow_row(out: np.ndarray, r: int, kind: int, bpp: int) -> None:
    """Average and Paeth depend on the pixel just made; all channels of a pixel go together."""
    up = out[r - 1].astype(np.int32) if r else np.zeros(out.shape[1], np.int32)
    raw, left, corner = out[r].astype(np.int32), np.zeros(bpp, np.int32), np.zeros(bpp, np.int32)
    for p in range(0, len(raw), bpp):
        b = up[p : p + bpp]
        if kind == 3:
            guess = (left + b) // 2
        else:
            base = left + b - corner
            pa, pb, pc = abs(base - left), abs(base - b), abs(base - corner)
            guess = np.where((pa <= pb) & (pa <= pc), left, np.where(pb <= pc, b, corner))
        left = (raw[p : p + bpp] + guess) & 255
        corner = b
        out[r, p : p + bpp] = left


def decode_png(media: bytes) -> tuple[np.ndarray, int, int]:
    """Samples (rows, bytes a row), width and channels; ValueError for any damage."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, header, data, ended = 8, None, [], False
    while at < len(media) and not ended:
        (size,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + size]
        if len(body) != size or struct.unpack_from(">I", media, at + 8 + size)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        at += size + 12
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        ended = kind == b"IEND"
    if not ended or header is None:
        raise ValueError("the file is cut off")
    width, height, depth, colour, _, _, interlace = header
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(colour)
    if depth != 8 or channels is None or interlace:
        raise ValueError("only 8-bit images without palette or interlace")
    try:
        raw = zlib.decompress(b"".join(data))  # tests the Adler checksum
    except zlib.error as e:
        raise ValueError(str(e)) from None
    if len(raw) != height * (width * channels + 1):
        raise ValueError("wrong number of samples")
    image = np.frombuffer(raw, np.uint8).reshape(height, width * channels + 1)
    return _unfilter(image, width * channels, channels), width, channels


@lru_cache
def _cosines() -> np.ndarray:
    k, x = np.arange(_LOW)[:, None], np.arange(_GRID)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * _GRID))


def _shrink(grey: np.ndarray, axis: int) -> np.ndarray:
    """Means over 32 equal spans of an axis; a short axis repeats its samples."""
    n = grey.shape[axis]
    if n < _GRID:
        return np.take(grey, np.arange(_GRID) * n // _GRID, axis)
    edges = np.arange(_GRID) * n // _GRID
    size = np.diff(np.append(edges, n)).reshape([-1 if a == axis else 1 for a in range(2)])
    return np.add.reduceat(grey, edges, axis) / size


def perceptual_hash(samples: np.ndarray, channels: int) -> str:
    """16 hex digits: which of the 8 x 8 lowest frequencies exceed their median."""
    grey = samples.reshape(len(samples), -1, channels).mean(2)
    low = _cosines() @ _shrink(_shrink(grey, 0), 1) @ _cosines().T
    flat = low.ravel()
    bits = flat > np.median(flat[1:])
    return np.packbits(bits).tobytes().hex()


def _encode(batches):
    import pyarrow as pa

    names = ["doc_id", "n_bytes", "media"]
    for batch in batches:
        ids, sizes, media, held = [], [], [], 0
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = text.as_buffer().to_pybytes()
            ids.append(i)
            sizes.append(len(raw))
            media.append(encode_png(raw + b" " * ((-len(raw)) % STRIDE or (0 if raw else STRIDE))))
            held += len(media[-1])
            if held >= _BATCH_BYTES:
                yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names)
                ids, sizes, media, held = [], [], [], 0
        yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names)


def _decode(batches):
    import hashlib

    import pyarrow as pa

    for batch in batches:
        rows = []
        for i, size, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            samples, _, channels = decode_png(media)
            payload = samples.tobytes()
            rows.append(
                (
                    i,
                    size,
                    len(payload),
                    hashlib.sha256(payload).hexdigest(),
                    zlib.crc32(payload[-16:]),
                    len(media),
                    hashlib.sha256(media).hexdigest(),
                    perceptual_hash(samples, channels),
                )
            )
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
        yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and the PNG in the binary column ``media``, a row for each row.

    The text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are the samples.
    """
    return text_rows(docs, id_col, text_col).mapInArrow(_encode, "doc_id long, n_bytes long, media binary")


def read_media(stored: DataFrame) -> DataFrame:
    """Digests and features of what the binary column holds, read back.

    Null text is empty and gives one row of spaces. Equal texts have equal values; null ids
    stay; an empty table gives no rows. A damaged image fails the task with a ValueError.
    """
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(
        _decode,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string",
    )
