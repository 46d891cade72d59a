"""Image containers without an image library: what a file claims to be, whether its structure holds, size and pixels.

PNG, JPEG and BMP are walked by their own length fields, so a check costs what the
headers cost (PNG also a CRC over each chunk). Pixels come from PNG (8-bit grey, RGB,
RGBA or palette, not interlaced) and BMP (24 bits, not compressed) only.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PNG, JPEG, BMP = b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff", b"BM"  # fixed values: signatures
CHANNELS = {0: 1, 2: 3, 3: 1, 6: 4}  # fixed values: samples of a PNG's colour types
MAX_PIXELS = 1 << 28  # larger images keep their size and have no pixels


class Image(NamedTuple):
    kind: str | None
    error: str | None        # null: the structure holds
    width: int | None = None
    height: int | None = None
    pixels: np.ndarray | None = None  # (height, width, 3)


def unfiltered(raw: np.ndarray, kinds: np.ndarray, step: int) -> np.ndarray:
    """Undoes PNG's row filters. ``raw``: rows of bytes; ``step``: bytes of a pixel."""
    height, width = raw.shape
    out = np.zeros((height + 1, width + step), np.uint8)  # a row above and a pixel before are zero
    for y in range(height):
        up, row, kind = out[y], out[y + 1], kinds[y]
        if kind == 0:
            row[step:] = raw[y]
        elif kind == 1:  # each byte adds the pixel before: a running sum for each byte of a pixel
            row[step:] = np.cumsum(raw[y].reshape(-1, step), axis=0, dtype=np.uint8).ravel()
        elif kind == 2:
            row[step:] = raw[y] + up[step:]
        elif kind in (3, 4):
            line, above, now = raw[y].tolist(), up.tolist(), row.tolist()
            for x in range(width):
                a, b = now[x], above[x + step]
                if kind == 3:
                    guess = (a + b) >> 1
                else:  # the neighbour nearest to left + above - corner
                    c = above[x]
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = a if pa_ <= pb and pa_ <= pc else b if pb <= pc else c
                now[x + step] = (line[x] + guess) & 255
            row[:] = now
        else:
            raise ValueError(f"filter {kind}")
    return out[1:, step:]


def _png(data: bytes, want_pixels: bool) -> Image:
    at, head, body, palette = 8, None, [], None
    while True:
        if at + 12 > len(data):
            return Image("png", "truncated", *(head or ())[:2])
        size, name = struct.unpack(">I4s", data[at : at + 8])
        if at + 12 + size > len(data):
            return Image("png", "truncated", *(head or ())[:2])
        chunk = data[at + 8 : at + 8 + size]
        if zlib.crc32(name + chunk) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            return Image("png", f"bad checksum of {name.decode('latin-1')}", *(head or ())[:2])
        if head is None:
            if name != b"IHDR" or size != 13:
                return Image("png", "no header")
            head = struct.unpack(">IIBBBBB", chunk)
            if not head[0] or not head[1]:
                return Image("png", "no size")
        elif name == b"PLTE":
            palette = chunk
        elif name == b"IDAT":
            body.append(chunk)
        elif name == b"IEND":
            break
        at += 12 + size
    width, height, depth, colour, _, _, interlaced = head
    if not body:
        return Image("png", "no image data", width, height)
    if not want_pixels or depth != 8 or colour not in CHANNELS or interlaced or width * height > MAX_PIXELS:
        return Image("png", None, width, height)
    step = CHANNELS[colour]
    try:
        rows = zlib.decompressobj().decompress(b"".join(body), height * (width * step + 1))
        rows = np.frombuffer(rows, np.uint8).reshape(height, width * step + 1)
        flat = unfiltered(rows[:, 1:], rows[:, 0], step).reshape(height, width, step)
    except (zlib.error, ValueError) as e:
        return Image("png", f"bad image data: {e}", width, height)
    if colour == 3:
        colours = np.frombuffer(palette or b"", np.uint8)[: len(palette or b"") // 3 * 3].reshape(-1, 3)
        if not len(colours) or int(flat.max()) >= len(colours):
            return Image("png", "bad palette", width, height)
        flat = colours[flat[:, :, 0]]
    return Image("png", None, width, height, np.repeat(flat, 3, axis=2) if step == 1 and colour == 0 else flat[:, :, :3])


def _jpeg(data: bytes) -> Image:
    at, size = 2, ()
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            return Image("jpeg", "no marker", *size)
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        if mark == 0xD9:
            return Image("jpeg", "no image data", *size)
        length = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if at + 2 + length > len(data):
            return Image("jpeg", "truncated", *size)
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and length >= 8:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            size = width, height
        if mark == 0xDA:
            if not size:
                return Image("jpeg", "no size")
            return Image("jpeg", None if data.rstrip(b"\0").endswith(b"\xff\xd9") else "truncated", *size)
        at += 2 + length
    return Image("jpeg", "truncated", *size)


def _bmp(data: bytes, want_pixels: bool) -> Image:
    if len(data) < 54:
        return Image("bmp", "truncated")
    begin, head, width, height, _, bits, packed = struct.unpack("<4xIIiiHHI", data[6:34])
    if head < 40 or width <= 0 or not height:
        return Image("bmp", "no size")
    line = (width * bits + 31) // 32 * 4
    if not packed and begin + line * abs(height) > len(data):
        return Image("bmp", "truncated", width, abs(height))
    if packed or bits != 24 or not want_pixels or width * abs(height) > MAX_PIXELS:
        return Image("bmp", None, width, abs(height))
    rows = np.frombuffer(data, np.uint8, line * abs(height), begin).reshape(abs(height), line)[:, : width * 3]
    pixels = rows.reshape(abs(height), width, 3)[:, :, ::-1]
    return Image("bmp", None, width, abs(height), pixels[::-1] if height > 0 else pixels)


def parsed(data: bytes | None, want_pixels: bool = True) -> Image:
    """What the bytes are; null and unknown content have an error."""
    if not data:
        return Image(None, "empty")
    if data.startswith(PNG):
        return _png(data, want_pixels)
    if data.startswith(JPEG):
        return _jpeg(data)
    if data.startswith(BMP):
        return _bmp(data, want_pixels)
    return Image(None, "not an image")


def with_image_facts(df: DataFrame, content: str = "content", pixels: bool = True) -> DataFrame:
    """Adds image_kind, image_error, width, height and mean_rgb (array of 3 doubles) of a binary column.

    A row whose content isn't a whole image has image_error; the others have none.
    mean_rgb is null where there are no pixels to read, or without ``pixels``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parsed(x.as_py(), pixels) for x in batch.column(batch.schema.get_field_index(content))]
            mean = [None if f.pixels is None else (f.pixels.reshape(-1, 3).sum(axis=0, dtype=np.int64) / (f.width * f.height)).tolist() for f in found]
            facts = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.record_batch([*batch.columns, *facts, pa.array(mean, pa.list_(pa.float64()))], names=[*batch.schema.names, "image_kind", "image_error", "width", "height", "mean_rgb"])

    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

    added = [StructField("image_kind", StringType()), StructField("image_error", StringType()), StructField("width", IntegerType()), StructField("height", IntegerType()), StructField("mean_rgb", ArrayType(DoubleType()))]
    return df.mapInArrow(run, StructType([*df.schema.fields, *added]))


def load_images(rows: DataFrame, source: str = "source", headers: dict[str, str] | None = None, timeout: float = 30.0, at_once: int = 4) -> DataFrame:
    """Adds content, name, sha256 and load_error to rows whose ``source`` is a path, a URI, an http(s) or a data URL, or bytes.

    name is the last step of a path or URL before any query, "image" if that is empty,
    and null for bytes and data URLs. A source that can't be read is its row's error;
    some are read at once in each task.
    """
    import base64
    import hashlib

    from pyspark.sql.types import BinaryType, StringType, StructField, StructType

    from marlstone.operators.pull import fetch_uri, in_order

    def read(given: str | bytes | None) -> bytes:
        if given is None:
            raise ValueError("no source")
        if not isinstance(given, str):
            return bytes(given)
        if given.startswith("data:"):
            return base64.b64decode(given.partition(",")[2], validate=True)
        return fetch_uri(given, headers, timeout)

    def named(given: str | bytes | None) -> str | None:
        return (given.split("?")[0].rsplit("/", 1)[-1] or "image") if isinstance(given, str) and not given.startswith("data:") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(source)
            for begin in range(0, batch.num_rows, 64):  # so many contents are held at once
                part = batch.slice(begin, 64)
                given = part.column(at).to_pylist()
                got: list[bytes | None] = [None] * len(given)

                def one(k: int, what: str | bytes | None, got=got) -> None:
                    got[k] = read(what)

                errors = [None if e is None else f"{type(e).__name__}: {e}" for _, e in in_order(enumerate(given), one, at_once)]
                sha = [None if c is None else hashlib.sha256(c).hexdigest() for c in got]
                columns = [pa.array(got, pa.binary()), pa.array([named(g) for g in given], pa.string()), pa.array(sha, pa.string()), pa.array(errors, pa.string())]
                yield pa.record_batch([*part.columns, *columns], names=[*part.schema.names, "content", "name", "sha256", "load_error"])

    added = [StructField("content", BinaryType()), *(StructField(n, StringType()) for n in ("name", "sha256", "load_error"))]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *added]))


def valid_images(df: DataFrame, content: str = "content") -> DataFrame:
    """The rows whose content is a whole image; the rest of an upload is left out."""
    return with_image_facts(df, content).filter("image_error is null")


def encode_png(pixels: np.ndarray, kinds: list[int] | None = None) -> bytes:
    """An RGB PNG of (height, width, 3) pixels; ``kinds``: the filter of each row (0, 1 or 2)."""
    height, width, _ = pixels.shape
    flat = pixels.reshape(height, width * 3)
    rows = []
    for y in range(height):
        kind = kinds[y] if kinds else 0
        before = {0: np.zeros(width * 3, np.uint8), 1: np.append(np.zeros(3, np.uint8), flat[y, :-3]), 2: flat[y - 1] if y else np.zeros(width * 3, np.uint8)}[kind]
        rows.append(bytes([kind]) + (flat[y] - before).tobytes())

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"".join(rows), 1)) + chunk(b"IEND", b"")
