"""Images read from PNG, given transparency, and written again, in batches."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.operators.render import png

SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: Pixels of an image, beyond which its header is taken for damage.
MOST_PIXELS = 1 << 28


class Fault(ValueError):
    """What is wrong with an image."""


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    if data[:8] != SIGNATURE:
        raise Fault("no PNG")
    at = 8
    while at < len(data):
        if at + 12 > len(data):
            raise Fault("ends inside a chunk")
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or at + 12 + size > len(data):
            raise Fault("ends inside a chunk")
        if zlib.crc32(kind + body) != struct.unpack(">I", data[at + 8 + size : at + 12 + size])[0]:
            raise Fault("checksum of a chunk")
        yield kind, body
        if kind == b"IEND":
            return
        at += 12 + size
    raise Fault("no end")


def _paeth(line: np.ndarray, above: np.ndarray, step: int) -> None:
    """Undoes the fourth filter in place; each byte needs the one before, so pixels go one after the other."""
    left, corner = [0] * step, [0] * step
    out = line.tolist()
    for k, up in enumerate(above.tolist()):
        a, c = left[k % step], corner[k % step]
        p, q, r = abs(up - c), abs(a - c), abs(a + up - 2 * c)
        out[k] = (out[k] + (a if p <= q and p <= r else up if q <= r else c)) & 255
        left[k % step], corner[k % step] = out[k], up
    line[:] = out


def _average(line: np.ndarray, above: np.ndarray, step: int) -> None:
    out = line.tolist()
    for k, up in enumerate(above.tolist()):
        out[k] = (out[k] + ((out[k - step] if k >= step else 0) + up) // 2) & 255
    line[:] = out


def unfiltered(raw: bytes, height: int, width: int, step: int) -> np.ndarray:
    """The lines of an image of height and width * step bytes a line, whose filters are undone."""
    lines = np.frombuffer(raw, np.uint8).reshape(height, 1 + width * step)
    out = lines[:, 1:].copy()
    above = np.zeros(width * step, np.uint8)
    for y, kind in enumerate(lines[:, 0].tolist()):
        line = out[y]
        if kind == 1:
            line[:] = np.cumsum(line.reshape(width, step), axis=0, dtype=np.uint8).reshape(-1)
        elif kind == 2:
            line += above
        elif kind == 3:
            _average(line, above, step)
        elif kind == 4:
            _paeth(line, above, step)
        elif kind:
            raise Fault(f"filter {kind}")
        above = line
    return out


def read_png(data: bytes | None) -> np.ndarray:
    """Red, green, blue and opacity of an image of 8 bits a channel, height by width by 4; a Fault for anything else."""
    header, palette, clear, body = None, None, b"", []
    for kind, part in _chunks(data or b""):
        if kind == b"IHDR":
            header = struct.unpack(">IIBBBBB", part) if len(part) == 13 else None
        elif kind == b"PLTE":
            palette = part
        elif kind == b"tRNS":
            clear = part
        elif kind == b"IDAT":
            body.append(part)
    if not header:
        raise Fault("no header")
    width, height, bits, colours, _, _, laced = header
    if bits != 8 or laced or colours not in CHANNELS:
        raise Fault("a kind of PNG that isn't read")
    if not 0 < width * height <= MOST_PIXELS:
        raise Fault("size")
    step = CHANNELS[colours]
    inflate, size = zlib.decompressobj(), height * (1 + width * step)
    try:
        raw = inflate.decompress(b"".join(body), size)
    except zlib.error as fault:
        raise Fault("compressed data") from fault
    if len(raw) != size:
        raise Fault("length of the data")
    pixels = unfiltered(raw, height, width, step).reshape(height, width, step)
    out = np.full((height, width, 4), 255, np.uint8)
    if colours == 3:
        table = np.zeros((256, 4), np.uint8)
        table[:, 3] = 255
        known = len(palette or b"") // 3
        if not known or pixels.max() >= known:
            raise Fault("palette")
        table[:known, :3] = np.frombuffer(palette[: known * 3], np.uint8).reshape(known, 3)
        table[: len(clear[:256]), 3] = np.frombuffer(clear[:256], np.uint8)
        return table[pixels[..., 0]]
    out[..., :3] = pixels[..., : 3 if step >= 3 else 1]
    if step in (2, 4):
        out[..., 3] = pixels[..., -1]
    return out


def black_keyed(rgba: np.ndarray) -> np.ndarray:
    """The image with opacity from its brightness, so that black vanishes."""
    out = rgba.copy()
    total = rgba[..., :3].astype(np.float64).sum(axis=2)
    out[..., 3] = (np.clip((total - 6.0) / 60.0, 0.0, 1.0) * 255.0).astype(np.uint8)
    return out


def rewrite_images(images: DataFrame, image: str = "image") -> DataFrame:
    """images with their pictures made transparent where they are black; those that can't be read stay as they are, with their fault.

    Null is a fault too. One picture is held at a time. fault replaces a column of that name.
    """
    rest = [c for c in images.columns if c not in (image, "fault")]
    inner = images.select(*rest, image)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1)
                data, fault = row.column(image)[0].as_py(), None
                try:
                    data = png(black_keyed(read_png(data)))
                except Fault as found:
                    fault = str(found)
                columns = [row.column(c) for c in rest] + [pa.array([data], pa.binary()), pa.array([fault], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, [*rest, image, "fault"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in inner.schema)
    return inner.mapInArrow(run, f"{fields}, fault string")


def pixels(images: DataFrame, key: str, image: str = "image") -> DataFrame:
    """key, row, col, r, g, b, alpha of every pixel, and one row with a fault for an image that can't be read."""
    kind = images.schema[key].dataType.simpleString()
    names = [key, "row", "col", "r", "g", "b", "alpha", "fault"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                own = batch.column(key).slice(k, 1)
                try:
                    rgba = read_png(batch.column(image)[k].as_py())
                except Fault as found:
                    yield pa.RecordBatch.from_arrays([own, *[pa.nulls(1, pa.int32())] * 6, pa.array([str(found)])], names)
                    continue
                rows, cols = np.indices(rgba.shape[:2], np.int32).reshape(2, -1)
                many = own.take(pa.array(np.zeros(len(rows), np.int64)))
                parts = [pa.array(rgba[..., c].reshape(-1).astype(np.int32)) for c in range(4)]
                yield pa.RecordBatch.from_arrays([many, pa.array(rows), pa.array(cols), *parts, pa.nulls(len(rows), pa.string())], names)

    return images.select(key, F.col(image).alias(image)).mapInArrow(run, f"`{key}` {kind}, row int, col int, r int, g int, b int, alpha int, fault string")
