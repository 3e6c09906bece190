"""TIFF 6.0 files of 8-bit or 16-bit samples: writing single files, walking directories, decoding strips and tiles."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np

# Tag numbers and compression codes of the TIFF 6.0 format.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPE_FORMATS = {1: "B", 2: "c", 3: "H", 4: "I", 16: "Q"}

_RUN = re.compile(rb"(.)\1{2,127}", re.DOTALL)


def packbits_encode(data: bytes) -> bytes:
    """Runs of three and more bytes, literals of up to 128 between them."""
    out, at = bytearray(), 0

    def literals(end: int) -> None:
        for k in range(at, end, 128):
            part = data[k : min(k + 128, end)]
            out.append(len(part) - 1)
            out.extend(part)

    for run in _RUN.finditer(data):
        literals(run.start())
        out.append(257 - (run.end() - run.start()))
        out.append(data[run.start()])
        at = run.end()
    literals(len(data))
    return bytes(out)


def packbits_decode(data: bytes) -> bytes:
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += n + 2
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first; codes widen one entry early, as TIFF asks for."""
    clear, end = 256, 257
    fresh = {bytes([b]): b for b in range(256)}
    table, bits, acc, held, out = dict(fresh), 9, clear, 9, bytearray()
    following, word = 258, b""
    for k in range(len(data)):
        longer = word + data[k : k + 1]
        if longer in table:
            word = longer
            continue
        acc, held = acc << bits | table[word], held + bits
        table[longer] = following
        following += 1
        word = data[k : k + 1]
        if following == 4094:
            acc, held = acc << bits | clear, held + bits
            table, bits, following = dict(fresh), 9, 258
        elif following + 1 > 1 << bits:
            bits += 1
        if held > 512:
            rest = held % 8
            out += (acc >> rest).to_bytes(held // 8, "big")
            acc, held = acc & ((1 << rest) - 1), rest
    if word:
        acc, held = acc << bits | table[word], held + bits
        following += 1
        if following + 1 > 1 << bits and bits < 12:
            bits += 1
    acc, held = acc << bits | end, held + bits
    pad = -held % 8
    return bytes(out) + (acc << pad).to_bytes((held + pad) // 8, "big")


def lzw_decode(data: bytes) -> bytes:
    clear, end = 256, 257
    singles = [bytes([b]) for b in range(256)] + [b"", b""]
    table, bits, acc, held, out, last = list(singles), 9, 0, 0, [], None
    for byte in data:
        acc, held = acc << 8 | byte, held + 8
        if held < bits:
            continue
        held -= bits
        code, acc = acc >> held, acc & ((1 << held) - 1)
        if code == clear:
            table, bits, last = list(singles), 9, None
            continue
        if code == end:
            break
        if last is None:
            entry = table[code]
        else:
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        if len(table) + 1 >= 1 << bits and bits < 12:
            bits += 1
    return b"".join(out)


def _packed(data: bytes, compression: int) -> bytes:
    return {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 6), PACKBITS: packbits_encode}[compression](data)


def _unpacked(data: bytes, compression: int) -> bytes:
    if compression not in (NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS):
        raise ValueError(f"TIFF compression {compression} is not supported")
    return {NONE: bytes, LZW: lzw_decode, DEFLATE: zlib.decompress, OLD_DEFLATE: zlib.decompress, PACKBITS: packbits_decode}[compression](data)


def write_tiff(pages: list[dict]) -> bytes:
    """A little-endian file of pages {samples: uint8 array (rows, columns), compression, predictor, tile or strip rows}."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for page in pages:
        image, compression, predictor, tile = page["samples"], page.get("compression", DEFLATE), page.get("predictor", 1), page.get("tile")
        height, width = image.shape
        if tile:
            padded = np.zeros((-(-height // tile) * tile, -(-width // tile) * tile), np.uint8)
            padded[:height, :width] = image
            blocks = [padded[y : y + tile, x : x + tile] for y in range(0, padded.shape[0], tile) for x in range(0, padded.shape[1], tile)]
        else:
            rows = page.get("rows", 128)
            blocks = [image[y : y + rows] for y in range(0, height, rows)]
        offsets, counts = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = _packed(np.ascontiguousarray(block).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
        tags = [(WIDTH, 4, [width]), (LENGTH, 4, [height]), (BITS, 3, [8]), (COMPRESSION, 3, [compression]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 3, [tile]), (TILE_LENGTH, 3, [tile]), (TILE_OFFSETS, 4, offsets), (TILE_COUNTS, 4, counts)] if tile else [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, [rows]), (STRIP_COUNTS, 4, counts)]
        entries = []
        for tag, kind, values in sorted(tags):
            raw = struct.pack(f"<{len(values)}{TYPE_FORMATS[kind]}", *values)
            if len(raw) > 4:
                raw, place = struct.pack("<I", len(out) + len(out) % 2), raw
                out += b"\0" * (len(out) % 2) + place
            entries.append(struct.pack("<HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        out[link : link + 4] = struct.pack("<I", len(out))
        out += struct.pack("<H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """Byte order and tags of every image directory, in the order of their links; a link back ends the walk."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack(order + "H", data[2:4]) != (42,):
        raise ValueError("not a TIFF file")
    (at,), seen = struct.unpack(order + "I", data[4:8]), set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind in TYPE_FORMATS:
                form, where = f"{order}{count}{TYPE_FORMATS[kind]}", at + 10 + 12 * k
                if struct.calcsize(form) > 4:
                    (where,) = struct.unpack_from(order + "I", data, where)
                tags[tag] = list(struct.unpack_from(form, data, where))
        yield order, tags
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def read_pages(data: bytes) -> Iterator[dict]:
    """Every page of a file: number, width, height, compression, predictor, layout and its samples as an array."""
    for number, (order, tags) in enumerate(_directories(data)):
        one = lambda tag, default=None: tags.get(tag, [default])[0]
        width, height, samples = one(WIDTH), one(LENGTH), one(SAMPLES, 1)
        bits, compression, predictor = one(BITS, 1), one(COMPRESSION, NONE), one(PREDICTOR, 1)
        if bits not in (8, 16) or predictor not in (1, 2):
            raise ValueError(f"TIFF of {bits} bits, predictor {predictor} is not supported")
        kind = np.dtype(np.uint8) if bits == 8 else np.dtype(np.uint16).newbyteorder(order)
        tiled = TILE_OFFSETS in tags
        block_w, block_h = (one(TILE_WIDTH), one(TILE_LENGTH)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
        image, across = np.zeros((height, width, samples), kind.newbyteorder("=")), -(-width // block_w)
        for k, (at, size) in enumerate(zip(tags[TILE_OFFSETS if tiled else STRIP_OFFSETS], tags[TILE_COUNTS if tiled else STRIP_COUNTS])):
            y, x = k // across * block_h, k % across * block_w
            rows = block_h if tiled else min(block_h, height - y)
            block = np.frombuffer(_unpacked(data[at : at + size], compression), kind, rows * block_w * samples).reshape(rows, block_w, samples)
            if predictor == 2:
                block = np.cumsum(block, axis=1, dtype=image.dtype)
            image[y : y + rows, x : x + block_w] = block[: height - y, : width - x]
        yield {"page": number, "width": width, "height": height, "compression": compression, "predictor": predictor, "tiled": tiled, "samples": image}
