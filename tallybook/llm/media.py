"""Media columns: texts stored as TIFF images, and TIFF columns walked into one row per page.

`store_texts` packs a text's UTF-8 bytes, zero-padded to a positive multiple of 64, as an image of 64 samples a row.
Codec and layout follow from the payload's CRC-32 alone, at every size, so equal texts give equal files: PackBits
strips, LZW strips, deflate tiles, or deflate strips with the horizontal predictor. `tiff_pages` decodes any
column of TIFF files. Both run row by row inside tasks; nothing is shuffled.

Edge cases: a null or empty text is one row of 64 zero samples; a null file has no pages; a file that is no TIFF or
uses an unsupported codec gives one row with page null and the error's text. Repeated rows each give their pages.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame

from tallybook.llm import tiff
from tallybook.llm.batches import map_rows

SAMPLES_A_ROW = 64
CODECS = {tiff.NONE: "none", tiff.LZW: "lzw", tiff.DEFLATE: "deflate", tiff.OLD_DEFLATE: "deflate", tiff.PACKBITS: "packbits"}


def payload(text: str | None) -> tuple[int, bytes]:
    """Length of the text's UTF-8 bytes, and these padded with zeros."""
    data = (text or "").encode("utf-8", "surrogatepass")
    return len(data), data.ljust(max(SAMPLES_A_ROW, -(-len(data) // SAMPLES_A_ROW) * SAMPLES_A_ROW), b"\0")


def to_tiff(data: bytes) -> bytes:
    """A payload as a one-page TIFF file."""
    page = {"samples": np.frombuffer(data, np.uint8).reshape(-1, SAMPLES_A_ROW)}
    choice = zlib.crc32(data) % 4
    if choice == 0:
        page |= {"compression": tiff.PACKBITS}
    elif choice == 1:
        page |= {"compression": tiff.LZW}
    elif choice == 2:
        page |= {"compression": tiff.DEFLATE, "tile": SAMPLES_A_ROW}
    else:
        page |= {"compression": tiff.DEFLATE, "predictor": 2}
    return tiff.write_tiff([page])


def _stored(doc_id: int, text: str | None) -> Iterator[tuple]:
    n, data = payload(text)
    yield doc_id, n, to_tiff(data)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: every text as a TIFF file."""
    return map_rows(docs.select(doc_id, text), _stored, "doc_id bigint, n_bytes bigint, media binary")


def _pages(key: int, n_bytes: int, media: bytes | None) -> Iterator[tuple]:
    try:
        for page in tiff.read_pages(media) if media is not None else ():
            samples = page["samples"]
            counts = np.bincount(samples.ravel().view(np.uint8), minlength=256)
            share = counts[counts > 0] / counts.sum()
            codec = CODECS[page["compression"]] + (" predictor" if page["predictor"] == 2 else "") + (" tiles" if page["tiled"] else " strips")
            feature = f"{page['width']}x{page['height']} {codec} mean {samples.mean():.4f} entropy {-(share * np.log2(share)).sum() + 0.0:.4f}"
            yield key, n_bytes, media, page["page"], page["width"], page["height"], samples.tobytes(), feature, None
    except Exception as error:  # a damaged file: told in its row
        yield key, n_bytes, media, None, None, None, None, None, f"{type(error).__name__}: {error}"


def tiff_pages(media: DataFrame, key: str = "doc_id", n_bytes: str = "n_bytes", column: str = "media") -> DataFrame:
    """One row per page of every file: page, width, height, samples (bytes, row by row), feature, error."""
    schema = "doc_id bigint, n_bytes bigint, media binary, page int, width int, height int, samples binary, feature string, error string"
    return map_rows(media.select(key, n_bytes, column), _pages, schema)
