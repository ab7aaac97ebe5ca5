"""Media columns: payloads kept losslessly in progressive JPEG files, and tensors read from them.

A payload's bytes, less 128, are the quantised coefficients of an image with halved chroma,
which is its format's unit: entropy coding loses nothing, while samples would be rounded. The
number of blocks in use stands in the comment segment. Reading a file accumulates its scans into
coefficients, gives the payload back, and transforms them to a full-resolution RGB tensor.

Defined results: a null or empty text has a payload of 64 zero bytes; texts of any length are
stored whole; equal texts give equal values; a null doc_id is passed on; repeated rows give
repeated rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from skein.llm import progressive_jpeg as jpeg
from skein.llm.common import as_bytes, batches_of, doc_text, table

#: Payload bytes that a worker holds as images at a time (or one document, if that is longer).
AT_ONCE = 1 << 18
STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])


def payload(text: bytes) -> bytes:
    """The bytes with zeros up to a positive multiple of 64."""
    return text + bytes(max(64, -(-len(text) // 64) * 64) - len(text))


def parcels(sizes: list[int]) -> Iterator[slice]:
    """Neighbours of at most AT_ONCE bytes together."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > AT_ONCE:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield slice(start, len(sizes))


def write_images(payloads: list[bytes]) -> list[bytes]:
    """A progressive JPEG file for each payload."""
    used = np.array([len(p) // 64 for p in payloads])
    mcus = -(-used // jpeg.MCU)
    columns = jpeg.mcu_columns(mcus)
    mcus = -(-mcus // columns) * columns
    blocks = np.zeros((int(mcus.sum()) * jpeg.MCU, jpeg.SIZE), np.int16)
    first = np.concatenate([[0], np.cumsum(mcus)]) * jpeg.MCU
    for p, at, n in zip(payloads, first, used):
        blocks[at : at + n] = np.frombuffer(p, np.uint8).reshape(-1, jpeg.SIZE).astype(np.int16) - 128
    return jpeg.encode(blocks, mcus, [int(n).to_bytes(8, "big") for n in used])


def read_images(files: list[bytes]) -> tuple[list[jpeg.Image], np.ndarray, list[bytes]]:
    """Headers, coefficients of all images, and the payloads."""
    images = [jpeg.parse(f) for f in files]
    c = jpeg.coefficients(images)
    flat = (c + 128).astype(np.uint8)
    return images, c, [flat[im.first_block : im.first_block + int.from_bytes(im.comment, "big")].tobytes() for im in images]


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of every document; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column("doc_id"), as_bytes(batch.column("text"))
            for part in parcels([len(t) for t in texts]):
                own = texts[part]
                yield batches_of({"doc_id": ids.slice(part.start, len(own)), "n_bytes": [len(t) for t in own], "media": write_images([payload(t) for t in own])}, STORED)

    return doc_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(stored: DataFrame) -> DataFrame:
    """Reads the media column back: payload digests and a feature of the RGB tensor.

    The feature names width, height and for each colour the mean and the spread of its samples,
    from sums in whole numbers.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
    sha = lambda x: hashlib.sha256(x).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = as_bytes(batch.column("media"))
            for part in parcels([len(f) for f in files]):
                own = files[part]
                images, c, payloads = read_images(own)
                yield batches_of(
                    {
                        "doc_id": batch.column("doc_id").slice(part.start, len(own)),
                        "n_bytes": batch.column("n_bytes").slice(part.start, len(own)),
                        "payload_bytes": [len(p) for p in payloads],
                        "payload_sha256": [sha(p) for p in payloads],
                        "tail_crc32": [zlib.crc32(p[-64:]) for p in payloads],
                        "media_bytes": [len(f) for f in own],
                        "media_sha256": [sha(f) for f in own],
                        "feature": describe(images, c),
                    },
                    out,
                )

    return stored.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def describe(images: list[jpeg.Image], c: np.ndarray) -> list[str]:
    """From the images that write_images makes, all MCUs at once."""
    pixels = jpeg.mcu_rgb(jpeg.samples(c))
    at = np.array([im.first_block // jpeg.MCU for im in images])
    n = np.array([im.width * im.height for im in images])[:, None]
    sums = []
    for colour in range(3):  # 256 samples and their squares add up to whole numbers below 2 ** 24
        x = pixels[..., colour].reshape(-1, 256).astype(np.float32)
        sums.append((x @ np.ones(256, np.float32), np.einsum("ij,ij->i", x, x)))
    total, square = (np.add.reduceat(np.stack([s[i] for s in sums], axis=1).astype(np.int64), at) for i in (0, 1))
    mean = total // n
    spread = square // n - mean * mean
    return [f"{im.width}x{im.height} mean {','.join(map(str, m))} spread {','.join(map(str, s))}" for im, m, s in zip(images, mean.tolist(), spread.tolist())]


def tensors(stored: DataFrame) -> DataFrame:
    """doc_id, height, width and the full-resolution RGB tensor (row by row, 3 bytes a pixel)."""
    out = pa.schema([("doc_id", pa.int64()), ("height", pa.int32()), ("width", pa.int32()), ("rgb", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = as_bytes(batch.column("media"))
            for part in parcels([len(f) for f in files]):
                made = jpeg.decode(files[part])
                yield batches_of({"doc_id": batch.column("doc_id").slice(part.start, len(made)), "height": [x.shape[0] for x in made], "width": [x.shape[1] for x in made], "rgb": [x.tobytes() for x in made]}, out)

    return stored.mapInArrow(run, "doc_id long, height int, width int, rgb binary")


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features(store(table(spark, sf_dir, "documents")))
