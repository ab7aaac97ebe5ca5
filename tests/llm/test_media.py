import hashlib
import os
import random
import zlib

import numpy as np
import pytest

from skein.llm import media
from skein.llm import progressive_jpeg as jpeg
from tests.llm.helpers import empty_documents, odd_documents, odd_texts


def payloads():
    rng = random.Random(4)
    odd = bytes(rng.choice([126, 127, 128, 129, 130, 128, 128]) for _ in range(2000))
    return [media.payload(x) for x in (b"", b"\x80" * 640, bytes(range(256)) * 3, odd, bytes([128] * 40 + [129] + [128] * 100), os.urandom(5000), b"\xff" * 300, b"plain text " * 30)]


def test_round_trip():
    own = payloads()
    files = media.write_images(own)
    assert media.read_images(files)[2] == own
    assert [media.read_images([f])[2][0] for f in files] == own
    assert media.write_images(own[3:4]) == files[3:4]


def test_long_payload_takes_several_rows():
    own = [media.payload(os.urandom(jpeg.MOST_COLUMNS * 6 * 64 + 100))]
    files = media.write_images(own)
    assert jpeg.parse(files[0]).mcu_shape[0] == 2
    assert media.read_images(files)[2] == own


def test_without_restart_markers_and_with_end_runs():
    """An image as other encoders write it: one interval, runs of ended blocks, one component."""
    dc, dc_lengths = jpeg._codes(jpeg.DC_TABLE[0], tuple(jpeg.DC_TABLE[1]))
    table = jpeg._table({4: [0x00, 0x01, 0x02, 0x10, 0x11, 0x20, 0xF0]})
    ac, ac_lengths = jpeg._codes(table[0], tuple(table[1]))
    sym = lambda s: (ac[s], ac_lengths[s])

    def bits(*pairs):
        s = "".join(format(int(v), f"0{int(n)}b") for v, n in pairs)
        s += "1" * (-len(s) % 8)
        return bytes(int(s[i : i + 8], 2) for i in range(0, len(s), 8)).replace(b"\xff", b"\xff\x00")

    seg = jpeg._segment
    frame = bytes([8]) + (8).to_bytes(2, "big") + (40).to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    head = b"\xff\xd8" + seg(0xDB, bytes([0]) + bytes([1] * 64)) + seg(0xC2, frame) + seg(0xC4, bytes([0]) + jpeg.DC_TABLE[0] + bytes(jpeg.DC_TABLE[1])) + seg(0xC4, bytes([0x10]) + table[0] + bytes(table[1]))
    # DC of five blocks: 5, then the same again
    first = seg(0xDA, bytes([1, 1, 0, 0, 0, 0])) + bits((dc[3], dc_lengths[3]), (5, 3), *[(dc[0], dc_lengths[0])] * 4)
    # block 0 has 2 at place 1; then a run ends it and the four blocks after it
    band = seg(0xDA, bytes([1, 1, 0, 1, 63, 0x01])) + bits(sym(0x01), (1, 1), sym(0x20), (1, 2))
    # block 0: its value gets its low bit, and nothing new; block 1: -1 after a zero; a run of ends for the rest
    refined = seg(0xDA, bytes([1, 1, 0, 1, 63, 0x10])) + bits(sym(0x00), (1, 1), sym(0x11), (0, 1), sym(0x00), sym(0x10), (1, 1))
    data = head + first + band + refined + b"\xff\xd9"
    c = jpeg.coefficients([jpeg.parse(data)])
    assert c[:, 0].tolist() == [5] * 5
    assert {(int(i), int(k)): int(c[i, k]) for i, k in zip(*np.nonzero(c[:, 1:]))  for k in [k + 1]} == {(0, 1): 3, (1, 2): -1}
    assert jpeg.decode([data])[0].shape == (8, 40, 3)


def test_transform_against_the_definition():
    rng = np.random.default_rng(1)
    c = rng.integers(-40, 40, (3, 64))
    got = jpeg.samples(c).astype(int)
    for block, s in zip(c, got):
        f = np.zeros((8, 8))
        f[jpeg.ZIGZAG // 8, jpeg.ZIGZAG % 8] = block
        for y in range(0, 8, 3):
            for x in range(0, 8, 2):
                total = sum((np.sqrt(0.5) if u == 0 else 1) * (np.sqrt(0.5) if v == 0 else 1) * f[v, u] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4
                assert abs(np.clip(total + 128, 0, 255) - s[y * 8 + x]) <= 1.01


def test_colour_and_chroma():
    assert jpeg.to_rgb(np.array([128]), np.array([128]), np.array([128])).tolist() == [[128, 128, 128]]
    red = jpeg.to_rgb(np.array([76]), np.array([85]), np.array([255]))[0]
    assert red[0] >= 250 and red[1] <= 3 and red[2] <= 3
    own = payloads()
    files = media.write_images(own)
    images, c, _ = media.read_images(files)
    whole = jpeg.decode(files)
    mcus = jpeg.mcu_rgb(jpeg.samples(c))
    for image, tensor in zip(images, whole):
        assert tensor.shape == (image.height, image.width, 3)
        n = image.width // 16
        at = image.first_block // 6
        assert (tensor[:16] == np.concatenate(list(mcus[at : at + n]), axis=1)).all()


def test_other_kinds_are_refused():
    with pytest.raises(ValueError):
        jpeg.parse(b"\xff\xd8" + jpeg._segment(0xC0, bytes(10)))


def test_query(spark):
    docs = odd_documents(spark)
    stored = media.store(docs)
    rows = media.features(stored).collect()
    assert len(rows) == docs.count()
    feature = {}
    for r in rows:
        if r["doc_id"] is None:
            continue
        p = media.payload((odd_texts()[r["doc_id"]] or "").encode())
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert feature.setdefault(p, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    t = media.tensors(stored).first()
    assert len(t["rgb"]) == t["height"] * t["width"] * 3
    assert media.features(media.store(empty_documents(spark))).count() == 0
