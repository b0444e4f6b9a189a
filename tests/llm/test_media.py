import hashlib
import random
import zlib

import numpy as np

from quarry.llm import media


def payloads():
    rng = random.Random(1)
    out = [bytes(rng.randrange(256) for _ in range(64 * k)) for k in (1, 2, 5, 6, 7, 13, 100, 97)]
    out += [bytes([128, 127, 129, 128] * 16), bytes([128] * 64 * 7), bytes(64), bytes([255] * 640)]
    return out + [bytes(rng.choice([128, 127, 129, 126, 131]) for _ in range(6400)), ("né à Ève – " * 99).encode().ljust(1344, b"\0")[:1344]]


def slow_samples(blocks):
    k = np.arange(8)
    c = np.where(k == 0, np.sqrt(1 / 8), 0.5)[None, :] * np.cos((2 * k[:, None] + 1) * k[None, :] * np.pi / 16)
    natural = np.zeros((len(blocks), 64))
    natural[:, media.ZIGZAG] = blocks
    return np.array([c @ b.reshape(8, 8) @ c.T + 128 for b in natural])


def test_round_trip_together_and_alone():
    given = payloads()
    files = media.write(given)
    for want, data, (picture, blocks, rgb) in zip(given, files, media.read(files)):
        assert media.payload_of(picture, blocks) == want
        alone = media.read(media.write([want]))[0]
        assert media.write([want])[0] == data and (alone[2] == rgb).all()
        assert rgb.shape == (picture.height, picture.width, 3)


def test_tensor_is_the_inverse_transform_with_repeated_chroma():
    rng = random.Random(4)
    given = bytes(128 + rng.choice([0, 0, 0, 5, -9, 30, -60]) for _ in range(64 * 24))
    picture, blocks, rgb = media.read(media.write([given]))[0]
    planes = []
    for p, own in zip(picture.parts, blocks):
        s = np.clip(np.round(slow_samples(own)), 0, 255).reshape(p.rows, p.stride, 8, 8).transpose(0, 2, 1, 3).reshape(p.rows * 8, p.stride * 8)
        planes.append(s if p.across == 2 else s.repeat(2, 0).repeat(2, 1))
    y, b, r = planes[0], planes[1] - 128, planes[2] - 128
    want = np.stack([y + 1.402 * r, y - 0.344136 * b - 0.714136 * r, y + 1.772 * b], axis=-1)
    assert np.abs(np.clip(want, 0, 255) - rgb).max() <= 2


def test_file_without_restarts_and_with_long_zero_runs():
    # The same coefficients in one lane: restart markers taken out by writing with a restart interval that is never reached.
    given = bytes(128 + (i % 37 == 0) * 3 for i in range(64 * 30))
    kept = media.RESTART
    try:
        media.RESTART = 60000
        data = media.write([given])[0]
    finally:
        media.RESTART = kept
    picture, blocks, _ = media.read([data])[0]
    assert media.payload_of(picture, blocks) == given


def test_rows(spark):
    texts = [None, "", "x", "y" * 64, "é" * 4000, "y" * 64, "\0\0"]
    df = spark.createDataFrame([(i if i else None, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, media string")
    rows = {r.doc_id: r for r in media.digests(df).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        r, (data, n) = rows[i or None], media.payload(t)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))
    assert rows[3].feature == rows[5].feature and rows[3].media_sha256 == rows[5].media_sha256
    stored = media.to_media(df)
    tensors = {r.doc_id: r for r in media.to_tensors(stored).collect()}
    assert all(len(t.rgb) == t.height * t.width * 3 for t in tensors.values())
    assert media.digests(df.limit(0)).count() == 0
