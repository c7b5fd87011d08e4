import hashlib
import struct
import zlib

import numpy as np
import pytest

from windrow.llm import media_png as M


def test_round_trip_of_any_payload():
    rng = np.random.default_rng(1)
    for n in (1, 2, 50, 700):
        for data in (rng.integers(0, 256, n * 64, np.uint8).tobytes(), bytes(n * 64), bytes(range(64)) * n):
            assert M.read_png(M.write_png(data)).tobytes() == data


@pytest.mark.parametrize("step,colour", [(1, 0), (3, 2), (2, 4), (4, 6)])
def test_all_five_filters_against_the_definition(step, colour):
    rng = np.random.default_rng(step)
    w, h = 7, 11
    plain = rng.integers(0, 256, (h, w * step), np.uint8)
    lines = []
    for y in range(h):
        kind, line = y % 5, [y % 5]
        for x in range(w * step):
            a = int(plain[y, x - step]) if x >= step else 0
            b = int(plain[y - 1, x]) if y else 0
            c = int(plain[y - 1, x - step]) if y and x >= step else 0
            p = a + b - c
            paeth = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]
            line.append((int(plain[y, x]) - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        lines.append(bytes(line))
    body = zlib.compress(b"".join(lines))
    png = M.SIGNATURE + M._chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0)) + M._chunk(b"IDAT", body[:9]) + M._chunk(b"IDAT", body[9:]) + M._chunk(b"IEND", b"")
    assert (M.read_png(png) == plain).all()


def test_damage_is_found():
    png = M.write_png(bytes(range(128)))
    for at in (0, 20, 45, len(png) - 2):
        with pytest.raises(ValueError):
            M.read_png(png[:at] + bytes([png[at] ^ 1]) + png[at + 1 :])
    with pytest.raises(ValueError):
        M.read_png(png[:-12])


def test_cosine_hash_by_definition():
    rng = np.random.default_rng(3)
    image = rng.integers(0, 256, (32, 32), np.uint8)
    x = np.arange(32)
    bits = np.array([[(image * np.outer(np.cos(np.pi * (2 * x + 1) * u / 64), np.cos(np.pi * (2 * x + 1) * v / 64))).sum() for v in range(8)] for u in range(8)]).ravel()
    want = "".join("1" if b > np.median(bits) else "0" for b in bits)
    assert M.cosine_hash(image) == f"{int(want, 2):016x}"


def test_columns_of_a_table(spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "same", "same", "long " * 50_000, "z" * 65]
    rows = [(i if i else None, t, "f") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, extra string")
    got = {r.doc_id: r for r in M.media_features(M.with_media(docs)).collect()}
    for i, t, _ in rows:
        raw = (t or "").encode()
        full = raw + bytes(-len(raw) % 64 if raw else 64)
        r = got[i]
        assert r.payload_bytes == len(full) and r.payload_sha256 == hashlib.sha256(full).hexdigest()
        assert r.tail_crc32 == zlib.crc32(full[-64:]) and M.read_png(bytes(r.media)).tobytes() == full
    assert got[5].feature == got[6].feature and got[5].media == got[6].media
    assert M.media_features(M.with_media(docs.limit(0))).count() == 0


def test_long_payloads_and_bad_headers():
    data = np.random.default_rng(2).integers(0, 9, (3 * M.SLICE_ROWS + 5) * M.WIDTH, np.uint8).tobytes()
    png = M.write_png(data)
    assert M.read_png(png).tobytes() == data and len(png) < len(data)
    header = png[16:29]
    for bad in (header[:-1], header[:10] + b"\1" + header[11:], header[:11] + b"\1" + header[12:]):
        with pytest.raises(ValueError):
            M.read_png(png[:8] + M._chunk(b"IHDR", bad) + png[33:])
