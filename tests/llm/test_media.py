"""Images against plain loops and exact round trips."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import media, queries


def test_round_trips():
    rng = np.random.default_rng(1)
    grey, rgb = rng.integers(0, 256, (7, 5), np.uint8), rng.integers(0, 256, (3, 6, 3), np.uint8)
    for image, forms in ((grey, (media.encode_pgm, media.encode_bmp)), (rgb, (media.encode_ppm, media.encode_bmp))):
        for form in forms:
            assert np.array_equal(media.decode(form(image)), image)


def test_text_forms_and_damage():
    assert media.decode(b"P1\n# c\n2 2\n0 1\n1 0\n").tolist() == [[255, 0], [0, 255]]
    assert media.decode(b"P2 2 1 15 0 15").tolist() == [[0, 255]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4 3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 1 1 65535\n\xff\xff").tolist() == [[255]]
    for bad in (b"", b"GIF", b"P5 9 9 255\n12", b"BM123"):
        with pytest.raises((ValueError, media.struct.error)):
            media.decode(bad)


def test_area_resize(monkeypatch):
    rng = np.random.default_rng(2)
    image = rng.integers(0, 256, (11, 6), np.uint8)
    fine = np.kron(image, np.ones((4, 9)))  # a common grid of 44 x 54
    want = fine.reshape(4, 11, 9, 6).mean((1, 3))
    assert np.allclose(media.area_resize(image, 4, 9), want)
    monkeypatch.setattr(media, "STRIP", 3)
    assert np.allclose(media.area_resize(image, 4, 9), want)


def test_tile_and_hash():
    image = np.tile(np.arange(90, dtype=np.uint8), (16, 1))
    assert media.difference_hash(image) == "f" * 16 and media.difference_hash(image[:, ::-1]) == "0" * 16
    assert np.load(io.BytesIO(media.npy_tile(image, 8))).shape == (8, 8)


def test_query(spark, sf, tmp_path):
    import hashlib
    import zlib

    rows = [(1, None), (2, ""), (3, "ä" * 33), (4, "x" * 200_000), (5, "ä" * 33)]
    spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, payload string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in queries.op2_media(spark, str(tmp_path)).collect()}
    for i, t in rows:
        raw = (t or "").encode()
        full = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))
    assert got[3]["feature"] == got[5]["feature"] and got[3]["media_sha256"] == got[5]["media_sha256"]
    x = spark.createDataFrame([(1, bytearray(b"junk")), (2, bytearray(media.encode_pgm(np.zeros((2, 2), np.uint8)))), (3, None)], "id long, m binary")
    back = {r["id"]: r for r in media.media_features(x, "id", "m").collect()}
    assert back[1]["dhash"] is None and back[3]["dhash"] is None and back[2]["samples"] == bytes(4)
    bmp = media.text_media(spark.createDataFrame(rows, "doc_id long, text string"), fmt="bmp")
    assert bmp.where(F.octet_length("payload") % 64 != 0).count() == 0
    assert media.text_media(spark.createDataFrame([], "doc_id long, text string")).count() == 0
