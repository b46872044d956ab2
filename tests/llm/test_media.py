"""Progressive JPEG: exact round trips, a second decoder (the JVM's), odd inputs."""

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from geostrata.llm import progressive_jpeg as J
from geostrata.llm.entry import QUERIES


@given(st.lists(st.binary(max_size=1500), min_size=1, max_size=5))
@settings(max_examples=30, deadline=None)
def test_any_payload_comes_back(parts):
    payloads = [J.padded(p) for p in parts]
    assert [J.payload_of(im, c) for im, c in J.decode(J.encode(payloads))] == payloads


@pytest.mark.parametrize("payload", [b"\x7f" * 960, b"\x80\x7f" * 480, b"\xff" * 3840, b"\0" * 192, bytes(range(256)) * 30])
def test_runs_of_small_values(payload):
    payload = J.padded(payload)
    assert [J.payload_of(*x) for x in J.decode(J.encode([payload]))] == [payload]


def image_io(spark, raw: bytes):
    jvm = spark.sparkContext._jvm
    image = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw))
    h, w = image.getHeight(), image.getWidth()
    pixels = np.array(list(image.getRGB(0, 0, w, h, None, 0, w)), np.int64).reshape(h, w)
    return np.stack([(pixels >> s) & 255 for s in (16, 8, 0)], axis=-1)


def test_another_decoder_sees_the_same_picture(spark):
    raw = J.encode([J.padded(b"hello progressive world " * 30)])[0]
    (im, coefs) = J.decode([raw])[0]
    ours = J.tensors([(im, coefs)])[0].astype(int)
    # luma alone is compared, as decoders smooth chroma each in its own way
    luma = lambda p: p @ np.array([0.299, 0.587, 0.114])
    theirs = image_io(spark, raw).astype(int)
    assert ours.shape == theirs.shape and np.median(np.abs(luma(ours) - luma(theirs))) < 6


def test_files_of_another_encoder(spark):
    """The JVM writes a progressive file with other scans, end-of-band runs and tables; ours decodes it as the JVM does."""
    jvm = spark.sparkContext._jvm
    w, h = 53, 37
    picture = jvm.java.awt.image.BufferedImage(w, h, 10)  # grey
    for y in range(h):
        for x in range(w):
            v = int(128 + 100 * np.sin(x / 5) * np.cos(y / 7))
            picture.getRaster().setSample(x, y, 0, v)
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    params = writer.getDefaultWriteParam()
    params.setProgressiveMode(1)
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), params)
    stream.close()
    raw = bytes(out.toByteArray())
    im, coefs = J.decode([raw])[0]
    assert len(im.scans) > 1
    ours = J.tensors([(im, coefs)])[0].astype(int)
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(raw)).getRaster()
    theirs = np.array(list(back.getSamples(0, 0, w, h, 0, spark.sparkContext._gateway.new_array(jvm.int, w * h)))).reshape(h, w)
    assert np.abs(ours[..., 0] - theirs).max() <= 2


def test_damaged_files_fail():
    raw = J.encode([J.padded(b"x")])[0]
    for bad in (b"", b"\xff\xd8", raw[: len(raw) // 2], raw.replace(b"\xff\xc2", b"\xff\xc0")):
        with pytest.raises((ValueError, IndexError, KeyError)):
            J.decode([bad])


def test_query_digests(spark, sf):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op1_progressive_jpeg"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        p = J.padded(docs[r.doc_id])
        assert len(r.tensor) == 3 * r.height * r.width and r.feature.endswith(f"crc {zlib.crc32(r.tensor):08x}")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
    by_text = {}
    for r in rows:
        assert by_text.setdefault(docs[r.doc_id], (r.media_sha256, r.feature)) == (r.media_sha256, r.feature)


def test_odd_rows(spark, odd, empty):
    rows = J.decode_media(J.encode_media(odd)).collect()
    assert len(rows) == odd.count() and all(len(r.rgb) == 3 * r.height * r.width for r in rows)
    assert J.decode_media(J.encode_media(empty)).count() == 0
