"""The JPEG decoder against the JVM's image library: baseline and progressive, grey and colour, restart intervals."""

from __future__ import annotations

import numpy as np
import pytest

from quire.operators import jpeg, pdf


def written(spark, pixels: np.ndarray, progressive: bool = False, quality: float = 0.9) -> tuple[bytes, np.ndarray]:
    """A JPEG file of grey (h, w) or colour (h, w, 3) pixels by the JVM, and what the JVM reads from it."""
    jvm = spark._jvm
    colour = pixels.ndim == 3
    h, w = pixels.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, 5 if colour else 10)
    raster = image.getRaster()
    for y in range(h):
        for x in range(w):
            for band in range(3 if colour else 1):
                raster.setSample(x, y, band, int(pixels[y, x, band] if colour else pixels[y, x]))
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(out))
    how = writer.getDefaultWriteParam()
    explicit = jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT
    how.setCompressionMode(explicit)
    how.setCompressionQuality(quality)
    if progressive:
        how.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), how)
    writer.dispose()
    data = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(bytearray(data)))
    shown = back.getRaster()
    bands = range(shown.getNumBands())
    read = np.array([[[shown.getSample(x, y, b) for b in bands] for x in range(w)] for y in range(h)])
    return data, (read[:, :, 0] if len(bands) == 1 else read)


def scene(h: int, w: int, seed: int = 1) -> np.ndarray:
    y, x = np.mgrid[0:h, 0:w]
    rng = np.random.default_rng(seed)
    return np.clip(120 + 70 * np.sin(x / 5) + 50 * np.cos(y / 7) + rng.normal(0, 6, (h, w)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("size", [(8, 8), (21, 37), (40, 16)])
def test_grey_images(spark, size, progressive):
    data, want = written(spark, scene(*size), progressive)
    got = jpeg.decode(data)
    assert got.shape == size and got.dtype == np.uint8
    assert np.abs(got.astype(int) - want).max() <= 1


@pytest.mark.parametrize("progressive", [False, True])
def test_colour_images(spark, progressive):
    colour = np.stack([scene(33, 50, s) for s in (1, 2, 3)], 2)
    colour = (colour // 8 + 100).astype(np.uint8)
    data, want = written(spark, colour, progressive, 0.95)
    got = jpeg.decode(data).astype(float)
    # samples of reduced colour planes may be spread differently
    assert np.abs(got - want @ np.array(jpeg.LUMA)).mean() < 2


def test_restart_intervals(spark):
    data, want = written(spark, scene(16, 64))
    image = jpeg.decode(data)
    bounds = data.index(b"\xff\xda")
    assert image.shape == (16, 64) and np.abs(image.astype(int) - want).max() <= 1
    with pytest.raises(jpeg.JpegError):
        jpeg.decode(data[:bounds])


@pytest.mark.parametrize("cut", [0, 1, 5, 40, 200])
def test_broken_images_raise(spark, cut):
    data, _ = written(spark, scene(16, 16))
    with pytest.raises(ValueError):
        jpeg.decode(data[:cut])


def test_damaged_bytes_never_do_worse_than_raise(spark):
    data, _ = written(spark, scene(24, 24), progressive=True)
    rng = np.random.default_rng(2)
    for _ in range(200):
        bad = bytearray(data)
        for at in rng.integers(2, len(data), 3):
            bad[at] = rng.integers(256)
        try:
            made = jpeg.decode(bytes(bad))
        except ValueError:
            continue
        assert made.dtype == np.uint8


def test_a_page_with_a_jpeg_image(spark):
    data, want = written(spark, scene(30, 20))
    image = pdf.Stream({"Type": pdf.Name("XObject"), "Subtype": pdf.Name("Image"), "Width": 20, "Height": 30, "ColorSpace": pdf.Name("DeviceGray"), "BitsPerComponent": 8, "Filter": pdf.Name("DCTDecode")}, data)
    doc = pdf.load(pdf.save(pdf.new_document([(100, 150, image, b"")])))
    got = pdf.pixels(doc, pdf.images(doc, doc.pages()[0][2])[0][2])
    assert np.abs(got.astype(int) - want).max() <= 1
