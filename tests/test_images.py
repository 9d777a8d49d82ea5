import struct
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from sparkfolio.api import Library
from sparkfolio.functions.images import image_header

PNG = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 640, 70_000) + b"\x08\x02\0\0\0"
GIF = b"GIF89a" + struct.pack("<HH", 300, 65_535) + b"\xf0\0\0"


def segment(marker, body):
    return bytes([0xFF, marker]) + struct.pack(">H", len(body) + 2) + body


def jpeg(frame=0xC0, before=b""):
    return b"\xff\xd8" + segment(0xE0, b"JFIF\0" + bytes(9)) + before + segment(frame, b"\x08" + struct.pack(">HH", 480, 1024) + b"\x03" + bytes(9)) + segment(0xDA, bytes(10)) + b"data\xff\xd9"


def webp(kind, data):
    chunk = kind + struct.pack("<I", len(data)) + data
    return b"RIFF" + struct.pack("<I", len(chunk) + 4) + b"WEBP" + chunk


LOSSY = webp(b"VP8 ", b"\x50\x01\0\x9d\x01\x2a" + struct.pack("<HH", 800 | 1 << 14, 601 | 3 << 14) + bytes(5))
LOSSLESS = webp(b"VP8L", b"\x2f" + struct.pack("<I", (16_384 - 1) | (33 - 1) << 14 | 1 << 28) + bytes(5))
EXTENDED = webp(b"VP8X", b"\x10\0\0\0" + (100_000 - 1).to_bytes(3, "little") + (7 - 1).to_bytes(3, "little"))

CASES = {
    "png": (PNG, ("png", 640, 70_000)),
    "gif": (GIF, ("gif", 300, 65_535)),
    "gif, old": (GIF.replace(b"89a", b"87a"), ("gif", 300, 65_535)),
    "jpeg": (jpeg(), ("jpeg", 1024, 480)),
    "jpeg, progressive, tables and filler": (jpeg(0xC2, segment(0xC4, bytes(30)) + b"\xff\xff\xff" + segment(0xFE, b"\xff\xc0 not a frame")[1:] + b"\xff\x01"), ("jpeg", 1024, 480)),
    "jpeg without a frame": (b"\xff\xd8" + segment(0xDB, bytes(65)) + segment(0xDA, bytes(10)), ("jpeg", None, None)),
    "jpeg, lost": (b"\xff\xd8" + segment(0xE1, bytes(5)) + b"\0\0\0", ("jpeg", None, None)),
    "webp": (LOSSY, ("webp", 800, 601)),
    "webp, lossless": (LOSSLESS, ("webp", 16_384, 33)),
    "webp, extended": (EXTENDED, ("webp", 100_000, 7)),
    "webp, unknown": (webp(b"VP9 ", bytes(30)), ("webp", None, None)),
    "png of no width": (PNG[:16] + bytes(4) + PNG[20:], ("png", None, None)),
    "text": (b"<svg width='3'/>", None),
    "empty": (b"", None),
    "null": (None, None),
}


def headers(spark, contents):
    rows = spark.createDataFrame(list(enumerate(contents)), "id int, content binary")
    return [r["h"] and tuple(r["h"]) for r in rows.select("id", image_header(F.col("content")).alias("h")).orderBy("id").collect()]


def test_format_and_size(spark):
    assert headers(spark, [c for c, _ in CASES.values()]) == [want for _, want in CASES.values()]


@pytest.mark.parametrize("whole, needs", [(PNG, 24), (GIF, 10), (LOSSY, 30), (LOSSLESS, 25), (EXTENDED, 30), (jpeg(), 29)])
def test_files_cut_off_have_no_size(spark, whole, needs):
    got = headers(spark, [whole[:n] for n in range(len(whole) + 1)])
    assert all(h is None or h[1:] == (None, None) for h in got[:needs]) and all(h[1] for h in got[needs:])


@pytest.fixture
def library(spark, tmp_path):
    (tmp_path / "on [x]" / "images").mkdir(parents=True)
    (tmp_path / "on [x]" / "images" / "page_001.png").write_bytes(PNG)
    (tmp_path / "on [x]" / "images" / "e{1}.jpg").write_bytes(jpeg())
    (tmp_path / "secret.png").write_bytes(PNG)
    documents = spark.createDataFrame([(1, "on [x]")], "id long, slug string")
    pages = spark.createDataFrame([(1, 1, 1, "images/page_001.png"), (2, 1, 2, "../secret.png"), (3, 1, 3, "images/gone.png"), (4, 1, 4, None)], "id long, document_id long, page_number int, image_path string")
    elements = spark.createDataFrame([(1, 1, "figure", "images/e{1}.jpg", None), (2, 1, "equation", "images/e{1}.jpg", "images/page_001.png"), (3, 1, "figure", None, "")], "id long, document_id long, element_type string, crop_path string, rendered_path string")
    corpus = SimpleNamespace(documents=documents, pages=pages, elements=elements)
    return Library(corpus, lambda texts: [], tree=str(tmp_path))


def test_images_of_pages_and_elements(library):
    one = library.page_image(1, 1).collect()
    assert [(r["mime"], r["width"], r["height"], bytes(r["content"])) for r in one] == [("image/png", 640, 70_000, PNG)]
    for page in (2, 3, 4, 5):
        assert library.page_image(1, page).collect() == [], page
    assert [(r["mime"], r["width"]) for r in library.element_image(1).collect()] == [("image/jpeg", 1024)]
    assert [r["mime"] for r in library.element_image(2).collect()] == ["image/png"]
    assert library.element_image(3).collect() == library.element_image(9).collect() == []
    library.tree = None
    with pytest.raises(RuntimeError):
        library.page_image(1, 1)
