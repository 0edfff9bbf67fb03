"""Orientation of stored images: reading the tag, and turning red masks."""

import struct

import numpy as np
import pytest

from relearn.operators.recognition import TURNS, red_masks
from relearn.sources.images import exif_orientation, image_turns, scan_images


def jpeg(value, order=">", kind=3, before=b""):
    tiff = (b"MM" if order == ">" else b"II") + struct.pack(f"{order}HIH", 42, 8, 2)
    tiff += struct.pack(f"{order}HHIHH", 0x0100, 3, 1, 9, 0) + struct.pack(f"{order}HHIHH", 0x0112, kind, 1, value, 0)
    body = b"Exif\0\0" + tiff
    return b"\xff\xd8" + before + b"\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\2"


@pytest.mark.parametrize("order", "<>")
def test_tag_is_read(order):
    other = b"\xff\xe0" + struct.pack(">H", 6) + b"JFIF"
    for value in range(1, 9):
        assert exif_orientation(jpeg(value, order)) == value
        assert exif_orientation(jpeg(value, order, before=other)) == value


def test_no_or_damaged_tag_means_upright():
    whole = jpeg(6)
    assert {exif_orientation(x) for x in (None, b"", b"GIF89a", jpeg(0), jpeg(9), jpeg(6, kind=4), b"\xff\xd8\xff\xda\0\2")} == {1}
    assert {exif_orientation(whole[:n]) for n in range(len(whole))} <= {1, 6}


# A picture that is upright as the rows "ab", "cd", "ef", and how each orientation stores it.
STORED = {
    1: ["ab", "cd", "ef"], 2: ["ba", "dc", "fe"], 3: ["fe", "dc", "ba"], 4: ["ef", "cd", "ab"],
    5: ["ace", "bdf"], 6: ["bdf", "ace"], 7: ["fdb", "eca"], 8: ["eca", "fdb"],
}


def test_all_eight_turns():
    for value, rows in STORED.items():
        grid = np.array([list(r) for r in rows])
        assert ["".join(r) for r in TURNS.get(value, np.asarray)(grid)] == STORED[1]


def test_masks_come_out_upright(spark):
    red, grey = b"\0\0\xff", b"\x80\x80\x80"
    rows = [
        (value, len(stored), len(stored[0]), 3, b"".join(red if c == "b" else grey for r in stored for c in r), True)
        for value, stored in STORED.items()
    ]
    pixels = spark.createDataFrame(rows, "image_id int, height int, width int, channels int, pixels binary, readable boolean")
    turns = pixels.filter("image_id > 1").selectExpr("image_id", "image_id AS orientation")
    for row in red_masks(pixels, turns).collect():
        bits = np.unpackbits(np.frombuffer(row["mask"], dtype=np.uint8), count=6).tolist()
        assert (row["height"], row["width"], bits) == (3, 2, [0, 1, 0, 0, 0, 0]), row["image_id"]


def test_turns_of_a_folder(spark, tmp_path):
    for name, data in (("a.jpg", jpeg(6)), ("b.jpg", jpeg(1)), ("c.png", b"\x89PNG"), ("empty.jpg", b"")):
        (tmp_path / name).write_bytes(data)
    found = [tuple(r) for r in image_turns(spark, str(tmp_path)).collect()]
    assert found == [(f"file://{tmp_path}/a.jpg", 6)]


def test_turns_name_files_as_the_scan_does(spark, tmp_path):
    jvm = spark._jvm
    plain = tmp_path / "plain"
    picture = jvm.java.awt.image.BufferedImage(4, 2, 1)
    jvm.javax.imageio.ImageIO.write(picture, "jpg", jvm.java.io.File(str(plain)))
    folder = tmp_path / "two words"
    folder.mkdir()
    tag = jpeg(8)[2:-4]
    (folder / "a b.jpg").write_bytes(b"\xff\xd8" + tag + plain.read_bytes()[2:])
    scanned = scan_images(spark, str(folder)).select("object_path", "height", "width").collect()
    turned = image_turns(spark, str(folder)).collect()
    assert [(r["object_path"], r["orientation"]) for r in turned] == [(scanned[0]["object_path"], 8)]
    assert (scanned[0]["height"], scanned[0]["width"]) == (2, 4)
