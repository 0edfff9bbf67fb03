"""Uploaded images as pixel rows."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scan_images(spark: SparkSession, path: str, max_pixels: int | None = None) -> DataFrame:
    """One row per file: object_path, height, width, channels, pixels (BGR), readable.

    Files that do not decode, or exceed ``max_pixels`` where a limit is given (cutting crops needs
    one, the red check does not), stay as unreadable rows without pixels, since the red-mark rules
    reject their marks rather than lose them. Spark's reader
    knows no WebP and leaves pixels as stored; :func:`image_turns` tells how they are to be turned.
    """
    files = spark.read.format("image").load(path).select("image.*")
    readable = F.col("height") > 0
    if max_pixels is not None:
        readable = readable & (F.col("height").cast("long") * F.col("width") <= max_pixels)
    return files.select(
        F.col("origin").alias("object_path"),
        "height",
        "width",
        F.col("nChannels").alias("channels"),
        F.when(readable, F.col("data")).alias("pixels"),
        readable.alias("readable"),
    )


def exif_orientation(content: bytes | None) -> int:
    """The orientation a JPEG's Exif segment declares, 1 to 8; 1 where there is none or it is damaged."""
    data = content or b""
    at = 2
    while data[:2] == b"\xff\xd8" and data[at : at + 1] == b"\xff" and at + 4 <= len(data):
        kind, size = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        if kind == 0xDA or size < 2:  # the pixels begin
            return 1
        if kind == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
            return _tiff_orientation(data[at + 10 : at + 2 + size])
        at += 2 + size
    return 1


def _tiff_orientation(tiff: bytes) -> int:
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    try:
        (start,) = struct.unpack_from(f"{order}I", tiff, 4)
        (entries,) = struct.unpack_from(f"{order}H", tiff, start)
        for i in range(entries):
            tag, kind, _, value = struct.unpack_from(f"{order}HHIH", tiff, start + 2 + 12 * i)
            if tag == 0x0112:
                return value if kind == 3 and 1 <= value <= 8 else 1
    except struct.error:  # no byte order, or cut off
        pass
    return 1


def image_turns(spark: SparkSession, path: str) -> DataFrame:
    """object_path as ``scan_images`` gives it, and orientation, of the JPEG files that are not stored upright.

    The result is narrow; join it to ids and hand it to the recognition flow as ``turns``, so that masks are
    turned, a 24th of the pixels, and no pixels travel for it.
    """

    @F.pandas_udf("int")
    def orientation(content: pd.Series) -> pd.Series:
        return content.map(exif_orientation).astype("int32")

    files = spark.read.format("binaryFile").load(path)
    # The image reader encodes paths as the metadata does, and writes file:///x for file:/x.
    shown = F.regexp_replace("_metadata.file_path", "^file:/(?!/)", "file:///")
    found = files.select(shown.alias("object_path"), orientation("content").alias("orientation"))
    return found.filter("orientation > 1")
