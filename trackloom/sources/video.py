"""Raw high-speed video: layouts of headers and frames, and reading them from whole files.

``headers`` and ``read_frames`` let Spark ship the files (``binaryFile``), which
works in any store that Spark reads and for recordings below two gigabytes.
``rawvideo`` reads ranges of frames of files of any size.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HEADER = "path string, kind string, width int, height int, n_frames int, first_frame int, bit_depth int, frame_rate double, header_pad int"

#: Fixed values of the formats: 1-based 32-bit words of the cine header.
CINE_WORDS = {"first_frame": 5, "n_frames": 6, "header_pad": 9, "width": 13, "height": 14, "bytes": 17, "frame_rate": 214, "exposure": 215, "camera": 220, "software": 222}


def cine_header(raw: bytes) -> dict:
    word = {k: struct.unpack_from("<i", raw, 4 * (i - 1))[0] for k, i in CINE_WORDS.items()}
    word["bit_depth"] = word.pop("bytes") * 8 // (word["width"] * word["height"])
    return {"kind": "cine", **word}


def mrf_header(raw: bytes) -> dict:
    _, pad, frames, width, height, depth, _, _, _, _, _, rate = struct.unpack_from("<iiiiiiiiihhi", raw, 8)
    return {"kind": "mrf", "first_frame": 1, "n_frames": frames, "header_pad": pad + 12, "width": width, "height": height, "bit_depth": depth, "frame_rate": rate}


def header_of(path: str, raw: bytes) -> dict:
    name = path.lower()
    found = cine_header(raw) if name.endswith((".cin", ".cine")) else mrf_header(raw) if name.endswith(".mrf") else None
    if found is None:
        raise ValueError(f"{path}: no raw video file name")
    return {**found, "path": path, "frame_rate": float(found["frame_rate"]) or 1.0}


def headers(spark: SparkSession, path: str) -> DataFrame:
    """One row of metadata per raw video."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 2048).alias("content"))

    def read(batches):
        for g in batches:
            yield pd.DataFrame([header_of(p, bytes(c)) for p, c in zip(g["path"], g["content"])], columns=[f.split()[0] for f in HEADER.split(", ")])

    return files.mapInPandas(read, HEADER)


def unpack10(raw: np.ndarray) -> np.ndarray:
    """Four 10-bit big-endian numbers from every five bytes."""
    b = raw.reshape(-1, 5).astype(np.uint16)
    return np.stack([b[:, 0] << 2 | b[:, 1] >> 6, (b[:, 1] & 63) << 4 | b[:, 2] >> 4, (b[:, 2] & 15) << 6 | b[:, 3] >> 2, (b[:, 3] & 3) << 8 | b[:, 4]], 1).ravel()


def place_of(h: dict, frame: int) -> tuple[int, int, int]:
    """(first byte, bytes, stored bits a pixel) of a frame, from 1."""
    w, t, bits = h["width"], h["height"], h["bit_depth"]
    stored = bits if h["kind"] == "cine" else 8 if bits <= 8 else 16 if bits <= 16 else 24
    if stored not in (8, 10, 16, 24):
        raise ValueError(f"{h.get('path')}: {stored} bits a pixel")
    size = w * t * stored // 8
    return h["header_pad"] + (frame - 1) * size + (8 * h["n_frames"] + 8 * frame if h["kind"] == "cine" else 0), size, stored


def decoded(body: bytes, h: dict) -> np.ndarray:
    """The pixels of a frame's bytes as height x width (x 3), in the orientation of the formats."""
    w, t, stored = h["width"], h["height"], place_of(h, 1)[2]
    raw = np.frombuffer(body, np.uint8)
    if stored == 10:
        return unpack10(raw).reshape(t, w)
    if stored == 24:
        image = raw.reshape(t, w, 3) / 255
    else:
        image = raw.view("<u2" if stored == 16 else "u1").reshape(t, w)
        spare = h["bit_depth"] - (h.get("recorded_depth") or h["bit_depth"])
        if spare > 0 and h.get("side") == "Lower":
            image = image << spare
    return image[::-1] if h["kind"] == "cine" else image


def frame_of(raw: bytes, h: dict, frame: int) -> np.ndarray:
    """Frame ``frame`` (from 1) out of a whole file."""
    if not 1 <= frame <= h["n_frames"]:
        raise IndexError(f"{h['path']}: frame {frame} of {h['n_frames']}")
    at, size, _ = place_of(h, frame)
    return decoded(raw[at : at + size], h)


def read_frames(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Frames as arrays: ``wanted`` has path and frame; path, frame, height, width, pix come back."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(batches):
        for g in batches:
            out = []
            for p, raw, frames in zip(g["path"], g["content"], g["frames"]):
                h = header_of(p, bytes(raw[:2048]))
                for n in sorted(int(f) for f in frames):
                    image = frame_of(raw, h, n)
                    out.append((p, n, image.shape[0], image.shape[1], image.astype(float).ravel()))
            yield pd.DataFrame(out, columns=["path", "frame", "height", "width", "pix"])

    chosen = wanted.groupBy("path").agg(F.collect_set("frame").alias("frames"))
    return files.join(chosen, "path").mapInPandas(read, "path string, frame int, height int, width int, pix array<double>")
