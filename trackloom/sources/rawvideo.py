"""Raw high-speed video as a data source: partitions are ranges of frames, read by seeking.

``spark.dataSource.register(RawVideo)``, then
``spark.read.format("rawvideo").load(path)``.  The driver lists the files and
reads their headers, a few kilobytes each; a task opens one file, seeks to its
first frame and reads no byte beyond its last, so the size of a recording does
not matter.  A schema without ``pix`` reads no frames at all.  Conditions on
``frame`` and ``path`` drop frames and files before they are read (Spark hands
them over if ``spark.sql.python.filterPushdown.enabled`` is set).
"""

from __future__ import annotations

import fnmatch
import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from .video import cine_header, decoded, mrf_header, place_of

FRAMES = "path string, kind string, frame int, height int, width int, channels int, bit_depth int, frame_rate double, pix array<double>"
HEADERS = "path string, kind string, width int, height int, n_frames int, first_frame int, bit_depth int, recorded_depth int, frame_rate double, exposure int, camera int, software int, compression string, variable_timing boolean, header_pad int"
TYPES = {"string": pa.string(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
#: Bytes of frames in a partition.
RANGE_BYTES = 64 << 20
EXTENSIONS = {".cin": "cine", ".cine": "cine", ".mrf": "mrf", ".cih": "mraw"}

# Fixed values of the text header of headerless recordings.
CIH_KEYS = {"Total Frame": "n_frames", "Image Width": "width", "Image Height": "height", "Color Bit": "bit_depth", "Record Rate(fps)": "frame_rate", "File Format": "format", "EffectiveBit Side": "side", "EffectiveBit Depth": "recorded_depth"}
CIH_LINES = 82


def kind_of(path: str) -> str | None:
    return EXTENSIONS.get(posixpath.splitext(path.lower())[1])


def cih_header(text: str) -> dict:
    """``key : value`` lines up to END, without blanks and comments."""
    found = {}
    for line in text.splitlines()[:CIH_LINES]:
        if line.strip() == "END":
            break
        if ":" in line and not line.startswith("#"):
            key, value = (x.strip() for x in line.split(":", 1))
            if key in CIH_KEYS:
                found[CIH_KEYS[key]] = value
    number = lambda name: int(float(found.get(name, 0) or 0))
    if found.get("format", "MRaw").lower() != "mraw":
        raise ValueError(f"file format {found['format']} holds no raw frames")
    depth = number("bit_depth")
    return {"kind": "mraw", "width": number("width"), "height": number("height"), "n_frames": number("n_frames"), "first_frame": 1, "bit_depth": depth, "recorded_depth": number("recorded_depth") or depth, "side": found.get("side", ""), "frame_rate": float(found.get("frame_rate", 0) or 0), "header_pad": 0}


def located(path: str) -> tuple[fs.FileSystem, str, str]:
    """(file system, path in it, what stands before that in a full path)."""
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path, ""
    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: path.rindex(inner)] if inner in path else ""


def listed(path: str) -> list[str]:
    """Raw recordings under a folder, of a pattern, or the one file, in order of name."""
    system, inner, before = located(path)
    folder = inner
    if any(c in inner for c in "*?["):
        folder = posixpath.dirname(inner.split("*")[0].split("?")[0].split("[")[0] + "x")
        names = [f.path for f in system.get_file_info(fs.FileSelector(folder, recursive=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.path, inner)]
    elif system.get_file_info(inner).type == fs.FileType.Directory:
        names = [f.path for f in system.get_file_info(fs.FileSelector(inner, recursive=True)) if f.type == fs.FileType.File]
    else:
        names = [inner]
        if kind_of(inner) is None:
            raise ValueError(f"{path}: no raw recording; containers with a codec have no frames that can be sought")
    return sorted(before + n for n in names if kind_of(n))


def header_at(path: str) -> dict:
    """The header of a recording, with the ``data`` file that holds its frames."""
    system, inner, before = located(path)
    kind = kind_of(path)
    with system.open_input_file(inner) as f:
        raw = f.read(1 << 16 if kind == "mraw" else 4 * 410)
    header = cine_header(raw) if kind == "cine" else mrf_header(raw) if kind == "mrf" else cih_header(raw.decode("latin-1"))
    data = inner
    if kind == "mraw":
        data = next((p for p in (inner[:-3] + e for e in ("mraw", "MRAW", "Mraw")) if system.get_file_info(p).type == fs.FileType.File), inner[:-3] + "mraw")
    rate = float(header["frame_rate"] or 0)
    return {"recorded_depth": header["bit_depth"], **header, "path": path, "data": before + data, "frame_rate": rate if rate == rate and rate else 1.0, "compression": f"{header['bit_depth']}-bit raw", "variable_timing": False}


def frame_at(f, header: dict, frame: int) -> np.ndarray:
    """One frame of an open file, by one seek."""
    if not 1 <= frame <= header["n_frames"]:
        raise IndexError(f"{header['path']}: frame {frame} of {header['n_frames']}")
    at, size, _ = place_of(header, frame)
    f.seek(at)
    body = f.read(size)
    if len(body) < size:
        raise EOFError(f"{header['path']}: frame {frame} is cut off")
    return decoded(body, header)


def read_frame(path: str, frame: int) -> np.ndarray:
    """A single frame (from 1) of any raw recording."""
    header = header_at(path)
    system, inner, _ = located(header["data"])
    with system.open_input_file(inner) as f:
        return frame_at(f, header, frame)


@dataclass
class Range(InputPartition):
    """Frames ``first`` to ``last`` of a recording."""

    header: dict
    first: int
    last: int


class RawVideoReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.first, self.last, self.frames, self.paths = 1, 1 << 62, None, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else ()
            if column == ("frame",) and isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual)):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.last = min(self.last, f.value - isinstance(f, LessThan))
            elif column == ("frame",) and isinstance(f, In):
                self.frames = set(f.value) if self.frames is None else self.frames & set(f.value)
            elif column == ("path",) and isinstance(f, (EqualTo, In)):
                some = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.paths = some if self.paths is None else self.paths & some
            else:
                yield f

    def partitions(self) -> list[Range]:
        found = []
        for path in listed(self.options["path"]):
            if self.paths is not None and path not in self.paths:
                continue
            header = header_at(path)
            if self.options.get("mode") == "headers":
                found.append(Range(header, 0, 0))
                continue
            first, last = max(1, self.first), min(header["n_frames"], self.last)
            if self.frames is not None:
                wanted = sorted(n for n in self.frames if n is not None and first <= n <= last)
                cuts = [i for i in range(1, len(wanted)) if wanted[i] != wanted[i - 1] + 1]
                runs = [(wanted[a], wanted[b - 1]) for a, b in zip([0, *cuts], [*cuts, len(wanted)]) if b > a]
            else:
                runs = [(first, last)] if first <= last else []
            step = int(self.options.get("framesPerPartition", 0)) or max(1, RANGE_BYTES // max(1, place_of(header, 1)[1]))
            found += [Range(header, a, min(a + step - 1, hi)) for lo, hi in runs for a in range(lo, hi + 1, step)]
        return found

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no range was left
            return
        names = self.schema.names
        kinds = [TYPES[f.dataType.simpleString()] for f in self.schema]
        if self.options.get("mode") == "headers":
            yield pa.RecordBatch.from_arrays([pa.array([partition.header.get(n)], t) for n, t in zip(names, kinds)], names)
            return
        header = partition.header
        if "pix" not in names and "channels" not in names:
            for lo in range(partition.first, partition.last + 1, 1 << 16):
                frames = range(lo, min(lo + (1 << 16), partition.last + 1))
                yield pa.RecordBatch.from_arrays([pa.array(frames if n == "frame" else [header.get(n)] * len(frames), t) for n, t in zip(names, kinds)], names)
            return
        system, inner, _ = located(header["data"])
        with system.open_input_file(inner) as f:
            for frame in range(partition.first, partition.last + 1):
                image = frame_at(f, header, frame)
                row = header | {"frame": frame, "channels": 1 if image.ndim == 2 else image.shape[2], "pix": image.astype(float).ravel()}
                yield pa.RecordBatch.from_arrays([pa.array([row.get(n)], t) for n, t in zip(names, kinds)], names)


class RawVideo(DataSource):
    """Frames of raw recordings (cine, mrf, and cih with its mraw), numbered from 1; with ``mode`` = ``headers`` a row of metadata a file."""

    @classmethod
    def name(cls) -> str:
        return "rawvideo"

    def schema(self) -> str:
        return HEADERS if self.options.get("mode") == "headers" else FRAMES

    def reader(self, schema: StructType) -> RawVideoReader:
        known = {f.split(" ")[0] for f in (HEADERS if self.options.get("mode") == "headers" else FRAMES).split(", ")}
        unknown = [n for n in schema.names if n not in known]
        if unknown:
            raise ValueError(f"raw recordings have no {', '.join(unknown)}")
        return RawVideoReader(schema, dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RawVideo)
