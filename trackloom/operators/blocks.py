"""Images of any size as tiles, and functions of the user's over blocks of them.

A tile row holds the key columns of its image (whatever they are), row0 and
col0 (where it lies, from 0), height and width (of the image), h and w (its
own), channels and pix (h x w x channels, row-major).  No task ever sees a whole
image: a tile sends the strips that lie within ``border`` of other tiles to
them, which is the only shuffle, and every tile is then evaluated with what is
around it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PLACE = ("row0", "col0", "height", "width", "h", "w", "channels")
TILE = ", ".join(f"{c} int" for c in PLACE) + ", pix array<double>"
Function = Callable[[np.ndarray], np.ndarray]


def keys_of(df: DataFrame, *others: str) -> list[str]:
    known = {*PLACE, "pix", *others}
    return [c for c in df.columns if c not in known]


def schema_of(df: DataFrame, keys: list[str], rest: str) -> str:
    return "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys) + rest


def handfuls(batches: Iterator[pa.RecordBatch], most: int = 256, size: int = 1 << 23) -> Iterator[pa.RecordBatch]:
    """Arrow batches in slices of at most ``most`` tiles and about ``size`` bytes (a tile at least), which is what a task holds as arrays."""
    for batch in batches:
        rows = max(1, min(most, size * batch.num_rows // max(1, batch.nbytes)))
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


def arrays(batch: pa.RecordBatch) -> Iterator[tuple[int, dict, np.ndarray]]:
    """(number, place, pixels) of every tile in a batch."""
    places = {c: batch.column(c).to_pylist() for c in PLACE}
    pix = batch.column("pix")
    for i in range(batch.num_rows):
        place = {c: places[c][i] for c in PLACE}
        yield i, place, pix[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(place["h"], place["w"], place["channels"])


def placed(keys: pa.RecordBatch, rows: list[int], places: list[dict], pix: list[np.ndarray], more: dict[str, list] | None = None) -> pa.RecordBatch:
    """Tiles as a batch: ``rows`` are their rows in ``keys``."""
    picked = keys.take(pa.array(rows, pa.int64()))
    columns = list(picked.columns) + [pa.array(v, pa.int32()) for v in (more or {}).values()]
    columns += [pa.array([p[c] for p in places], pa.int32()) for c in PLACE]
    sizes = np.r_[0, np.cumsum([x.size for x in pix])].astype(np.int32)
    flat = np.concatenate([x.ravel() for x in pix]) if pix else np.zeros(0)
    columns.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(flat.astype(float))))
    return pa.RecordBatch.from_arrays(columns, [*keys.schema.names, *(more or {}), *PLACE, "pix"])


def cut(images: DataFrame, size: int) -> DataFrame:
    """Tiles of at most ``size`` x ``size`` from whole images (keys, height, width, channels, pix).

    A null or empty image has no tiles.
    """
    keys = keys_of(images)

    def split(batches):
        for batch in handfuls(batches):
            heights, widths, channels = (batch.column(c).to_pylist() for c in ("height", "width", "channels"))
            named = batch.select(keys)
            for i, pix in enumerate(batch.column("pix")):
                if not pix.is_valid or not len(pix):
                    continue
                image = pix.values.to_numpy(zero_copy_only=False).astype(float).reshape(heights[i], widths[i], channels[i])
                places, parts = [], []
                for r in range(0, heights[i], size):
                    for c in range(0, widths[i], size):
                        part = image[r : r + size, c : c + size]
                        places.append({"row0": r, "col0": c, "height": heights[i], "width": widths[i], "h": part.shape[0], "w": part.shape[1], "channels": channels[i]})
                        parts.append(part)
                yield placed(named, [i] * len(parts), places, parts)

    return images.select(*keys, "height", "width", "channels", "pix").mapInArrow(split, schema_of(images, keys, TILE))


def with_halo(tiles: DataFrame, size: int, border: int, each: Callable[[dict, np.ndarray], pa.RecordBatch | None], columns: str) -> DataFrame:
    """Lay images out anew on a grid of ``size`` and hand ``each`` grid cell with ``border`` pixels around it on.

    ``each(place, block)`` gets a block of (size + 2 border) squared, zero
    outside the image, and returns the columns besides the keys.
    """
    keys = keys_of(tiles)

    def send(batches):
        for batch in handfuls(batches):
            named = batch.select(keys)
            rows, places, parts, cells = [], [], [], {"cell_row": [], "cell_col": []}
            for i, p, pix in arrays(batch):
                lines = range(max(0, (p["row0"] - border) // size), min(-(-p["height"] // size), (p["row0"] + p["h"] - 1 + border) // size + 1))
                columns_ = range(max(0, (p["col0"] - border) // size), min(-(-p["width"] // size), (p["col0"] + p["w"] - 1 + border) // size + 1))
                for a in lines:
                    top, below = max(p["row0"], a * size - border), min(p["row0"] + p["h"], (a + 1) * size + border)
                    for b in columns_:
                        left, right = max(p["col0"], b * size - border), min(p["col0"] + p["w"], (b + 1) * size + border)
                        part = pix[top - p["row0"] : below - p["row0"], left - p["col0"] : right - p["col0"]]
                        rows.append(i), parts.append(part), cells["cell_row"].append(a), cells["cell_col"].append(b)
                        places.append(p | {"row0": top, "col0": left, "h": part.shape[0], "w": part.shape[1]})
            yield placed(named, rows, places, parts, cells)

    grid = [*keys, "cell_row", "cell_col"]
    sent = tiles.select(*keys, *PLACE, "pix").mapInArrow(send, schema_of(tiles, keys, "cell_row int, cell_col int, " + TILE))

    def gather(table: pa.Table) -> pa.Table:
        batch = table.combine_chunks().to_batches()[0]
        a, b = batch.column("cell_row")[0].as_py(), batch.column("cell_col")[0].as_py()
        block, place = None, None
        for _, p, pix in arrays(batch):
            if block is None:
                block = np.zeros((size + 2 * border, size + 2 * border, p["channels"]))
                place = p | {"row0": a * size, "col0": b * size, "h": min(size, p["height"] - a * size), "w": min(size, p["width"] - b * size)}
            r, c = p["row0"] - a * size + border, p["col0"] - b * size + border
            block[r : r + p["h"], c : c + p["w"]] = pix
        found = each(place, block)
        named = batch.select(keys).take(pa.array([0] * found.num_rows, pa.int64()))
        return pa.Table.from_batches([pa.RecordBatch.from_arrays([*named.columns, *found.columns], [*keys, *found.schema.names])])

    return sent.groupBy(*grid).applyInArrow(gather, schema_of(tiles, keys, columns))


def apply_blocks(tiles: DataFrame, size: int, function: Function, border: int = 0) -> DataFrame:
    """The user's function over blocks: tiles of its results, of any number of channels.

    ``function`` takes a block with ``border`` pixels on every side, zero where
    the image ends (partial blocks are filled up with zeros too), and returns as
    many rows and columns; border and filling are cut off again.  A function that
    looks no further than ``border`` gives the same image at every ``size``.
    """

    def each(place: dict, block: np.ndarray) -> pa.RecordBatch:
        out = np.asarray(function(block), float)
        out = out.reshape(*block.shape[:2], -1)[border : border + place["h"], border : border + place["w"]]
        return placed(pa.RecordBatch.from_arrays([pa.array([0])], ["_"]), [0], [place | {"channels": out.shape[2]}], [out]).drop_columns(["_"])

    return with_halo(tiles, size, border, each, TILE)


def around(block: int) -> np.ndarray:
    """Rows of a block relative to its center; a block of an even side leaves its center's out, as rounding away from zero does."""
    x = np.arange(block) - (block - 1) / 2
    return (np.sign(x) * np.floor(np.abs(x) + 0.5)).astype(int)


def centers(side: int, block: int, stride: int) -> range:
    """Centers, from 1, of blocks that lie within ``side`` pixels."""
    steps = around(block)
    return range(1 - int(steps[0]), side - int(steps[-1]) + 1, stride)


def check_blocks(tiles: DataFrame, size: int, block: int, stride: int, function: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """The user's function of every block on a stride grid: keys, row, col (of the center, from 1), channel, value.

    ``function`` takes block x block x channels and returns a number a channel.
    An image smaller than a block gives no rows.
    """
    steps = around(block)
    border = int(max(-steps[0], steps[-1], 0)) if block else 0

    def each(place: dict, whole: np.ndarray) -> pa.RecordBatch:
        found = []
        lines = [r for r in centers(place["height"], block, stride) if place["row0"] < r <= place["row0"] + place["h"]]
        columns = [c for c in centers(place["width"], block, stride) if place["col0"] < c <= place["col0"] + place["w"]]
        for r in lines:
            for c in columns:
                values = function(whole[np.ix_(r - 1 - place["row0"] + border + steps, c - 1 - place["col0"] + border + steps)])
                found += [(r, c, k, float(x)) for k, x in enumerate(np.ravel(values))]
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.float64()))], ["row", "col", "channel", "value"])

    return with_halo(tiles, size, border, each, "row int, col int, channel int, value double")


def network_block(predict: Function, side: int = 224) -> Function:
    """A block function that resizes to the network's side, predicts, and resizes back."""
    from .resample import resize

    def function(block: np.ndarray) -> np.ndarray:
        out = np.asarray(predict(resize(block, side, side)), float)
        return resize(out.reshape(*out.shape[:2], -1), *block.shape[:2])

    return function
