"""The automatic tracker with all cameras of a point in one state, in batch and as a stream.

Frames of a trial are taken in order.  Every point that is followed is
predicted, matched and checked in every camera that it started in; then it is
triangulated, and if the residual is too large the camera with the worst match
loses its position and the point is triangulated again.  What is found feeds
the next frame's prediction.  ``advance`` is that step for a frame of many
trials side by side, and ``Tracker`` holds only templates and the last samples:
a batch walks over sorted rows with some images of one frame number in memory,
in a stream it is the state of a key and event-time timers call it once all
cameras had their time to deliver a frame.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, DataType, StructType

from ..operators import kernels
from ..operators.kernels import centroid, correlations, kalman_nexts

SIGHT = "array<struct<cam: int, u: double, v: double, fit: double>>"
OUT = f"trial string, frame int, point int, sights {SIGHT}, x double, y double, z double, rmse double, erased int, ended boolean"
NAMES = [c.split()[0] for c in OUT.replace(SIGHT, "sights").split(", ")]
#: Trials of a task that go side by side are those of one of so many parts: their templates are in memory together.
PARTS = 16
#: Pixels of one frame number in memory together, and those of the trial that goes beyond.
PIXELS = 1 << 22
ROWS = "trial string, lane int, frame int, kind int, cam int, point int, us array<double>, vs array<double>, height int, width int, pix array<double>"


@dataclass
class Options:
    """``half``: template and search reach in pixels; ``least_fit``: of a match; ``most_rmse``: of a point; ``gap``: frames in a row that may fail; ``together``: one end ends all points of the same start."""

    half: int = 6
    reach: int = 6
    least_fit: float = 2.0
    most_rmse: float = 3.0
    gap: int = 0
    window: int = 11
    gamma: float = 1.0
    find_centroid: bool = False
    together: bool = True


def away(x: float) -> float:
    """Rounded, halves away from zero."""
    return math.copysign(math.floor(abs(x) + 0.5), x) if math.isfinite(x) else x


def all_predicted(histories: list[list[float]]) -> np.ndarray:
    """Static, linear or filtered continuation of each, by how many of the last samples there are; NaN without any."""
    longest = max(map(len, histories), default=0)
    held = np.array([[float("nan")] * (longest - len(h)) + list(h) for h in histories], float).reshape(len(histories), longest)
    known = ~np.isnan(held)
    count, out = known.sum(axis=1), np.full(len(held), np.nan)
    last = np.where(known, np.arange(longest), -1)
    few, some, many = ((count > 0) & (count < 3)).nonzero()[0], ((count > 2) & (count < 8)).nonzero()[0], (count > 7).nonzero()[0]
    out[few] = held[few, last[few].max(axis=1)] if len(few) else []
    if len(some):
        c, b, a = held[some[:, None], np.sort(last[some], axis=1)[:, -3:]].T
        out[some] = np.round((4 * a + b - 2 * c) / 3, 6)
    out[many] = kalman_nexts(held[many])
    return np.where(np.isfinite(out), np.copysign(np.floor(np.abs(out) + 0.5), out), out)


def predicted(history: list[float]) -> float:
    """``all_predicted`` of one."""
    return float(all_predicted([history])[0])


def patch(image: np.ndarray, u: float, v: float, half: int) -> np.ndarray | None:
    """The square around a pixel counted from 1; None if it does not lie inside."""
    if not (u == u and v == v):
        return None
    r, c = int(away(v)) - 1, int(away(u)) - 1
    inside = half <= r < image.shape[0] - half and half <= c < image.shape[1] - half
    return image[r - half : r + half + 1, c - half : c + half + 1].copy() if inside else None


def template_of(image: np.ndarray, u: float, v: float, o: Options) -> np.ndarray | None:
    """What is looked for: the square around a sample, as matching wants it."""
    cut = patch(image, u, v, o.half)
    return None if cut is None else kernels.flat(kernels.stretch(cut, o.gamma))


def matches(asked: list[tuple[np.ndarray, np.ndarray | None, list[float], list[float]]], o: Options) -> list[tuple[float, float, float]]:
    """(u, v, fit) in the next image for each (image, template, us, vs); the last sample stands in for a prediction outside, and what cannot be matched has fit -1."""
    nan = float("nan")
    found, alike = [(nan, nan, -1.0)] * len(asked), {}
    cut = [i for i, a in enumerate(asked) if a[1] is not None]
    ahead = all_predicted([h for i in cut for h in asked[i][2:]]).tolist()
    for i, u, v in zip(cut, ahead[::2], ahead[1::2]):
        image, template, us, vs = asked[i]
        h, w = image.shape
        u, v = u if not (u > w or u < 1) else away(us[-1]), v if not (v > h or v < 1) else away(vs[-1])
        if u != u or v != v:
            continue
        top, left = int(v) - 1 - o.half - o.reach, int(u) - 1 - o.half - o.reach
        scene = image[max(0, top) : int(v) + o.half + o.reach, max(0, left) : int(u) + o.half + o.reach]
        if min(scene.shape) >= 2 * o.half + 1:
            alike.setdefault((template.shape, scene.shape), []).append((i, template, scene, max(0, top), max(0, left)))
    for same in alike.values():
        for lo in range(0, len(same), 256):
            at, templates, scenes, tops, lefts = zip(*same[lo : lo + 256])
            for i, top, left, (row, col, fit) in zip(at, tops, lefts, correlations(np.stack(templates), np.stack(scenes), o.gamma)):
                u, v = left + col + 1, top + row + 1
                if o.find_centroid and fit >= o.least_fit:
                    around = patch(asked[i][0], u, v, o.half)
                    middle = centroid(around, gamma=o.gamma) if around is not None else None
                    if middle:
                        u, v = away(u) - o.half + middle[1], away(v) - o.half + middle[0]
                found[i] = u, v, fit
    return found


def match(image: np.ndarray, template: np.ndarray | None, us: list[float], vs: list[float], o: Options) -> tuple[float, float, float]:
    """``matches`` of one."""
    return matches([(image, template, us, vs)], o)[0]


def flat(u: float, v: float, lens: dict | None) -> tuple[float, float]:
    """A pixel without its lens's distortion, by three fixed-point rounds."""
    if not lens:
        return u, v
    f, k = (lens["f1"] + lens["f2"]) / 2, [lens[f"k{i}"] for i in range(1, 6)]
    a, b = (u - lens["cx"]) / f, (v - lens["cy"]) / f
    x, y = a, b
    for _ in range(3):
        r2 = x * x + y * y
        radial = 1 + k[0] * r2 + k[1] * r2**2 + k[4] * r2**3
        x, y = (a - 2 * k[2] * x * y - k[3] * (r2 + 2 * x * x)) / radial, (b - k[2] * (r2 + 2 * y * y) - 2 * k[3] * x * y) / radial
    return x * f + lens["cx"], y * f + lens["cy"]


def all_located(sights: list[dict[int, tuple[float, float]]], cameras: dict[int, list[float]], lenses: dict[int, dict]) -> list[tuple[float, float, float, float] | None]:
    """(x, y, z, rmse) by least squares from two cameras or more, for each point's sights."""
    out, alike = [None] * len(sights), {}
    for i, s in enumerate(sights):
        cams = tuple(cam for cam in sorted(s) if cam in cameras)
        if len(cams) > 1:
            alike.setdefault(cams, []).append((i, [flat(*s[cam], lenses.get(cam)) for cam in cams]))
    for cams, same in alike.items():
        c = np.array([cameras[cam] for cam in cams])
        uv = np.array([x for _, x in same])
        u, v = uv[..., 0], uv[..., 1]
        a = np.concatenate([u[..., None] * c[:, 8:11] - c[:, 0:3], v[..., None] * c[:, 8:11] - c[:, 4:7]], axis=1)
        left, size, right = np.linalg.svd(a, full_matrices=False)
        whole = (size > np.finfo(float).eps * a.shape[1] * size[:, :1]).all(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            # element by element: products of whole matrices would give other last digits beside other points
            part = (left * np.concatenate([c[:, 3] - u, c[:, 7] - v], axis=1)[:, :, None]).sum(axis=1) / size
            xyz = (part[:, :, None] * right).sum(axis=1)
            along = lambda k: sum(xyz[:, j, None] * c[:, k + j] for j in range(3))
            below = along(8) + 1
            error = (((along(0) + c[:, 3]) / below - u) ** 2 + ((along(4) + c[:, 7]) / below - v) ** 2).sum(axis=1)
        rmse = np.sqrt(error / (2 * len(cams) - 3))
        for (i, _), known, place in zip(same, whole, np.c_[xyz, rmse].tolist()):
            if known:
                out[i] = tuple(place)
    return out


def located(sights: dict[int, tuple[float, float]], cameras: dict[int, list[float]], lenses: dict[int, dict]) -> tuple[float, float, float, float] | None:
    """``all_located`` of one point."""
    return all_located([sights], cameras, lenses)[0]


@dataclass
class Tracker:
    """Points that are followed: point -> (first frame, camera -> [template, us, vs, failures in a row])."""

    points: dict[int, tuple[int, dict[int, list]]] = field(default_factory=dict)

    def begin(self, frame: int, starts: list[tuple[int, int, list[float], list[float]]], images: dict[int, np.ndarray], o: Options) -> None:
        """Follow (point, cam, us, vs), samples up to this frame, whose last is where the template is cut."""
        fresh: dict[int, dict[int, list]] = {}
        for point, cam, us, vs in sorted(starts, key=lambda s: s[:2]):
            template = template_of(images[cam], us[-1], vs[-1], o) if cam in images else None
            fresh.setdefault(point, {})[cam] = [template, list(us)[-o.window :], list(vs)[-o.window :], 0]
        for point, cams in fresh.items():
            self.points[point] = (frame, cams)


def advance(steps: list[tuple[str, int, Tracker, dict[int, np.ndarray]]], cameras: dict, lenses: dict, o: Options) -> list[tuple]:
    """One row a point for each (trial, frame, tracker, images), every tracker once; a camera without an image fails."""
    followed = [(n, point, begun, dict(sorted(cams.items()))) for n, (_, _, tracker, _) in enumerate(steps) for point, (begun, cams) in sorted(tracker.points.items())]
    seen = [(k, cam) for k, (n, _, _, cams) in enumerate(followed) for cam in cams if cam in steps[n][3]]
    found = dict(zip(seen, matches([(steps[followed[k][0]][3][cam], *followed[k][3][cam][:3]) for k, cam in seen], o)))
    fits, sights = [], []
    for k, (_, _, _, cams) in enumerate(followed):
        here = {cam: found.get((k, cam), (float("nan"), float("nan"), -1.0)) for cam in cams}
        fits.append({cam: fit for cam, (_, _, fit) in here.items()})
        sights.append({cam: (u, v) for cam, (u, v, fit) in here.items() if fit >= o.least_fit and u == u and v == v})
    erased, places = [None] * len(followed), all_located(sights, cameras, lenses)
    again = [k for k, place in enumerate(places) if place and place[3] > o.most_rmse]
    for k in again:
        erased[k] = min((fits[k][c], c) for c in sights[k])[1]
        del sights[k][erased[k]]
    for k, place in zip(again, all_located([sights[k] for k in again], cameras, lenses)):
        places[k] = place
    out, ended = [], [set() for _ in steps]
    for k, (n, point, begun, cams) in enumerate(followed):
        for cam, held in cams.items():
            u, v = sights[k].get(cam, (float("nan"), float("nan")))
            held[1], held[2] = [*held[1], u][-o.window :], [*held[2], v][-o.window :]
            held[3] = 0 if cam in sights[k] else held[3] + 1
        if max(held[3] for held in cams.values()) > o.gap:
            ended[n] |= {p for p, (first, _) in steps[n][2].points.items() if first == begun} if o.together else {point}
        rows = [{"cam": c, "u": sights[k][c][0] if c in sights[k] else None, "v": sights[k][c][1] if c in sights[k] else None, "fit": f} for c, f in fits[k].items()]
        out.append((n, (*steps[n][:2], point, rows, *(places[k] or (None,) * 4), erased[k])))
    for n, points in enumerate(ended):
        for point in points:
            del steps[n][2].points[point]
    return [(*row, row[2] in ended[n]) for n, row in out]


def multi_starts(obs: DataFrame, window: int = 11) -> DataFrame:
    """Where tracks (trial, frame, point, cam, u, v) are seen but not in the next frame: trial, frame, point, cam, us, vs with the last samples, missing ones NaN."""
    order = Window.partitionBy("trial", "point", "cam").orderBy("frame")
    seen = obs.where("u IS NOT NULL AND v IS NOT NULL").select("trial", "frame", "point", "cam", F.struct("frame", "u", "v").alias("s"))
    last = seen.select("*", F.lead("frame").over(order).alias("next"), F.collect_list("s").over(order.rangeBetween(-(window - 1), 0)).alias("held")).where("next IS NULL OR next > frame + 1")
    first = F.element_at("held", 1)["frame"]

    def along(c: str) -> Column:
        at = lambda f: F.coalesce(F.get(F.filter("held", lambda s: s["frame"] == f), 0)[c], F.lit(float("nan")))
        return F.transform(F.sequence(first, F.col("frame")), at)

    return last.select("trial", "frame", "point", "cam", along("u").alias("us"), along("v").alias("vs"))


def as_rows(frames: DataFrame, starts: DataFrame, lanes: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """Images (kind 0) and starts (kind 1) of a frame as rows of one table; every lane of a trial gets its images.

    ``carried`` names the columns of ``frames`` that pixels are made from later.
    """
    kind = pix_type(frames.schema["pix"].dataType) if "pix" in frames.columns else "array<double>"
    none = lambda *names: [F.lit(None).cast(t).alias(n) for n, t in names]
    lane = F.lit(0) if lanes == 1 else F.explode(F.sequence(F.lit(0), F.lit(lanes - 1)))
    images = frames.select(F.col("trial").cast("string").alias("trial"), lane.alias("lane"), F.col("frame").cast("int").alias("frame"), F.lit(0).alias("kind"), F.col("cam").cast("int").alias("cam"), *none(("point", "int"), ("us", "array<double>"), ("vs", "array<double>")), F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), (F.col("pix").cast(kind) if "pix" in frames.columns else F.lit(None).cast(kind)).alias("pix"), *carried, *[c for c in frames.columns if c == "ts"])
    begun = starts.select(F.col("trial").cast("string").alias("trial"), F.pmod("point", F.lit(lanes)).cast("int").alias("lane"), F.col("frame").cast("int").alias("frame"), F.lit(1).alias("kind"), F.col("cam").cast("int").alias("cam"), F.col("point").cast("int").alias("point"), "us", "vs", *none(("height", "int"), ("width", "int"), ("pix", kind), *[(c, frames.schema[c].dataType) for c in carried]), *[c for c in starts.columns if c == "ts"])
    return images.unionByName(begun)


def few_cameras(camera: DataFrame, lens: DataFrame | None) -> tuple[dict, dict]:
    """Coefficients and lenses by camera: the rows of a rig, some nine."""
    cameras = {r.cam: list(r.c) for r in camera.where(F.size("c") == 11).collect()}
    return cameras, {r.cam: r.asDict() for r in lens.collect()} if lens is not None else {}


def tabled(rows: list[tuple]) -> Iterator[pd.DataFrame]:
    if rows:
        yield pd.DataFrame(rows, columns=NAMES).astype({"erased": "Int32"})


def arrow_rows(rows: list[tuple], kinds: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(column, kind.type) for column, kind in zip(zip(*rows), kinds)], schema=kinds)


def pix_type(given: DataType) -> str:
    """Pixels, or profiles whose products add up to them."""
    return "array<array<double>>" if isinstance(given, ArrayType) and isinstance(given.elementType, ArrayType) else "array<double>"


def image_of(pix: np.ndarray, height: int, width: int, profiles: bool = False) -> np.ndarray:
    """The image of pixels or, one behind the other, of profiles."""
    if not profiles:
        return pix.reshape(height, width)
    both = pix.reshape(-1, height + width)
    return both[:, :height].T @ both[:, height:]


def flattened(pix, profiles: bool) -> np.ndarray:
    return np.concatenate([np.zeros(0), *pix]) if profiles else np.asarray(pix, float)


def numbers(lists: pa.ListArray) -> tuple[np.ndarray, list[int]]:
    """All numbers of a column of lists, or of lists of lists, and where each row's begin, with the end; a null in a list is NaN."""
    at = lists.offsets.to_numpy()
    inner = lists.values
    if pa.types.is_list(inner.type):
        at, inner = inner.offsets.to_numpy()[at], inner.values
    return inner.to_numpy(zero_copy_only=False).astype(float, copy=False), at.tolist()


def track_points(frames: DataFrame, starts: DataFrame, camera: DataFrame, lens: DataFrame | None = None, options: Options | None = None, lanes: int = 1, picture: Column | None = None) -> DataFrame:
    """Follow ``starts`` (see ``multi_starts``) through synchronised ``frames`` (trial, frame, cam, height, width, pix).

    Returns one row per trial, frame behind the start and point: sights (every
    camera of the point with its fit; u and v are NULL where it failed or was
    erased), x, y, z and rmse (NULL from fewer than two cameras), the erased
    camera, and whether the point ends here.  It ends when a camera fails more
    than ``gap`` frames in a row, with all points of the same start if
    ``together``; only then may ``lanes``, which spread a trial's points over
    tasks at the price of its images once a lane, not be more than one.

    Frames are taken in order of their number, those without any image are
    passed over; a null image counts as absent.  Starts in frames without an
    image have no template and fail.

    pix holds the pixels row by row or, as an array of arrays, any number of
    profiles, ``height`` values down and ``width`` across, whose products add up
    to the image.

    With ``picture``, frames have no pix but the columns that it is made from by
    this expression, once they are dealt and sorted: pixels are never shuffled.

    Trials of a task whose frames have the same number are looked at together:
    a task holds the templates of a part of its trials, and up to ``PIXELS`` of
    images beside those of one trial's frame.
    """
    o = options or Options()
    if lanes > 1 and o.together:
        raise ValueError("points that end together stay in one lane")
    cameras, lenses = few_cameras(camera, lens)
    carried = () if picture is None else tuple(c for c in frames.columns if c not in ("trial", "frame", "cam", "height", "width", "pix", "ts"))
    rows = as_rows(frames, starts, lanes, carried).withColumn("part", F.pmod(F.xxhash64("trial", "lane"), F.lit(PARTS)).cast("int"))
    # as many tasks as shuffles have: rows are small, and their number says little about the work
    dealt = rows.repartition(int(frames.sparkSession.conf.get("spark.sql.shuffle.partitions")), "trial", "lane").sortWithinPartitions("part", "frame", "trial", "lane", "kind", "cam")
    if picture is not None:
        kind = pix_type(frames.select(picture.alias("pix")).schema["pix"].dataType)
        dealt = dealt.withColumn("pix", F.when(F.col("kind") == 0, picture).cast(kind)).drop(*carried)
    profiles, kinds = pix_type(dealt.schema["pix"].dataType) != "array<double>", to_arrow_schema(StructType.fromDDL(OUT))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, key, trackers, raw, begun, steps, pixels = None, None, {}, {}, [], [], 0

        def gathered():
            """The rows of a trial's frame are complete; its images are made if anything is followed in them."""
            if key is not None and (begun or raw and key in trackers):
                images = {cam: image_of(*image, profiles) for cam, image in raw.items()}
                steps.append((key, key[0], now[1], trackers.setdefault(key, Tracker()), images, begun))
                return sum(image.size for image in images.values())
            return 0

        def step():
            out = advance([s[1:5] for s in steps if s[4]], cameras, lenses, o)
            for key_, _, frame, tracker, images, starts_ in steps:
                tracker.begin(frame, starts_, images, o)
                if not tracker.points:
                    del trackers[key_]
            steps.clear()
            return out

        for g in batches:
            out, pix = [], g.column("pix")
            (values, ends), us, vs = numbers(pix), g.column("us"), g.column("vs")
            columns = (g.column(c).to_pylist() for c in ("part", "frame", "trial", "lane", "kind", "cam", "point", "height", "width"))
            for i, (part, frame, trial, lane, kind, cam, point, height, width) in enumerate(zip(*columns)):
                if now != (part, frame) or key != (trial, lane):
                    pixels += gathered()
                    if now != (part, frame) or pixels > PIXELS:
                        out += step()
                        pixels = 0
                    if now is None or now[0] != part:
                        trackers = {}
                    now, key, raw, begun = (part, frame), (trial, lane), {}, []
                if kind == 1:
                    begun.append((point, cam, us[i].as_py(), vs[i].as_py()))
                elif pix[i].is_valid:
                    raw[cam] = (values[ends[i] : ends[i + 1]], height, width)
            yield from arrow_rows(out, kinds)
        gathered()
        yield from arrow_rows(step(), kinds)

    return dealt.mapInArrow(scan, OUT)


class FrameByFrame(StatefulProcessor):
    """The tracker of a (trial, lane) in a stream: images wait for their frame's timer, and timers fire in order of time."""

    def __init__(self, cameras: dict, lenses: dict, options: Options, profiles: bool):
        self.cameras, self.lenses, self.options, self.profiles = cameras, lenses, options, profiles

    def init(self, handle) -> None:
        self.handle = handle
        self.tracker = handle.getValueState("tracker", "held binary")
        self.waiting = handle.getMapState("images", "due long, cam int", "frame int, height int, width int, pix array<double>")
        self.begun = handle.getMapState("starts", "due long, cam int, point int", "frame int, us array<double>, vs array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        for g in rows:
            for r in g.itertuples(index=False):
                due = int(pd.Timestamp(r.ts).timestamp() * 1000)
                if due <= mark:
                    continue  # its frame has been looked at
                if r.kind == 1:
                    self.begun.updateValue((due, int(r.cam), int(r.point)), (int(r.frame), [float(x) for x in r.us], [float(x) for x in r.vs]))
                elif r.pix is not None:
                    self.waiting.updateValue((due, int(r.cam)), (int(r.frame), int(r.height), int(r.width), image_of(flattened(r.pix, self.profiles), int(r.height), int(r.width), self.profiles).ravel().tolist()))
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due = expiredTimerInfo.getExpiryTimeInMs()
        images, begun, frame = {}, [], None
        for (at, cam), (frame_, height, width, pix) in list(self.waiting.iterator()):
            if at == due:
                frame, images[cam] = frame_, image_of(np.asarray(pix, float), height, width)
                self.waiting.removeKey((at, cam))
        for (at, cam, point), (frame_, us, vs) in list(self.begun.iterator()):
            if at == due:
                frame = frame_
                begun.append((point, cam, us, vs))
                self.begun.removeKey((at, cam, point))
        held = self.tracker.get()
        tracker = pickle.loads(held[0]) if held else Tracker()
        out = advance([(key[0], frame, tracker, images)], self.cameras, self.lenses, self.options) if images else []
        if frame is not None:
            tracker.begin(frame, begun, images, self.options)
        self.tracker.update((pickle.dumps(tracker),))
        yield from tabled(out)

    def close(self) -> None:
        pass


def track_points_stream(frames: DataFrame, starts: DataFrame, camera: DataFrame, lens: DataFrame | None = None, options: Options | None = None, lanes: int = 1, delay: str = "1 second") -> DataFrame:
    """``track_points`` on streams that carry the time of their frame in ``ts``.

    A frame is looked at when the watermark, ``delay`` behind the newest frame,
    has passed it, with the images that came until then; later ones are
    dropped.  All rows of a frame carry the same ``ts``, which grows with the
    frame.  The session needs the RocksDB state store.
    """
    o = options or Options()
    if lanes > 1 and o.together:
        raise ValueError("points that end together stay in one lane")
    rows = as_rows(frames, starts, lanes).withWatermark("ts", delay)
    return rows.groupBy("trial", "lane").transformWithStateInPandas(FrameByFrame(*few_cameras(camera, lens), o, pix_type(frames.schema["pix"].dataType) != "array<double>"), outputStructType=OUT, outputMode="Append", timeMode="EventTime")
