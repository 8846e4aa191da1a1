"""Raw Y4M videos: frames found by place and read by ranges, as rows to decode and as a Spark data source."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructField, StructType

from orbitframe.functions.raster import IMAGE, _arrow, to_array
from orbitframe.sources.stores import Ranged, located

#: First bytes of a file and of a frame.
FILE, FRAME = b"YUV4MPEG2", b"FRAME"
#: Bytes that a header may have, and bytes of a partition.
HEADER, SPLIT = 4096, 64 << 20
FRAMES = f"path string, frame_idx long, fps double, image {IMAGE}, error string"
_NAMES, _KINDS = ["path", "frame_idx", "fps", "image", "error"], [pa.string(), pa.int64(), pa.float64(), _arrow(IMAGE), pa.string()]


def header(data: bytes) -> dict:
    """Width, height, frames a second, header length and bytes of a frame of a raw 4:2:0 or mono video."""
    end = data.index(b"\n")
    tags = {t[:1].decode(): t[1:].decode() for t in data[:end].split()[1:]}
    w, h = int(tags["W"]), int(tags["H"])
    num, den = map(int, tags.get("F", "25:1").split(":"))
    mono = tags.get("C", "420").startswith("mono")
    return {"width": w, "height": h, "fps": num / den if den else 0.0, "start": end + 1, "size": w * h if mono else w * h + 2 * (-(-w // 2) * -(-h // 2)), "mono": mono}


def pixels(planes: bytes, head: dict) -> np.ndarray:
    """Blue, green, red of a frame's planes, or its one channel."""
    w, h = head["width"], head["height"]
    y = np.frombuffer(planes, np.uint8, w * h).reshape(h, w)
    if head["mono"]:
        return y[..., None]
    cw, ch = -(-w // 2), -(-h // 2)
    u, v = (np.frombuffer(planes, np.uint8, cw * ch, w * h + k * cw * ch).reshape(ch, cw).astype(float).repeat(2, 0).repeat(2, 1)[:h, :w] - 128 for k in (0, 1))
    y = 1.164 * (y.astype(float) - 16)
    return np.clip(np.rint(np.stack([y + 2.018 * u, y - 0.391 * u - 0.813 * v, y + 1.596 * v], axis=-1)), 0, 255).astype(np.uint8)


@dataclass
class Layout:
    """Where a video's frames lie. If no frame's header has parameters, places follow from the file's size; else headers are walked."""

    head: dict
    count: int
    even: bool

    @classmethod
    def of(cls, file: Ranged) -> Layout | None:
        """None if the file is no raw video."""
        first = file.read(0, HEADER)
        if not first.startswith(FILE):
            return None
        try:
            head = header(first)
        except (IndexError, KeyError, ValueError):
            return None
        step = len(FRAME) + 1 + head["size"]
        count = max(0, file.size - head["start"]) // step
        plain = lambda k: file.read(head["start"] + k * step, len(FRAME) + 1) == FRAME + b"\n"
        return cls(head, count, count == 0 or (plain(0) and plain(count - 1) and plain(count // 2)))

    def place(self, k: int) -> int:
        return self.head["start"] + k * (len(FRAME) + 1 + self.head["size"]) + len(FRAME) + 1

    def walked(self, file: Ranged) -> Iterator[int]:
        """Where the planes of each whole frame begin, header by header."""
        at, size = self.head["start"], self.head["size"]
        while at < file.size:
            line = file.read(at, HEADER)
            end = line.find(b"\n")
            if not line.startswith(FRAME) or end < 0 or at + end + 1 + size > file.size:
                return
            yield at + end + 1
            at += end + 1 + size

    def read(self, file: Ranged, place: int) -> np.ndarray | None:
        """The pixels of the frame whose planes begin at ``place``; None if no frame's header ends there or planes are cut."""
        skip = len(FRAME) + 1 if self.even else 1
        data = file.read(place - skip, skip + self.head["size"])
        whole = len(data) == skip + self.head["size"] and (data.startswith(FRAME + b"\n") if self.even else data[:1] == b"\n")
        return pixels(data[skip:], self.head) if whole else None

    def places(self, file: Ranged) -> Iterator[int]:
        return (self.place(k) for k in range(self.count)) if self.even else self.walked(file)


def wanted(n: int, fps: float, step: int = 1, interval: tuple[float, str] | None = None, only: str | None = None) -> range:
    """Numbers of the frames to take of n: every step-th, by an interval of seconds or frames, or the first or middle one."""
    if only:
        at = n // 2 if only == "middle" and n > 60 else 0
        return range(at, min(n, at + 1))
    value, unit = interval or (step, "frames")
    return range(0, n, int(max(1.0, float(value) if unit.lower() == "frames" else fps * float(value))))


def packed(path: str, k: int, fps: float | None, px: np.ndarray | None, error: str | None) -> pa.RecordBatch:
    img = None if px is None else {"height": px.shape[0], "width": px.shape[1], "channels": px.shape[2], "data": np.ascontiguousarray(px).tobytes()}
    return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip((path, k, fps, img, error), _KINDS)], names=_NAMES)


def frame_keys(files: DataFrame, step: int = 1, interval: tuple[float, str] | None = None, only: str | None = None) -> DataFrame:
    """(path, frame_idx, fps, place, error) of the frames to take of raw videos (path): a row a frame, nothing decoded.

    ``place`` is where the planes begin. A file that is no raw video, can't be opened, or has no frame gives one row with an error.
    Join, filter and deal these rows, then decode them (decoded): so no image passes through a join.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.string()]
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["path", "frame_idx", "fps", "place", "error"])
        for b in batches:
            for path in b.column(0).to_pylist():
                try:
                    with Ranged(path) as file:
                        layout = Layout.of(file)
                        if layout is None:
                            yield pack([(path, 0, 0.0, None, "unreadable")])
                            continue
                        places = None if layout.even else list(layout.walked(file))
                        n, fps = layout.count if layout.even else len(places), layout.head["fps"]
                        if not n:
                            yield pack([(path, 0, fps, None, "no frames")])
                        take = wanted(n, fps, step, interval, only)
                        for lo in range(0, len(take), 10_000):
                            yield pack([(path, k, fps, layout.place(k) if layout.even else places[k], None) for k in take[lo : lo + 10_000]])
                except OSError as e:
                    yield pack([(path, 0, 0.0, None, str(e))])

    return files.select("path").mapInArrow(run, "path string, frame_idx long, fps double, place long, error string")


def decoded(keys: DataFrame) -> DataFrame:
    """keys with the column ``image``: each frame read by its range and decoded, rows staying where they are; null where place is null or can't be read.

    Rows of a file that are neighbours share one open file.
    """
    columns = keys.columns
    path_at, place_at = columns.index("path"), columns.index("place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file, layout = None, None, None
        try:
            for b in batches:
                for i, (path, place) in enumerate(zip(b.column(path_at).to_pylist(), b.column(place_at).to_pylist())):
                    px = None
                    try:
                        if path != name:
                            if file is not None:
                                file.__exit__()
                            name, file, layout = path, None, None
                            file = Ranged(path)
                            layout = Layout.of(file)
                        if layout is not None and place is not None:
                            px = layout.read(file, place)
                    except OSError:
                        name = None
                    img = None if px is None else {"height": px.shape[0], "width": px.shape[1], "channels": px.shape[2], "data": np.ascontiguousarray(px).tobytes()}
                    row = b.slice(i, 1)
                    yield pa.RecordBatch.from_arrays([*row.columns, pa.array([img], _arrow(IMAGE))], schema=pa.schema([*zip(b.schema.names, b.schema.types), ("image", _arrow(IMAGE))]))
        finally:
            if file is not None:
                file.__exit__()

    return keys.mapInArrow(run, StructType([*keys.schema.fields, StructField("image", StructType.fromDDL(f"image {IMAGE}")[0].dataType)]))


@dataclass
class Piece(InputPartition):
    """Bytes of a file; the frames whose headers begin there belong to the partition."""

    path: str
    low: int
    high: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.least, self.most, self.only = options, 0, None, None

    def pushFilters(self, filters: list[Filter]):
        """Bounds and lists of frame numbers are kept here, and still checked by Spark where the source can't promise them."""
        for f in filters:
            if getattr(f, "attribute", None) != ("frame_idx",):
                yield f
            elif isinstance(f, EqualTo) and f.value is not None:
                self._among({int(f.value)})
            elif isinstance(f, In):
                self._among({int(v) for v in f.value if v is not None})
            elif isinstance(f, GreaterThan | GreaterThanOrEqual):
                self.least = max(self.least, int(f.value) + isinstance(f, GreaterThan))
            elif isinstance(f, LessThan | LessThanOrEqual):
                top = int(f.value) - isinstance(f, LessThan)
                self.most = top if self.most is None else min(self.most, top)
            else:
                yield f

    def _among(self, some: set[int]) -> None:
        self.only = some if self.only is None else self.only & some

    def partitions(self) -> list[Piece]:
        store, path = located(self.options["path"])
        info = store.get_file_info(path)
        files = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(path, recursive=True))
        root = self.options["path"].removesuffix(path) if "://" in self.options["path"] else ""
        split = int(self.options.get("split", SPLIT))
        return [Piece(root + f.path, low, min(low + split, f.size)) for f in files if f.type == fs.FileType.File and f.path.lower().endswith(".y4m") for low in range(0, max(f.size, 1), split)]

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        value = self.options.get("interval")
        interval = (float(value), self.options.get("unit", "seconds")) if value else None
        with Ranged(piece.path) as file:
            layout = Layout.of(file)
            if layout is None or (layout.even and not layout.count):
                if piece.low == 0 and not self.least and (self.most is None or self.most >= 0) and (self.only is None or 0 in self.only):
                    yield packed(piece.path, 0, 0.0, None, "unreadable" if layout is None else "no frames")
                return
            if not layout.even and piece.low:
                return  # headers of their own lengths have to be walked from the first one
            places = None if layout.even else list(layout.walked(file))
            n, head = layout.count if layout.even else len(places), layout.head
            take = wanted(n, head["fps"], int(self.options.get("step", 1)), interval, self.options.get("only"))
            top = n - 1 if self.most is None else min(n - 1, self.most)
            numbers = sorted(k for k in self.only if k in take and self.least <= k <= top) if self.only is not None else range(take.start + -(-max(0, self.least - take.start) // take.step) * take.step, min(take.stop, top + 1), take.step)
            if layout.even:  # of these, the ones that begin in the piece
                step = len(FRAME) + 1 + head["size"]
                low, high = -(-(piece.low - head["start"]) // step), -(-(piece.high - head["start"]) // step)
                low = max(0, low)
                numbers = [k for k in numbers if low <= k < high] if self.only is not None else range(numbers.start + -(-max(0, low - numbers.start) // numbers.step) * numbers.step, min(numbers.stop, high), numbers.step)
            for k in numbers:
                px = layout.read(file, layout.place(k) if layout.even else places[k])
                yield packed(piece.path, k, head["fps"], px, None if px is not None else "no frame where one should be")


class RawVideoSource(DataSource):
    """``spark.read.format("y4m").load(folder)``: FRAMES rows of the .y4m files under a folder.

    A file is read by as many tasks as it has pieces of ``split`` bytes; a piece holds the frames that begin in it. Options: ``step``;
    ``interval`` with ``unit`` (seconds or frames); ``only`` (first or middle); ``split``. Filters on frame_idx are pushed down (register() turns that
    on), so only those frames are read. A file that is no raw video gives one row with an error.
    """

    @classmethod
    def name(cls) -> str:
        return "y4m"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)


def register(spark: SparkSession) -> SparkSession:
    """The session with the source registered and filters of Python sources pushed down."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawVideoSource)
    return spark


def video_frames(spark: SparkSession, folder: str, **options) -> DataFrame:
    """FRAMES rows of the raw videos under a folder; options as those of RawVideoSource."""
    return register(spark).read.format("y4m").options(**{k: str(v) for k, v in options.items()}).load(folder)


def all_places(data: bytes) -> tuple[dict, list[int]] | None:
    """Header and places of the frames of a raw video in memory; None if it is none."""
    file = Ranged(data)
    layout = Layout.of(file)
    return None if layout is None else (layout.head, list(layout.places(file)))


def planes(px: np.ndarray) -> bytes:
    """The planes of a frame: luma alone of one channel, else with both colour differences at half size."""
    if px.shape[2] == 1:
        return np.ascontiguousarray(px).tobytes()
    b, g, r = np.moveaxis(px[..., :3].astype(float), 2, 0)
    y = 16 + 0.257 * r + 0.504 * g + 0.098 * b
    byte = lambda p: np.clip(np.rint(p), 0, 255).astype(np.uint8).tobytes()

    def half(p: np.ndarray) -> np.ndarray:
        p = np.pad(p, [(0, n % 2) for n in p.shape], mode="edge")
        return p.reshape(p.shape[0] // 2, 2, p.shape[1] // 2, 2).mean(axis=(1, 3))

    return byte(y) + byte(half(128 - 0.148 * r - 0.291 * g + 0.439 * b)) + byte(half(128 + 0.439 * r - 0.368 * g - 0.071 * b))


def write_videos(frames: DataFrame, folder: str, fps: int = 25, name: str = "name", order: str = "frame_idx", image: str = "image") -> DataFrame:
    """(path, frames, error) of raw videos <folder>/<name>.y4m, a row a file; the frames of a name in order, null images left out.

    Names are dealt to tasks, and a task streams sorted frames to one file after another, so it holds a batch, however long a video.
    A file gets its name when it is whole. All frames of a video have the size of its first one; a video with another has an error.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        mark = context.taskAttemptId() if context else 0
        current, out, shape, count, error = None, None, None, 0, None

        def closed() -> pa.RecordBatch:
            nonlocal out
            path = f"{folder}/{current}.y4m"
            store, part = located(f"{path}.{mark}")
            if out is not None:
                out.close()
                store.delete_file(part) if error else store.move(part, located(path)[1])
            out = None
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([count], pa.int64()), pa.array([error], pa.string())], names=["path", "frames", "error"])

        for b in batches:
            for key, img in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if key != current:
                    if current is not None:
                        yield closed()
                    current, shape, count, error = key, None, 0, None
                if img is None or error:
                    continue
                px = to_array(img["height"], img["width"], img["channels"], img["data"])
                if shape is None:
                    shape = px.shape
                    store, part = located(f"{folder}/{current}.y4m.{mark}")
                    store.create_dir(part.rsplit("/", 1)[0], recursive=True)
                    out = store.open_output_stream(part)
                    out.write(f"YUV4MPEG2 W{shape[1]} H{shape[0]} F{fps}:1 {'Cmono' if shape[2] == 1 else 'C420jpeg'}\n".encode())
                if px.shape != shape:
                    error = "frames of different sizes"
                    continue
                out.write(FRAME + b"\n" + planes(px))
                count += 1
        if current is not None:
            yield closed()

    dealt = frames.select(name, order, image).where(f"`{name}` is not null").repartition(name).sortWithinPartitions(name, order)
    return dealt.mapInArrow(run, "path string, frames long, error string")
