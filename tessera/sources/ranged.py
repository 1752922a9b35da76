"""Rasters read by byte ranges: the data source "tiff" (S03, S01, S09, S10, S12).

spark.read.format("tiff").option("table", "directories") has a row for each image directory,
with the default table "pixels" a row for each row of samples of a strip or tile.  Neither reads
a file whole: headers are fetched page by page, blocks one by one, so files may have any size.
Filters on ifd and band, and the options ifd, band, rows (first:last) and row_step, decide which blocks are fetched.

Small files are packed into partitions by their size.  A file over partition_bytes is planned by its
header and split into runs of blocks, so one large file is many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from fnmatch import fnmatch
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition

from . import tiff_format as T

PAGE = 1 << 14  # bytes fetched at a time from a header
PAGES_KEPT = 64  # of one file
PARTITION_BYTES = 32 << 20

DIRECTORIES = "path string, ifd int, subfile long, width long, height long, bits int, samples int, sample_format int, compression int, predictor int, tile_w long, tile_h long, rows_per_strip long, ifd_offset long, blocks long, bytecount long, nodata double, alpha boolean, fetched long, error string"
PIXELS = "path string, ifd int, band int, row int, col int, block int, data array<double>, error string"


class Ranged:
    """A file as something with a length and slices; fetched: bytes read so far."""

    def __init__(self, path: str):
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(path)
        self.file = files.open_input_file(at)
        self.size, self.fetched = self.file.size(), 0
        self._page = lru_cache(PAGES_KEPT)(self._fetch_page)

    def __len__(self) -> int:
        return self.size

    def _fetch_page(self, number: int) -> bytes:
        return self.exactly(number * PAGE, PAGE)

    def exactly(self, at: int, n: int) -> bytes:
        """n bytes from at on, fewer at the end, in one read."""
        n = max(0, min(n, self.size - at))
        self.fetched += n
        return self.file.read_at(n, at) if n else b""

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        if stop <= start:
            return b""
        if stop - start > 4 * PAGE:
            return self.exactly(start, stop - start)
        first, last = start // PAGE, (stop - 1) // PAGE
        whole = b"".join(self._page(i) for i in range(first, last + 1))
        return whole[start - first * PAGE : stop - first * PAGE]

    def close(self) -> None:
        self.file.close()


def one(tags: dict[int, tuple], tag: int, default=None):
    return (tags.get(tag) or (default,))[0]


def nodata_of(tags: dict[int, tuple]) -> float | None:
    try:
        return float(b"".join(tags[42113]).rstrip(b"\0").decode("latin-1")) if 42113 in tags else None
    except (ValueError, TypeError):
        return None


class Grid:
    """Blocks of a directory: place of each, and what it takes to decode one."""

    def __init__(self, tags: dict[int, tuple]):
        bits, kind = tags.get(T.BITS) or (1,), {1: "u", 2: "i", 3: "f"}.get(one(tags, T.SAMPLE_FORMAT, 1))
        self.order, self.samples = tags[0][0], one(tags, T.SAMPLES, 1)
        self.width, self.height = one(tags, T.WIDTH, 0), one(tags, T.HEIGHT, 0)
        if len(set(bits)) > 1 or bits[0] not in (8, 16, 32, 64) or kind is None or kind == "f" and bits[0] == 8 or self.samples < 1:
            raise ValueError(f"samples of {bits} bits aren't supported")
        self.stored = np.dtype(f"{self.order}{kind}{bits[0] // 8}")
        self.tiled = T.TILE_OFFSETS in tags
        if self.tiled:
            self.w, self.h, self.at, self.sizes = one(tags, T.TILE_WIDTH, 0), one(tags, T.TILE_HEIGHT, 0), tags[T.TILE_OFFSETS], tags[T.TILE_COUNTS]
        else:
            self.w, self.h, self.at, self.sizes = self.width, min(one(tags, T.ROWS_PER_STRIP, self.height), self.height), tags[T.STRIP_OFFSETS], tags[T.STRIP_COUNTS]
        if not self.w or not self.h:
            raise ValueError("strips or tiles without area")
        self.across, self.down = -(-self.width // self.w), -(-self.height // self.h)
        self.planes = self.samples if one(tags, T.PLANAR, 1) == 2 else 1
        self.deep = self.samples // self.planes
        self.count = self.across * self.down * self.planes
        if min(len(self.at), len(self.sizes)) < self.count:
            raise ValueError("strips or tiles are missing")
        self.compression, self.predictor = one(tags, T.COMPRESSION, 1), one(tags, T.PREDICTOR, 1)

    def place(self, n: int) -> tuple[int, int, int]:
        """(plane, first row, first column) of block n."""
        plane, rest = divmod(n, self.across * self.down)
        return plane, rest // self.across * self.h, rest % self.across * self.w

    def wanted(self, bands: set[int] | None, rows: tuple[int, int], step: int) -> list[int]:
        """Numbers of the blocks with a row and a band that are asked for."""
        found = []
        for n in range(self.count):
            plane, r, _ = self.place(n)
            last = min(r + self.h, self.height, rows[1] + 1)
            first = max(r, rows[0])
            first += -first % step
            mine = range(plane * self.deep + 1, (plane + 1) * self.deep + 1)
            if first < last and (bands is None or bands & set(mine)):
                found.append(n)
        return found

    def decoded(self, data: Ranged, n: int) -> np.ndarray:
        """rows x columns x samples of block n within the image; a block without bytes is all 0."""
        _, r, c = self.place(n)
        rows = self.h if self.tiled else min(self.h, self.height - r)
        shape = (rows, self.w, self.deep)
        if not self.sizes[n]:
            block = np.zeros(shape, self.stored)
        else:
            plain = T.decode_segment(data.exactly(self.at[n], self.sizes[n]), self.compression, rows * self.w * self.deep * self.stored.itemsize)
            block = T.undo_predictor(np.frombuffer(plain, self.stored).reshape(shape), self.predictor, self.order)
        return block[: self.height - r, : self.width - c]


def walked(data: Ranged) -> Iterator[tuple[int, dict[int, tuple] | None, str | None]]:
    """(number, tags, error) of each directory; damage ends the walk with an error."""
    i = -1
    try:
        for i, tags in enumerate(T.directories(data)):
            yield i, tags, None
    except T.DAMAGE as e:
        yield i + 1, None, str(e) or type(e).__name__


class Part(InputPartition):
    """Files, each with the numbers of the (directory, first block, last block) to read, or None for all."""

    def __init__(self, files: list[tuple[str, tuple[int, int, int] | None]]):
        super().__init__(files)


class TiffReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = options["path"], options.get("pathglobfilter", "*.tif*").lower()
        self.table = options.get("table", "pixels")
        self.bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.ifd = int(options["ifd"]) if "ifd" in options else None
        self.bands = {int(b) for b in options["band"].split(",")} if "band" in options else None
        first, _, last = options.get("rows", "").partition(":")
        self.rows, self.step = (int(first or 0), int(last or 2**31)), int(options.get("row_step", 1))

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("ifd",) and self.ifd in (None, f.value):
                self.ifd = f.value
            elif self.table == "pixels" and isinstance(f, EqualTo) and f.attribute == ("band",) and (self.bands is None or f.value in self.bands):
                self.bands = {f.value}
            else:
                yield f

    def listed(self) -> list[tuple[str, int]]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(self.path)
        info = files.get_file_info(root)
        if info.type == fs.FileType.File:
            return [(self.path, info.size)]
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else "file://"
        head = scheme + self.path.split("://", 1)[-1].split("/", 1)[0] if scheme not in ("file://",) else "file://"
        found = files.get_file_info(fs.FileSelector(root, recursive=True))
        return [(head + ("" if f.path.startswith("/") or head.endswith("/") else "/") + f.path, f.size) for f in found if f.type == fs.FileType.File and fnmatch(f.base_name.lower(), self.glob)]

    def partitions(self) -> Sequence[InputPartition]:
        parts, held, size = [], [], 0
        for path, n in sorted(self.listed()):
            if self.table == "pixels" and n > self.bytes:
                parts += self._split(path)
                continue
            cost = 4 * PAGE if self.table == "directories" else n
            if held and size + cost > self.bytes:
                parts.append(Part(held))
                held, size = [], 0
            held.append((path, None))
            size += cost
        return [*parts, *([Part(held)] if held else [])] or [Part([])]

    def _split(self, path: str) -> list[Part]:
        """Runs of a large file's blocks, planned by its header."""
        data, parts = Ranged(path), []
        for i, tags, error in walked(data):
            if error or self.ifd not in (None, i):
                continue
            try:
                grid = Grid(tags)
            except T.DAMAGE:
                parts.append(Part([(path, (i, 0, 0))]))  # read() tells the error
                continue
            first, size = 0, 0
            for n in range(grid.count):
                if size and size + grid.sizes[n] > self.bytes:
                    parts.append(Part([(path, (i, first, n))]))
                    first, size = n, 0
                size += grid.sizes[n]
            parts.append(Part([(path, (i, first, grid.count))]))
        data.close()
        return parts

    def read(self, partition: Part) -> Iterator:
        for path, run in partition.value:
            try:
                data = Ranged(path)
            except OSError as e:
                yield pa.RecordBatch.from_pylist([{"path": path, "error": str(e)}], self._schema())
                continue
            yield from self._directories(path, data) if self.table == "directories" else self._pixels(path, data, run)
            data.close()

    def _schema(self) -> pa.Schema:
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "array<double>": pa.list_(pa.float64())}
        return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in (DIRECTORIES if self.table == "directories" else PIXELS).split(", ")])

    def _directories(self, path: str, data: Ranged) -> Iterator[pa.RecordBatch]:
        rows = []
        for i, t, error in walked(data):
            if self.ifd not in (None, i):
                continue
            if t is None:
                rows.append({"path": path, "ifd": i, "fetched": data.fetched, "error": error})
                continue
            counts = t.get(T.TILE_COUNTS) or t.get(T.STRIP_COUNTS) or ()
            rows.append({"path": path, "ifd": i, "subfile": one(t, 254, 0), "width": one(t, T.WIDTH), "height": one(t, T.HEIGHT), "bits": one(t, T.BITS, 1), "samples": one(t, T.SAMPLES, 1), "sample_format": one(t, T.SAMPLE_FORMAT, 1), "compression": one(t, T.COMPRESSION, 1), "predictor": one(t, T.PREDICTOR, 1), "tile_w": one(t, T.TILE_WIDTH), "tile_h": one(t, T.TILE_HEIGHT), "rows_per_strip": one(t, T.ROWS_PER_STRIP), "ifd_offset": t[-1][0], "blocks": len(counts), "bytecount": int(sum(counts)), "nodata": nodata_of(t), "alpha": T.alpha_band(t) is not None, "fetched": data.fetched})
        yield pa.RecordBatch.from_pylist(rows, self._schema())

    def _pixels(self, path: str, data: Ranged, run: tuple[int, int, int] | None) -> Iterator[pa.RecordBatch]:
        schema = self._schema()
        failed = lambda i, e: pa.RecordBatch.from_pylist([{"path": path, "ifd": i, "error": str(e) or type(e).__name__}], schema)
        for i, tags, error in walked(data):
            if run and i > run[0]:
                return
            if self.ifd not in (None, i) or run and i != run[0]:
                continue
            try:
                if error:
                    raise ValueError(error)
                grid = Grid(tags)
                wanted = grid.wanted(self.bands, self.rows, self.step)
            except T.DAMAGE as e:
                yield failed(i, e)
                continue
            for n in wanted:
                if run and not run[1] <= n < run[2]:
                    continue
                plane, r, c = grid.place(n)
                try:
                    block = grid.decoded(data, n)
                except T.DAMAGE as e:
                    yield failed(i, e)
                    continue
                bands = [b for b in range(block.shape[2]) if self.bands is None or plane * grid.deep + b + 1 in self.bands]
                rows = [k for k in range(len(block)) if self.rows[0] <= r + k <= self.rows[1] and (r + k) % self.step == 0]
                values = block[rows][:, :, bands].transpose(2, 0, 1).astype(np.float64)
                m, wide = len(bands) * len(rows), block.shape[1]
                if not m:
                    continue
                lists = pa.ListArray.from_arrays(np.arange(0, (m + 1) * wide, wide, dtype=np.int32), np.ascontiguousarray(values).ravel())
                columns = [pa.array([path] * m), pa.array(np.full(m, i, np.int32)), pa.array(np.repeat(np.array([plane * grid.deep + b + 1 for b in bands], np.int32), len(rows))), pa.array(np.tile(np.array(rows, np.int32) + r, len(bands)), pa.int32()), pa.array(np.full(m, c, np.int32)), pa.array(np.full(m, n, np.int32)), lists, pa.nulls(m, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)


class TiffSource(DataSource):
    """Options: path (a file or a folder tree), pathGlobFilter, table, ifd, band, rows, row_step, partition_bytes."""

    @classmethod
    def name(cls) -> str:
        return "tiff"

    def schema(self) -> str:
        return DIRECTORIES if self.options.get("table") == "directories" else PIXELS

    def reader(self, schema) -> DataSourceReader:
        return TiffReader({k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes format("tiff") known to the session, with filters pushed down."""
    spark.dataSource.register(TiffSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
