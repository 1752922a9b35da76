"""TIFF files: codecs, image directories, pages and a writer; plain Python and NumPy for use inside tasks.

Classic and big files in either byte order; stored, PackBits, LZW, deflate and zstandard strips
and tiles; horizontal and floating-point predictors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import zstandard

# Fixed values of the format.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS, ZSTD = 1, 5, 8, 32946, 32773, 50000
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT = 284, 317, 322, 323, 324, 325, 339
EXTRA_SAMPLES = 338
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
UNDEFINED, RATIONALS = 7, {5: "I", 10: "i"}  # bytes of any content; numerator and denominator
CLEAR, END, FIRST = 256, 257, 258

#: What reading a damaged file may raise; readers turn each into an error row.
DAMAGE = (ValueError, KeyError, IndexError, TypeError, ArithmeticError, MemoryError, struct.error, zlib.error)


# --- codecs -----------------------------------------------------------------------------


def packbits_encode(rows: np.ndarray) -> bytes:
    """Packs each row of an array of bytes on its own, as the format asks."""
    width = rows.shape[1]
    if not rows.size:
        return b""
    runs = np.zeros(len(rows), bool)
    if width > 2:
        runs = np.any((rows[:, 2:] == rows[:, 1:-1]) & (rows[:, 1:-1] == rows[:, :-2]), axis=1)
    if width <= 128 and not runs.any():
        return np.insert(rows, 0, width - 1, axis=1).tobytes()
    out = []
    for row, has_runs in zip(rows, runs, strict=True):
        data, at = row.tobytes(), 0
        if not has_runs:
            out += [bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, width, 128)]
            continue
        cuts = np.flatnonzero(np.diff(row)) + 1
        for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), width], strict=True):
            if e - s < 3:
                continue
            out += [bytes([len(data[i : min(i + 128, s)]) - 1]) + data[i : min(i + 128, s)] for i in range(at, s, 128)]
            for i in range(s, e, 128):
                n = min(128, e - i)
                out.append(bytes([257 - n if n > 1 else 0, data[s]]))
            at = e
        out += [bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(at, width, 128)]
    return b"".join(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at, got = [], 0, 0
    while at < len(data) and got < size:
        n = data[at]
        if n < 128:
            part, at = data[at + 1 : at + 2 + n], at + 2 + n
        elif n > 128:
            part, at = data[at + 1 : at + 2] * (257 - n), at + 2
        else:
            part, at = b"", at + 1
        out.append(part)
        got += len(part)
    return b"".join(out)


def _code_width(position: np.ndarray) -> np.ndarray:
    """Bits of the codes by their number since the last clear; the decoder's table holds FIRST + position - 1 entries then."""
    entries = FIRST - 1 + position
    return 9 + (entries >= 511).astype(np.int64) + (entries >= 1023) + (entries >= 2047)


_BLOCK = np.arange(4096 - FIRST + 2)  # no table block has more codes than this
_WIDTHS = _code_width(_BLOCK)
_OFFSETS = np.concatenate([[0], np.cumsum(_WIDTHS)])


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits, the width changing one code early."""
    codes, widths = [[CLEAR]], [np.array([9])]
    at, n = 0, len(data)
    while at < n:
        table: dict[int, int] = {}
        free, now, block = FIRST, data[at], []
        at += 1
        find, put = table.get, block.append
        for at in range(at, n):
            b = data[at]
            key = now << 8 | b
            to = find(key)
            if to is None:
                put(now)
                table[key] = free
                free += 1
                now = b
                if free == 4094:
                    break
            else:
                now = to
        else:
            at = n
        if at < n:  # table full: the pending byte starts the next block
            put(CLEAR)
        else:
            put(now)
        codes.append(block)
        widths.append(_WIDTHS[: len(block)])
    tail = _WIDTHS[len(codes[-1])] if len(codes) > 1 else 9
    codes.append([END])
    widths.append(np.array([tail]))
    every, width = np.fromiter((c for b in codes for c in b), np.uint16), np.concatenate(widths)
    bits = np.unpackbits(every.astype(">u2").view(np.uint8).reshape(-1, 2), axis=1)
    return np.packbits(bits[np.arange(16) >= 16 - width[:, None]]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """Decodes up to the end code or size bytes."""
    raw = np.frombuffer(data + b"\0\0\0\0", np.uint8).astype(np.uint32)
    bit, total = 0, len(data) * 8
    out: list[bytes] = []
    got = 0
    singles = [bytes([i]) for i in range(256)] + [b"", b""]
    while bit < total and got < size:
        count = int(np.searchsorted(_OFFSETS, total - bit, side="right")) - 1
        count = min(count, len(_BLOCK))
        if count <= 0:
            break
        at = bit + _OFFSETS[:count]
        byte, shift = at >> 3, (at & 7).astype(np.uint32)
        window = raw[byte] << np.uint32(16) | raw[byte + 1] << np.uint32(8) | raw[byte + 2]
        width = _WIDTHS[:count].astype(np.uint32)
        codes = (window >> (np.uint32(24) - shift - width)) & ((np.uint32(1) << width) - np.uint32(1))
        stops = np.flatnonzero((codes == CLEAR) | (codes == END))
        stop = int(stops[0]) if stops.size else count
        table, last = singles.copy(), b""
        add, emit = table.append, out.append
        for code in codes[:stop].tolist():
            if code < len(table):
                entry = table[code]
                if last:
                    add(last + entry[:1])
            elif code == len(table) and last:
                entry = last + last[:1]
                add(entry)
            else:
                raise ValueError("LZW code out of range")
            emit(entry)
            got += len(entry)
            last = entry
        if not stops.size or codes[stop] == END:
            break
        bit += int(_OFFSETS[stop + 1])
    return b"".join(out)


def zstd_decode(data: bytes, size: int) -> bytes:
    """At most size bytes, whatever size the frame claims."""
    try:
        return zstandard.ZstdDecompressor().stream_reader(data).read(size)
    except zstandard.ZstdError as e:
        raise ValueError(f"zstandard: {e}") from e


def decode_segment(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        plain = data
    elif compression == LZW:
        plain = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        plain = zlib.decompressobj().decompress(data, max(1, size))
    elif compression == PACKBITS:
        plain = packbits_decode(data, size)
    elif compression == ZSTD:
        plain = zstd_decode(data, size)
    else:
        raise ValueError(f"compression {compression} isn't supported")
    if len(plain) < size:
        raise ValueError("a strip or tile is too short")
    return plain[:size]


def undo_predictor(block: np.ndarray, predictor: int, order: str) -> np.ndarray:
    """block: rows x columns x samples, as stored."""
    if predictor == 1:
        return block
    if predictor == 2 and block.dtype.kind in "ui":
        return np.cumsum(block.astype(block.dtype.newbyteorder("=")), axis=1, dtype=block.dtype.newbyteorder("="))
    if predictor == 3 and block.dtype.kind == "f":
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        flat = np.frombuffer(block.tobytes(), np.uint8).reshape(rows, -1, samples)
        planes = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, size, columns * samples)
        return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}").reshape(rows, columns, samples).astype(f"<f{size}")
    raise ValueError(f"predictor {predictor} isn't supported for {block.dtype}")


def apply_predictor(block: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 1:
        return block
    if predictor == 3:
        rows, columns, samples = block.shape
        size = block.dtype.itemsize
        planes = np.ascontiguousarray(block.astype(block.dtype.newbyteorder(">"))).view(np.uint8).reshape(rows, columns * samples, size)
        flat = np.ascontiguousarray(planes.transpose(0, 2, 1)).reshape(rows, size * columns, samples)
        out = flat.copy()
        out[:, 1:] -= flat[:, :-1]
        return out
    out = block.copy()
    out[:, 1:] -= block[:, :-1]
    return out


# --- reader -----------------------------------------------------------------------------


@dataclass
class Page:
    index: int
    width: int = 0
    height: int = 0
    samples: int = 1
    bits: int = 8
    sample_format: int = 1
    compression: int = 1
    predictor: int = 1
    tiled: bool = False
    segments: int = 0
    pixels: bytes | None = None
    error: str | None = None


def _number(data: bytes, form: str, at: int) -> int:
    """A number at an offset; data need only have a length and slices (see sources.ranged)."""
    return struct.unpack(form, data[at : at + struct.calcsize(form)])[0]


def _frame(data: bytes) -> tuple[str, bool]:
    """Byte order, and whether the file is a big one."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(data[:2]))
    version = _number(data, f"{order}H", 2) if order and len(data) >= 8 else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    return order, version == 43


def _directory(data: bytes, at: int, order: str, big: bool) -> tuple[dict[int, tuple], int]:
    """Tags of the directory at an offset, and where its link to the next one is."""
    count_at, entry_at, offset = ("Q", "HHQ8s", "Q") if big else ("H", "HHI4s", "I")
    start = at
    count = _number(data, order + count_at, at)
    at += struct.calcsize("<" + count_at)
    size = struct.calcsize("<" + entry_at)
    if at + count * size > len(data):
        raise ValueError("an image directory is cut off")
    tags: dict[int, tuple] = {0: (order,)}
    for tag, kind, n, inline in struct.iter_unpack(order + entry_at, data[at : at + count * size]):
        form = f"{n}s" if kind == UNDEFINED else f"{2 * n}{RATIONALS[kind]}" if kind in RATIONALS else f"{n}{TYPES[kind]}" if kind in TYPES else None
        if form is None:
            continue
        length = struct.calcsize("<" + form)
        if length <= len(inline):
            raw = inline[:length]
        else:
            where = struct.unpack(order + offset, inline)[0]
            raw = data[where : where + length]
        if len(raw) < length:
            if kind not in TYPES:  # no such tag is needed to read pixels
                continue
            raise ValueError(f"tag {tag} is cut off")
        values = struct.unpack(order + form, raw)
        tags[tag] = tuple(zip(values[::2], values[1::2], strict=True)) if kind in RATIONALS else values
    tags[-1] = (start,)
    return tags, at + count * size


def directories(data: bytes) -> Iterator[dict[int, tuple]]:
    """Tags of each image directory in the order of the chain; a chain that turns back ends.

    Besides the tags, 0 has the byte order and -1 the directory's offset.  A rational is a pair,
    undefined content one value of bytes.
    """
    order, big = _frame(data)
    offset = "Q" if big else "I"
    at = _number(data, order + offset, 8 if big else 4)
    seen: set[int] = set()
    while at and at not in seen:
        seen.add(at)
        tags, link = _directory(data, at, order, big)
        yield tags
        at = _number(data, order + offset, link)


def sub_directory(data: bytes, tags: dict[int, tuple], tag: int) -> dict[int, tuple]:
    """Tags of the directory that a tag points to; none if there is no such tag or the directory is damaged."""
    if not tags.get(tag) or not isinstance(tags[tag][0], int):
        return {}
    try:
        return _directory(data, tags[tag][0], *_frame(data))[0]
    except DAMAGE:
        return {}


def read_page(data: bytes, tags: dict[int, tuple], index: int) -> Page:
    one = lambda tag, default: (tags.get(tag) or (default,))[0]
    order, bits = tags[0][0], tags.get(BITS) or (1,)
    page = Page(index, one(WIDTH, 0), one(HEIGHT, 0), one(SAMPLES, 1), bits[0], one(SAMPLE_FORMAT, 1), one(COMPRESSION, 1), one(PREDICTOR, 1), TILE_OFFSETS in tags)
    kind = {1: "u", 2: "i", 3: "f"}.get(page.sample_format)
    if page.samples < 1:
        raise ValueError("a page without samples")
    if page.bits == 1 and page.samples == 1:
        return _bit_page(data, tags, page)
    if len(set(bits)) > 1 or page.bits not in (8, 16, 32, 64) or kind is None or kind == "f" and page.bits == 8:
        raise ValueError(f"samples of {bits} bits and format {page.sample_format} aren't supported")
    stored = np.dtype(f"{order}{kind}{page.bits // 8}")
    if page.tiled:
        w, h, at, sizes = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        w, h, at, sizes = page.width, min(one(ROWS_PER_STRIP, page.height), page.height), tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_COUNTS, ())
    page.segments = len(at)
    planes = page.samples if one(PLANAR, 1) == 2 else 1
    deep = page.samples // planes
    if page.width * page.height and not w * h:
        raise ValueError("strips or tiles without area")
    across, down = (-(-page.width // w), -(-page.height // h)) if w and h else (0, 0)
    if len(at) < across * down * planes or len(sizes) < len(at):
        raise ValueError("strips or tiles are missing")
    if not page.tiled and planes == deep == 1 and page.predictor == 1 and stored == np.uint8:  # strips are whole rows
        page.pixels = b"".join(decode_segment(data[at[r] : at[r] + sizes[r]], page.compression, w * min(h, page.height - r * h)) for r in range(down))
        return page
    image = np.zeros((page.height, page.width, page.samples), stored.newbyteorder("<"))
    for n in range(across * down * planes):
        plane, rest = divmod(n, across * down)
        r, c = divmod(rest, across)
        rows = h if page.tiled else min(h, page.height - r * h)
        plain = decode_segment(data[at[n] : at[n] + sizes[n]], page.compression, rows * w * deep * stored.itemsize)
        block = undo_predictor(np.frombuffer(plain, stored).reshape(rows, w, deep), page.predictor, order)
        target = image[r * h : r * h + rows, c * w : c * w + w, plane * deep : (plane + 1) * deep]
        target[:] = block[: target.shape[0], : target.shape[1]]
    page.pixels = image.tobytes()
    return page


def _bit_page(data: bytes, tags: dict[int, tuple], page: Page) -> Page:
    """A page of one bit a pixel, as masks are, as bytes of 0 and 1; rows of a strip or tile begin at a byte."""
    one = lambda tag, default: (tags.get(tag) or (default,))[0]
    if page.tiled:
        w, h, at, sizes = one(TILE_WIDTH, 0), one(TILE_HEIGHT, 0), tags[TILE_OFFSETS], tags[TILE_COUNTS]
    else:
        w, h, at, sizes = page.width, min(one(ROWS_PER_STRIP, page.height), page.height), tags[STRIP_OFFSETS], tags[STRIP_COUNTS]
    across, down = -(-page.width // w), -(-page.height // h)
    page.segments, wide = len(at), -(-w // 8)
    image = np.zeros((down * h, across * w), np.uint8)
    for n in range(across * down):
        r, c = divmod(n, across)
        rows = h if page.tiled else min(h, page.height - r * h)
        plain = decode_segment(data[at[n] : at[n] + sizes[n]], page.compression, rows * wide)
        image[r * h : r * h + rows, c * w : c * w + w] = np.unpackbits(np.frombuffer(plain, np.uint8).reshape(rows, wide), axis=1)[:, :w]
    page.pixels, page.bits = np.ascontiguousarray(image[: page.height, : page.width]).tobytes(), 8
    return page


def page_image(page: Page) -> np.ndarray:
    """A page's samples: rows x columns x samples."""
    kind = {1: "u", 2: "i", 3: "f"}[page.sample_format]
    return np.frombuffer(page.pixels, f"<{kind}{page.bits // 8}").reshape(page.height, page.width, page.samples)


def is_mask(tags: dict[int, tuple]) -> bool:
    return bool((tags.get(254) or (0,))[0] & 4)


def alpha_band(tags: dict[int, tuple]) -> int | None:
    """The place, from 0, of the sample that the extra samples call alpha."""
    samples, extra = (tags.get(SAMPLES) or (1,))[0], tags.get(EXTRA_SAMPLES) or ()
    found = [samples - len(extra) + i for i, kind in enumerate(extra) if kind in (1, 2)]
    return found[0] if found and 0 <= found[0] < samples else None


def read_pages(data: bytes) -> Iterator[Page]:
    """Pages of a file; a damaged page has an error instead of pixels, a damaged chain ends with such a page."""
    index = 0
    try:
        for index, tags in enumerate(directories(data)):  # noqa: B020
            try:
                yield read_page(data, tags, index)
            except DAMAGE as e:
                yield Page(index, error=str(e) or type(e).__name__)
            index += 1
    except DAMAGE as e:
        yield Page(index, error=str(e) or type(e).__name__)


# --- writer -----------------------------------------------------------------------------


LEVELS = {DEFLATE: 6, OLD_DEFLATE: 6, ZSTD: 9}  # where none is asked for


@dataclass
class Layout:
    compression: int = DEFLATE
    predictor: int = 1
    tile: tuple[int, int] | None = None  # width, height; else strips
    strip_rows: int = 256
    order: str = "<"
    level: int | None = None  # of deflate and zstandard; None: LEVELS
    extra: dict[int, tuple[str, tuple]] = field(default_factory=dict)  # tag -> (kind, values), kinds as in struct: H, I, d, s


def encode_segment(block: np.ndarray, layout: Layout) -> bytes:
    stored = apply_predictor(block, layout.predictor)
    stored = stored.astype(stored.dtype.newbyteorder(layout.order))
    if layout.compression == PACKBITS:
        return packbits_encode(np.frombuffer(stored.tobytes(), np.uint8).reshape(len(stored), -1))
    plain, level = stored.tobytes(), LEVELS.get(layout.compression) if layout.level is None else layout.level
    if layout.compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(plain, level)
    if layout.compression == ZSTD:
        return zstandard.ZstdCompressor(level=level).compress(plain)
    return {NONE: bytes, LZW: lzw_encode}[layout.compression](plain)


def write_tiff(pages: list[tuple[np.ndarray, Layout]]) -> bytes:
    """A classic file of pages (rows x columns [x samples] of unsigned or signed integers or floats)."""
    order = pages[0][1].order if pages else "<"
    out = bytearray(struct.pack(f"{order}2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for image, layout in pages:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        if layout.tile:
            w, h = layout.tile
            padded = np.pad(image, ((0, -height % h), (0, -width % w), (0, 0)))
            blocks = [padded[r : r + h, c : c + w] for r in range(0, height, h) for c in range(0, width, w)]
        else:
            blocks = [image[r : r + layout.strip_rows] for r in range(0, height, layout.strip_rows)]
        offsets, counts = [], []
        for block in blocks:
            part = encode_segment(block, layout)
            offsets.append(len(out))
            counts.append(len(part))
            out += part
        bits = image.dtype.itemsize * 8
        tags = {
            WIDTH: ("I", (width,)), HEIGHT: ("I", (height,)), BITS: ("H", (bits,) * samples), COMPRESSION: ("H", (layout.compression,)), PHOTOMETRIC: ("H", (1,)),
            SAMPLES: ("H", (samples,)), PLANAR: ("H", (1,)), PREDICTOR: ("H", (layout.predictor,)), SAMPLE_FORMAT: ("H", ({"u": 1, "i": 2, "f": 3}[image.dtype.kind],) * samples),
        }
        if layout.tile:
            tags |= {TILE_WIDTH: ("I", (w,)), TILE_HEIGHT: ("I", (h,)), TILE_OFFSETS: ("I", tuple(offsets)), TILE_COUNTS: ("I", tuple(counts))}
        else:
            tags |= {ROWS_PER_STRIP: ("I", (layout.strip_rows,)), STRIP_OFFSETS: ("I", tuple(offsets)), STRIP_COUNTS: ("I", tuple(counts))}
        tags |= layout.extra
        entries, kinds = [], {"H": 3, "I": 4, "d": 12, "s": 2}
        for tag, (kind, values) in sorted(tags.items()):
            raw = bytes(values) if kind == "s" else struct.pack(f"{order}{len(values)}{kind}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, where = struct.pack(f"{order}I", len(out)), raw
                out += where
            entries.append(struct.pack(f"{order}HHI4s", tag, kinds[kind], len(values), raw))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)
