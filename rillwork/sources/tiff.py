"""GeoTIFF bytes: directories of a file, its tiles or strips as arrays, and a tiled file with overviews from an array.

Read: classic and big files of either byte order, tiles or strips, one band of several, uncompressed, deflate or LZW, with no predictor, differences or floating point planes. Other compressions are refused.
Written: one band, tiles in deflate with the predictor of its type, directories first, then the tiles of the smallest overview to those of the full image, as cloud readers expect.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np

# TIFF 6.0, BigTIFF and GeoTIFF 1.1.
(REDUCED, WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, STRIP_ROWS, STRIP_SIZES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILES, TILE_SIZES, FORMAT) = (
    254, 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 323, 324, 325, 339,
)
PIXEL_SCALE, TIE_POINT, MATRIX, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34264, 34735, 42112, 42113
KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "s", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 13: "I", 16: "Q", 17: "q", 18: "Q"}
MODEL, RASTER, GEOGRAPHIC, PROJECTED = 1024, 1025, 2048, 3072
PLAIN, LZW, DEFLATE, OLD_DEFLATE = 1, 5, 8, 32946


@dataclass(frozen=True)
class Image:
    """One directory: the full image or an overview. A strip counts as a tile of the image's width. places: (offset, size) by number of tile, a size of 0 for a tile that is all nodata."""

    width: int
    height: int
    tile_width: int
    tile_height: int
    dtype: str
    samples: int
    planar: bool
    compression: int
    predictor: int
    tiled: bool
    places: dict[int, tuple[int, int]] = field(default_factory=dict)

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)

    def only(self, tiles: list[int]) -> Image:
        return replace(self, places={k: self.places[k] for k in tiles if k in self.places})


@dataclass(frozen=True)
class Header:
    """images: the full one and its overviews, ever smaller. transform: x = t[2] + t[0] col + t[1] row, y = t[5] + t[3] col + t[4] row, of cells' corners."""

    images: list[Image]
    transform: tuple[float, ...]
    epsg: int | None
    nodata: float | None

    def level_transform(self, level: int) -> tuple[float, ...]:
        full, image, t = self.images[0], self.images[level], self.transform
        sx, sy = full.width / image.width, full.height / image.height
        return t[0] * sx, t[1] * sy, t[2], t[3] * sx, t[4] * sy, t[5]


def read_header(read_at: Callable[[int, int], bytes]) -> Header:
    """read_at(offset, size) gives bytes of the file."""
    start = read_at(0, 16)
    order = {b"II": "<", b"MM": ">"}.get(start[:2])
    version = struct.unpack(f"{order}H", start[2:4])[0] if order else 0
    if version not in (42, 43):
        raise ValueError("not a TIFF file")
    big = version == 43
    at = struct.unpack(f"{order}Q", start[8:16])[0] if big else struct.unpack(f"{order}I", start[4:8])[0]
    found, seen = [], set()
    while at and at not in seen:
        seen.add(at)
        tags, at = _directory(read_at, order, at, big)
        found.append(tags)
    if not found:
        raise ValueError("a TIFF file without an image")
    images = [_image(t, order) for t in found if not t.get(REDUCED, (0,))[0] & 4]
    first, tags = images[0], found[0]
    smaller = sorted((i for i in images[1:] if i.width <= first.width and i.height <= first.height and i.dtype == first.dtype), key=lambda i: -i.width)
    return Header([first, *smaller], _transform(tags), _epsg(tags), _nodata(tags))


def _directory(read_at: Callable[[int, int], bytes], order: str, at: int, big: bool) -> tuple[dict, int]:
    head, entry, word = (8, 20, "Q") if big else (2, 12, "I")
    n = struct.unpack(f"{order}{'Q' if big else 'H'}", read_at(at, head))[0]
    if n > 4096:
        raise ValueError("a TIFF directory with too many entries")
    body = read_at(at + head, n * entry + (8 if big else 4))
    tags: dict = {}
    for k in range(n):
        tag, kind = struct.unpack_from(f"{order}HH", body, k * entry)
        count = struct.unpack_from(f"{order}{word}", body, k * entry + 4)[0]
        code = KINDS.get(kind)
        if code is None:
            continue
        size = count * struct.calcsize("=" + code)
        inside = entry - 4 - struct.calcsize("=" + word)
        where = k * entry + 4 + struct.calcsize("=" + word)
        raw = body[where : where + size] if size <= inside else read_at(struct.unpack_from(f"{order}{word}", body, where)[0], size)
        tags[tag] = raw if code == "s" else struct.unpack(f"{order}{count * len(code)}{code[0]}", raw)
    return tags, struct.unpack(f"{order}{word}", body[n * entry :])[0]


def _image(tags: dict, order: str) -> Image:
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    bits, kind = one(BITS, 1), one(FORMAT, 1)
    if bits not in (8, 16, 32, 64) or kind not in (1, 2, 3):
        raise ValueError(f"{bits} bits of sample format {kind} are not read")
    compression = one(COMPRESSION, PLAIN)
    if compression not in (PLAIN, LZW, DEFLATE, OLD_DEFLATE):
        raise ValueError(f"TIFF compression {compression} is not read")
    tiled = TILES in tags
    width, height = one(WIDTH), one(HEIGHT)
    places = zip(tags[TILES if tiled else STRIPS], tags[TILE_SIZES if tiled else STRIP_SIZES], strict=True)
    return Image(
        width, height, one(TILE_WIDTH) if tiled else width, one(TILE_HEIGHT) if tiled else min(height, one(STRIP_ROWS, height)), f"{order}{'uif'[kind - 1]}{bits // 8}",
        one(SAMPLES, 1), one(PLANAR, 1) == 2, compression, one(PREDICTOR, 1), tiled, dict(enumerate(places)),
    )


def _transform(tags: dict) -> tuple[float, ...]:
    half = _geo_keys(tags).get(RASTER) == 2  # the tie point is a cell's centre
    if MATRIX in tags:
        m = tags[MATRIX]
        t = (m[0], m[1], m[3], m[4], m[5], m[7])
    elif PIXEL_SCALE in tags and TIE_POINT in tags:
        (sx, sy), (col, row, _, x, y) = tags[PIXEL_SCALE][:2], tags[TIE_POINT][:5]
        t = (sx, 0.0, x - col * sx, 0.0, -sy, y + row * sy)
    else:
        t = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    return (t[0], t[1], t[2] - (t[0] + t[1]) / 2, t[3], t[4], t[5] - (t[3] + t[4]) / 2) if half else t


def _geo_keys(tags: dict) -> dict[int, int]:
    keys = tags.get(GEO_KEYS, ())
    return {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4) if keys[k + 1] == 0}


def _epsg(tags: dict) -> int | None:
    keys = _geo_keys(tags)
    code = keys.get(PROJECTED, keys.get(GEOGRAPHIC))
    return code if code not in (None, 0, 32767) else None


def _nodata(tags: dict) -> float | None:
    try:
        return float(tags[NODATA].split(b"\0")[0]) if NODATA in tags else None
    except ValueError:
        return None


def unpacked_lzw(data: bytes) -> bytes:
    """TIFF's LZW: codes of 9 to 12 bits from the highest bit on, which widen one code early."""
    out, table, width, bits, held = bytearray(), [], 9, 0, 0
    last = None
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == 257:
            break
        if code == 256:
            table, width, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, None
            continue
        if last is None:
            piece = table[code]
        else:
            piece = table[code] if code < len(table) else last + last[:1]
            table.append(last + piece[:1])
            width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
        out += piece
        last = piece
    return bytes(out)


def tile_array(image: Image, number: int, data: bytes, band: int = 0) -> np.ndarray:
    """The cells of one tile or strip, cut to the image, as the file's type."""
    r0, c0 = image.tile_height * (number // image.across), image.tile_width * (number % image.across)
    rows, cols = image.tile_height, image.tile_width
    if not image.tiled:
        rows = min(rows, image.height - r0)
    samples = 1 if image.planar else image.samples
    if image.compression == LZW:
        data = unpacked_lzw(data)
    elif image.compression != PLAIN:
        data = zlib.decompress(data)
    dtype = np.dtype(image.dtype)
    need = rows * cols * samples * dtype.itemsize
    if len(data) < need:
        raise ValueError("a TIFF tile is cut short")
    if image.predictor == 3:
        # differences of bytes along a row, whose most significant bytes come first, for all cells
        planes = np.cumsum(np.frombuffer(data[:need], np.uint8).reshape(rows, cols * samples * dtype.itemsize), 1, dtype=np.uint8)
        a = np.ascontiguousarray(planes.reshape(rows, dtype.itemsize, cols * samples).transpose(0, 2, 1)).view(dtype.newbyteorder(">"))
        a = a.reshape(rows, cols, samples)
    else:
        a = np.frombuffer(data[:need], dtype).reshape(rows, cols, samples)
        if image.predictor == 2:
            a = np.cumsum(a.astype(dtype.newbyteorder("=")), 1, dtype=dtype.newbyteorder("="))
    return a[: image.height - r0, : image.width - c0, 0 if image.planar else band].astype(dtype.newbyteorder("="))


# --- writing


def halved(a: np.ndarray, average: bool) -> np.ndarray:
    """Each 2 by 2 cells: the mean of those that aren't NaN, or the upper left one."""
    if not average:
        return a[::2, ::2]
    p = np.pad(a, ((0, a.shape[0] % 2), (0, a.shape[1] % 2)), constant_values=np.nan)
    four = np.stack([p[i::2, j::2] for i in (0, 1) for j in (0, 1)])
    n = np.isfinite(four).sum(0)
    return np.where(n, np.nansum(four, 0) / np.maximum(n, 1), np.nan)


def _packed_tile(a: np.ndarray, side: int, fill: float) -> bytes:
    tile = np.full((side, side), fill, a.dtype)
    tile[: a.shape[0], : a.shape[1]] = a
    if a.dtype.kind == "f":
        planes = np.ascontiguousarray(tile.astype(a.dtype.newbyteorder(">")).view(np.uint8).reshape(side, side, a.dtype.itemsize).transpose(0, 2, 1)).reshape(side, -1)
        return zlib.compress(np.diff(planes, axis=1, prepend=np.uint8(0)).tobytes(), 6)
    return zlib.compress(np.diff(tile, axis=1, prepend=a.dtype.type(0)).astype(a.dtype.newbyteorder("<")).tobytes(), 6)


def statistics(a: np.ndarray) -> dict:
    """Of the cells that aren't NaN: nulls if there are none."""
    v = a[np.isfinite(a)]
    if not len(v):
        return {"min": None, "max": None, "mean": None, "p2": None, "p98": None, "valid": 0, "nodata": int(a.size)}
    p2, p98 = np.percentile(v, [2, 98])
    return {"min": float(v.min()), "max": float(v.max()), "mean": float(v.mean()), "p2": float(p2), "p98": float(p98), "valid": int(len(v)), "nodata": int(a.size - len(v))}


def encoded(values: np.ndarray, transform: tuple[float, ...], epsg: int, dtype: str, nodata: float, average: bool = True, side: int = 512, product: str = "") -> tuple[bytes, dict]:
    """(file, statistics) of an array with NaN for nodata. Overviews halve until one tile holds the image, each from the one before; the same array gives the same bytes."""
    kind = np.dtype(dtype)
    levels = [np.where(np.isfinite(values), values, np.nan)]
    while max(levels[-1].shape) > side:
        levels.append(halved(levels[-1], average))
    stored = []
    for a in levels:
        filled = np.where(np.isfinite(a), a, nodata)
        if kind.kind in "ui":
            filled = np.clip(np.rint(filled), np.iinfo(kind).min, np.iinfo(kind).max)
        stored.append(filled.astype(kind))
    written = np.where(stored[0] == kind.type(nodata), np.nan, stored[0].astype(float))
    stats = statistics(written) | {"overviews": len(levels) - 1}
    tiles = [[_packed_tile(a[r : r + side, c : c + side], side, nodata) for r in range(0, a.shape[0], side) for c in range(0, a.shape[1], side)] for a in stored]
    geographic = 4000 <= epsg < 5000
    keys = (1, 1, 0, 3, MODEL, 0, 1, 2 if geographic else 1, RASTER, 0, 1, 1, GEOGRAPHIC if geographic else PROJECTED, 0, 1, epsg)
    t = transform
    about = "".join(f'<Item name="STATISTICS_{k}" sample="0">{v!r}</Item>' for k, v in (("MINIMUM", stats["min"]), ("MAXIMUM", stats["max"]), ("MEAN", stats["mean"])) if v is not None)
    meta = f'<GDALMetadata><Item name="product">{product}</Item>{about}</GDALMetadata>\0'.encode()
    place = [(PIXEL_SCALE, 12, (t[0], -t[4], 0.0)), (TIE_POINT, 12, (0.0, 0.0, 0.0, t[2], t[5], 0.0))] if not t[1] and not t[3] and t[0] > 0 > t[4] else [(MATRIX, 12, (t[0], t[1], 0.0, t[2], t[3], t[4], 0.0, t[5], *[0.0] * 7, 1.0))]
    geo = [*place, (GEO_KEYS, 3, keys), (METADATA, 2, meta), (NODATA, 2, f"{nodata:g}\0".encode())]
    plans = []
    for k, (a, made) in enumerate(zip(stored, tiles, strict=True)):
        entries = [(REDUCED, 4, (1 if k else 0,)), (WIDTH, 4, (a.shape[1],)), (HEIGHT, 4, (a.shape[0],)), (BITS, 3, (8 * kind.itemsize,)), (COMPRESSION, 3, (DEFLATE,)), (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (1,)),
            (PREDICTOR, 3, (3 if kind.kind == "f" else 2,)), (TILE_WIDTH, 4, (side,)), (TILE_HEIGHT, 4, (side,)), (TILES, 4, (0,) * len(made)), (TILE_SIZES, 4, tuple(map(len, made))), (FORMAT, 3, ({"u": 1, "i": 2, "f": 3}[kind.kind],))]
        plans.append(entries + (geo if not k else [(NODATA, 2, f"{nodata:g}\0".encode())]))
    room = lambda e: 2 + 12 * len(e) + 4 + sum((n + n % 2) for _, f, v in e if (n := len(v) * struct.calcsize("=" + KINDS[f])) > 4)
    at, starts = 8, []
    for e in plans:
        starts.append(at)
        at += room(e)
    offsets: list = [None] * len(plans)
    for k in reversed(range(len(plans))):
        offsets[k] = tuple(at + o for o in np.cumsum([0, *map(len, tiles[k])])[:-1].tolist())
        at += sum(map(len, tiles[k]))
    if at >= 1 << 32:
        raise ValueError("a file of 4 GiB or more; cut the grid into smaller files")
    out = bytearray(struct.pack("<2sHI", b"II", 42, 8))
    for k, e in enumerate(plans):
        e = [(tag, f, offsets[k] if tag == TILES else v) for tag, f, v in e]
        table, extra, free = struct.pack("<H", len(e)), b"", starts[k] + 2 + 12 * len(e) + 4
        for tag, f, v in e:
            raw = v if f == 2 else struct.pack(f"<{len(v)}{KINDS[f]}", *v)
            if len(raw) <= 4:
                table += struct.pack("<HHI4s", tag, f, len(v), raw)
            else:
                table += struct.pack("<HHII", tag, f, len(v), free + len(extra))
                extra += raw + b"\0" * (len(raw) % 2)
        out += table + struct.pack("<I", starts[k + 1] if k + 1 < len(plans) else 0) + extra
    for k in reversed(range(len(plans))):
        out += b"".join(tiles[k])
    return bytes(out), stats
