"""Media columns: animated GIF. Encoding of 8-bit samples, decoding of LZW code streams, and rendering of timed frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lacewing.llm.common import replace_columns

#: Samples in a row, and rows of a frame at most, of stored payloads; hundredths of a second that each is shown.
WIDTH, ROWS, DELAY = 192, 256, 4
#: The stored files' palette, 256 greys.
GREYS = bytes(i for i in range(256) for _ in range(3))
#: Bins of a colour histogram for each of red, green and blue.
BINS = 8
#: Canvases and images of more pixels are reported as an error and not rendered.
MOST_PIXELS = 1 << 25

_FRAME = [T.StructField(c, T.IntegerType()) for c in ("delay", "left", "top", "width", "height")] + [T.StructField("histogram", T.ArrayType(T.LongType()))]

#: Layout of a decoded file; a frame's histogram counts the pixels of its rendered canvas, red bins first, then green, then blue.
DECODED = T.StructType([
    T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("n_frames", T.IntegerType()),
    T.StructField("frames", T.ArrayType(T.StructType(_FRAME))), T.StructField("samples", T.BinaryType()), T.StructField("error", T.StringType()),
])


def lzw_encode(data: bytes) -> bytes:
    """GIF's LZW code stream of 8-bit samples: codes of 9 to 12 bits, lowest bit first, the table cleared when it is full.

    Codes are kept shifted by the width of a sample, so that a code and the sample after it make the table's key by a single or.
    """
    codes, clears, step, begin, full = [256 << 8], [0], 1 << 8, 258 << 8, 4096 << 8
    if data:
        table: dict[int, int] = {}
        put, append, following, prefix = table.setdefault, codes.append, begin, data[0] << 8
        for byte in memoryview(data)[1:]:
            code = put(prefix | byte, following)
            if code != following:
                prefix = code
                continue
            append(prefix)
            prefix = byte << 8
            if following < full:
                following += step
            else:
                clears.append(len(codes))
                append(256 << 8)
                table = {}
                put, following = table.setdefault, begin
        append(prefix)
    codes.append(257 << 8)
    return _pack(np.array(codes, np.uint32) >> np.uint32(8), clears)


@cache
def _layout(least: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits of each code after a clear code, and where it begins: with each code but the first the reader makes an entry, and codes widen, to
    12 bits at most, when all of a width are taken. As many codes as any sensible file has between clear codes; more are rare and go on with 12."""
    entries = (1 << least) + 2 + np.maximum(np.arange(1 << 14) - 1, 0)
    widths = np.clip(np.ceil(np.log2(entries + 1)).astype(np.int64), least + 1, 12)
    return widths, np.concatenate(([0], np.cumsum(widths)))


def _begins(n: int, least: int) -> np.ndarray:
    """Where each of n codes after a clear code begins, and where the last one ends."""
    begins = _layout(least)[1]
    if n < len(begins):
        return begins[: n + 1]
    return np.concatenate((begins, begins[-1] + 12 * np.arange(1, n + 2 - len(begins))))


def _pack(codes: np.ndarray, clears: list[int]) -> bytes:
    starts, at = np.empty(len(codes) + 1, np.int64), 9
    starts[0] = 0
    for begin, end in zip(clears, [*clears[1:], len(codes) - 1], strict=True):
        starts[begin + 1 : end + 2] = at + _begins(end - begin, 8)
        at = starts[end + 1]
    starts, size = starts[:-1], int(starts[-1] + 7) // 8
    shifted, first = codes << (starts & 7).astype(np.uint32), starts >> 3
    out = np.zeros(size + 3)
    for k in range(3):  # two codes may share a byte but never a bit, so their sum is their union
        out += np.bincount(first + k, (shifted >> np.uint32(8 * k)) & np.uint32(255), size + 3)
    return out[:size].astype(np.uint8).tobytes()


def _codes(stream: np.ndarray, at: int, n: int, least: int) -> np.ndarray:
    """At most n codes after the clear code that ends at bit `at`."""
    begins = _begins(n, least)
    n = int(np.searchsorted(begins[1:], (len(stream) - 4) * 8 - at, side="right"))
    starts = at + begins[:n]
    first = starts >> 3
    word = stream[first] | stream[first + 1] << np.uint32(8) | stream[first + 2] << np.uint32(16)
    masks = (np.uint32(1) << np.diff(begins[: n + 1]).astype(np.uint32)) - np.uint32(1)
    return word >> (starts & 7).astype(np.uint32) & masks


@cache
def _singles(n: int) -> list[bytes]:
    return [bytes([i]) for i in range(n)]


def _expand(codes: list[int], clear: int) -> bytes:
    """Samples of the codes between two clear codes; codes from the first that the table can't have on are left out."""
    if not codes or codes[0] >= clear:
        return b""
    table = [*_singles(clear), b"", b""]
    last = table[codes[0]]
    parts, room = [last], 4096 - len(table)
    put, add = parts.append, table.append
    for code in codes[1 : 1 + room]:
        try:
            entry = table[code]
        except IndexError:
            if code > len(table):
                return b"".join(parts)
            entry = last + last[:1]
        add(last + entry[:1])
        put(entry)
        last = entry
    if len(codes) > 1 + room:  # a full table goes on to be used
        parts += [table[code] for code in codes[1 + room :]]
    return b"".join(parts)


def lzw_decode(data: bytes, least: int, most: int) -> bytes:
    """At most `most` samples of a code stream whose clear code is 1 << least.

    Codes between two clear codes have widths known beforehand, so they are cut out of the stream together. A stream that ends early gives
    what it has; a code beyond the table ends it.
    """
    clear = 1 << least
    stream = np.zeros(len(data) + 4, np.uint32)
    stream[: len(data)] = np.frombuffer(data, np.uint8)
    out, held, bit = [], 0, 0
    while held < most:
        asked, n = 4096, -1
        while n < 0:
            codes = _codes(stream, bit, asked, least)
            stop = np.flatnonzero((codes == clear) | (codes == clear + 1))
            n = int(stop[0]) if len(stop) else len(codes) if len(codes) < asked or asked > most else -1
            asked *= 2
        out.append(_expand(codes[:n].tolist(), clear))
        held += len(out[-1])
        if n == len(codes) or codes[n] != clear:
            break
        bit += int(_begins(n + 1, least)[n + 1])
    return b"".join(out)[:most]


def _blocks(data: bytes) -> Iterator[bytes]:
    for at in range(0, len(data), 255):
        part = data[at : at + 255]
        yield bytes([len(part)]) + part
    yield b"\0"


def gif_of(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay: int = DELAY) -> bytes:
    """A GIF whose frames' palette indices are the samples, on a palette of 256 greys; their number must be a positive multiple of width."""
    height = len(samples) // width
    parts = [b"GIF89a", struct.pack("<HHBBB", width, min(height, rows), 0xF7, 0, 0), GREYS]
    for top in range(0, height, rows):
        frame = samples[top * width : (top + rows) * width]
        parts += [b"!\xf9\x04", struct.pack("<BHBB", 1 << 2, delay, 0, 0), b",", struct.pack("<HHHHB", 0, 0, width, len(frame) // width, 0), b"\x08", *_blocks(lzw_encode(frame))]
    return b"".join([*parts, b";"])


@dataclass
class Frame:
    """A frame as rendered (height, width, 4: red, green, blue, opacity), its time in hundredths of a second, and its own rectangle."""

    canvas: np.ndarray
    delay: int
    box: tuple[int, int, int, int]


@dataclass
class _Control:
    disposal: int = 0
    delay: int = 0
    transparent: int = -1


@dataclass
class _Image:
    """An image as stored: canvas size, rectangle (left, top, width, height), palette indices and which of them are drawn, palette, control, and
    whether its code stream has samples for all of it."""

    size: tuple[int, int]
    box: tuple[int, int, int, int]
    indices: np.ndarray
    shown: np.ndarray
    palette: np.ndarray
    control: _Control
    whole: bool

    def covers(self) -> bool:
        """Whether nothing of an earlier canvas is seen through it."""
        return self.box == (0, 0, *self.size) and self.whole and self.control.transparent < 0


def _images(data: bytes) -> Iterator[_Image]:
    """Images of a GIF, in order. Raises ValueError with the reason where it is none, breaks off, or asks for what it may not."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError(f"canvas of {width} x {height} pixels")
    at, control = 13, _Control()

    def palette_at(packed: int, at: int) -> np.ndarray:
        size = 3 << (packed & 7) + 1
        if at + size > len(data):
            raise ValueError("breaks off within a palette")
        return np.frombuffer(data, np.uint8, size, at).reshape(-1, 3)

    def blocks(at: int) -> tuple[bytes, int]:
        parts = []
        while at < len(data) and data[at]:
            parts.append(data[at + 1 : at + 1 + data[at]])
            at += 1 + data[at]
        return b"".join(parts), at + 1

    common = np.zeros((256, 3), np.uint8)
    if flags & 0x80:
        common = palette_at(flags, at)
        at += common.size
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            body, at = blocks(at + 2)
            if label == 0xF9 and len(body) >= 4:
                packed, delay, transparent = struct.unpack_from("<BHB", body)
                control = _Control(packed >> 2 & 7, delay, transparent if packed & 1 else -1)
        elif data[at] == 0x2C:
            if at + 11 > len(data):
                raise ValueError("breaks off within an image")
            left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at + 1)
            if w * h > MOST_PIXELS:
                raise ValueError(f"image of {w} x {h} pixels")
            at, palette = at + 10, common
            if packed & 0x80:
                palette = palette_at(packed, at)
                at += palette.size
            least = data[at] if at < len(data) else 0
            if not 1 <= least <= 8:
                raise ValueError(f"code size {least}")
            stream, at = blocks(at + 1)
            found = np.frombuffer(lzw_decode(stream, least, w * h), np.uint8)
            indices, shown, whole = found, np.ones(w * h, bool), len(found) == w * h
            if not whole:
                indices = np.zeros(w * h, np.uint8)
                indices[: len(found)], shown[len(found) :] = found, False
            if packed & 0x40:  # rows in four passes
                back = np.argsort(np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))]))
                indices, shown = indices.reshape(h, w)[back], shown.reshape(h, w)[back]
            indices, shown = indices.reshape(h, w), shown.reshape(h, w)
            if control.transparent >= 0:
                shown = shown & (indices != control.transparent)
            yield _Image((width, height), (left, top, w, h), indices, shown, palette, control, whole)
            if not whole:
                raise ValueError("an image's codes break off")
            control = _Control()
        else:
            raise ValueError(f"unknown block {data[at]}")
    if at >= len(data):
        raise ValueError("breaks off before its end")


def _colours(image: _Image, indices: np.ndarray) -> np.ndarray:
    return image.palette[indices if len(image.palette) == 256 else np.minimum(indices, len(image.palette) - 1)]


class _Screen:
    """The canvas, on which images are drawn one after the other. One that covers it all is drawn only when a later one needs it."""

    def __init__(self, size: tuple[int, int]):
        self.canvas, self.covering = np.zeros((size[1], size[0], 4), np.uint8), None

    def place(self, image: _Image) -> tuple[slice, slice]:
        (width, height), (left, top, w, h) = image.size, image.box
        return slice(top, max(top, min(top + h, height))), slice(left, max(left, min(left + w, width)))

    def draw(self, image: _Image) -> np.ndarray:
        """The canvas with the image on it."""
        if self.covering is not None:
            covering, self.covering = self.covering, None
            self._put(covering)
        before = self.canvas.copy() if image.control.disposal == 3 else None
        self._put(image)
        shown = self.canvas.copy()
        if image.control.disposal == 2:
            self.canvas[self.place(image)] = 0
        elif image.control.disposal == 3:
            self.canvas = before
        return shown

    def _put(self, image: _Image) -> None:
        box = self.place(image)
        part, inner = self.canvas[box], (slice(0, box[0].stop - box[0].start), slice(0, box[1].stop - box[1].start))
        colours, visible = _colours(image, image.indices[inner]), image.shown[inner]
        part[visible, :3], part[visible, 3] = colours[visible], 255


def frames_of(data: bytes) -> Iterator[Frame]:
    """Rendered frames of a GIF, in order.

    Each image's indices go through its own palette or else the common one; transparent ones leave the canvas as it is. After a frame is
    shown, its rectangle stays (disposal 0, 1), is cleared (2), or is put back as it was before it (3). Raises ValueError, after the frames that can be
    rendered, for what is no GIF or breaks off, for code sizes other than 1 to 8, and for more than MOST_PIXELS.
    """
    screen = None
    for image in _images(data):
        screen = screen or _Screen(image.size)
        yield Frame(screen.draw(image), image.control.delay, image.box)


def _histogram(values: list[np.ndarray], weights: np.ndarray | None = None) -> list[int]:
    """Counts of red, green and blue values by BINS."""
    return np.concatenate([np.bincount(v.ravel() // (256 // BINS), weights, BINS) for v in values]).astype(np.int64).tolist()


def decode_gif(data: bytes | None) -> dict:
    """One row of DECODED. samples: the red channel of each frame's own rectangle as rendered, frame after frame.

    Null gives nulls. Bytes that are no GIF, or a broken one, give the reason in error, besides the frames that were found before; an error is
    null only for a file that is whole.
    """
    if data is None:
        return dict.fromkeys(DECODED.names)
    frames, samples, error, size, screen = [], [], None, (None, None), None
    try:
        for image in _images(data):
            size = image.size
            screen = screen or _Screen(size)
            left, top, w, h = image.box
            if image.covers() and image.control.disposal < 2:
                screen.covering = image  # its colours follow from its indices, whatever was there before
                palette = _colours(image, np.arange(256))
                histogram = _histogram(list(palette.T), np.bincount(image.indices.ravel(), minlength=256))
                samples.append(palette[:, 0][image.indices].tobytes())
            else:
                canvas = screen.draw(image)
                histogram = _histogram([canvas[:, :, c] for c in range(3)])
                samples.append(canvas[screen.place(image)][..., 0].tobytes())
            frames.append((image.control.delay, left, top, w, h, histogram))
    except ValueError as e:
        error = str(e)
    return {"width": size[0], "height": size[1], "n_frames": len(frames), "frames": frames, "samples": b"".join(samples), "error": error}


def decoded(rows: list[dict]) -> pa.Array:
    """Rows of decode_gif() as an Arrow array of DECODED, column by column, frames of all files together."""
    columns = {name: [row[name] for row in rows] for name in DECODED.names}
    frames = list(zip(*chain.from_iterable(x or () for x in columns["frames"]), strict=True)) or [()] * len(_FRAME)
    inner = [pa.array(x, pa.int32()) for x in frames[:-1]] + [pa.array(frames[-1], pa.list_(pa.int64()))]
    ends = np.concatenate(([0], np.cumsum([len(x or ()) for x in columns["frames"]]))).astype(np.int32)
    missing = np.array([x is None for x in columns["frames"]], bool)
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32(), mask=np.append(missing, False)), pa.StructArray.from_arrays(inner, [f.name for f in _FRAME]))
    kinds = {"samples": pa.binary(), "error": pa.string()}
    arrays = [lists if name == "frames" else pa.array(x, kinds.get(name, pa.int32())) for name, x in columns.items()]
    return pa.StructArray.from_arrays(arrays, DECODED.names)


def store_gif(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Add a binary column of GIF files that hold the payloads (multiples of WIDTH bytes, not empty). Null gives null; an existing column of
    the name is replaced; repeated rows and an empty table pass through. No shuffle."""

    @F.arrow_udf("binary")
    def encode(payloads: pa.Array) -> pa.Array:
        return pa.array([gif_of(p.as_py()) if p.is_valid else None for p in payloads], pa.binary())

    # the optimizer would put the call wherever its column is read, and run it each time, if it weren't said to differ
    return replace_columns(df, media).withColumn(media, encode.asNondeterministic()(payload))


def read_gif(df: DataFrame, media: str = "media", out: str = "gif") -> DataFrame:
    """Add a struct column DECODED read from GIF files: size, timed frames with their histograms, samples, error. Null gives nulls within; files that
    can't be read give an error; an existing column of the name is replaced; repeated rows and an empty table pass through. No shuffle."""

    @F.arrow_udf(DECODED)
    def decode(files: pa.Array) -> pa.Array:
        return decoded([decode_gif(f.as_py()) for f in files])

    return replace_columns(df, out).withColumn(out, decode(media))


def read_frames(df: DataFrame, id_col: str, media: str = "media") -> DataFrame:
    """One row for each frame as it is shown: id_col, frame (from 0), delay (hundredths of a second), width, height, rgba (rows from the top,
    opacity last), histogram. Files that can't be read, and null ones, give the frames found before the fault, or none; frames are made one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, file in enumerate(batch.column(1)):
                try:
                    for n, frame in enumerate(frames_of(file.as_py() or b"")):
                        height, width, _ = frame.canvas.shape
                        row = [n, frame.delay, width, height], frame.canvas.tobytes(), _histogram([frame.canvas[:, :, c] for c in range(3)])
                        arrays = [*(pa.array([x], pa.int32()) for x in row[0]), pa.array([row[1]], pa.binary()), pa.array([row[2]], pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), *arrays], names=[id_col, *_SHOWN])
                except ValueError:
                    continue

    kinds = [T.IntegerType()] * 4 + [T.BinaryType(), T.ArrayType(T.LongType())]
    schema = T.StructType([df.schema[id_col], *[T.StructField(c, kind) for c, kind in zip(_SHOWN, kinds, strict=True)]])
    return df.select(id_col, media).mapInArrow(run, schema)


_SHOWN = ("frame", "delay", "width", "height", "rgba", "histogram")


def payloads(df: DataFrame, text_col: str = "text", payload: str = "payload") -> DataFrame:
    """Add the UTF-8 bytes of a text, filled up with blanks to a positive multiple of WIDTH. Null and empty texts give WIDTH blanks; an existing
    column of the name is replaced; repeated rows and an empty table pass through."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    length = F.octet_length(text)
    fill = F.greatest(F.lit(1), F.ceil(length / WIDTH)).cast("int") * WIDTH - length
    return replace_columns(df, payload).withColumn(payload, F.concat(text, F.repeat(F.lit(" "), fill)).cast("binary"))
