"""GIF as a media column: an LZW code stream decoder and writer, palettes, disposal, transparency and timed frames.

`encode_payload` stores bytes losslessly as 8-bit samples of an animated GIF, 64 samples a row, through a palette whose
entry i has the first three bits of i as its red, the next three as its green and the last two as its blue, so each of the
64 bins of a colour histogram counts four byte values, and what a frame shows tells its samples. `decode` reads any GIF87a or GIF89a: it follows sub-blocks, decodes LZW streams
of 2 to 8 bits with clear codes at any place (or a full table that is kept on), undoes interlacing, applies the local or
global palette, transparency and the disposal of the frame before, and gives each frame as the canvas to show, with its
delay. `frame_table` turns a column of GIFs into one row for each frame with colour-histogram columns; `op2_gif` stores the
frames of each document beside its digests, and returns the digests.

Defined results: a null text is an empty one. A payload is padded with zeros to a positive multiple of 64 bytes. Null and
repeated doc_ids are kept as they are; equal texts give equal bytes and features. Broken or null media give no frames
in `frame_table` but one row with `error` set, and so do media whose canvas has more than `MOST_PIXELS`, or whose frames
have more than `MOST_DRAWN` in all, before any is drawn; codes beyond a frame's last sample are not read. A very long text
makes more frames of the same size. An empty table gives no rows. Columns besides the ones named are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, record_batch, small_batches

WIDTH, UNIT = 64, 64
#: Rows of a frame that `encode_payload` writes.
FRAME_ROWS = 512
#: Rules for what follows a frame: leave it, restore the background, restore what was there before.
KEEP, BACKGROUND, PREVIOUS = 1, 2, 3
_CHANNEL_BINS = 4
_FULL = 4096
#: Pixels of a canvas, and of all frames of a GIF together, that are drawn at most.
MOST_PIXELS, MOST_DRAWN = 1 << 24, 1 << 31


# --- LZW ----------------------------------------------------------------------------------------------------------


def _schedule(bits: int, n: int) -> np.ndarray:
    """The width of each of the `n` codes that follow a clear code, as a decoder knows them."""
    held = (1 << bits) + 2 + np.maximum(np.arange(n) - 1, 0)
    return np.clip(np.frexp(np.minimum(held, _FULL - 1).astype(np.float64))[1], bits + 1, 12).astype(np.int64)


@lru_cache(maxsize=16)
def _plan(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """`_schedule` for as many codes as are read at a time and more, and where they begin."""
    widths = _schedule(bits, 2 * _FULL)
    return widths, np.concatenate([[0], np.cumsum(widths)])


def _pack(codes: np.ndarray, widths: np.ndarray) -> bytes:
    """Codes of up to 12 bits, least significant bit first."""
    ends = np.cumsum(widths)
    begins = ends - widths
    words = np.zeros(int(ends[-1] + 31 >> 5) + 1, np.uint64)
    value = codes.astype(np.uint64) << (begins & 31).astype(np.uint64)
    at = begins >> 5
    first = np.flatnonzero(np.diff(at, prepend=-1))
    words[at[first]] += np.add.reduceat(value & np.uint64(0xFFFFFFFF), first)
    words[at[first] + 1] += np.add.reduceat(value >> np.uint64(32), first)
    return words.astype("<u4").tobytes()[: int(ends[-1] + 7 >> 3)]


def lzw_encode(data: bytes, bits: int = 8) -> bytes:
    """The code stream of `data`, whose samples are below 2**bits. The table is cleared as soon as it is full."""
    clear = 1 << bits
    codes = [clear]
    segments = [0]
    if data:
        known: dict[int, int] = {}
        get, put = known.get, codes.append
        free = clear + 2
        prefix = data[0] << 8
        for sample in memoryview(data)[1:]:
            key = prefix | sample
            code = get(key)
            if code is not None:
                prefix = code
                continue
            put(prefix >> 8)
            prefix = sample << 8
            known[key] = free << 8
            free += 1
            if free == _FULL:
                segments.append(len(codes))
                put(clear)
                known.clear()
                free = clear + 2
        put(prefix >> 8)
    put_end = codes + [clear + 1]
    n = len(put_end)
    widths = np.empty(n, np.int64)
    widths[0] = bits + 1
    edges = [*segments, n - 1]
    plan = _plan(bits)[0]
    for a, b in zip(edges, edges[1:]):  # codes a + 1 to b, b being the next clear code or the end
        widths[a + 1 : b + 1] = plan[: b - a]
    return _pack(np.array(put_end, np.int64), widths)


def lzw_decode(stream: bytes, bits: int, most: int = 1 << 62) -> bytes:
    """The samples of a code stream, up to its end code, its last whole code, or `most` samples and at most 4096 codes
    more."""
    clear, end = 1 << bits, (1 << bits) + 1
    raw = np.frombuffer(stream + b"\0\0\0", np.uint8).astype(np.uint32)
    window = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16
    total = 8 * len(stream)
    plan, offsets = _plan(bits)
    base = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    put = out.append
    at, done, table, before = 0, 0, list(base), b""  # done: codes since the last clear code
    size = counted = 0
    while True:
        size, counted = size + sum(map(len, out[counted:])), len(out)
        if size >= most:
            break
        if done + 4096 > len(plan):
            plan = np.concatenate([plan, np.full(len(plan), 12)])
            offsets = np.concatenate([[0], np.cumsum(plan)])
        begins = at + offsets[done : done + 4096] - offsets[done]
        widths = plan[done : done + 4096]
        whole = int(np.searchsorted(begins + widths, total, side="right"))
        begins, widths = begins[:whole], widths[:whole]
        codes = window[begins >> 3] >> (begins & 7).astype(np.uint32) & ((1 << widths) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else whole
        free, add = len(table), table.append
        for code in codes[:n].tolist():
            if code < free:
                entry = table[code]
            elif code == free and before:
                entry = before + before[:1]
            else:
                raise ValueError("a code before its entry")
            put(entry)
            if before and free < _FULL:
                add(before + entry[:1])
                free += 1
            before = entry
        if len(stops):
            if codes[n] == end:
                break
            at = int(begins[n] + widths[n])
            done, table, before = 0, list(base), b""
        elif whole < 4096:
            break
        else:
            done += n
            at = int(begins[-1] + widths[-1])
    return b"".join(out)


# --- the container ------------------------------------------------------------------------------------------------


@dataclass
class Frame:
    canvas: np.ndarray  #: height x width x RGBA, as shown
    delay_ms: int
    left: int
    top: int
    width: int
    height: int
    disposal: int
    transparent: int | None


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := data[at]:
        parts.append(data[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _split(stream: bytes) -> bytes:
    parts = []
    for i in range(0, len(stream), 255):
        own = stream[i : i + 255]
        parts += [bytes([len(own)]), own]
    return b"".join(parts) + b"\0"


def write(width: int, height: int, palette: bytes, frames: list[dict], background: int = 0) -> bytes:
    """A GIF89a. frames: samples (bytes), and by choice left, top, width, height, delay_ms, disposal, transparent,
    interlaced, palette."""

    def colours(p: bytes) -> tuple[int, bytes]:
        power = max(1, (len(p) // 3 - 1).bit_length())
        return power - 1, p.ljust(3 << power, b"\0")

    size, table = colours(palette)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF0 | size, background, 0), table]
    for f in frames:
        w, h = f.get("width", width), f.get("height", height)
        see = f.get("transparent")
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, f.get("disposal", KEEP) << 2 | (see is not None), f.get("delay_ms", 0) // 10, see or 0, 0))
        own = f.get("palette")
        flags, local = (0, b"") if own is None else (0x80 | colours(own)[0], colours(own)[1])
        out.append(struct.pack("<BHHHHB", 0x2C, f.get("left", 0), f.get("top", 0), w, h, flags | 0x40 * bool(f.get("interlaced"))) + local)
        samples = f["samples"]
        if f.get("interlaced"):
            rows = [samples[y * w : y * w + w] for y in range(h)]
            samples = b"".join(rows[y] for y in _interlaced(h))
        bits = max(2, size + 1 if own is None else (flags & 7) + 1)
        out += [bytes([bits]), _split(lzw_encode(samples, bits))]
    return b"".join(out) + b"\x3b"


def _interlaced(height: int) -> list[int]:
    return [y for first, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for y in range(first, height, step)]


def decode(data: bytes) -> tuple[tuple[int, int], Iterator[Frame]]:
    """(width, height) and the frames, one at a time. Raises ValueError for what isn't a GIF."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, background, _ = struct.unpack_from("<HHBBB", data, 6)
    if width * height > MOST_PIXELS:
        raise ValueError("a canvas too large to draw")
    return (width, height), _frames(data, width, height, flags, background)


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def _frames(data: bytes, width: int, height: int, flags: int, background: int) -> Iterator[Frame]:
    try:
        common, at = _palette(data, 13, flags)
        canvas = np.zeros((height, width, 4), np.uint8)  # nothing is drawn: transparent
        control, drawn_pixels = (0, 0, None), 0
        while at < len(data) and data[at] != 0x3B:
            if data[at] == 0x21:
                label, (body, at) = data[at + 1], _blocks(data, at + 2)
                if label == 0xF9:
                    how, delay, see = struct.unpack_from("<BHB", body)
                    control = (how >> 2 & 7, delay * 10, see if how & 1 else None)
                continue
            if data[at] != 0x2C:
                raise ValueError("unknown block")
            left, top, w, h, own_flags = struct.unpack_from("<HHHHB", data, at + 1)
            palette, at = _palette(data, at + 10, own_flags)
            palette = common if palette is None else palette
            bits = data[at]
            stream, at = _blocks(data, at + 1)
            if palette is None or not 2 <= bits <= 8 or left + w > width or top + h > height:
                raise ValueError("a frame without colours or beyond the canvas")
            drawn_pixels += width * height
            if drawn_pixels > MOST_DRAWN:
                raise ValueError("too many frames to draw")
            samples = np.frombuffer(lzw_decode(stream, bits, w * h)[: w * h].ljust(w * h, b"\0"), np.uint8)[: w * h].reshape(h, w)
            if own_flags & 0x40:
                rows = np.empty_like(samples)
                rows[_interlaced(h)] = samples
                samples = rows
            disposal, delay, see = control
            saved = canvas.copy() if disposal == PREVIOUS else None
            area = canvas[top : top + h, left : left + w]
            colours = np.zeros((256, 4), np.uint8)
            colours[: len(palette), :3], colours[:, 3] = palette, 255
            drawn = colours[samples]
            if see is None:
                area[:] = drawn
            else:
                np.copyto(area, drawn, where=(samples != see)[:, :, None])
            yield Frame(canvas.copy(), delay, left, top, w, h, disposal, see)
            if disposal == BACKGROUND:
                area[:] = 0
            elif disposal == PREVIOUS:
                canvas = saved
            control = (0, 0, None)
    except (IndexError, struct.error) as e:
        raise ValueError("the data end too early") from e


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Counts of visible samples in 4 x 4 x 4 colour bins."""
    channel = rgba.reshape(-1, 4) >> 6  # four bins each
    keys = channel[:, 0] << 4 | channel[:, 1] << 2 | channel[:, 2]
    shown = rgba.reshape(-1, 4)[:, 3] > 0
    return np.bincount(keys if shown.all() else keys[shown], minlength=_CHANNEL_BINS**3)


# --- payloads -----------------------------------------------------------------------------------------------------

_RED_STEP, _BLUE_STEP = 36, 85
_COLOURS = bytes(c for i in range(256) for c in ((i >> 5) * _RED_STEP, (i >> 2 & 7) * _RED_STEP, (i & 3) * _BLUE_STEP))


def pad(raw: bytes) -> bytes:
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def encode_payload(payload: bytes, delay_ms: int = 100) -> bytes:
    rows = len(payload) // WIDTH
    step = WIDTH * FRAME_ROWS
    frames = [{"samples": payload[i : i + step], "height": min(step, len(payload) - i) // WIDTH, "delay_ms": delay_ms, "disposal": BACKGROUND} for i in range(0, len(payload), step)]
    return write(WIDTH, min(rows, FRAME_ROWS), _COLOURS, frames)


def decode_payload(media: bytes) -> tuple[bytes, list[Frame], list[np.ndarray]]:
    """The samples that the colours of each frame tell, the frames (their canvas let go), and the colour histogram of
    each."""
    parts, frames, colours = [], [], []
    for frame in decode(media)[1]:
        area = frame.canvas[frame.top : frame.top + frame.height, frame.left : frame.left + frame.width]
        parts.append((area[:, :, 0] // _RED_STEP << 5 | area[:, :, 1] // _RED_STEP << 2 | area[:, :, 2] // _BLUE_STEP).tobytes())
        colours.append(histogram(area))
        frame.canvas = None
        frames.append(frame)
    return b"".join(parts), frames, colours


# --- tables -------------------------------------------------------------------------------------------------------


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a GIF."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "text"):
            raws = [(x or "").encode() for x in batch.column(1).to_pylist()]
            yield record_batch(schema, {"doc_id": batch.column(0), "n_bytes": [len(r) for r in raws], "media": [encode_payload(pad(r)) for r in raws]})

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _timed(frames: list[Frame]) -> Iterator[tuple[int, Frame]]:
    at = 0
    for frame in frames:
        yield at, frame
        at += frame.delay_ms


_FRAME = [("at_ms", pa.int64()), ("delay_ms", pa.int32()), ("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("disposal", pa.int32()), ("transparent", pa.int32())]
_FRAME_DDL = "at_ms long, delay_ms int, `left` int, top int, width int, height int, disposal int, transparent int"


def frame_table(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row for each frame: the medium's key, of any type, the frame's number, when it is shown, its place and rules, and
    the colour histogram of what is shown. Broken media: one row with the frame number null and `error`."""
    added = pa.schema([("frame", pa.int32()), *_FRAME, ("histogram", pa.list_(pa.int64())), ("error", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, column):
            for k, data in enumerate(batch.column(1).to_pylist()):
                rows, at = [], 0
                try:
                    for i, f in enumerate(decode(data or b"")[1]):
                        rows.append((i, at, f.delay_ms, f.left, f.top, f.width, f.height, f.disposal, f.transparent, histogram(f.canvas).tolist(), None))
                        at += f.delay_ms
                except ValueError as e:
                    rows = [(*[None] * 10, str(e))]
                found = record_batch(added, dict(zip(added.names, zip(*rows))) if rows else {n: [] for n in added.names})
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k] * len(rows), pa.int64())), *found.columns], names=[key, *added.names])

    picked = media.select(F.col(f"`{key}`"), F.col(f"`{column}`").cast("binary"))
    return picked.mapInArrow(run, T.StructType([picked.schema[0], *T.StructType.fromDDL(f"frame int, {_FRAME_DDL}, histogram array<long>, error string").fields]))


def payload_features(media: DataFrame) -> DataFrame:
    """What `op2_gif` returns, from the stored bytes, and `frames`, the timed frames of each document with their colour
    histograms. feature: the counts of the 64 colours in all frames."""
    fields = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_frames", pa.int32())]
    schema = pa.schema([*fields, ("frames", pa.list_(pa.struct([*_FRAME, ("histogram", pa.list_(pa.int64()))])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "media"):
            rows = []
            for doc_id, n, data in zip(*(batch.column(i).to_pylist() for i in range(3))):
                payload, frames, colours = decode_payload(data)
                feature = ",".join(map(str, sum(colours).tolist()))
                timed = [{**{name: at if name == "at_ms" else getattr(f, name) for name, _ in _FRAME}, "histogram": c} for (at, f), c in zip(_timed(frames), colours)]
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(frames), timed))
            yield record_batch(schema, dict(zip(schema.names, zip(*rows))))

    ddl = f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, frames array<struct<{_FRAME_DDL.replace(' long', ':long').replace(' int', ':int')}, histogram:array<long>>>"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, ddl)


def op2_gif(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = materialize(media_table(spark.read.parquet(f"{sf_dir}/documents.parquet")), "gif", codec="uncompressed")
    return materialize(payload_features(media), "frames").drop("frames")
