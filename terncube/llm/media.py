"""Media columns: bytes kept losslessly in baseline JPEG files, and features from the files alone.

A payload is a positive multiple of 64 bytes; 64 of them are the coefficients of one 8 x 8 block, so that entropy coding
gives every byte back. A byte b stands for the coefficient b - 255 if b < 128 and b otherwise: these 256 values are
size category 8, whose additional bits are b itself. Every block is a restart interval. The decoder reads baseline files
in general (tables, sampling, restart intervals) and steps through all intervals of a batch together in numpy.

Defined results: a null text is empty; an empty text is 64 zero bytes; equal texts have equal values in every column.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the format: the zigzag order of an 8 x 8 block follows from walking its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda k: (k // 8 + k % 8, k // 8 if (k // 8 + k % 8) % 2 else k % 8)), dtype=np.int64)
SIZE8 = 8
CHUNK = 1 << 15


def padded(data: bytes) -> bytes:
    return data + bytes((-len(data)) % 64 if data else 64)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def encode(payload: bytes) -> bytes:
    """A baseline grey JPEG whose coefficients are the payload, a positive multiple of 64 bytes."""
    n = len(payload) // 64
    cols = min(8191, math.isqrt(n - 1) + 1)
    rows = -(-n // cols)
    if rows > 8191:
        raise ValueError("the payload is too long for one file")
    dc, ac = bytes([1, *[0] * 15, SIZE8]), bytes([1, *[0] * 15, SIZE8])
    head = b"\xff\xd8" + _segment(0xFE, b"bytes=%d" % len(payload)) + _segment(0xDB, bytes([0, 4, *[1] * 63]))
    head += _segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, cols * 8, 1, 1, 0x11, 0)) + _segment(0xC4, b"\x00" + dc) + _segment(0xC4, b"\x10" + ac)
    head += _segment(0xDD, struct.pack(">H", 1)) + _segment(0xDA, bytes([1, 1, 0, 0, 63, 0]))
    b = np.zeros((rows * cols, 8, 8), np.uint16)
    b.reshape(-1)[: len(payload)] = np.frombuffer(payload, np.uint8)
    coded = np.empty((rows * cols, 74), np.uint8)
    nine = np.zeros((rows * cols, 8, 9), np.uint16)
    for i in range(8):  # eight times a zero bit and a byte make nine bytes
        nine[:, :, i] |= b[:, :, i] >> (i + 1)
        nine[:, :, i + 1] |= (b[:, :, i] << (7 - i)) & 0xFF
    coded[:, :72] = nine.reshape(-1, 72)
    coded[:, 72] = 0xFF
    coded[:, 73] = 0xD0 + np.arange(rows * cols) % 8
    body = coded.reshape(-1)[:-2]
    if (np.frombuffer(payload, np.uint8) == 255).any():  # a byte of ones inside a scan is followed by a zero
        scan = coded[:, :72].reshape(-1)
        ones = np.flatnonzero(scan == 255)
        body = np.insert(body, ones + 1 + 2 * (ones // 72), 0)
    return head + body.tobytes() + b"\xff\xd9"


@lru_cache(maxsize=256)
def _table(counts: bytes, symbols: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Code length and symbol of every 16-bit prefix; length 0 where no code begins so."""
    length, symbol, code, k = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0
    for bits in range(1, 17):
        for _ in range(counts[bits - 1]):
            span = slice(code << (16 - bits), (code + 1) << (16 - bits))
            length[span], symbol[span] = bits, symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return length, symbol


def parse(media: bytes) -> dict:
    """Read the markers of a baseline JPEG: width, height, parts (components with their sampling and quantisation table),
    comment, and where its restart intervals lie in the unstuffed scan."""
    if media[:2] != b"\xff\xd8":
        raise ValueError("no JPEG")
    at, quant, tables, every, parts, comment, out = 2, {}, {}, 0, [], b"", {}
    while True:
        if at + 4 > len(media) or media[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker, n = media[at + 1], struct.unpack_from(">H", media, at + 2)[0]
        body, at = media[at + 4 : at + 2 + n], at + 2 + n
        if marker == 0xFE:
            comment = body
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                size = 128 if wide else 64
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + size :]
        elif marker == 0xC0:
            _, out["height"], out["width"], count = struct.unpack_from(">BHHB", body)
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(count)]
        elif 0xC1 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline file")
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            every = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            break
    if not parts or len(chosen) != len(parts) or not out["width"] or not out["height"]:
        raise ValueError("one interleaved scan is read")
    if len(parts) == 1:  # one component is never interleaved
        parts[0] |= {"h": 1, "v": 1}
    across = -(-out["width"] // (8 * max(p["h"] for p in parts)))
    down = -(-out["height"] // (8 * max(p["v"] for p in parts)))
    units = across * down
    every = every or units
    scan = np.frombuffer(media, np.uint8)[at:]
    ff = np.flatnonzero(scan[:-1] == 0xFF)
    after = scan[ff + 1]
    end = ff[(after != 0) & ((after < 0xD0) | (after > 0xD7))]
    end = int(end[0]) if len(end) else len(scan)
    ff, after = ff[ff < end], after[ff < end]
    cuts = ff[after != 0]
    if len(cuts) != -(-units // every) - 1:
        raise ValueError("restart intervals are missing")
    starts, ends = np.concatenate([[0], cuts + 2]), np.append(cuts, end)
    stuffed = ff[after == 0] + 1
    if len(stuffed):
        keep = np.ones(end, bool)
        keep[stuffed] = False
        gone = np.concatenate([[0], np.cumsum(~keep)])
        starts, ends, scan = starts - gone[starts], ends - gone[ends], scan[:end][keep]
    for p in parts:
        p |= {"quant": quant[p["q"]], "across": across, "down": down}
        p["tables"] = (*tables[chosen[p["id"]] >> 4], *tables[16 | chosen[p["id"]] & 15])
    layout = (every, *((p["h"] * p["v"], *p["tables"]) for p in parts))
    return out | {"parts": parts, "comment": comment, "units": units, "layout": layout, "scan": scan[: int(ends[-1])], "starts": starts, "ends": ends}


def decode_many(pictures: list[dict]) -> None:
    """Decode the scans of parsed files, putting coefs (units, blocks a unit, 64 in zigzag order) into their parts. The
    intervals of all files with the same tables go through the steps together."""
    alike: dict[tuple, list[dict]] = {}
    for x in pictures:
        alike.setdefault(x["layout"], []).append(x)
    for layout, group in alike.items():
        every, blocks = layout[0], [x[0] for x in layout[1:]]
        plan = [(i, _table(*x[1:3]), _table(*x[3:5])) for i, x in enumerate(layout[1:]) for _ in range(x[0])]
        data = np.concatenate([*(x["scan"] for x in group), np.full(8, 255, np.uint8)])
        offset = np.concatenate([[0], np.cumsum([len(x["scan"]) for x in group])])
        begin, ends = (np.concatenate([x[k] + o for x, o in zip(group, offset, strict=False)]) for k in ("starts", "ends"))
        live = np.concatenate([np.minimum(every, x["units"] - every * np.arange(len(x["starts"]))) for x in group])
        coefs = [np.zeros((len(begin) * every, b, 64), np.int16) for b in blocks]
        bad = np.zeros(len(begin), bool)
        for lo in range(0, len(begin), CHUNK):
            part = slice(lo, lo + CHUNK)
            bad[part] = _lockstep(data, begin[part], ends[part], live[part], lo, every, plan, coefs)
        at = 0
        for x in group:
            lanes = len(x["starts"])
            x["error"] = "a scan is damaged" if bad[at : at + lanes].any() else None
            for p, c in zip(x["parts"], coefs, strict=True):
                p["coefs"] = c[at * every : at * every + x["units"]]
            at += lanes


def _lockstep(data, begin, ends, live, lo, every, plan, coefs) -> np.ndarray:
    """Decode many restart intervals side by side: each step takes the next code of every one. True where one is damaged."""
    pos, lanes = begin * 8, np.arange(len(begin))
    bad = np.zeros(len(begin), bool)
    dc = [np.zeros(len(begin), np.int64) for _ in coefs]
    last = len(data) - 5
    for unit in range(every):
        which = [0] * len(coefs)
        for part, dc_table, ac_table in plan:
            slot, which[part] = which[part], which[part] + 1
            k = np.where((unit < live) & ~bad, 0, 64)
            for step in range(64):
                on = np.flatnonzero(k < 64)
                if not len(on):
                    break
                whole = len(on) == len(k)
                p, kk = (pos, k) if whole else (pos[on], k[on])
                byte = np.minimum(p >> 3, last)
                window = data[byte].astype(np.int64)
                for i in range(1, 5):
                    window = (window << 8) | data[byte + i]
                window = (window << (p & 7)) & 0xFFFFFFFFFF
                bits, symbol = (dc_table if step == 0 else ac_table)[0][window >> 24], (dc_table if step == 0 else ac_table)[1][window >> 24]
                size = symbol & 15
                value = (window >> (40 - bits - size)) & ((1 << size) - 1)
                value -= np.where(value >= (1 << size) >> 1, 0, (1 << size) - 1)
                target = kk if step == 0 else kk + (symbol >> 4)
                lane = lanes if whole else on
                bad[lane[bits == 0]] = True
                if step == 0:
                    dc[part][lane] += value
                    value = dc[part][lane]
                    finished = bits == 0
                else:
                    finished = (size == 0) & (symbol < 0xF0) | (bits == 0)
                fits = ~finished & (target < 64)
                if fits.all():
                    coefs[part][(lo + lane) * every + unit, slot, target] = value
                else:
                    coefs[part][(lo + lane[fits]) * every + unit, slot, target[fits]] = value[fits]
                pos[lane] = p + bits + size
                k[lane] = np.where(finished, 64, target + 1)
    return bad | (pos > ends * 8)


def decode(media: bytes) -> dict:
    """A parsed file with its coefficients."""
    picture = parse(media)
    decode_many([picture])
    if picture["error"]:
        raise ValueError(picture["error"])
    return picture


def stored(picture: dict) -> bytes:
    """The payload that encode() laid into a file."""
    values = picture["parts"][0]["coefs"].reshape(-1)
    return np.where(values < 0, values + 255, values).astype(np.uint8)[: int(picture["comment"].removeprefix(b"bytes="))].tobytes()


def thumbnail(picture: dict) -> np.ndarray:
    """Luminance from the DC coefficients alone, a pixel per block, as 0 to 255."""
    p = picture["parts"][0]
    dc = p["coefs"][:, :, 0].astype(np.int64) * int(p["quant"][0])
    grid = dc.reshape(p["down"], p["across"], p["v"], p["h"]).transpose(0, 2, 1, 3).reshape(p["down"] * p["v"], p["across"] * p["h"])
    return np.clip(grid // 8 + 128, 0, 255).astype(np.uint8)


def difference_hash(grey: np.ndarray) -> str:
    """64 bits: in an 8 x 9 grid of cell means, whether a cell is brighter than its right neighbour."""
    rows = np.linspace(0, grey.shape[0], 9).astype(int)
    cols = np.linspace(0, grey.shape[1], 10).astype(int)
    total = np.pad(grey.astype(np.int64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    r0, r1 = np.minimum(rows[:-1], grey.shape[0] - 1), np.maximum(rows[1:], np.minimum(rows[:-1], grey.shape[0] - 1) + 1)
    c0, c1 = np.minimum(cols[:-1], grey.shape[1] - 1), np.maximum(cols[1:], np.minimum(cols[:-1], grey.shape[1] - 1) + 1)
    sums = total[np.ix_(r1, c1)] - total[np.ix_(r0, c1)] - total[np.ix_(r1, c0)] + total[np.ix_(r0, c0)]
    mean = sums / ((r1 - r0)[:, None] * (c1 - c0)[None, :])
    return np.packbits(mean[:, :-1] > mean[:, 1:]).tobytes().hex()


MEDIA = "media binary, n_bytes long"
FEATURES = "width int, height int, thumbnail_hash string, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, error string"


def add_media(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keep, media, n_bytes): every text as UTF-8, zero-padded to a positive multiple of 64, in a JPEG file."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).cast("binary").alias("raw"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = dict(rows.dtypes)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in _slices(batch, "raw"):
                raws = [x.as_py() for x in one.column("raw")]
                yield pa.RecordBatch.from_arrays([one.column(f"k{i}") for i in range(len(keep))] + [pa.array([encode(padded(r)) for r in raws], pa.binary()), pa.array([len(r) for r in raws], pa.int64())], names=[*(f"k{i}" for i in range(len(keep))), "media", "n_bytes"])

    out = rows.mapInArrow(build, ", ".join([*(f"k{i} {kinds[f'k{i}']}" for i in range(len(keep))), MEDIA]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def _slices(batch: pa.RecordBatch, column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes in a column, one row at least."""
    lo, size = 0, 0
    for i, x in enumerate(batch.column(column)):
        size += x.as_buffer().size if x.is_valid else 0
        if size >= most:
            yield batch.slice(lo, i + 1 - lo)
            lo, size = i + 1, 0
    if lo < batch.num_rows:
        yield batch.slice(lo)


def features(files: list[bytes | None]) -> list[tuple]:
    """FEATURES of each file."""
    parsed: list[dict | str | None] = []
    for media in files:
        try:
            parsed.append(None if media is None else parse(media))
        except (ValueError, KeyError, IndexError, struct.error) as x:
            parsed.append(f"not read: {x}")
    decode_many([x for x in parsed if isinstance(x, dict)])
    out = []
    for media, x in zip(files, parsed, strict=True):
        sums = (None, None) if media is None else (len(media), hashlib.sha256(media).hexdigest())
        if not isinstance(x, dict) or x["error"]:
            out.append((None,) * 6 + (*sums, x["error"] if isinstance(x, dict) else x))
            continue
        held = stored(x) if x["comment"].startswith(b"bytes=") else None
        mine = (None,) * 3 if held is None else (len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-64:]))
        out.append((x["width"], x["height"], difference_hash(thumbnail(x)), *mine, *sums, None))
    return out


def read_media(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """(keep, FEATURES) from the files alone; error says why a file could not be read."""
    rows = df.select(F.col(media).alias("media"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(keep)])
    kinds = dict(rows.dtypes)
    types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in FEATURES.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one in _slices(batch, "media", 2 << 20):
                found = features(one.column("media").to_pylist())
                cols = [pa.array([f[i] for f in found], t) for i, t in enumerate(types)]
                yield pa.RecordBatch.from_arrays([one.column(f"k{i}") for i in range(len(keep))] + cols, names=[*(f"k{i}" for i in range(len(keep))), *names])

    out = rows.mapInArrow(look, ", ".join([*(f"k{i} {kinds[f'k{i}']}" for i in range(len(keep))), FEATURES]))
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def op9_media(spark, sf_dir: str) -> DataFrame:
    found = read_media(add_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    whole = F.when(F.col("error").isNotNull(), F.raise_error(F.concat(F.lit("bad media: "), "error"))).otherwise(F.concat_ws(":", F.concat_ws("x", "width", "height"), "thumbnail_hash"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", whole.alias("feature"))
