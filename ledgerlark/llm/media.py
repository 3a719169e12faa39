"""Media columns: payloads stored as baseline JPEG, read back as DC-only luminance thumbnails.

``encode_media`` stores bytes losslessly: every 8x8 block of a grey baseline JPEG is flat and carries one byte in its DC
coefficient (quantiser 8, so the dequantised, inverse-transformed block is exactly that byte). ``decode_media`` parses the
markers of any baseline JPEG, Huffman-decodes its scans and rebuilds the DC-only luminance thumbnail (one sample a block),
its dimensions and a thumbnail hash. For files written here the thumbnail is the payload.

Huffman decoding runs over all restart intervals of a batch of images at once, one numpy lane an interval, by a table from
16-bit windows to whole blocks (DC code, extra bits, end of block). Blocks that don't fit a window, several components and
files without restart markers take the scalar decoder.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerlark.llm.common import by_value, table

by_value(__name__)

UNIT = 64  # payloads are padded to a multiple of this; also blocks in a row and in a restart interval
MOST_ROWS = 8191  # a JPEG has at most 65535 lines; longer payloads continue in further images
BATCH = 1 << 20  # payload bytes that are coded together
#: Length of the DC Huffman code of each size category, short for the differences that text has.
DC_LENGTHS = {4: 2, 7: 2, 3: 3, 2: 4, 5: 4, 6: 4, 1: 5, 0: 6, 8: 6}


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), codes in order of length as baseline JPEG defines them."""
    code, last, out = 0, 0, {}
    for s, n in sorted(lengths.items(), key=lambda x: x[1]):
        code <<= n - last
        out[s], last = (code, n), n
        code += 1
    return out


def dht(kind: int, lengths: dict[int, int]) -> bytes:
    order = sorted(lengths.items(), key=lambda x: x[1])
    body = bytes([kind]) + bytes(sum(n == k for _, n in order) for k in range(1, 17)) + bytes(s for s, _ in order)
    return b"\xff\xc4" + struct.pack(">H", 2 + len(body)) + body


def header(rows: int, n_bytes: int, payload: int) -> bytes:
    """All of an image before its scan's data; a comment keeps the text's own and the padded length."""
    note = f"bytes={n_bytes};payload={payload}".encode()
    return (
        b"\xff\xd8\xff\xfe" + struct.pack(">H", 2 + len(note)) + note
        + b"\xff\xdb\x00\x43\x00" + bytes([8]) + bytes([1]) * 63
        + b"\xff\xc0" + struct.pack(">HBHHBBBB", 11, 8, rows * 8, UNIT * 8, 1, 1, 0x11, 0)
        + dht(0x00, DC_LENGTHS) + dht(0x10, {0: 1})
        + b"\xff\xdd\x00\x04" + struct.pack(">H", UNIT)
        + b"\xff\xda" + struct.pack(">HBBBBBB", 8, 1, 1, 0x00, 0, 63, 0)
    )


def block_codes() -> tuple[np.ndarray, np.ndarray]:
    """For each DC difference -255..255 (at index + 255): the block's bits with its end-of-block, and how many."""
    dc, bits, lengths = canonical(DC_LENGTHS), np.zeros(511, np.uint64), np.zeros(511, np.uint64)
    for d in range(-255, 256):
        size = abs(d).bit_length()
        code, n = dc[size]
        extra = d if d >= 0 else d + (1 << size) - 1
        bits[d + 255], lengths[d + 255] = ((code << size | extra) << 1), n + size + 1
    return bits, lengths


def encode_scans(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entropy-coded restart intervals of (intervals, 64) bytes: stuffed bytes with two free bytes after each interval, and their ends."""
    bits, lengths = block_codes()
    v = samples.astype(np.int16) - 128
    d = v.copy()
    d[:, 1:] -= v[:, :-1]
    d += 255
    code, size = bits[d], lengths[d]
    code = (code[:, 0::2] << size[:, 1::2]) | code[:, 1::2]  # two blocks, at most 30 bits
    size = size[:, 0::2] + size[:, 1::2]
    lanes, stride = len(samples), UNIT * 15 // 32 + 2
    words = np.zeros(lanes * stride, ">u4")
    acc, cnt, at = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64), np.arange(lanes) * stride
    w32, w64, w5 = np.uint64(32), np.uint64(64), np.uint64(5)
    for j in range(UNIT // 2):
        acc = (acc << size[:, j]) | code[:, j]
        cnt = cnt + size[:, j]
        words[at] = (acc << (w64 - cnt)) >> w32
        full = cnt >> w5
        at += full.astype(np.int64)
        cnt -= full << w5
    # what is left over, then ones up to a whole byte
    total = size.sum(axis=1).astype(np.int64)
    rest = np.where(cnt == 0, np.uint64(0), (acc << (w64 - np.maximum(cnt, np.uint64(1)))) >> w32)
    words[at] = rest
    n = (total + 7) // 8
    raw = words.view(np.uint8).reshape(lanes, stride * 4)
    raw[np.arange(lanes), n - 1] |= ((1 << (n * 8 - total)) - 1).astype(np.uint8)
    flat = raw[np.arange(stride * 4) < n[:, None]]
    ff = (flat == 0xFF).astype(np.int64)
    lane = np.repeat(np.arange(lanes), n)
    place = np.arange(len(flat)) + np.cumsum(ff) - ff + 2 * lane
    out = np.zeros(int(len(flat) + ff.sum() + 2 * lanes), np.uint8)
    out[place] = flat
    last = np.cumsum(n) - 1
    ends = place[last] + 1 + ff[last]
    return out, ends


def encode_payloads(items: list[tuple[int, np.ndarray]]) -> list[bytes]:
    """JPEG bytes of each (text's own length, padded payload of at most MOST_ROWS rows), coded together."""
    rows = [len(p) // UNIT for _, p in items]
    out, ends = encode_scans(np.concatenate([p for _, p in items]).reshape(-1, UNIT))
    first = np.cumsum([0, *rows])
    k = np.arange(len(ends)) - np.repeat(first[:-1], rows)
    out[ends], out[ends + 1] = 0xFF, 0xD0 + k % 8
    last = first[1:] - 1
    out[ends[last] + 1] = 0xD9  # the last interval ends the image
    starts = np.concatenate([[0], ends[last][:-1] + 2])
    return [header(r, n, len(p)) + out[a : e + 2].tobytes() for (n, p), r, a, e in zip(items, rows, starts, ends[last], strict=True)]


def to_payload(data: bytes) -> np.ndarray:
    """The bytes, then zeros up to a positive multiple of 64."""
    return np.frombuffer(data + bytes(-len(data) % UNIT or UNIT * (not data)), np.uint8)


def encode_texts(texts: list[bytes]) -> list[bytes]:
    """The stored form of each text: one image, or several in a row for a long one."""
    units, owner = [], []
    for k, t in enumerate(texts):
        p = to_payload(t)
        for at in range(0, len(p), UNIT * MOST_ROWS):
            units.append((len(t), p[at : at + UNIT * MOST_ROWS]))
            owner.append(k)
    out: list[list[bytes]] = [[] for _ in texts]
    at = 0
    while at < len(units):
        end, size = at, 0
        while end < len(units) and (end == at or size + len(units[end][1]) <= BATCH):
            size += len(units[end][1])
            end += 1
        for k, image in zip(owner[at:end], encode_payloads(units[at:end]), strict=True):
            out[k].append(image)
        at = end
    return [b"".join(x) for x in out]


class Image:
    """One parsed baseline JPEG: dimensions, components, tables, comment and the raw bytes of its scan."""

    __slots__ = ("width", "height", "parts", "quant", "huff", "interval", "scan", "note", "order", "end", "tables")


def parse(data: bytes, at: int = 0) -> Image:
    """Read one image's markers from ``at``. ValueError for what isn't a whole baseline JPEG."""
    if data[at : at + 2] != b"\xff\xd8":
        raise ValueError("no image starts here")
    im = Image()
    im.quant, im.huff, im.interval, im.note, im.parts, im.tables = {}, {}, 0, b"", [], b""
    at += 2
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("a marker is missing")
        kind = data[at + 1]
        if kind == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        if kind == 0xFE:
            im.note = body
        elif kind == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                im.quant[body[k] & 15] = struct.unpack_from(">H", body, k + 1)[0] if wide else body[k + 1]
                k += 129 if wide else 65
        elif kind == 0xC0:
            _, im.height, im.width, count = struct.unpack_from(">BHHB", body)
            im.parts = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(count)]
        elif 0xC1 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline image")
        elif kind == 0xC4:
            im.tables += body
            k = 0
            while k < len(body):
                counts, s = body[k + 1 : k + 17], k + 17
                lengths = {}
                for size, c in enumerate(counts, 1):
                    for _ in range(c):
                        lengths[body[s]] = size
                        s += 1
                im.huff[body[k]], k = lengths, s
        elif kind == 0xDD:
            (im.interval,) = struct.unpack(">H", body[:2])
        elif kind == 0xDA:
            im.order = [(body[1 + 2 * c], body[2 + 2 * c]) for c in range(body[0])]
            at += 2 + n
            end = data.find(b"\xff\xd9", at)
            if end < 0 or not im.parts:
                raise ValueError("the scan has no end")
            im.scan, im.end = data[at:end], end + 2
            return im
        at += 2 + n


def images_of(data: bytes) -> list[Image]:
    out, at = [], 0
    while at < len(data):
        out.append(parse(data, at))
        at = out[-1].end
    return out


def block_table(dc: dict[int, int], ac: dict[int, int]) -> np.ndarray:
    """From each 16-bit window to (DC difference + 4096) << 8 | bits of a block that ends after its DC; 0 where it does not."""
    out = np.zeros(1 << 16, np.int32)
    stop = canonical(ac).get(0)
    if stop is None:
        return out
    for size, (code, n) in canonical(dc).items():
        for extra in range(1 << size):
            total = n + size + stop[1]
            if size > 12 or total > 16:
                break
            d = extra if not size or extra >> (size - 1) else extra - (1 << size) + 1
            lo = ((code << size | extra) << stop[1] | stop[0]) << (16 - total)
            out[lo : lo + (1 << (16 - total))] = (d + 4096) << 8 | total
    return out


def luminance_scalar(im: Image) -> np.ndarray:
    """Quantised DC values of the first component, block row by block row, by plain sequential decoding."""
    tables = {k: {(n, c): s for s, (c, n) in canonical(v).items()} for k, v in im.huff.items()}
    parts = {p[0]: p for p in im.parts}
    single = len(im.order) == 1
    hmax, vmax = max(p[1] for p in im.parts), max(p[2] for p in im.parts)
    first = im.parts[0]
    wide = -(-(-(-im.width * first[1] // hmax)) // 8)
    high = -(-(-(-im.height * first[2] // vmax)) // 8)
    mw, mh = (wide, high) if single else (-(-im.width // (8 * hmax)), -(-im.height // (8 * vmax)))
    out = np.zeros((mh if single else mh * first[2], mw if single else mw * first[1]), np.int32)
    data, pos, bit = im.scan, 0, 0

    def take(n: int) -> int:
        nonlocal pos, bit
        v = 0
        for _ in range(n):
            b = data[pos] if pos < len(data) else 0xFF
            v = v << 1 | (b >> (7 - bit) & 1)
            bit += 1
            if bit == 8:
                bit, pos = 0, pos + (2 if b == 0xFF and pos + 1 < len(data) and data[pos + 1] == 0 else 1)
        return v

    def symbol(t: dict) -> int:
        c = 0
        for n in range(1, 17):
            c = c << 1 | take(1)
            if (n, c) in t:
                return t[n, c]
        raise ValueError("no such code")

    def signed(size: int) -> int:
        v = take(size)
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    before = dict.fromkeys(parts, 0)
    for m in range(mw * mh):
        if im.interval and m and m % im.interval == 0:
            if bit:
                bit, pos = 0, pos + (2 if data[pos] == 0xFF and data[pos + 1] == 0 else 1)
            pos += 2
            before = dict.fromkeys(parts, 0)
        for name, which in im.order:
            _, h, v, _ = parts[name]
            for b in range(1 if single else h * v):
                before[name] += signed(symbol(tables[which >> 4]))
                k = 1
                while k < 64:
                    s = symbol(tables[0x10 | which & 15])
                    if s == 0:
                        break
                    take(s & 15)
                    k += (s >> 4) + 1
                if name == first[0]:
                    y, x = (m // mw, m % mw) if single else (m // mw * v + b // h, m % mw * h + b % h)
                    out[y, x] = before[name]
    return out[:high, :wide]


def thumbnails(images: list[Image]) -> list[np.ndarray]:
    """DC-only luminance thumbnails, uint8 (block rows, block columns)."""
    out: list[np.ndarray | None] = [None] * len(images)
    groups: dict[tuple, list[int]] = {}
    for k, im in enumerate(images):
        if len(im.parts) == 1 and im.interval:
            groups.setdefault((im.interval, im.tables), []).append(k)
    for (interval, _), ks in groups.items():
        for k, dc in zip(ks, luminance_lanes([images[k] for k in ks], interval), strict=True):
            out[k] = dc
    for k, im in enumerate(images):
        dc = luminance_scalar(im) if out[k] is None else out[k]
        out[k] = np.clip((dc * im.quant[im.parts[0][3]] + 4) // 8 + 128, 0, 255).astype(np.uint8)
    return out


def luminance_lanes(images: list[Image], interval: int) -> list[np.ndarray | None]:
    """As luminance_scalar for one-component images with equal tables, all restart intervals at once; None where that fails."""
    im = images[0]
    lut = block_table(im.huff[im.order[0][1] >> 4], im.huff[0x10 | im.order[0][1] & 15])
    sizes = [(-(-x.height // 8), -(-x.width // 8)) for x in images]
    lanes_of = [-(-h * w // interval) for h, w in sizes]
    raw = np.frombuffer(b"".join(x.scan + b"\xff\xd8" for x in images), np.uint8)  # a mark that no scan holds ends each
    ff = np.flatnonzero(raw[:-1] == 0xFF)
    after = raw[ff + 1]
    marks = ff[(after >= 0xD0) & (after <= 0xD8)]
    keep = np.ones(len(raw), bool)
    keep[ff[after == 0] + 1] = False
    keep[marks] = keep[marks + 1] = False
    if len(marks) != sum(lanes_of):
        return [None] * len(images)
    kept = np.concatenate([[0], np.cumsum(keep)])
    ends = kept[marks]
    pos = np.concatenate([[0], ends[:-1]]) * 8
    data = np.concatenate([raw[keep], np.full(4, 0xFF, np.uint8)]).astype(np.int32)
    window = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    blocks = np.concatenate([[min(interval, h * w - i * interval) for i in range(n)] if n * interval != h * w else np.full(n, interval) for (h, w), n in zip(sizes, lanes_of, strict=True)])
    diff = np.zeros((interval, len(pos)), np.int32)
    limit, bad = ends * 8, np.zeros(len(pos), bool)
    uniform = (blocks == interval).all()
    for j in range(interval):
        e = lut[(window[np.minimum(pos >> 3, len(window) - 1)] >> (8 - (pos & 7))) & 0xFFFF]
        if not uniform:
            e = np.where(j < blocks, e, 4096 << 8)
        bad |= e == 0
        diff[j] = (e >> 8) - 4096
        pos = pos + (e & 255)
    bad |= pos > limit
    dc = np.cumsum(diff, axis=0, dtype=np.int32).T
    out, at = [], 0
    for (h, w), n in zip(sizes, lanes_of, strict=True):
        out.append(None if bad[at : at + n].any() else np.ascontiguousarray(dc[at : at + n]).reshape(-1)[: h * w].reshape(h, w))
        at += n
    return out


def average_hash(thumb: np.ndarray) -> str:
    """64 bits: which of 8x8 cells are brighter than the mean cell. Smaller thumbnails are stretched."""
    h, w = thumb.shape
    x = thumb
    if h < 8 or w < 8:
        x = x[np.arange(max(h, 8)) * h // max(h, 8)][:, np.arange(max(w, 8)) * w // max(w, 8)]
        h, w = x.shape
    ys, xs = np.arange(8) * h // 8, np.arange(8) * w // 8
    cells = np.add.reduceat(np.add.reduceat(x.astype(np.int64), ys, 0), xs, 1)
    area = np.diff([*ys, h])[:, None] * np.diff([*xs, w])[None, :]
    means = cells / area
    return np.packbits(means > means.mean()).tobytes().hex()


MEDIA_SCHEMA = "media binary, n_bytes bigint"


def _plain(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def encode_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            texts = _plain(part, "text")
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(encode_texts(texts), pa.binary())], ["id", "media"])


def decode_batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            media = part.column("media").to_pylist()
            cols: dict[str, list] = {k: [] for k in ("n_bytes", "width", "height", "images", "thumbnail", "thumbnail_hash")}
            parsed = [images_of(m) if m is not None else [] for m in media]
            flat = [im for p in parsed for im in p]
            thumbs, group, size = [], [], 0
            for im in flat:
                group.append(im)
                size += len(im.scan)
                if size >= BATCH:
                    thumbs += thumbnails(group)
                    group, size = [], 0
            thumbs += thumbnails(group) if group else []
            k = 0
            for p in parsed:
                own = thumbs[k : k + len(p)]
                k += len(p)
                note = dict(x.split(b"=") for x in p[0].note.split(b";") if x.count(b"=") == 1) if p else {}
                cols["n_bytes"].append(int(note[b"bytes"]) if note.get(b"bytes", b"").isdigit() else None)
                cols["width"].append(p[0].width if p else None)
                cols["height"].append(sum(im.height for im in p) if p else None)
                cols["images"].append(len(p))
                cols["thumbnail"].append(b"".join(t.tobytes() for t in own))
                cols["thumbnail_hash"].append(average_hash(own[0] if len(own) == 1 else np.concatenate(own)) if own and len({t.shape[1] for t in own}) == 1 else None)
            kinds = {"n_bytes": pa.int64(), "width": pa.int32(), "height": pa.int64(), "images": pa.int32(), "thumbnail": pa.binary(), "thumbnail_hash": pa.string()}
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("media"), *(pa.array(v, kinds[c]) for c, v in cols.items())], ["id", "media", *cols])


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``<id_col>, media``: each whole text (null: empty) as baseline JPEG. Rows stay rows, repeated ones and null ids too."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.selectExpr(f"`{id_col}` AS id", f"cast(`{text_col}` AS string) AS text")
    return rows.mapInArrow(encode_batches, f"id {kind}, media binary").withColumnRenamed("id", id_col)


def decode_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """``<id_col>, media, n_bytes, width, height, images, thumbnail, thumbnail_hash`` of baseline JPEG columns.

    ``thumbnail`` holds the DC-only luminance samples row by row, of all images of the column's value in turn; ``height``
    is their sum. ``n_bytes`` comes from our own comment, else null. A null medium gives nulls and an empty thumbnail; what
    isn't baseline JPEG raises ValueError.
    """
    kind = media.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, media binary, n_bytes bigint, width int, height bigint, images int, thumbnail binary, thumbnail_hash string"
    return media.selectExpr(f"`{id_col}` AS id", f"`{media_col}` AS media").mapInArrow(decode_batches, schema).withColumnRenamed("id", id_col)


def op9_media_columns(spark, sf_dir: str) -> DataFrame:
    """Digest columns of the media written and read back; equal texts give equal values, a null text those of the empty one."""
    back = decode_media(encode_media(table(spark, sf_dir, "documents")))
    return back.selectExpr(
        "doc_id", "n_bytes", "cast(length(thumbnail) AS bigint) AS payload_bytes", "sha2(thumbnail, 256) AS payload_sha256", "crc32(substring(thumbnail, length(thumbnail) - 63, 64)) AS tail_crc32",
        "cast(length(media) AS bigint) AS media_bytes", "sha2(media, 256) AS media_sha256", "concat(width, 'x', height, ':', thumbnail_hash) AS feature",
    )


def digest(data: bytes) -> tuple[int, str, int]:
    """Length, SHA-256 and CRC-32 of the last 64 bytes of a payload; what the query must agree with."""
    p = to_payload(data).tobytes()
    return len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])
