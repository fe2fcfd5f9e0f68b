"""Operator 7: media columns as progressive JPEG.

Method. `decode` reads a progressive JPEG: every scan adds its spectral band (Ss..Se) or its bit of
precision (Ah, Al) to the coefficient arrays; then the blocks are inverse-transformed in numpy, chroma is
upsampled and the picture becomes a full-resolution RGB tensor. Scans whose Huffman table holds a single
symbol have a fixed stride and are read as arrays; all others go through the general bit reader.

Lossless payloads. `encode_payload` stores arbitrary bytes in the format's own unit, the quantised DCT
coefficient (8-bit samples would not survive the transform): byte b becomes AC coefficient 256 + b, 63 to a
block, in a 4:2:0 picture, sent in two spectral bands without the two lowest bits and two refinement
scans for these. Every such coefficient is of category 7 in the first scans, so these scans consist of
bytes 01xxxxxx. A comment segment holds the payload's length.

All arithmetic of the transform is on integers (in float64, far below 2^53), so results do not depend on
how pictures are batched.

Defined cases: null text counts as empty, which still makes one padded unit; equal texts give equal
values; repeated rows give repeated results; an empty table gives an empty one; texts beyond the format's 65,535 x 65,535 picture raise an error; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import arrow_map, utf8

UNIT = 576

# The zigzag order of the format, as row-major positions, from its rule.
ZIGZAG = np.array(
    [8 * r + c for d in range(15) for r, c in sorted(((r, d - r) for r in range(8) if 0 <= d - r < 8), reverse=d % 2 == 0)]
)
# Inverse DCT on whole blocks: kron of the 8-point basis, scaled by 2^20 and rounded to integers.
_B = np.array([[math.sqrt((1 if u == 0 else 2) / 8) * math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)])
IDCT = np.rint(np.kron(_B, _B) * (1 << 20))
#: Blocks transformed at once.
IDCT_BLOCKS = 4096


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """Bytes 255 appended up to a positive multiple of `unit`."""
    n = max(1, -(-len(payload) // unit)) * unit
    return payload + b"\xff" * (n - len(payload))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _scan(components: list[int], ss: int, se: int, ah: int, al: int, data: bytes) -> bytes:
    head = bytes([len(components)]) + b"".join(bytes([c, 0]) for c in components) + bytes([ss, se, ah << 4 | al])
    return _segment(0xDA, head) + data


def _single_symbol_table(kind: int, symbol: int) -> bytes:
    """A Huffman table with one symbol, code 0 of length 1."""
    return _segment(0xC4, bytes([kind << 4, 1] + [0] * 15 + [symbol]))


def _stuffed(data: bytes) -> bytes:
    return data.replace(b"\xff", b"\xff\x00")


def encode_payload(payload: bytes) -> bytes:
    """The payload as coefficients of a progressive JPEG (see the module's text)."""
    units = -(-len(payload) // (6 * 63))
    cols = math.isqrt(max(units - 1, 0)) + 1
    rows = -(-units // cols) or 1
    if max(cols, rows) * 16 > 65535:
        raise ValueError("payload is beyond the largest picture of the format")
    blocks = rows * cols * 6
    raw = np.full(blocks * 63, 255, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    raw = raw.reshape(blocks, 63)
    n_y = rows * cols * 4
    parts = {1: raw[:n_y], 2: raw[n_y : n_y + rows * cols], 3: raw[n_y + rows * cols :]}
    out = [b"\xff\xd8", _segment(0xFE, b"payload " + str(len(payload)).encode())]
    out.append(_segment(0xDB, b"\x00" + b"\x01" * 64))
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, rows * 16, cols * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    out.append(_single_symbol_table(0, 0))
    # DC carries nothing: difference 0, one bit a block
    out.append(_scan([1, 2, 3], 0, 0, 0, 0, _stuffed(np.packbits(np.concatenate([np.zeros(blocks, np.uint8), np.ones(-blocks % 8, np.uint8)])).tobytes())))
    out.append(_single_symbol_table(1, 0x07))
    for c, part in parts.items():
        first = part >> 2 | 0x40
        out.append(_scan([c], 1, 15, 0, 2, first[:, :15].tobytes()))
        out.append(_scan([c], 16, 63, 0, 2, first[:, 15:].tobytes()))
    out.append(_single_symbol_table(1, 0x00))
    for bit in (1, 0):
        for c, part in parts.items():
            bits = np.zeros((len(part), 64), np.uint8)
            bits[:, 1:] = part >> bit & 1
            out.append(_scan([c], 1, 63, bit + 1, bit, _stuffed(np.packbits(bits, axis=1).tobytes())))
    out.append(b"\xff\xd9")
    return b"".join(out)


class _Bits:
    """Bit reader over one entropy-coded segment; beyond its end it gives zeros."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data, 0, 0, 0

    def get(self, k: int) -> int:
        while self.n < k:
            chunk = self.data[self.at : self.at + 8]
            self.at += 8
            self.acc = (self.acc & ((1 << self.n) - 1)) << 64 | int.from_bytes(chunk.ljust(8, b"\0"), "big")
            self.n += 64
        self.n -= k
        return self.acc >> self.n & ((1 << k) - 1)

    def symbol(self, table: dict) -> int:
        code = 1  # a leading 1 keeps codes of different lengths apart
        for _ in range(16):
            code = code << 1 | self.get(1)
            if code in table:
                return table[code]
        raise ValueError("bad Huffman code")

    def signed(self, size: int) -> int:
        if not size:
            return 0
        v = self.get(size)
        return v if v >> (size - 1) else v - (1 << size) + 1


class Jpeg:
    """A progressive JPEG, decoded scan by scan into `coefficients[component]` (rows, cols, 64 in zigzag order)."""

    def __init__(self, data: bytes, fast: bool = True):
        self.fast, self.tables, self.quant, self.comments = fast, {}, {}, []
        self.restart, self.eobrun = 0, 0
        at = 2
        if data[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG")
        while at < len(data):
            marker = data[at + 1]
            if marker == 0xD9:
                return
            length = struct.unpack_from(">H", data, at + 2)[0]
            body, at = data[at + 4 : at + 2 + length], at + 2 + length
            if marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xDB:
                self._read_quant(body)
            elif marker == 0xC4:
                self._read_huffman(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xC2:
                self._read_frame(body)
            elif marker in (0xC0, 0xC1, 0xC3, *range(0xC5, 0xD0)):
                raise ValueError("only progressive Huffman pictures of 8 bits are read")
            elif marker == 0xDA:
                end = at
                while True:  # up to the next marker that is neither stuffing nor a restart
                    end = data.index(b"\xff", end)
                    if data[end + 1] == 0 or 0xD0 <= data[end + 1] <= 0xD7:
                        end += 2
                    else:
                        break
                self._scan(body, data[at:end])
                at = end
        raise ValueError("no end of image")

    def _read_quant(self, body: bytes) -> None:
        while body:
            wide, k = body[0] >> 4, body[0] & 15
            size = 128 if wide else 64
            self.quant[k] = np.frombuffer(body[1 : 1 + size], ">u2" if wide else np.uint8).astype(np.int64)
            body = body[1 + size :]

    def _read_huffman(self, body: bytes) -> None:
        while body:
            key, counts = body[0], body[1:17]
            symbols, table, code, k = body[17 : 17 + sum(counts)], {}, 0, 0
            for length, count in enumerate(counts, 1):
                for _ in range(count):
                    table[1 << length | code] = symbols[k]
                    code, k = code + 1, k + 1
                code <<= 1
            self.tables[key] = table
            body = body[17 + len(symbols) :]

    def _read_frame(self, body: bytes) -> None:
        bits, self.height, self.width, n = struct.unpack_from(">BHHB", body)
        if bits != 8:
            raise ValueError("only 8-bit samples are read")
        self.components = {}
        for i in range(n):
            c, hv, q = body[6 + 3 * i : 9 + 3 * i]
            self.components[c] = (hv >> 4, hv & 15, q)
        self.hmax = max(h for h, _, _ in self.components.values())
        self.vmax = max(v for _, v, _ in self.components.values())
        self.mcu_cols = -(-self.width // (8 * self.hmax))
        self.mcu_rows = -(-self.height // (8 * self.vmax))
        self.coefficients = {c: np.zeros((self.mcu_rows * v, self.mcu_cols * h, 64), np.int32) for c, (h, v, _) in self.components.items()}

    def _scan(self, body: bytes, data: bytes) -> None:
        n = body[0]
        chosen = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(n)]
        ss, se, a = body[1 + 2 * n : 4 + 2 * n]
        ah, al = a >> 4, a & 15
        if n == 1:
            c, dc, ac = chosen[0]
            h, v, _ = self.components[c]
            rows = -(-(-(-self.height * v // self.vmax)) // 8)
            cols = -(-(-(-self.width * h // self.hmax)) // 8)
            if self._fixed_stride(c, rows, cols, ss, se, ah, al, ac, data):
                return
            order = [[(c, dc, ac, r, k)] for r in range(rows) for k in range(cols)]
        else:
            if self._empty_dc([self.tables[dc] for _, dc, _ in chosen], ss, se, ah):
                return
            order = [
                [(c, dc, ac, r * v + y, k * h + x) for c, dc, ac in chosen for h, v, _ in [self.components[c]] for y in range(v) for x in range(h)]
                for r in range(self.mcu_rows)
                for k in range(self.mcu_cols)
            ]
        pieces = self._pieces(data)
        for start in range(0, len(order), self.restart or len(order)):
            bits, previous = _Bits(next(pieces)), dict.fromkeys(self.components, 0)
            self.eobrun = 0
            for unit in order[start : start + (self.restart or len(order))]:
                for c, dc, ac, r, k in unit:
                    block = self.coefficients[c][r, k]
                    if ss == 0:
                        if ah:
                            block[0] |= bits.get(1) << al
                        else:
                            previous[c] += bits.signed(bits.symbol(self.tables[dc]))
                            block[0] = previous[c] << al
                    elif ah:
                        self._refine(bits, self.tables[16 + ac], block, ss, se, al)
                    else:
                        self._first(bits, self.tables[16 + ac], block, ss, se, al)

    @staticmethod
    def _pieces(data: bytes) -> Iterator[bytes]:
        """Entropy-coded segments between restart markers, without stuffing."""
        start = at = 0
        while (at := data.find(b"\xff", at)) >= 0:
            if 0xD0 <= data[at + 1] <= 0xD7:
                yield data[start:at].replace(b"\xff\x00", b"\xff")
                start = at + 2
            at += 2
        yield data[start:].replace(b"\xff\x00", b"\xff")

    def _empty_dc(self, tables: list[dict], ss: int, se: int, ah: int) -> bool:
        """A first DC scan whose only symbol is difference 0 leaves all DC at 0."""
        return self.fast and ss == se == ah == 0 and all(t == {2: 0} for t in tables)

    def _fixed_stride(self, c: int, rows: int, cols: int, ss: int, se: int, ah: int, al: int, ac: int, data: bytes) -> bool:
        """Scans whose table holds one symbol with code 0, read as arrays; False if this is not such a scan."""
        table = self.tables.get(16 + ac, {})
        if not self.fast or ss == 0 or self.restart or len(table) != 1 or 2 not in table:
            return False
        target, width = self.coefficients[c][:rows, :cols, ss : se + 1], se - ss + 1
        if not ah and table[2] >> 4 == 0 and table[2] == 7:
            raw = np.frombuffer(data, np.uint8)[: rows * cols * width].reshape(rows, cols, width)
            size = raw.astype(np.int32) & 127
            target[...] = np.where(size >> 6, size, size - 127) << al
            return True
        if ah and table[2] == 0 and width == 63 and (target != 0).all():
            raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff"), np.uint8)[: rows * cols * 8]
            bits = np.unpackbits(raw.reshape(rows, cols, 8), axis=2)[:, :, 1:].astype(np.int32)
            target += np.where(target > 0, bits, -bits) << al
            return True
        return False

    def _first(self, bits: _Bits, table: dict, block: np.ndarray, k: int, se: int, al: int) -> None:
        if self.eobrun:
            self.eobrun -= 1
            return
        while k <= se:
            symbol = bits.symbol(table)
            run, size = symbol >> 4, symbol & 15
            if size:
                k += run
                block[k] = bits.signed(size) * (1 << al)
                k += 1
            elif run == 15:
                k += 16
            else:
                self.eobrun = (1 << run) + bits.get(run) - 1
                return

    def _refine(self, bits: _Bits, table: dict, block: np.ndarray, k: int, se: int, al: int) -> None:
        one = 1 << al

        def correct(k: int) -> None:
            if bits.get(1) and not abs(int(block[k])) & one:
                block[k] += one if block[k] > 0 else -one

        if not self.eobrun:
            while k <= se:
                symbol = bits.symbol(table)
                run, size = symbol >> 4, symbol & 15
                value = 0
                if size:
                    value = one if bits.get(1) else -one
                elif run < 15:
                    self.eobrun = (1 << run) + bits.get(run)
                    break
                while k <= se:
                    if block[k]:
                        correct(k)
                    elif run:
                        run -= 1
                    else:
                        if value:
                            block[k] = value
                        k += 1
                        break
                    k += 1
        if self.eobrun:
            for k in range(k, se + 1):
                if block[k]:
                    correct(k)
            self.eobrun -= 1

    def plane(self, c: int) -> np.ndarray:
        """Samples of a component at its own resolution, 0 to 255."""
        _, _, q = self.components[c]
        rows, cols, _ = self.coefficients[c].shape
        flat = self.coefficients[c].reshape(-1, 64)
        out = np.empty((len(flat), 64), np.uint8)
        steps = self.quant[q]
        for a in range(0, len(flat), IDCT_BLOCKS):
            part = np.zeros((len(flat[a : a + IDCT_BLOCKS]), 64))
            part[:, ZIGZAG] = flat[a : a + IDCT_BLOCKS] * steps
            out[a : a + IDCT_BLOCKS] = np.clip(np.floor((part @ IDCT + (1 << 19)) / (1 << 20)) + 128, 0, 255)
        return out.reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor (height, width, 3) of bytes; one component gives grey."""
        planes = []
        for c, (h, v, _) in self.components.items():
            p = self.plane(c).repeat(self.vmax // v, axis=0).repeat(self.hmax // h, axis=1)
            planes.append(p[: self.height, : self.width].astype(np.int32))
        if len(planes) == 1:
            return np.repeat(planes[0][:, :, None], 3, axis=2).astype(np.uint8)
        y, cb, cr = planes[0], planes[1] - 128, planes[2] - 128
        # The format's colour matrix in 16-bit fixed point.
        r = y + ((91881 * cr + 32768) >> 16)
        g = y - ((22554 * cb + 46802 * cr + 32768) >> 16)
        b = y + ((116130 * cb + 32768) >> 16)
        return np.clip(np.stack([r, g, b], axis=2), 0, 255).astype(np.uint8)

    def payload(self) -> bytes:
        """What encode_payload stored."""
        size = next(int(c.split()[1]) for c in self.comments if c.startswith(b"payload "))
        flat = np.concatenate([self.coefficients[c][:, :, 1:].ravel() for c in (1, 2, 3)])
        return (flat - 256).astype(np.uint8)[:size].tobytes()


def features(rgb: np.ndarray) -> str:
    """Size, channel means and variances (thousandths, from integer sums) and the mean step between rows."""
    n = rgb.shape[0] * rgb.shape[1]
    flat = rgb.reshape(-1, 3)
    sums = flat.sum(axis=0, dtype=np.int64)
    squares = [int((flat[:, i].astype(np.uint16) ** 2).sum(dtype=np.int64)) for i in range(3)]
    means = [int(s) * 1000 // n for s in sums]
    variances = [(q * n - int(s) ** 2) * 1000 // (n * n) for q, s in zip(squares, sums)]
    green = rgb[:, :, 1].astype(np.int16)
    step = int(np.abs(np.diff(green, axis=0)).sum(dtype=np.int64)) * 1000 // n
    return f"{rgb.shape[1]}x{rgb.shape[0]};mean={','.join(map(str, means))};var={','.join(map(str, variances))};step={step}"


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_media: bool = True, with_tensor: bool = False) -> DataFrame:
    """Per row the stored picture and what is read back from it.

    Columns: id_col, n_bytes, payload (read back), media (with_media), feature, and with_tensor
    tensor (full-resolution RGB bytes), height, width. Without media: digests of both instead.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {id_type}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    if with_media:
        schema += ", payload binary, media binary"
    if with_tensor:
        schema += ", tensor binary, height int, width int"

    def one(text: bytes) -> dict:
        media = encode_payload(padded(text))
        picture = Jpeg(media)
        back, rgb = picture.payload(), picture.rgb()
        row = {
            "n_bytes": len(text), "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(),
            "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": features(rgb),
        }
        if with_media:
            row |= {"payload": back, "media": media}
        if with_tensor:
            row |= {"tensor": rgb.tobytes(), "height": rgb.shape[0], "width": rgb.shape[1]}
        return row

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        heavy = with_media or with_tensor
        for batch in batches:
            size = 16 if heavy else max(1, batch.num_rows)
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                rows = [one(t or b"") for t in utf8(part.column(1))]
                yield {id_col: part.column(0)} | {k: [r[k] for r in rows] for k in rows[0]}

    return arrow_map(docs.select(id_col, text_col), step, schema)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_media=False)
