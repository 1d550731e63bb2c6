"""MPEG audio columns: a parser of frames, tags and variable-bitrate tables, and a lossless carrier of bytes.

The parser reads ID3v2 and ID3v1 tags, finds frame headers again after foreign bytes (a header counts if it is valid and
another follows where it says the next frame begins, or the audio ends there), reads Xing/Info and VBRI tables, verifies
the CRC-16 of Layer I and III frames that have one (Layer II's covers a length that depends on allocation tables; such
frames count as unchecked), and gives exact durations (samples and rate) and the offset of each frame.

The carrier writes silent MPEG-1 Layer III frames (side information all zero), whose ancillary bytes are the payload.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tarnsearch.llm._bytes import pieces, texts

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1, layer) and (lower versions, layer); Hz of version 1.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)


def crc16(data: bytes) -> int:
    """CRC of MPEG audio: polynomial 0x8005, start 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass(frozen=True)
class Header:
    version: str
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    length: int
    samples: int
    side: int
    joint_bound: int


def read_header(b: bytes, _kept: dict = {}) -> Header | None:  # noqa: B006
    """The header in four bytes, or None. Free-format and reserved values count as invalid."""
    if b in _kept:
        return _kept[b]
    out = None
    if len(b) == 4 and b[0] == 0xFF and b[1] & 0xE0 == 0xE0:
        version = {0: "2.5", 2: "2", 3: "1"}.get(b[1] >> 3 & 3)
        layer = 4 - (b[1] >> 1 & 3)
        rate_at, kbps_at = b[2] >> 2 & 3, b[2] >> 4
        if version and layer < 4 and rate_at < 3 and 0 < kbps_at < 15 and b[3] & 3 != 2:
            first = version == "1"
            kbps = BITRATES[1 if first else 2, layer][kbps_at]
            rate = RATES[rate_at] // {"1": 1, "2": 2, "2.5": 4}[version]
            padding, mono = b[2] >> 1 & 1, b[3] >> 6 == 3
            samples = 384 if layer == 1 else 1152 if layer == 2 or first else 576
            length = (12000 * kbps // rate + padding) * 4 if layer == 1 else samples // 8 * kbps * 1000 // rate + padding
            side = 0 if layer < 3 else (17 if mono else 32) if first else (9 if mono else 17)
            bound = (b[3] >> 4 & 3) * 4 + 4 if b[3] >> 6 == 1 else 32
            out = Header(version, layer, not b[1] & 1, kbps, rate, 1 if mono else 2, length, samples, side, bound)
    if len(_kept) < 4096:
        _kept[b] = out
    return out


@dataclass
class Audio:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    skipped: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    crc_unchecked: int = 0
    table: dict | None = None

    @property
    def rate(self) -> int:
        return self.headers[0].rate if self.headers else 0

    @property
    def seconds(self) -> float:
        return sum(h.samples / h.rate for h in self.headers) if len({h.rate for h in self.headers}) > 1 else self.samples / self.rate if self.rate else 0.0

    @property
    def variable(self) -> bool:
        return len({h.kbps for h in self.headers}) > 1


def _text(raw: bytes) -> str:
    kind, raw = (raw[0], raw[1:]) if raw else (0, raw)
    return raw.decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(kind, "latin-1"), "replace").rstrip("\0")


def _synchsafe(raw: bytes) -> int:
    return sum((x & 127) << (7 * (len(raw) - 1 - i)) for i, x in enumerate(raw))


def read_tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """(tags, where audio begins, where it ends) by ID3v2 at the front and ID3v1 at the end."""
    tags: dict[str, str] = {}
    begin, end = 0, len(data)
    while data[begin : begin + 3] == b"ID3" and begin + 10 <= end:
        major, flags, size = data[begin + 3], data[begin + 5], _synchsafe(data[begin + 6 : begin + 10])
        at, stop = begin + 10, min(begin + 10 + size, end)
        if flags & 0x40 and major >= 3 and at + 4 <= stop:
            extra = data[at : at + 4]
            at += _synchsafe(extra) if major == 4 else int.from_bytes(extra, "big") + 4
        short = major == 2
        while at + (6 if short else 10) <= stop and data[at]:
            name = data[at : at + (3 if short else 4)].decode("latin-1")
            raw = data[at + 3 : at + 6] if short else data[at + 4 : at + 8]
            n = _synchsafe(raw) if major == 4 else int.from_bytes(raw, "big")
            at += 6 if short else 10
            body = data[at : min(at + n, stop)]
            if name in ("TXXX", "TXX"):
                key, _, value = _text(body).partition("\0")
                tags[f"TXXX:{key}"] = value
            elif name[0] == "T":
                tags[name] = _text(body)
            at += n
        begin = min(begin + 10 + size + (10 if flags & 0x10 else 0), end)
    if end - begin >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags[f"v1:{key}"] = value
    return tags, begin, end


def _table(data: bytes, at: int, h: Header) -> dict | None:
    """A Xing, Info or VBRI table in the frame at ``at``."""
    frame = data[at : at + h.length]
    for skip in {4 + h.side, 6 + h.side}:
        kind = frame[skip : skip + 4]
        if kind in (b"Xing", b"Info") and len(frame) >= skip + 8:
            flags, p, out = int.from_bytes(frame[skip + 4 : skip + 8], "big"), skip + 8, {"kind": kind.decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(frame[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(frame[p : p + 100])
            return out
    if frame[36:40] == b"VBRI" and len(frame) >= 62:
        size, frames = struct.unpack(">II", frame[46:54])
        entries, scale, width, per = struct.unpack(">HHHH", frame[54:62])
        toc = [int.from_bytes(frame[62 + i * width : 62 + (i + 1) * width], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_an_entry": per}
    return None


def _checked(data: bytes, at: int, h: Header, kept: dict[bytes, bool]) -> bool | None:
    if h.layer == 2:
        return None
    if h.layer == 3:
        covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]
    else:
        bits = 4 * (h.joint_bound * h.channels + (32 - h.joint_bound))
        covered = data[at + 2 : at + 4] + data[at + 6 : at + 6 + bits // 8]
    key = covered + data[at + 4 : at + 6]
    if key not in kept:
        if len(kept) >= 4096:
            kept.clear()
        kept[key] = crc16(covered) == int.from_bytes(data[at + 4 : at + 6], "big")
    return kept[key]


def parse(data: bytes | None) -> Audio:
    """Parse any bytes; null, empty or foreign bytes give an Audio without frames."""
    data = data or b""
    out = Audio()
    out.tags, at, end = read_tags(data)
    kept: dict[bytes, bool] = {}
    first, synced = True, False
    while at + 4 <= end:
        h = read_header(data[at : at + 4])
        good = h is not None and at + h.length <= end
        if good and not synced:
            after = at + h.length
            good = after + 4 > end or read_header(data[after : after + 4]) is not None
        if not good:
            to = data.find(b"\xff", at + 1, end)
            to = end if to < 0 else to
            out.skipped += to - at
            at, synced = to, False
            continue
        synced = True
        if first and h.layer == 3:
            out.table = _table(data, at, h)
        if h.protected:
            ok = _checked(data, at, h, kept)
            out.crc_good += ok is True
            out.crc_bad += ok is False
            out.crc_unchecked += ok is None
        if not (first and out.table):
            out.offsets.append(at)
            out.headers.append(h)
            out.samples += h.samples
        first = False
        at += h.length
    out.skipped += max(0, end - at)
    return out


# The carrier: MPEG-1 Layer III, 48 kHz, one channel, with CRC. A frame has 3 bytes for each kbit/s.
_OVERHEAD = 4 + 2 + 17


def _head(kbps: int) -> bytes:
    header = bytes([0xFF, 0xFA, BITRATES[1, 3].index(kbps) << 4 | 1 << 2, 0xC0])
    return header + crc16(header[2:] + bytes(17)).to_bytes(2, "big") + bytes(17)


_HEADS = {kbps: _head(kbps) for kbps in BITRATES[1, 3][1:]}


def carry(payload: bytes) -> bytes:
    """Payload as an MPEG stream: an ID3v2 tag with its length, a Xing frame, full frames at 320, a last one that fits."""
    room = 960 - _OVERHEAD
    full, rest = divmod(len(payload), room)
    frames = np.empty((full, 960), dtype=np.uint8)
    frames[:, :_OVERHEAD] = np.frombuffer(_HEADS[320], np.uint8)
    frames[:, _OVERHEAD:] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    last = b""
    if rest:
        kbps = next(x for x in BITRATES[1, 3][1:] if 3 * x - _OVERHEAD >= rest)
        last = (_HEADS[kbps] + payload[full * room :]).ljust(3 * kbps, b"\0")
    body = b"\x03PAYLOAD\0" + str(len(payload)).encode()
    safe = lambda n: bytes(n >> s & 127 for s in (21, 14, 7, 0))
    frame = b"TXXX" + safe(len(body)) + b"\0\0" + body
    tag = b"ID3\x04\0\0" + safe(len(frame)) + frame
    size = 192 + full * 960 + len(last)
    bounds = np.minimum(np.arange(100) * (full + (rest > 0)) // 100, full) * 960 + 192
    toc = bytes((bounds * 256 // size).astype(np.uint8).tolist())
    table = (_HEADS[64] + b"Xing" + struct.pack(">III", 7, full + (rest > 0), size) + toc).ljust(192, b"\0")
    return tag + table + frames.tobytes() + last


def carried(data: bytes, audio: Audio) -> bytes:
    """The payload in a stream of carry(), from the frames that the parser found."""
    want, got = int(audio.tags.get("TXXX:PAYLOAD", 0)), bytearray()
    for at, h in zip(audio.offsets, audio.headers, strict=True):
        got += data[at + 6 + h.side : at + h.length]
    return bytes(got[:want])


def feature(audio: Audio) -> str:
    """A summary of what was parsed, with a digest of the seek offsets."""
    seek = zlib.crc32(np.asarray(audio.offsets, dtype="<i8").tobytes())
    h = audio.headers[0] if audio.headers else None
    kind = f"mpeg{h.version}-layer{h.layer},{h.rate}Hz,{h.channels}ch" if h else "none"
    return f"{kind},frames={len(audio.offsets)},samples={audio.samples},crc={audio.crc_good}/{audio.crc_bad},skipped={audio.skipped},vbr={int(audio.variable)},seek={seek:08x}"


AUDIO_SCHEMA = "n_frames long, n_samples long, rate int, seconds double, seek_offsets array<long>, crc_good long, crc_bad long, crc_unchecked long, skipped long, table_kind string, table_frames long, tags map<string,string>"


def parse_column(df: DataFrame, media: str = "media", keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns ``keep`` and what AUDIO_SCHEMA says, for each row's bytes in ``media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(x.as_py()) for x in batch.column(batch.schema.get_field_index("__media"))]
            cols = [batch.column(i) for i in range(len(keep))] + [
                pa.array([len(a.offsets) for a in found], pa.int64()),
                pa.array([a.samples for a in found], pa.int64()),
                pa.array([a.rate for a in found], pa.int32()),
                pa.array([a.seconds for a in found], pa.float64()),
                pa.array([a.offsets for a in found], pa.list_(pa.int64())),
                pa.array([a.crc_good for a in found], pa.int64()),
                pa.array([a.crc_bad for a in found], pa.int64()),
                pa.array([a.crc_unchecked for a in found], pa.int64()),
                pa.array([a.skipped for a in found], pa.int64()),
                pa.array([a.table and a.table["kind"] for a in found], pa.string()),
                pa.array([a.table and a.table.get("frames") for a in found], pa.int64()),
                pa.array([list(a.tags.items()) for a in found], pa.map_(pa.string(), pa.string())),
            ]
            yield pa.RecordBatch.from_arrays(cols, [*keep, *(x.split()[0] for x in AUDIO_SCHEMA.split(", "))])

    kinds = dict(df.dtypes)
    chosen = df.select(*keep, df[media].alias("__media"))
    return chosen.mapInArrow(run, ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), AUDIO_SCHEMA]))


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8 bytes, with zeros up to a positive multiple of 64, as an MPEG stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in pieces(batch, "text"):
                raw, off = texts(part.column(1))
                raw, media = raw.tobytes(), []
                for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    n = max(64, -(-(b - a) // 64) * 64)
                    media.append(carry(raw[a:b].ljust(n, b"\0")))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(off)), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return df.select(df[id_col].cast("long").alias("doc_id"), df[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read_back(stored: DataFrame) -> DataFrame:
    """The digest of each stored stream: what the parser and the carried bytes give. Equal texts give equal rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for x in batch.column(2):
                data = x.as_py()
                audio = parse(data)
                payload = carried(data, audio)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(audio), len(audio.offsets), audio.seconds, audio.crc_good, audio.crc_bad))
            cols = list(zip(*rows, strict=True)) or [()] * 10
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "seconds", "crc_good", "crc_bad"]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames long, seconds double, crc_good long, crc_bad long"
    return stored.mapInArrow(run, schema)


def text_audio(docs: DataFrame) -> DataFrame:
    """Store all texts as streams, read them back, digest them."""
    return read_back(store_texts(docs))
