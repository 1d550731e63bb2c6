import hashlib
import random
import zlib

from tarnsearch.llm import audio


def test_texts_come_back(edge, edge_rows):
    got = audio.text_audio(edge).collect()
    assert len(got) == len(edge_rows)
    want = []
    for i, t, _ in edge_rows:
        raw = (t or "").encode()
        p = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        want.append((i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:5]) for r in got)
    assert all(r["crc_bad"] == 0 and r["media_bytes"] > r["payload_bytes"] for r in got)


def test_payloads_with_false_headers_and_of_all_sizes():
    rng = random.Random(3)
    for n in (0, 64, 128, 896, 937, 960, 1024, 5000, 20_032):
        payload = bytes(rng.choice(b"\xff\xfb\xfa\x90\x00ID3TAG") for _ in range(n))
        data = audio.carry(payload)
        found = audio.parse(data)
        assert audio.carried(data, found) == payload
        assert found.table["kind"] == "Xing" and found.table["frames"] == len(found.offsets) and found.skipped == 0
        assert found.samples == 1152 * len(found.offsets) and found.seconds == found.samples / 48000


def test_resynchronisation_checksums_and_tags():
    data = audio.carry(bytes(range(256)) * 16)
    clean = audio.parse(data)
    noise = b"\xff\xfbnoise\xff" * 5
    assert len(audio.parse(noise + data[data.index(b"\xff\xfa") :]).offsets) == len(clean.offsets)
    at = clean.offsets[1]
    broken = data[:at] + noise + data[at:]
    found = audio.parse(broken)
    assert found.skipped == len(noise) and len(found.offsets) == len(clean.offsets)
    flipped = bytearray(data)
    flipped[at + 4] ^= 1
    assert audio.parse(bytes(flipped)).crc_bad == 1
    tagged = audio.parse(data + b"TAG" + b"Title".ljust(30, b"\0") + bytes(95))
    assert tagged.tags["v1:title"] == "Title" and len(tagged.offsets) == len(clean.offsets)
    for junk in (None, b"", b"\xff", b"ID3", b"no audio at all" * 9):
        assert audio.parse(junk).offsets == []


def test_known_headers():
    h = audio.read_header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    assert (h.version, h.layer, h.kbps, h.rate, h.length, h.samples, h.side) == ("1", 3, 128, 44100, 417, 1152, 32)
    h = audio.read_header(bytes([0xFF, 0xF3, 0x80, 0xC0]))
    assert (h.version, h.kbps, h.rate, h.length, h.samples, h.side) == ("2", 64, 22050, 208, 576, 9)
    assert audio.read_header(bytes([0xFF, 0xFB, 0xF0, 0x00])) is None


def test_parsed_column(spark):
    rows = spark.createDataFrame([(1, bytearray(audio.carry(b"x" * 2000))), (2, None)], "id long, media binary")
    got = {r["id"]: r for r in audio.parse_column(rows, "media", ("id",)).collect()}
    assert got[1]["n_frames"] == len(got[1]["seek_offsets"]) == 3 and got[2]["n_frames"] == 0
