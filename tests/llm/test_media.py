import hashlib
import random
import struct
import zlib

import pytest

from quirekit.llm import op1_matroska as mkv


def test_query(make, saved, spark):
    texts = [None, "", "a", "é" * 32, "x" * 64, "y" * 100_000, "日本" * 70_000]
    got = {r["doc_id"]: r for r in mkv.op1_matroska(spark, saved(documents=make([*enumerate(texts), (1, "")]))).collect()}
    for i, t in enumerate(texts):
        body = (t or "").encode()
        payload = body + b"\0" * (-len(body) % 64) if body else b"\0" * 64
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(body), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        assert r["media_sha256"] == hashlib.sha256(mkv.store(payload)).hexdigest()
    assert got[0]["media_sha256"] == got[1]["media_sha256"]
    assert mkv.op1_matroska(spark, saved(documents=make([]))).count() == 0


def test_round_trip_of_all_sizes():
    rng = random.Random(1)
    for n in [*range(1, 40), *(rng.randrange(1, 4000) for _ in range(40))]:
        payload = rng.randbytes(64 * n)
        media = mkv.store(payload)
        found = mkv.parse(media)
        assert mkv.payload_of(media, found) == payload
        assert found["tracks"][1]["codec"] == "A_PCM/INT/LIT" and {c[2] for c in found["cues"]} == set(found["clusters"])
        times = [p[1] for p in found["packets"]]
        assert times == sorted(times)


class Reader:
    """A second reader, written for the files that ``store`` makes: a cursor over known sizes, nothing shared with the module."""

    def __init__(self, data):
        self.data, self.at = data, 0

    def vint(self, marked):
        width = 1
        while not self.data[self.at] & (0x100 >> width):
            width += 1
        value = int(self.data[self.at : self.at + width].hex(), 16)
        self.at += width
        return value if marked else value - (1 << (7 * width)), width

    def children(self, end):
        while self.at < end:
            ident, _ = self.vint(True)
            size, _ = self.vint(False)
            stop = self.at + size
            yield ident, stop
            self.at = stop

    def packets(self):
        out = []
        for ident, stop in self.children(len(self.data)):
            if ident == 0x18538067:
                for inner, until in self.children(stop):
                    if inner == 0x1F43B675:
                        clock = 0
                        for leaf, last in self.children(until):
                            if leaf == 0xE7:
                                clock = int(self.data[self.at : last].hex(), 16)
                            elif leaf == 0xA3:
                                out += self.block(clock, last)
        return out

    def block(self, clock, last):
        track, _ = self.vint(False)
        moment = int.from_bytes(self.data[self.at : self.at + 2], "big", signed=True)
        flags = self.data[self.at + 2]
        self.at += 3
        kind, sizes = (flags & 6) >> 1, []
        if kind:
            count = self.data[self.at] + 1
            self.at += 1
        if kind == 1:
            for _ in range(count - 1):
                sizes.append(0)
                while True:
                    self.at += 1
                    sizes[-1] += self.data[self.at - 1]
                    if self.data[self.at - 1] < 255:
                        break
        elif kind == 3:
            for i in range(count - 1):
                value, width = self.vint(False)
                sizes.append(value if i == 0 else sizes[-1] + value - (2 ** (7 * width - 1) - 1))
        elif kind == 2:
            sizes = [(last - self.at) // count] * (count - 1)
        sizes.append(last - self.at - sum(sizes))
        out = []
        for size in sizes:
            out.append((track, (clock + moment) * 1_000_000, self.at, size, bool(flags & 128), kind))
            self.at += size
        return out


@pytest.mark.parametrize("size", [64, 512, 576, 4096, 4160, 64 * 777, 300_032])
def test_against_a_second_reader(size):
    payload = random.Random(size).randbytes(size)
    media = mkv.store(payload)
    found = mkv.parse(media)["packets"]
    assert found == Reader(media).packets() and {p[5] for p in found} <= {0, 1, 2, 3}
    assert b"".join(media[a : a + n] for _, _, a, n, _, _ in found) == payload


def test_a_file_written_by_hand():
    media = bytes.fromhex(
        "1a45dfa3 87 4282 84 7765626d"  # header: webm
        "18538067 01ffffffffffffff"  # segment of unknown size
        "1549a966 4007 2ad7b1 83 0f4240"  # info: scale, its size in two bytes
        "ec 82 0000"  # void
        "1654ae6b 8f ae 8d d7 81 02 83 81 01 86 85 565f565038"  # a video track, number 2, V_VP8
        "1f43b675 10000026 e7 81 0a"  # cluster at 10, its size in four bytes
        "a3 8d 82 0005 86 02 81 bf 61 6161 62 6263"  # simple block: EBML lacing of 1, 1 and the rest
        "a0 92 a1 87 82 fffe 00 7a7a7a 9b 81 03 fb 81 ff"  # block group, refers back
    )
    # Sizes of the last cluster's children: 3 + 14 + 2 + 15.
    at = media.index(bytes.fromhex("10000026"))
    rest = len(media) - at - 4
    media = media[:at] + (0x10000000 | rest).to_bytes(4, "big") + media[at + 4 :]
    group = media.index(bytes.fromhex("a092"))
    media = media[: group + 1] + bytes([0x80 | len(media) - group - 2]) + media[group + 2 :]
    found = mkv.parse(media)
    assert found["doc_type"] == "webm" and found["tracks"][2]["codec"] == "V_VP8" and found["tracks"][2]["type"] == 1
    assert [(p[0], p[1], media[p[2] : p[2] + p[3]], p[4], p[5]) for p in found["packets"]] == [
        (2, 15_000_000, b"a", True, 3), (2, 15_000_000, b"a", True, 3), (2, 15_000_000, b"abbc", True, 3), (2, 8_000_000, b"zzz", False, 0),
    ]


@pytest.mark.parametrize("n", [0, 1, 126, 127, 128, 16382, 16383, 2**21, 2**35])
def test_variable_length_numbers(n):
    body = mkv._vint(n)
    assert mkv._number(body, 0, len(body), False) == (n, len(body))


@pytest.mark.parametrize("turn", [0, 1, 2])
def test_lacing(turn):
    frames = [bytes([i]) * n for i, n in enumerate((3, 700, 255, 1, 9000, 12))]
    code, head = mkv._lace(frames, turn)
    body = head + b"".join(frames)
    assert [body[a:b] for a, b in mkv._frames(body, 0, len(body), code)] == frames


def test_unknown_sizes_and_block_groups():
    e, u = mkv._element, mkv._uint
    block = e(mkv.BLOCK_GROUP, e(mkv.BLOCK, b"\x81\x00\x05\x00" + b"abc") + u(mkv.BLOCK_DURATION, 9))
    later = e(mkv.BLOCK_GROUP, e(mkv.BLOCK, b"\x81\x00\x06\x00" + b"de") + e(mkv.REFERENCE_BLOCK, b"\xff"))
    cluster = lambda t, b: struct.pack(">I", mkv.CLUSTER) + b"\x01\xff\xff\xff\xff\xff\xff\xff" + u(mkv.TIMESTAMP, t) + b
    track = e(mkv.TRACKS, e(mkv.TRACK_ENTRY, u(mkv.TRACK_NUMBER, 1) + u(mkv.TRACK_TYPE, 2) + e(mkv.CODEC_ID, b"X")))
    data = e(mkv.EBML, e(mkv.DOC_TYPE, b"webm")) + struct.pack(">I", mkv.SEGMENT) + b"\x01\xff\xff\xff\xff\xff\xff\xff" + track + e(0xEC, b"void") + cluster(10, block) + cluster(20, later)
    found = mkv.parse(data)
    assert [(p[1], data[p[2] : p[2] + p[3]], p[4]) for p in found["packets"]] == [(15_000_000, b"abc", True), (26_000_000, b"de", False)]


def test_damaged_media(spark):
    good = mkv.store(b"q" * 4096)
    rng = random.Random(2)
    rows = [("none", None), ("empty", bytearray()), ("text", bytearray(b"hello")), ("good", bytearray(good))]
    rows += [(f"cut{i}", bytearray(good[: rng.randrange(len(good))])) for i in range(30)]
    for i in range(60):
        bad = bytearray(good)
        bad[rng.randrange(300)] = rng.randrange(256)
        rows.append((f"bad{i}", bad))
    got = mkv.packet_table(spark.createDataFrame(rows, "doc_id string, media binary")).collect()
    kinds = {r["doc_id"]: r["error"] for r in got}
    assert kinds["good"] is None and all(kinds[k] for k in ("none", "empty", "text"))
    assert sum(r["byte_length"] for r in got if r["doc_id"] == "good") == 4096
