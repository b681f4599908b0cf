"""Media columns: Matroska. Elements with variable-length ids and sizes, clusters, lacing and cues become packet tables.

``store`` writes bytes as 8-bit PCM samples into a Matroska file; ``parse`` reads any Matroska bytes into tracks, packets
(track, timestamp, byte range, keyframe, lacing) and cues, without copying payloads. One row is one file, so tasks need memory for
one text at a time.

Defined results: a null or empty text stores one block of 64 zero bytes; media that can't be parsed gives no packets and an
``error`` text, never a failure; unknown element sizes, unknown elements, void and checksum elements are handled; repeated rows repeat.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, tuned
from .words import sliced, text_bytes

# Element ids of the Matroska and EBML specifications.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
DOC_TYPE, TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x4282, 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83
CODEC_ID, FLAG_LACING, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x86, 0x9C, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER, CUE_RELATIVE = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0

#: Samples a second of the stored track, bytes of a frame, frames of a block, blocks of a cluster.
RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 16
UNIT = 64
_TOP = frozenset((EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES))


class MediaError(ValueError):
    """Bytes that aren't a Matroska file."""


def _vint(value: int) -> bytes:
    """A size in as few bytes as hold it; all ones is kept for "unknown"."""
    n = 1
    while value >= (1 << 7 * n) - 1:
        n += 1
    return (value | 1 << 7 * n).to_bytes(n, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _vint(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return _element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(frames: list[bytes], turn: int) -> tuple[int, bytes]:
    """Lacing code and header of a block's frames: none, or fixed, EBML and Xiph in turn where the sizes allow."""
    sizes = [len(f) for f in frames]
    if len(frames) == 1:
        return 0, b""
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1 and turn % 3 == 0:
        return 2, head
    if turn % 3 == 2:
        return 1, head + b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    out = _vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1], strict=False):
        step, n = b - a, 1
        while not -(1 << 7 * n - 1) < step < (1 << 7 * n - 1):
            n += 1
        out += ((step + (1 << 7 * n - 1) - 1) | 1 << 7 * n).to_bytes(n, "big")
    return 3, head + out


def store(payload: bytes) -> bytes:
    """A Matroska file whose one audio track holds ``payload`` as unsigned 8-bit samples, with cues to each cluster."""
    out = [_element(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))]
    audio = _element(AUDIO, _element(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio
    body = [
        _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + _element(0x4D80, b"quirekit") + _element(0x5741, b"quirekit")),
        _element(TRACKS, _element(TRACK_ENTRY, entry)),
    ]
    at, cues, turn = sum(map(len, body)), [], 0
    step = FRAME * LACED
    for start in range(0, len(payload), step * BLOCKS):
        begin = start * 1000 // RATE
        blocks = [_uint(TIMESTAMP, begin)]
        for low in range(start, min(start + step * BLOCKS, len(payload)), step):
            chunk = payload[low : low + step]
            frames = [chunk[i : i + FRAME] for i in range(0, len(chunk), FRAME)]
            code, head = _lace(frames, turn)
            turn += 1
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", low * 1000 // RATE - begin, 0x80 | code << 1) + head + chunk))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, begin) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at) + _uint(CUE_RELATIVE, len(blocks[0])))))
        body.append(_element(CLUSTER, b"".join(blocks)))
        at += len(body[-1])
    body.append(_element(CUES, b"".join(cues)))
    out.append(_element(SEGMENT, b"".join(body)))
    return b"".join(out)


def _number(data: bytes, at: int, end: int, keep: bool) -> tuple[int, int]:
    """A variable-length number and where it ends; ``keep`` leaves the length marker in (ids). All ones gives -1."""
    if at >= end:
        raise MediaError("number past the end")
    n = 9 - data[at].bit_length()
    if n > 8 or at + n > end:
        raise MediaError(f"bad number at {at}")
    value = int.from_bytes(data[at : at + n], "big")
    if keep:
        return value, at + n
    value &= (1 << 7 * n) - 1
    return (-1 if value == (1 << 7 * n) - 1 else value), at + n


def elements(data: bytes, at: int, end: int, inside: int = 0):
    """(id, start of the element, start of its body, end of its body) of each child between two offsets.

    A body of unknown size ends where an element of the same or a higher level begins."""
    while at < end:
        start = at
        ident, at = _number(data, at, end, True)
        size, at = _number(data, at, end, False)
        if size < 0:
            stop = at
            while stop < end:
                child, after = _number(data, stop, end, True)
                if ident == SEGMENT and child == EBML or ident == CLUSTER and child in _TOP:
                    break
                length, after = _number(data, after, end, False)
                if length < 0:
                    stop = end
                    break
                stop = after + length
            size = min(stop, end) - at
        if at + size > end:
            raise MediaError(f"element {ident:#x} at {start} passes its parent's end")
        yield ident, start, at, at + size
        at += size


def _unsigned(data: bytes, low: int, high: int) -> int:
    if high - low > 8:
        raise MediaError(f"integer of {high - low} bytes at {low}")
    return int.from_bytes(data[low:high], "big")


def _real(data: bytes, low: int, high: int) -> float:
    return {4: lambda: struct.unpack(">f", data[low:high])[0], 8: lambda: struct.unpack(">d", data[low:high])[0]}.get(high - low, lambda: 0.0)()


def _frames(data: bytes, at: int, end: int, code: int) -> list[tuple[int, int]]:
    """Byte ranges of a block's frames by its lacing: none, Xiph, fixed size or EBML."""
    if code == 0:
        return [(at, end)]
    if at >= end:
        raise MediaError("lacing past the block's end")
    count, at, sizes = data[at] + 1, at + 1, []
    if code == 2:
        if (end - at) % count:
            raise MediaError("fixed lacing doesn't divide the block")
        sizes = [(end - at) // count] * count
    elif code == 1:
        for _ in range(count - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise MediaError("lacing past the block's end")
            sizes.append(size + data[at])
            at += 1
    else:
        size, at = _number(data, at, end, False)
        sizes.append(size)
        for _ in range(count - 2):
            first = at
            step, at = _number(data, at, end, True)
            n = at - first
            size += (step & (1 << 7 * n) - 1) - ((1 << 7 * n - 1) - 1)
            sizes.append(size)
        sizes = sizes[: count - 1]
    if code != 2:
        sizes.append(end - at - sum(sizes))
    out = []
    for size in sizes:
        if size < 0 or at + size > end:
            raise MediaError("frame passes the block's end")
        out.append((at, at + size))
        at += size
    return out


def parse(data: bytes) -> dict:
    """Tracks, packets and cues of a Matroska file; timestamps in nanoseconds, byte ranges from the file's start."""
    tracks: dict[int, dict] = {}
    packets: list[tuple[int, int, int, int, bool, int]] = []
    found = {"tracks": tracks, "packets": packets, "cues": [], "clusters": [], "scale": 1_000_000, "duration": 0.0, "doc_type": ""}
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise MediaError("no EBML header")
    for ident, _, low, high in elements(data, top[0][2], top[0][3]):
        if ident == DOC_TYPE:
            found["doc_type"] = data[low:high].rstrip(b"\0").decode("ascii", "replace")

    def block(low: int, high: int, base: int, simple: bool, key: bool) -> None:
        track, at = _number(data, low, high, False)
        if at + 3 > high:
            raise MediaError("short block")
        moment, flags = struct.unpack_from(">hB", data, at)
        code = flags >> 1 & 3
        if not -(1 << 63) <= (base + moment) * found["scale"] < 1 << 63:
            raise MediaError("timestamp out of range")
        for a, b in _frames(data, at + 3, high, code):
            packets.append((track, (base + moment) * found["scale"], a, b - a, bool(flags & 0x80) if simple else key, code))

    for ident, _, first, last in top[1:]:
        if ident != SEGMENT:
            continue
        for ident, start, low, high in elements(data, first, last):
            if ident == INFO:
                for x, _, a, b in elements(data, low, high):
                    if x == TIMESTAMP_SCALE:
                        found["scale"] = _unsigned(data, a, b)
                    elif x == DURATION:
                        found["duration"] = _real(data, a, b)
            elif ident == TRACKS:
                for x, _, a, b in elements(data, low, high):
                    if x == TRACK_ENTRY:
                        own = {y: (c, d) for y, _, c, d in elements(data, a, b)}
                        sound = {y: (c, d) for y, _, c, d in elements(data, *own[AUDIO])} if AUDIO in own else {}
                        number = _unsigned(data, *own[TRACK_NUMBER]) if TRACK_NUMBER in own else 0
                        tracks[number] = {
                            "type": _unsigned(data, *own[TRACK_TYPE]) if TRACK_TYPE in own else 0,
                            "codec": data[slice(*own[CODEC_ID])].decode("ascii", "replace") if CODEC_ID in own else "",
                            "rate": _real(data, *sound[SAMPLING]) if SAMPLING in sound else 0.0,
                            "bits": _unsigned(data, *sound[BIT_DEPTH]) if BIT_DEPTH in sound else 0,
                        }
            elif ident == CLUSTER:
                found["clusters"].append(start - first)
                base = 0
                for x, _, a, b in elements(data, low, high):
                    if x == TIMESTAMP:
                        base = _unsigned(data, a, b)
                    elif x == SIMPLE_BLOCK:
                        block(a, b, base, True, False)
                    elif x == BLOCK_GROUP:
                        own = [(y, c, d) for y, _, c, d in elements(data, a, b)]
                        key = all(y != REFERENCE_BLOCK for y, _, _ in own)
                        for y, c, d in own:
                            if y == BLOCK:
                                block(c, d, base, False, key)
            elif ident == CUES:
                for x, _, a, b in elements(data, low, high):
                    if x == CUE_POINT:
                        own = {y: (c, d) for y, _, c, d in elements(data, a, b)}
                        spot = {y: (c, d) for y, _, c, d in elements(data, *own[CUE_TRACK_POSITIONS])} if CUE_TRACK_POSITIONS in own else {}
                        value = lambda k, where: _unsigned(data, *where[k]) if k in where else 0  # noqa: B023, E731
                        found["cues"].append((value(CUE_TIME, own) * found["scale"], value(CUE_TRACK, spot), value(CUE_CLUSTER, spot), value(CUE_RELATIVE, spot)))
    return found


def payload_of(data: bytes, found: dict, track: int = 1) -> bytes:
    """The track's bytes in the order of its packets."""
    return b"".join(data[at : at + n] for t, _, at, n, _, _ in found["packets"] if t == track)


def padded(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % UNIT if text else UNIT)


_MEDIA = "doc_id {key}, media binary"
_PACKETS = "doc_id {key}, packet long, track long, timestamp_ns long, byte_start long, byte_length long, keyframe boolean, lacing int, error string"


def stored(docs: DataFrame) -> DataFrame:
    """(doc_id, media): each text as a Matroska file."""
    tuned(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                raw, offs = text_bytes(part.column(1))
                media = [store(padded(raw[a:b].tobytes())) for a, b in zip(offs, offs[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, _MEDIA.format(key=dict(docs.dtypes)["doc_id"]))


def packet_table(media: DataFrame) -> DataFrame:
    """One row a packet of each file of (doc_id, media); a file that can't be parsed gives one row with ``error``."""

    def run(batches):
        for batch in batches:
            for key, data in zip(batch.column(0), batch.column(1), strict=True):
                rows = []
                try:
                    rows = [(i, *p, None) for i, p in enumerate(parse(data.as_py() or b"")["packets"])]
                except MediaError as e:
                    rows = [(None, None, None, None, None, None, None, str(e))]
                for low in range(0, len(rows), 50_000):
                    piece = rows[low : low + 50_000]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string())
                    columns = [pa.array(c, k) for c, k in zip(zip(*piece, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * len(piece), batch.schema.field(0).type), *columns], ["doc_id", "packet", "track", "timestamp_ns", "byte_start", "byte_length", "keyframe", "lacing", "error"])

    return media.select("doc_id", "media").mapInArrow(run, _PACKETS.format(key=dict(media.dtypes)["doc_id"]))


def feature(found: dict) -> str:
    """Counts of tracks, clusters, cues, packets by lacing, cues that hit their cluster, and the track's end in milliseconds."""
    lacing = [0] * 4
    for p in found["packets"]:
        lacing[p[5]] += 1
    clusters = set(found["clusters"])
    hits = sum(c[2] in clusters for c in found["cues"])
    track = found["tracks"].get(1, {"codec": "", "bits": 0})
    return f"{found['doc_type']}:{track['codec']}:{track['bits']}:t{len(found['tracks'])}:c{len(clusters)}:q{hits}/{len(found['cues'])}:p{len(found['packets'])}:l{'/'.join(map(str, lacing))}:d{found['duration']:.0f}"


def digest(docs: DataFrame) -> DataFrame:
    """Stores each text, reads the stored bytes back by the packet table and returns what was found."""
    tuned(docs.sparkSession)
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_packets", "duration_ms"]

    def run(batches):
        for batch in batches:
            for part in sliced(batch):
                raw, offs = text_bytes(part.column(1))
                rows = []
                for a, b in zip(offs, offs[1:], strict=False):
                    media = store(padded(raw[a:b].tobytes()))
                    found = parse(media)
                    back = payload_of(media, found)
                    rows.append((int(b - a), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), len(found["packets"]), found["duration"]))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c) for c in zip(*rows, strict=True)]], names)

    kinds = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_packets long, duration_ms double"
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, {kinds}")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of ``digest`` over all documents; nulls, empty and repeated rows as in the module's defined results."""
    return digest(table(spark, sf_dir, "documents"))
