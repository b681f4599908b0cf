"""ZIP members as rows, with guards; page images and comic archives."""

from __future__ import annotations

import io
import re
import stat
import unicodedata
import zipfile
import zlib

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..schemas import LIMITS
from ..session import shipped


class Refused(Exception):
    """An archive or image that breaks a rule."""

    def __init__(self, code: str, message: str, member: str = ""):
        super().__init__(message)
        self.code, self.member = code, member


def portable(name: str) -> str:
    return unicodedata.normalize("NFC", name.rstrip("/")).casefold()


def member_fault(name: str, depth: int, strict: bool = True) -> str | None:
    """Code of the rule that a member's path breaks."""
    top = 0xA0 if strict else 0x20
    if not name or "\\" in name or any(ord(c) < 0x20 or (0x7F <= ord(c) < top) for c in name):
        return "ARCHIVE_UNSAFE"
    parts = name.removesuffix("/").split("/")
    if {"", ".", ".."} & set(parts) or ":" in parts[0]:
        return "ARCHIVE_UNSAFE"
    return "ARCHIVE_LIMIT" if len(parts) > depth else None


def ratio(size: int, packed: int) -> float:
    return 0.0 if size == 0 else size / packed if packed > 0 else float("inf")


def read_members(content: bytes, limits: dict | None = None, strict: bool = True) -> dict[str, bytes]:
    """Payloads of all members by name (None for folders), after every guard; raises Refused at the first one broken."""
    bound = LIMITS | (limits or {})
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, OSError, ValueError) as e:
        raise Refused("INVALID_FORMAT", "not a ZIP archive") from e
    infos = archive.infolist()
    if not infos:
        raise Refused("INVALID_FORMAT", "the archive is empty")
    if len(infos) > bound["files"]:
        raise Refused("ARCHIVE_LIMIT", f"members exceed the limit of files, {bound['files']}")
    seen, total = set(), 0
    for info in infos:
        name = info.filename
        total += info.file_size
        rules = (
            (member_fault(name, bound["depth"], strict), "unsafe or too deep path"),
            ("ARCHIVE_UNSAFE" if portable(name) in seen else None, "two members of one name"),
            ("PROTECTED" if info.flag_bits & 0x41 else None, "encrypted member"),
            ("ARCHIVE_UNSAFE" if info.create_system == 3 and stat.S_ISLNK(info.external_attr >> 16) else None, "symbolic link"),
            (None if info.compress_type in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) else "UNSUPPORTED", "compression method"),
            ("ARCHIVE_LIMIT" if info.file_size > bound["member_bytes"] else None, "member exceeds the limit of member_bytes"),
            ("ARCHIVE_LIMIT" if total > bound["total_bytes"] else None, "members exceed the limit of total_bytes"),
            ("ARCHIVE_LIMIT" if ratio(info.file_size, info.compress_size) > bound["ratio"] else None, "member exceeds the limit of ratio"),
        )
        for code, message in rules:
            if code:
                raise Refused(code, message, name)
        seen.add(portable(name))
    if portable("META-INF/encryption.xml") in seen:
        raise Refused("PROTECTED", "encryption metadata")
    out: dict[str, bytes] = {}
    for info in infos:
        if info.is_dir():
            continue
        try:
            with archive.open(info) as stream:  # reads at most one byte beyond what the directory announces
                body = stream.read(info.file_size + 1)
        except (zipfile.BadZipFile, zlib.error, EOFError, OSError, RuntimeError, NotImplementedError, ValueError) as e:
            raise Refused("INVALID_FORMAT", "damaged member", info.filename) from e
        if len(body) != info.file_size:
            raise Refused("INVALID_FORMAT", "member of another size than announced", info.filename)
        out[info.filename] = body
    return out


_MEMBERS = "source_sha256 string, position int, name string, member_size long, packed_size long, ratio double, member_sha256 string, error_code string, error_message string"


def members(files: DataFrame, limits: dict | None = None) -> DataFrame:
    """One row a member of each archive of (source_sha256, content), or one row with an error."""
    import hashlib

    shipped(files.sparkSession)
    columns = [c.split()[0] for c in _MEMBERS.split(", ")]

    def run(frames):
        for frame in frames:
            for key, content in zip(frame["source_sha256"], frame["content"], strict=True):
                try:
                    bodies = read_members(content, limits)
                    infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
                    rows = [(key, i, x.filename, x.file_size, x.compress_size, ratio(x.file_size, x.compress_size), hashlib.sha256(bodies[x.filename]).hexdigest() if x.filename in bodies else None, None, None) for i, x in enumerate(infos)]
                except Refused as e:
                    rows = [(key, None, e.member or None, None, None, None, None, e.code, str(e))]
                yield pd.DataFrame(rows, columns=columns).astype({"position": "Int32", "member_size": "Int64", "packed_size": "Int64"})

    return files.select("source_sha256", "content").mapInPandas(run, _MEMBERS)


def archive_summary(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_sha256").agg(F.count("position").alias("members"), F.sum("member_size").alias("expanded_bytes"), F.sum("packed_size").alias("packed_bytes"), F.max("ratio").alias("max_ratio"), F.max("error_code").alias("error_code"))


def natural_order(name: str) -> list:
    """Sort key: digit runs by value, the rest without case."""
    return [(0, int(p), "") if p.isascii() and p.isdigit() else (1, 0, p) for p in re.findall(r"[0-9]+|[^0-9]+", unicodedata.normalize("NFC", name).casefold())]


def image_type(body: bytes) -> str | None:
    """Media type of bytes whose structure is that of a PNG, JPEG or WebP file."""
    for check, kind in ((_png, "image/png"), (_jpeg, "image/jpeg"), (_webp, "image/webp")):
        if check(body):
            return kind
    return None


def _png(body: bytes) -> bool:
    if body[:8] != b"\x89PNG\r\n\x1a\n":
        return False
    at, kinds = 8, []
    while at + 12 <= len(body):
        size, kind = int.from_bytes(body[at : at + 4], "big"), body[at + 4 : at + 8]
        end = at + 12 + size
        if end > len(body) or zlib.crc32(body[at + 4 : end - 4]) != int.from_bytes(body[end - 4 : end], "big"):
            return False
        if kind == b"IHDR":
            head = body[at + 8 : end - 4]
            if kinds or size != 13 or 0 in (int.from_bytes(head[:4], "big"), int.from_bytes(head[4:8], "big")):
                return False
            if head[8] not in (1, 2, 4, 8, 16) or head[9] not in (0, 2, 3, 4, 6) or head[10:12] != b"\0\0" or head[12] > 1:
                return False
        kinds.append(kind)
        at = end
        if kind == b"IEND":
            return size == 0 and kinds[0] == b"IHDR" and b"IDAT" in kinds and end == len(body)
    return False


def _jpeg(body: bytes) -> bool:
    """Markers from the start to a scan after a frame, and the end marker last."""
    if len(body) < 12 or body[:2] != b"\xff\xd8" or body[-2:] != b"\xff\xd9":
        return False
    at, frame = 2, False
    while at + 4 <= len(body):
        if body[at] != 0xFF:
            return False
        marker = body[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = int.from_bytes(body[at + 2 : at + 4], "big")
        if size < 2 or at + 2 + size > len(body):
            return False
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            frame = size >= 8 and body[at + 5 : at + 9] != b"\0\0\0\0"
        if marker == 0xDA:
            return frame
        at += 2 + size
    return False


def _webp(body: bytes) -> bool:
    if body[:4] != b"RIFF" or body[8:12] != b"WEBP" or int.from_bytes(body[4:8], "little") + 8 != len(body):
        return False
    at, pictures = 12, 0
    while at + 8 <= len(body):
        kind, size = body[at : at + 4], int.from_bytes(body[at + 4 : at + 8], "little")
        if at + 8 + size > len(body):
            return False
        pictures += kind in (b"VP8 ", b"VP8L", b"ANMF") and size > 0
        at += 8 + size + size % 2
    return pictures > 0 and at == len(body)


_IMAGES = {"png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "webp": "image/webp"}
PAGES = "source_sha256 string, `order` int, name string, media_type string, page_sha256 string, page_size long, content binary, error_code string, error_message string"


def page_list(filename: str, content: bytes, limits: dict | None = None) -> list[tuple[str, str, bytes]]:
    """(name, media type, bytes) of an image file or of a comic archive's pages in natural order."""
    suffix = filename.rsplit(".", 1)[-1].lower()
    found = [(filename, content)] if suffix in _IMAGES else None
    if found is None:
        bodies = read_members(content, limits, strict=False)
        found = sorted(((n, b) for n, b in bodies.items() if n.rsplit(".", 1)[-1].lower() in _IMAGES), key=lambda x: (natural_order(x[0]), x[0]))
        if not found:
            raise Refused("INVALID_FORMAT", "the archive holds no page images")
    out = []
    for name, body in found:
        kind = image_type(body)
        if kind is None or kind != _IMAGES[name.rsplit(".", 1)[-1].lower()]:
            raise Refused("INVALID_FORMAT", "a page is no valid image of its suffix", name)
        out.append((name, kind, body))
    return out


def pages(files: DataFrame, limits: dict | None = None) -> DataFrame:
    """One row a page of each image or comic archive of (source_sha256, filename, content), with its identity, or one row with an error."""
    import hashlib

    shipped(files.sparkSession)
    columns = [c.split()[0].strip("`") for c in PAGES.split(", ")]

    def run(frames):
        for frame in frames:
            for key, name, content in zip(frame["source_sha256"], frame["filename"], frame["content"], strict=True):
                try:
                    rows = [(key, i, n, kind, hashlib.sha256(b).hexdigest(), len(b), b, None, None) for i, (n, kind, b) in enumerate(page_list(name, content, limits))]
                except Refused as e:
                    rows = [(key, None, e.member or None, None, None, None, None, e.code, str(e))]
                yield pd.DataFrame(rows, columns=columns).astype({"order": "Int32", "page_size": "Int64"})

    out = files.select("source_sha256", "filename", "content").mapInPandas(run, PAGES)
    return out.withColumn("page_id", F.when(F.col("error_code").isNull(), ids.page_id(F.col("source_sha256"), F.col("name"), F.col("page_sha256"))))


def verified_pages(rows: DataFrame) -> DataFrame:
    """Pages whose bytes still are those of their manifest; others get an error."""
    return rows.withColumn("error_code", F.when(F.col("error_code").isNull() & (F.sha2("content", 256) != F.col("page_sha256")), "SOURCE_MISMATCH").otherwise(F.col("error_code")))


def build_archives(results: DataFrame) -> DataFrame:
    """(source_sha256, output, output_sha256, translated, omitted): each source's succeeded pages, renumbered, in a new archive.

    A group is one archive, which fits a task as the archive it was read from did."""
    shipped(results.sparkSession)

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        done = frame[frame["status"] == "succeeded"].sort_values("order")
        sink = io.BytesIO()
        with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as out:
            for i, (name, body) in enumerate(zip(done["name"], done["content"], strict=True), 1):
                out.writestr(zipfile.ZipInfo(f"{i:04d}.{name.rsplit('.', 1)[-1].lower()}", (1980, 1, 1, 0, 0, 0)), body)
        return pd.DataFrame([(frame["source_sha256"].iloc[0], sink.getvalue() if len(done) else None, len(done), len(frame) - len(done))], columns=["source_sha256", "output", "translated", "omitted"])

    built = results.select("source_sha256", "order", "name", "status", "content").groupBy("source_sha256").applyInPandas(run, "source_sha256 string, output binary, translated long, omitted long")
    return built.withColumn("output_sha256", F.sha2("output", 256))


def folder_archives(files: DataFrame, limits: dict | None = None) -> DataFrame:
    """(folder, output, pages, error_code) of folders of page images (path, content): an archive of each folder's images in order of their
    paths without case. A folder is one group, bounded by the archive limits."""
    shipped(files.sparkSession)
    bound = LIMITS | (limits or {})

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        rows = sorted(((p.casefold(), p.rsplit("/", 1)[-1], bytes(b)) for p, b in zip(frame["path"], frame["content"], strict=True)), key=lambda r: r[:2])
        code = "ARCHIVE_LIMIT" if len(rows) > bound["files"] or sum(len(b) for _, _, b in rows) > bound["total_bytes"] else None
        code = code or ("INVALID_FORMAT" if any(image_type(b) != _IMAGES[n.rsplit(".", 1)[-1].lower()] for _, n, b in rows) else None)
        sink = io.BytesIO()
        if code is None:
            with zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as out:
                for _, name, body in rows:
                    out.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), body)
        return pd.DataFrame([(frame["folder"].iloc[0], None if code else sink.getvalue(), len(rows), code)], columns=["folder", "output", "pages", "error_code"])

    images = files.filter(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*_IMAGES) & F.col("content").isNotNull())
    return images.withColumn("folder", F.regexp_extract("path", "^(.*)/", 1)).select("folder", "path", "content").groupBy("folder").applyInPandas(run, "folder string, output binary, pages long, error_code string")
