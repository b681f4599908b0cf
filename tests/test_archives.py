import io
import struct
import zipfile
import zlib

import pytest

from quirekit.sources import archives, epub, files, sinks


def zipped(entries, stored=("mimetype",)):
    sink = io.BytesIO()
    with zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED) as out:
        for name, body in entries:
            out.writestr(name, body, zipfile.ZIP_STORED if name in stored else zipfile.ZIP_DEFLATED)
    return sink.getvalue()


def png(width=1):
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0" + b"\7" * width)) + chunk(b"IEND", b"")


LONG = " ".join(f"Sentence-{i}." for i in range(520))


def book(version="3.0", body=None, extra=(), manifest="", spine='<itemref idref="c1"/><itemref idref="c2"/>'):
    body = body or f'<p>Before<script>hidden</script>After</p><p>Ruby<ruby>A<rt>no</rt></ruby>tail</p><img src="pic.png" alt="An alt" title="A title"/><p>{LONG}</p>'
    page = lambda b: f'<?xml version="1.0" encoding="utf-8"?>\n<!DOCTYPE html>\n<html xmlns="http://www.w3.org/1999/xhtml"><head><title>no</title></head><body>{b}</body></html>'
    nav = '<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol><li><a href="c1.xhtml">One</a></li></ol></nav></body></html>'
    opf = f'''<package xmlns="http://www.idpf.org/2007/opf" version="{version}"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>My Book</dc:title><dc:creator>Nobody</dc:creator><dc:language>en</dc:language></metadata>
<manifest><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="c2.xhtml" media-type="application/xhtml+xml"/><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/>
<item id="pic" href="pic.png" media-type="image/png" properties="cover-image"/><item id="css" href="s.css" media-type="text/css"/>{manifest}</manifest><spine>{spine}</spine></package>'''
    return zipped(
        [
            ("mimetype", "application/epub+zip"),
            ("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf" media-type="application/oebps-package+xml"/></rootfiles></container>'),
            ("OEBPS/p.opf", opf),
            ("OEBPS/c1.xhtml", page(body)),
            ("OEBPS/c2.xhtml", page("<p> Second </p>")),
            ("OEBPS/nav.xhtml", nav),
            ("OEBPS/pic.png", png()),
            ("OEBPS/s.css", "/* url(no.png) */ p{background:url('pic.png')}"),
            *extra,
        ]
    )


def test_epub_units():
    found = epub.inspect(book())
    texts = [u["source_text"] for u in found["units"]]
    assert texts[:7] == ["My Book", "Before", "After", "Ruby", "A", "tail", "An alt"]
    assert texts[7] == "A title" and texts[-2:] == ["Second", "One"]
    assert not {"no", "hidden", "Nobody"} & set(texts)
    parts = [u for u in found["units"] if u["locator"]["part_count"] > 1]
    assert len(parts) >= 3 and "".join(u["source_text"] + u["joiner"] for u in parts) == LONG
    assert found["cover"] == "OEBPS/pic.png" and found["metadata"]["creators"] == ["Nobody"]
    assert next(u for u in found["units"] if u["source_text"] == "After")["locator"]["slot"] == "tail"


def test_epub_round_trip():
    source = book()
    units = epub.inspect(source)["units"]
    built, n = epub.rebuild(source, {u["sequence"]: f"T{u['sequence']}" for u in units if u["sequence"] != 1} | {2: "  "}, "zh-CN")
    again = epub.inspect(built)
    assert n == len(units) - 2
    texts = [u["source_text"] for u in again["units"]]
    assert texts[1:4] == ["Before", "After", "T3"] and again["metadata"]["languages"] == ["zh-CN"]
    assert b'lang="zh-CN"' in again["bodies"]["OEBPS/c1.xhtml"] and b"<!DOCTYPE html>" in again["bodies"]["OEBPS/c1.xhtml"]
    assert again["bodies"]["OEBPS/pic.png"] == png()
    with pytest.raises(archives.Refused):
        epub.rebuild(source, {}, "en_US")


@pytest.mark.parametrize(
    "content, code",
    [
        (b"not a zip", "INVALID_FORMAT"),
        (book(version="4.0"), "EPUB_UNSUPPORTED"),
        (book(body="<p>open"), "EPUB_INVALID"),
        (book(extra=[("META-INF/encryption.xml", "x")]), "PROTECTED"),
        (book(extra=[("../escape.txt", "x")]), "ARCHIVE_UNSAFE"),
        (book(extra=[("OEBPS/C1.XHTML", "x")]), "ARCHIVE_UNSAFE"),
        (book(body='<img src="gone.png"/>'), "EPUB_INVALID"),
        (book(body='<a href="../../../etc/passwd">x</a>'), "ARCHIVE_UNSAFE"),
        (book(spine='<itemref idref="pic"/>'), "EPUB_INVALID"),
        (book(manifest='<item id="c1" href="c2.xhtml" media-type="x"/>'), "EPUB_INVALID"),
        (zipped([("a", "b")]), "EPUB_INVALID"),
    ],
)
def test_epub_rejects(content, code):
    with pytest.raises(archives.Refused) as e:
        epub.inspect(content)
    assert e.value.code == code


@pytest.mark.parametrize("limits, word", [({"files": 3}, "files"), ({"total_bytes": 100}, "total_bytes"), ({"member_bytes": 32}, "member_bytes"), ({"depth": 1}, "deep"), ({"ratio": 1.5}, "ratio")])
def test_archive_limits(limits, word):
    with pytest.raises(archives.Refused, match=word):
        archives.read_members(book(), limits)


def test_entities_are_refused():
    for doctype in ("<!DOCTYPE x [<!ENTITY a 'b'>]>", "<!DOCTYPE x [<!ELEMENT a ANY>]>"):
        with pytest.raises(archives.Refused):
            epub.parse_xml(f"{doctype}<x/>".encode(), "x")


def test_images():
    assert archives.image_type(png()) == "image/png"
    for fake in (b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xe0" + b"\0" * 20, b"RIFF\0\0\0\0WEBP", png()[:-1], png() + b"x", b""):
        assert archives.image_type(fake) is None
    chunk = b"VP8L" + struct.pack("<I", 4) + b"\x2f\0\0\0"
    assert archives.image_type(b"RIFF" + struct.pack("<I", 4 + len(chunk)) + b"WEBP" + chunk) == "image/webp"
    jpeg = b"\xff\xd8" + b"\xff\xc0\x00\x0b\x08\x00\x01\x00\x01\x01\x01\x11\x00" + b"\xff\xda\x00\x08\x01\x01\x00\x00\x3f\x00" + b"\x12\x34\xff\xd9"
    assert archives.image_type(jpeg) == "image/jpeg"


def test_natural_order():
    assert sorted(["p/10.png", "p/2.png", "p/1.png", "P/1a.png"], key=archives.natural_order) == ["p/1.png", "P/1a.png", "p/2.png", "p/10.png"]


def test_pages_to_archive(spark):
    comic = zipped([("pages/10.png", png(3)), ("pages/2.png", png(2)), ("pages/1.png", png(1)), ("note.txt", "x")])
    rows = [("s1", "a.cbz", bytearray(comic)), ("s2", "b.cbz", bytearray(zipped([("1.png", b"fake")]))), ("s3", "c.png", bytearray(png()))]
    found = archives.pages(spark.createDataFrame(rows, "source_sha256 string, filename string, content binary"))
    names = [(r["source_sha256"], r["name"], r["error_code"]) for r in found.orderBy("source_sha256", "order").collect()]
    assert names == [("s1", "pages/1.png", None), ("s1", "pages/2.png", None), ("s1", "pages/10.png", None), ("s2", "1.png", "INVALID_FORMAT"), ("s3", "c.png", None)]
    from pyspark.sql import functions as F

    done = archives.verified_pages(found).filter("error_code is null").withColumn("status", F.when(F.col("name") == "pages/2.png", "failed").otherwise("succeeded"))
    built = {r["source_sha256"]: r for r in archives.build_archives(done).collect()}
    assert zipfile.ZipFile(io.BytesIO(built["s1"]["output"])).namelist() == ["0001.png", "0002.png"] and built["s1"]["omitted"] == 1


def test_epub_tables(spark):
    good, bad = book(), book(version="4.0")
    frame = spark.createDataFrame([("g", bytearray(good)), ("b", bytearray(bad))], "source_sha256 string, content binary")
    units = epub.epub_units(frame).collect()
    assert {r["error_code"] for r in units if r["source_sha256"] == "b"} == {"EPUB_UNSUPPORTED"}
    assert len({r["segment_id"] for r in units if r["source_sha256"] == "g"}) == sum(r["source_sha256"] == "g" for r in units)
    assert {r["kind"] for r in epub.epub_parts(frame).collect()} == {"item", "spine", "document", "reference", "metadata", "cover", "error"}
    values = spark.createDataFrame([("g", 1, "Davor")], "source_sha256 string, sequence int, value string")
    out = {r["source_sha256"]: r for r in epub.rebuild_packages(frame, values, "de").collect()}
    assert out["g"]["translated"] == 1 and out["b"]["error_code"] == "EPUB_UNSUPPORTED"
    summary = {r["source_sha256"]: r["members"] for r in archives.archive_summary(archives.members(frame)).collect()}
    assert summary == {"g": 8, "b": 8}


def test_decoding(spark, tmp_path):
    cases = {
        "utf8.txt": "Chapter One\r\n\r\n“Hello.”\r\n".encode(),
        "bom8.txt": "﻿x".encode(),
        "u16.txt": "wide\n".encode("utf-16"),
        "u32.txt": "wider".encode("utf-32"),
        "empty.txt": b"",
        "blank.txt": b" \n\t ",
        "jpeg.txt": b"\xff\xd8\xff\xe0abc",
        "nul.txt": b"a\0b",
        "latin.txt": ("Der Bär läuft über die Straße und hört schöne Vögel. " * 8).encode("latin-1"),
    }
    for name, body in cases.items():
        (tmp_path / name).write_bytes(body)
    found = files.decode_texts(files.read_files(spark, str(tmp_path)))
    got = {r["filename"]: r for r in found.collect()}
    assert (got["utf8.txt"]["text"], got["utf8.txt"]["newline"], got["utf8.txt"]["encoding"]) == ("Chapter One\n\n“Hello.”\n", "crlf", "utf-8")
    assert [got[n]["text"] for n in ("bom8.txt", "u16.txt", "u32.txt")] == ["x", "wide\n", "wider"]
    assert all(got[n]["error"]["code"] == "INVALID_FORMAT" and got[n]["text"] is None for n in ("empty.txt", "blank.txt", "jpeg.txt", "nul.txt"))
    assert got["latin.txt"]["error"] is None and got["latin.txt"]["encoding"] not in (None, "utf-8") and len(got["latin.txt"]["text"]) == 53 * 8  # which encoding is the detector's choice
    small = {r["filename"]: r["error"] for r in files.read_files(spark, str(tmp_path), maximum=10).collect()}
    assert small["utf8.txt"]["code"] == "UPLOAD_TOO_LARGE" and small["bom8.txt"] is None
    kinds = {r["filename"]: r["source_format"] for r in files.with_format(files.read_files(spark, str(tmp_path))).collect()}
    assert kinds["utf8.txt"] == "txt"


def test_sinks(spark, tmp_path):
    target = tmp_path / "out" / "a.bin"
    sinks.publish(str(target), b"one")
    with pytest.raises(FileExistsError):
        sinks.publish(str(target), b"two")
    sinks.publish(str(target), b"two", overwrite=True)
    assert target.read_bytes() == b"two" and len(list(target.parent.iterdir())) == 1
    with pytest.raises(ValueError):
        sinks.require_apart(str(target), f"file://{tmp_path}/out/../out/a.bin")
    rows = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"x")), (3, None), (4, bytearray(b"long"))], "key int, content binary")
    stored = {r["key"]: r for r in sinks.store_payloads(rows, str(tmp_path / "store"), 3).collect()}
    assert stored[1]["storage_key"] == stored[2]["storage_key"] and stored[3]["error"] == "ARTIFACT_MISSING" and stored[4]["error"] == "UPLOAD_TOO_LARGE"
    table = spark.range(3)
    sinks.write_table(table, str(tmp_path / "t"))
    with pytest.raises(Exception, match="(?i)exist"):
        sinks.write_table(table, str(tmp_path / "t"))
    assert spark.range(1).select(sinks.as_json("id").alias("j")).first()["j"] == '{"id":0}'


def test_folders(spark, tmp_path):
    for name, body in (("a/B.png", png(2)), ("a/a.png", png(1)), ("a/note.txt", b"x"), ("b/1.png", b"fake")):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(body)
    made = {r["folder"].rsplit("/", 1)[-1]: r for r in archives.folder_archives(files.read_files(spark, str(tmp_path), recursive=True)).collect()}
    assert zipfile.ZipFile(io.BytesIO(made["a"]["output"])).namelist() == ["a.png", "B.png"] and made["b"]["error_code"] == "INVALID_FORMAT"
