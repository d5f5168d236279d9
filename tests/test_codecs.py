import contextlib
import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.functions.codecs import Unreadable, archives, blocks, fonts, images, office, pdf, photos, trees, webp

PICTURE = np.random.default_rng(3).integers(0, 256, (12, 16, 4), dtype=np.uint8)


@pytest.mark.parametrize("kind", ["png", "qoi", "tga"])
def test_exact_pictures(kind):
    assert np.array_equal(images.READERS[kind](images.WRITERS[kind](PICTURE)), PICTURE)


@pytest.mark.parametrize("shape", [(12, 16), (1, 1), (1, 700), (530, 3), (61, 83)])
def test_webp_round_trip(shape):
    """Noise, smooth and flat pictures, also wider than a block of predictions."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    noise = np.random.default_rng(5).integers(0, 256, (*shape, 4), dtype=np.uint8)
    smooth = np.stack([x, y, x + y, np.full_like(x, 255)], axis=2).astype(np.uint8)
    for p in (noise, smooth, np.full((*shape, 4), 7, np.uint8), noise // 120):
        assert np.array_equal(webp.read_webp(webp.write_webp(p)), p)
    raw = webp.write_webp(noise)
    for bad in (raw[:15], raw[:30], raw[: len(raw) // 2], b"RIFF0000WEBPVP8 \1\0\0\0x"):
        with pytest.raises(Unreadable):
            webp.read_webp(bad)


def _webp(fields):
    """A file of (value, bits) fields, by hand from the format's description."""
    held = sum(v << sum(n for _, n in fields[:i]) for i, (v, n) in enumerate(fields))
    data = held.to_bytes((sum(n for _, n in fields) + 7) // 8, "little")
    return b"RIFF\0\0\0\0WEBPVP8L" + len(data).to_bytes(4, "little") + data


def _alone(*symbols):
    return [(1, 1), (len(symbols) - 1, 1), (1, 1), *((s, 8) for s in symbols)]


def test_webp_palette():
    head = [(0x2F, 8), (4, 14), (1, 14), (0, 1), (0, 3)]
    # Three colours, each stated as the step from the one before.
    colours = [(1, 1), (3, 2), (2, 8), (0, 1), *_alone(10, 20), *_alone(1), *_alone(2), *_alone(255, 0), *_alone(0)]
    colours += [(0, 1), (1, 1), (1, 1), (0, 1), (1, 1), (0, 1)]  # green and alpha of each; the smaller symbol is 0
    # Four places of two bits a byte, two bytes a line of five pixels.
    rows = [(0, 1), (0, 1), (0, 1), *_alone(0b00100100, 0b10), *_alone(0), *_alone(0), *_alone(255), *_alone(0)]
    rows += [(1, 1), (0, 1), (0, 1), (1, 1)]
    p = webp.read_webp(_webp(head + colours + rows))
    table = np.array([[1, 10, 2, 255], [2, 30, 4, 255], [3, 50, 6, 255]], np.uint8)
    assert np.array_equal(p, table[np.array([[0, 1, 2, 0, 2], [2, 0, 0, 0, 0]])])


def test_webp_copies_and_cache():
    a, b = (255 << 24 | 1 << 16 | 5 << 8 | 7), (255 << 24 | 1 << 16 | 6 << 8 | 7)
    place = [v * 0x1E35A7BD % 2**32 >> 31 for v in (a, b)]
    assert place == [1, 0]
    said, code, size = webp._written_code(np.bincount([5, 6, 256 + 3, 280, 281], minlength=282))
    put = lambda s: (int(code[s]), int(size[s]))
    fields = [(0x2F, 8), (3, 14), (1, 14), (0, 1), (0, 3), (0, 1), (1, 1), (1, 4), (0, 1)]
    fields += [*said, *_alone(1), *_alone(7), *_alone(255), *_alone(4)]
    # Two pixels, four copied from two before (the sixth near place), two from the cache.
    fields += [put(5), put(6), put(256 + 3), (1, 1), put(280), put(281)]
    p = webp.read_webp(_webp(fields))
    assert p[..., 1].tolist() == [[5, 6, 5, 6], [5, 6, 6, 5]] and p[0, 0].tolist() == [1, 5, 7, 255]


def test_webp_nearest_offsets():
    assert len(webp.NEAR) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


@pytest.mark.parametrize("kind", ["bmp", "pnm"])
def test_flattened_pictures(kind):
    p = images.READERS[kind](images.WRITERS[kind](PICTURE))
    assert np.array_equal(p[..., :3], images.flatten(PICTURE)) and (p[..., 3] == 255).all()


@pytest.mark.parametrize(("sizes", "n"), [("favicon", 3), ("app", 7), ("single", 1)])
def test_icons(sizes, n):
    raw = images.write_ico(PICTURE, sizes)
    assert int.from_bytes(raw[4:6], "little") == n
    assert images.read_ico(raw).shape[0] == max(images.ICON_SIZES[sizes])


def test_other_picture_forms():
    assert np.array_equal(images.read_pnm(b"P2 2 1 # c\n10\n0 10")[0, :, 0], [0, 255])
    assert np.array_equal(images.read_pnm(b"P1\n2 1\n1 0")[0, :, 0], [0, 255])
    rle = b"\0\0\x0a" + b"\0" * 9 + b"\2\0\1\0" + bytes([24, 0x20]) + b"\x81\1\2\3"
    assert images.read_tga(rle).tolist() == [[[3, 2, 1, 255]] * 2]
    assert b'width="16"' in images.svg(images.write_png(PICTURE), "png", 16, 12)
    assert images.to_text(PICTURE).count(b"\n") == 6
    with pytest.raises(Unreadable):
        images.read_qoi(b"qoif" + b"\xff" * 10)


@pytest.mark.parametrize("kind", ["zip", "tar", "tgz", "tzst", "txz"])
def test_archives(kind):
    made = [archives.Entry("d/", b"", True), archives.Entry("d/a.txt", b"hello")]
    raw = archives.write(made, kind)
    assert raw == archives.write(made, kind)
    assert [(e.name, e.data, e.is_dir) for e in archives.read(raw, kind)] == [("d/", b"", True), ("d/a.txt", b"hello", False)]
    with pytest.raises(Unreadable):
        archives.read(b"garbage" * 100, kind)


def test_archive_names():
    assert archives.clean_name("../x") is None and archives.clean_name("/a\\b") == "a/b" and archives.clean_name("./") is None
    assert archives.unique_names(["a.txt", "x/a.txt", "", "b", "b"]) == ["a.txt", "a-2.txt", "file", "b", "b-2"]


MARKDOWN = (
    "---\ntitle: My doc\nlang: de\n---\n# Head\n\nPara *it* **b** `c` [l](http://x.y)\n\n- one\n- two\n  - nested\n\n1. first\n2. second\n\n"
    "> quote\n\n```\nx = 1\ny\n```\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n\n# Two\n\nend\n"
)


def test_markdown_blocks():
    d = blocks.read_markdown(MARKDOWN.encode())
    assert (d.title, d.lang) == ("My doc", "de")
    assert [b.kind for b in d.blocks] == ["heading", "paragraph", "item", "item", "item", "item", "item", "quote", "code", "table", "rule", "heading", "paragraph"]
    assert [b.level for b in d.blocks if b.kind == "item"] == [1, 1, 2, 1, 1]
    assert [s.style() for s in d.blocks[1].spans if s.text == "l"] == [(False, False, False, False, "http://x.y")]


@pytest.mark.parametrize(("read", "write"), [(office.read_docx, office.write_docx), (office.read_epub, office.write_epub), (blocks.read_html, blocks.write_html)])
def test_documents_round_trip(read, write):
    d = blocks.read_markdown(MARKDOWN.encode())
    back = read(write(d))
    assert blocks.write_markdown(back) == blocks.write_markdown(d)
    assert back.lang == "de"


def test_front_matter_must_be_a_mapping():
    for text in ("---\n- a\n---\nx\n", "---\njust text\n---\nx\n"):
        assert blocks.front_matter(text) == ({}, text)
    assert blocks.front_matter("---\r\ntitle: t\r\n...\r\nbody") == ({"title": "t"}, "body")


def test_html_quirks():
    md = lambda h: blocks.write_markdown(blocks.read_html(h.encode())).decode()
    assert md("<p><b>a</b> b</p>") == "**a** b\n"
    assert md("<ul><li><p>i</p><li>j<ol start=3><li>n</ol></ul>") == "- i\n- j\n   3. n\n"
    assert md("<table><tr><th>H<tr><td><p>1</table>") == "| H |\n| --- |\n| 1 |\n"
    assert md("<head><title>t</title></head><!-- c --><p>x&amp;y<script>no</script>") == "x&y\n"
    assert md("<header>kept</header>") == "kept\n"


def test_text_and_pdf():
    d = blocks.read_text(b"\xef\xbb\xbfone\r\ntwo\r\n\r\nthree")
    assert [blocks.plain(b.spans) for b in d.blocks] == ["one\ntwo", "three"]
    raw = pdf.write_document(blocks.Document([blocks.Block("paragraph", [blocks.Span("word " * 4000)])]))
    assert raw.startswith(b"%PDF") and raw.count(b"/Type /Page ") > 3
    assert pdf.write_pictures([PICTURE]).count(b"/Type /Page ") == 1


def test_rich_text():
    raw = rb"{\rtf1\ansi\ansicpg1254{\fonttbl{\f0 Arial;}}Hello \b bold\b0  \'fe \u351?x\par\trowd\intbl A\cell B\cell\row\pard Next}"
    assert blocks.write_text(office.read_rtf(raw)).decode() == "Hello bold ş şx\n\nA\tB\n\nNext\n"
    with pytest.raises(Unreadable):
        office.read_rtf(b"hello")


def test_slides_come_by_number():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for n in (10, 2, 1):
            z.writestr(f"ppt/slides/slide{n}.xml", f'<sld><sp><nvSpPr><nvPr><ph type="title"/></nvPr></nvSpPr><txBody><p><r><rPr lang="fr-FR"/><t>T{n}</t></r></p></txBody></sp></sld>')
    d = office.read_pptx(out.getvalue())
    assert [blocks.plain(b.spans) for b in d.blocks] == ["T1", "T2", "T10"] and d.lang == "fr-FR"


def test_open_document():
    content = (
        '<c><body><text><h outline-level="2">H</h><p>a <span style-name="B">b</span></p><list><list-item><p>i</p></list-item></list></text></body>'
        '<automatic-styles><style name="B"><text-properties font-weight="bold"/></style></automatic-styles></c>'
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", content)
    assert blocks.write_markdown(office.read_odt(out.getvalue())).decode() == "## H\n\na **b**\n\n- i\n"
    sheet = '<c><body><spreadsheet><table><table-row><table-cell number-columns-repeated="2" value="3"><p>three</p></table-cell><table-cell number-columns-repeated="5000"/></table-row><table-row number-rows-repeated="9000"/></table></spreadsheet></body></c>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", sheet)
    assert office.read_ods(out.getvalue()) == [["three", "three"]]


def test_workbook():
    rows = [["a", "b"], ["007", "1.5"], ["x", "TRUE"]]
    assert office.read_xlsx(office.write_xlsx(rows)) == rows
    assert [office.numeric(x) for x in ("1", "-0.5", "01", "1.", ".5", "1e3", "12345678901234567")] == [True, True, False, False, False, False, False]


def workbook_cells():
    odd = st.sampled_from(["", "1", "-0.5", "17.0", "1e5", "a&b", "<i>", "]]>", '"', " x ", "\n", "\t", "\r", "\x01", "\uffff", "ü", "TRUE", "1" * 20])
    return st.lists(st.lists(odd, max_size=4), max_size=5)


def outcome(f, *args):
    try:
        return f(*args)
    except Exception as e:
        return type(e)


@settings(max_examples=150)
@given(workbook_cells(), st.integers(0, 1 << 16), st.integers(0, 255))
def test_plain_workbooks_read_as_any_other(rows, at, byte):
    """Without the quick paths for plain packages and sheets nothing differs, damaged or not."""
    made = office.write_xlsx(rows)
    with zipfile.ZipFile(io.BytesIO(made)) as z:
        assert z.testzip() is None and len(z.namelist()) == 6
        sheet = z.read("xl/worksheets/sheet1.xml")
    broken = bytearray(made)
    broken[at % len(made)] = byte
    torn = bytearray(sheet)
    torn[at % len(sheet)] = byte
    for raw in (made, bytes(broken), office.zipped_after(office._workbook(), office.SHEET, bytes(torn))):
        with pytest.MonkeyPatch.context() as m:
            quick = outcome(office.read_xlsx, raw)
            m.setattr(office, "_directory", lambda _: None)
            m.setattr(office, "_plain_rows", lambda _: None)
            assert outcome(office.read_xlsx, raw) == quick


def test_plain_workbooks_need_no_xml_parser(monkeypatch):
    parsed, real = [], office.ElementTree.fromstring
    monkeypatch.setattr(office.ElementTree, "fromstring", lambda data: parsed.append(len(data)) or real(data))
    for i in range(50):
        rows = [["n", "flag", "quantity"], [str(i), "N", "17"], [str(i + 1), "R", "3.5"]]
        assert office.read_xlsx(office.write_xlsx(rows)) == rows
    assert len(parsed) <= 2  # the workbook's own parts, once


@given(st.integers(0, 16383))
def test_column_names(i):
    assert office.column_index(office.column_name(i) + "7") == i


text = st.text(st.characters(exclude_categories=("Cs", "Cc")), max_size=8)


@settings(max_examples=60)
@given(st.lists(st.lists(text, min_size=2, max_size=2), min_size=1, max_size=5))
def test_delimited_round_trip(rows):
    for d in ",\t":
        raw = trees.write_delimited(rows, d)
        assert [r for r in trees.read_delimited(raw, d)] == [[c.lstrip("﻿") if i == j == 0 else c for j, c in enumerate(r)] for i, r in enumerate(rows)]


tree = st.recursive(st.booleans() | st.integers(-(10**12), 10**12) | text, lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text("abc_", min_size=1, max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=80)
@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), tree, max_size=4))
def test_trees_round_trip(v):
    for kind in ("json", "yaml", "toml"):
        assert trees.TREE_READERS[kind](trees.TREE_WRITERS[kind](v)) == v, kind


def test_xml_tree():
    assert trees.read_xml(b'<r a="1">t<b>x</b><b>y</b></r>') == {"r": {"@a": "1", "b": ["x", "y"], "#text": "t"}}
    assert trees.read_xml(trees.write_xml([1, None, {"a b": "é"}])) == ["1", "", {"a_b": "é"}]
    with pytest.raises(Unreadable):
        trees.read_xml(b"<a>")


def test_tables_of_trees():
    assert trees.rows_of(trees.read_json(b'[{"b":1,"a":null},{"c":1e20}]')) == [["a", "b", "c"], ["", "1", ""], ["", "", "100000000000000000000"]]
    assert trees.rows_of([[1, None], ["x"]]) == [["1", ""], ["x"]]
    for bad in (5, [1], [{"a": 1}, 2]):
        with pytest.raises(Unreadable):
            trees.rows_of(bad)
    assert trees.records([["a", ""], ["1"], ["2", "3", "4"]]) == [{"a": "1", "col2": ""}, {"a": "2", "col2": "3"}]


def test_fonts():
    f = fonts.write_sfnt(b"\0\1\0\0", [(b"abcd", b"x" * 100), (b"head", b"12345")])
    assert fonts.read_sfnt(fonts.from_woff(fonts.to_woff(f))) == fonts.read_sfnt(f)
    with pytest.raises(Unreadable):
        fonts.from_woff(b"wOF2" + b"\0" * 60)


def test_tagged_and_palette_pictures():
    assert np.array_equal(photos.read_tiff(photos.write_tiff(PICTURE)), PICTURE)
    few = PICTURE // 64 * 64
    few[..., 3] = 255
    assert np.array_equal(photos.read_gif(photos.write_gif(few)), few)
    few[:3, :4, 3] = 0
    assert np.array_equal(photos.read_gif(photos.write_gif(few))[..., 3], few[..., 3])
    many = np.stack([*np.mgrid[0:120, 0:90], np.zeros((120, 90)), np.full((120, 90), 255)], axis=2).astype(np.uint8)
    assert np.abs(photos.read_gif(photos.write_gif(many)).astype(int) - many).mean() < 5
    for bad in (photos.read_gif, photos.read_tiff, photos.read_jpg):
        with pytest.raises(Unreadable):
            bad(b"GIF89a" + b"\0" * 30)


@pytest.mark.parametrize(("quality", "error"), [(30, 6), (85, 2), (100, 0.5)])
def test_jpeg(quality, error):
    y, x = np.mgrid[0:61, 0:83]
    p = np.stack([x * 3, y * 4, x + y, np.full_like(x, 255)], axis=2).astype(np.uint8)
    raw = photos.write_jpg(p, quality)
    assert pdf.jpeg_size(raw) == (83, 61, 3)
    back = photos.read_jpg(raw)
    assert back.shape == p.shape and np.abs(back.astype(int) - p).mean() < error


def test_pictures_agree_with_the_jvm(spark, tmp_path):
    """The JVM's own decoders read what is written here."""
    y, x = np.mgrid[0:40, 0:50]
    p = np.stack([x * 5, y * 6, x + y, np.full_like(x, 255)], axis=2).astype(np.uint8)
    coders = {"png": (images.write_png, images.read_png), "bmp": (images.write_bmp, images.read_bmp), "gif": (photos.write_gif, photos.read_gif), "tiff": (photos.write_tiff, photos.read_tiff), "jpg": (photos.write_jpg, photos.read_jpg)}
    for k, (w, _) in coders.items():
        (tmp_path / f"x.{k}").write_bytes(w(p))
    rows = spark.read.format("image").load(str(tmp_path)).select("image.*").collect()
    assert len(rows) == 5
    for r in rows:
        k = r.origin.rpartition(".")[2]
        jvm = np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, r.nChannels)[..., [2, 1, 0]].astype(int)
        own = coders[k][1]((tmp_path / f"x.{k}").read_bytes())[..., :3]
        assert np.abs(jvm - own).max() <= (3 if k == "jpg" else 0), k


@pytest.mark.parametrize("size", [(61, 83), (16, 16), (7, 130)])
def test_jpeg_of_another_encoder(spark, tmp_path, size):
    """Files of the JVM's encoder, which halves the colours.  Both kinds hold the same
    coefficients; its decoder blends halved colours, so the luma is compared to it."""
    h, w = size
    y, x = np.mgrid[0:h, 0:w]
    p = np.stack([x * 255 // w, y * 255 // h, 128 + 100 * np.sin(x / 9) * np.cos(y / 7), np.full_like(x, 255)], axis=2).astype(np.uint8)
    (tmp_path / "in.bmp").write_bytes(images.write_bmp(p))
    jvm, back = spark._jvm, []
    io, file = jvm.javax.imageio.ImageIO, jvm.java.io.File
    luma = np.array([0.299, 0.587, 0.114])
    for progressive in (False, True):
        out = tmp_path / f"{progressive}.jpg"
        writer = io.getImageWritersByFormatName("jpeg").next()
        how = writer.getDefaultWriteParam()
        how.setProgressiveMode(int(progressive))
        writer.setOutput(io.createImageOutputStream(file(str(out))))
        picture = io.read(file(str(tmp_path / "in.bmp")))
        writer.write(None, jvm.javax.imageio.IIOImage(picture, None, None), how)
        writer.getOutput().close()
        raw = out.read_bytes()
        assert (b"\xff\xc2" in raw) == progressive
        theirs = np.array(list(io.read(file(str(out))).getRGB(0, 0, w, h, None, 0, w))).astype(np.int64).reshape(h, w)
        theirs = np.stack([theirs >> 16 & 255, theirs >> 8 & 255, theirs & 255], axis=2)
        back.append(photos.read_jpg(raw))
        assert back[-1].shape == p.shape and np.abs((back[-1][..., :3] - theirs) @ luma).mean() < 1
        for cut in (raw[: len(raw) // 3], raw[:200], raw[:30]):
            with contextlib.suppress(Unreadable):
                photos.read_jpg(cut)
    assert np.array_equal(*back)


@settings(max_examples=30, deadline=None)
@given(st.binary(max_size=3000))
def test_lzw(data):
    assert photos._lzw_unpack(photos._lzw_pack(data, 8), 8, len(data)) == data


def test_png_kinds():
    """Filters, depths, palettes and interlacing, each written by hand."""
    import struct
    import zlib

    def png(w, h, depth, colour, body, interlaced=0, *more):
        chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + b"\0\0\0\0"
        head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, colour, 0, 0, interlaced))
        return b"\x89PNG\r\n\x1a\n" + head + b"".join(chunk(*m) for m in more) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")

    grey = lambda raw: images.read_png(raw)[..., 0].tolist()
    assert grey(png(3, 1, 8, 0, b"\1\5\1\1")) == [[5, 6, 7]]
    assert grey(png(2, 2, 8, 0, b"\0\5\6\2\1\1")) == [[5, 6], [6, 7]]
    assert grey(png(2, 2, 8, 0, b"\0\4\6\3\1\1")) == [[4, 6], [3, 5]]
    assert grey(png(2, 2, 8, 0, b"\0\4\6\4\1\1")) == [[4, 6], [5, 7]]
    assert grey(png(4, 1, 2, 0, b"\0\x1b")) == [[0, 85, 170, 255]]
    assert grey(png(1, 1, 16, 0, b"\0\x80\x01")) == [[128]]
    p = images.read_png(png(2, 1, 1, 3, b"\0\x40", 0, (b"PLTE", bytes([1, 2, 3, 4, 5, 6])), (b"tRNS", b"\x07")))
    assert p.tolist() == [[[1, 2, 3, 7], [4, 5, 6, 255]]]
    want = np.arange(81, dtype=np.uint8).reshape(9, 9)
    body = b"".join(b"\0" + bytes(line) for x, y, dx, dy in images.PASSES for line in want[y::dy, x::dx].tolist())
    assert grey(png(9, 9, 8, 0, body, 1)) == want.tolist()
    with pytest.raises(Unreadable):
        images.read_png(png(9, 9, 8, 0, b"\0"))


@pytest.mark.parametrize(
    ("body", "text", "lang"),
    [
        (rb"\deflang1033 Hello \u-10179?\u-8704? there", "Hello 😀 there", "en-US"),
        (rb"\deflang1031 Ja {\lang1036 beaucoup de mots} nein", "Ja beaucoup de mots nein", "fr-FR"),
        (rb"\deflang1033\deflangfe1041 a \u26085?\u26412?\u-30050?", "a 日本語", "ja-JP"),
        (rb"half \u-10179? and \u-8704? end \u-10179?", "half � and � end �", ""),
        (rb"\lang1024 none", "none", ""),
    ],
)
def test_rich_text_surrogates_and_languages(body, text, lang):
    d = office.read_rtf(rb"{\rtf1\ansi " + body + rb"}")
    assert " ".join(blocks.write_text(d).decode().split()) == text
    assert d.lang == lang
