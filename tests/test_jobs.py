import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.functions import messages, text
from weftline.functions.codecs import images, photos, webp
from weftline.operators import detect as D
from weftline.operators import engines as E
from weftline.operators import jobs as J
from weftline.operators import subtitles as S
from weftline.operators.retry import run_with_retry
from weftline.plans.catalog import edges
from weftline.plans.planner import routes
from weftline.sources.files import read_files, write_files


@pytest.mark.parametrize(
    ("name", "fmt", "stem"),
    [
        ("a.PNG", "png", "a"), ("photo.jpeg", "jpg", "photo"), ("x.tar.gz", "tgz", "x"), ("a.b.docx", "docx", "a.b"), ("c:\\d\\e.txt", "txt", "e"), ("p/q.tgz", "tgz", "q"),
        ("noext", None, "noext"), (".hidden", None, ".hidden"), ("dot.", None, "dot."), ("x.unknown", None, "x"), (".tar.gz", None, ".tar"), ("a.tar.zst", "tzst", "a"),
    ],
)
def test_detect(spark, name, fmt, stem):
    r = D.detect(spark.createDataFrame([(name,)], "name string")).head()
    assert (r.format, r.stem) == (fmt, stem)


@pytest.mark.parametrize(("value", "want"), [("", (0, 0)), ("3", (3, 3)), ("2-5", (2, 5)), ("2-", (2, 0)), (" 7 ", (7, 7)), ("0", None), ("5-2", None), ("1-3,5", None), ("x", None), (None, (0, 0))])
def test_page_range(spark, value, want):
    r = spark.createDataFrame([(value,)], "v string").select(J.page_range(F.col("v")).alias("p")).head().p
    assert (None if r is None else tuple(r)) == want
    assert E.Knobs({"pages": value or ""}).pages() == (want or (0, 0))


def test_plan_files_codes(spark):
    f = spark.createDataFrame([("a.png", 1), ("b.mp4", 1), ("c.zzz", 1), ("d.mp3", 1), ("e.bmp", J.MAX_INPUT + 1)], "name string, size long")
    got = {r.name: r for r in J.plan_files(f, routes(spark, ()), routes(spark), "pdf", size="size").collect()}
    assert got["a.png"].error_code is None and got["a.png"]["keys"] == ["png>pdf@"]
    assert got["c.zzz"].error_code == "unknown_format" and got["e.bmp"].error_code == "too_large"
    assert got["b.mp4"].error_code in ("engine_missing", "no_route") and got["d.mp3"].error_code in ("engine_missing", "no_route")
    assert {r.error_code for r in J.plan_files(f, routes(spark, ()), routes(spark), "nonsense").collect()} == {"no_target"}


def test_output_names(spark):
    rows = [("f", "s", "pdf", "png", "png", 10), ("f", "s", "pdf", "png", "png", 2), ("g", "t", "pdf", "pdf", "pdf", 0), ("h", "u", "png", "jpg", "jpg", 0), ("i", "v", "pdf", "png", "png", 3)]
    d = spark.createDataFrame(rows, "file string, stem string, src string, dst string, ext string, page int")
    assert sorted(r.output for r in J.output_names(d, "file", "stem", "src", "dst", "ext", "page").collect()) == ["s-10.png", "s-2.png", "t.compressed.pdf", "u.jpg", "v-3.png"]
    assert spark.createDataFrame([("out-03.png",), ("x.png",)], "n string").select(J.page_number(F.col("n")).alias("p")).collect() == [(3,), (0,)]


@pytest.mark.parametrize(("name", "is_dir", "want"), [("a/b", False, "a/b"), ("/a//b/", True, "a/b/"), ("../x", False, None), ("a/../b", False, None), ("a\\b", False, "a/b"), ("./", True, None)])
def test_entry_names(spark, name, is_dir, want):
    d = spark.createDataFrame([(name, is_dir)], "n string, d boolean")
    assert d.select(J.clean_entry_name(F.col("n"), F.col("d"))).head()[0] == want


def test_retry(spark):
    def run(planned):
        broken = F.array_contains("keys", "docx>pdf@office") | F.array_contains("keys", "odp>pdf@office")
        return planned.select("*", F.when(~broken, F.array_join("keys", " ").cast("binary")).alias("result"), F.when(broken, "engine_failed").alias("error_code"), F.when(broken, F.col("keys")[0]).alias("failed_key"))

    f = spark.createDataFrame([("a.docx",), ("b.png",), ("c.odp",), ("d.none",)], "name string")
    got = {r.name: r for r in run_with_retry(f, "pdf", run).collect()}
    assert got["a.docx"].error_code is None and b"docx>pdf@office" not in bytes(got["a.docx"].result)
    assert got["b.png"].error_code is None and got["d.none"].error_code == "unknown_format"
    assert len(got) == 4 and (got["c.odp"].error_code in (None, "engine_failed"))


def test_cues(spark):
    srt = "\ufeff1\r\n00:00:01,5 --> 00:00:02,000\r\n<b>Hi</b> & <c.x>you</c>\r\nthere\r\n\r\nbad\r\n\r\n2\r\n01:02.250 --> 1:00:00,001\r\nx\r\n"
    d = spark.createDataFrame([(srt,), ("no cues",)], "text string")
    c = [tuple(x) for x in d.select(S.parse_cues(F.col("text")).alias("c")).head().c]
    assert c == [(1500, 2000, "<b>Hi</b> & <c.x>you</c>\nthere"), (62250, 3600001, "x")]
    out = {k: S.convert(d, "srt", k).collect() for k in ("srt", "vtt", "txt")}
    assert out["vtt"][0].result.startswith("WEBVTT\n\n00:00:01.500 --> 00:00:02.000\n<b>Hi</b> &amp; ")
    assert out["srt"][0].result.startswith("1\n00:00:01,500 --> 00:00:02,000\n<b>Hi</b> & you\nthere\n")
    assert out["txt"][0].result == "Hi & you\nthere\nx\n" and out["txt"][1].error_code == "convert_failed"


def test_every_engine_edge_builds_safe_words():
    n = 0
    for e in edges():
        if e.engine:
            n += 1
            for answers in ({}, {"pages": "2-5", "every": "3", "preset": "copy", "pdfa": "true", "picture": "spectrogram", "max_height": "720", "quality": "999"}):
                inv = E.build(e, answers)
                assert all(map(E.safe_argument, inv.args)) and 0 < inv.seconds <= 900
                assert e.multi or inv.outputs
    assert n == 644
    assert [E.safe_argument(x) for x in ("ok", "", "a/b", "..", "@list", "HTTP:x", "a=file:b", "x" * 5000)] == [True] + [False] * 7


def test_known_lines():
    by = {e.key: e for e in edges()}
    line = lambda k, **a: " ".join(E.build(by[k], a).args)
    assert line("mp4>mp3@ffmpeg", bitrate="320") == "-hide_banner -nostdin -y -i in.mp4 -vn -c:a libmp3lame -b:a 320k out.mp3"
    assert line("pdf>png@poppler", pages="2-") == "pdftoppm -r 150 -png -f 2 in.pdf out"
    assert line("svg>png@rsvg", dpi="300") == "--format=png --dpi-x=300 --dpi-y=300 --output=out.png in.svg"
    assert line("docx>pdf@office") == "--convert-to pdf:writer_pdf_Export in.docx"
    assert E.slideshow("gif", "x", {}).args[-1] == "x.gif"


def test_messages(spark):
    d = spark.createDataFrame([("too_large", "de-AT"), ("no_route", "xx"), ("nothing", "en")], "code string, locale string")
    got = [r[0] for r in d.select(messages.message(F.col("code"), F.col("locale"), {"file": F.lit("a"), "target": F.lit("PDF")})).collect()]
    assert got == ["a: zu groß", "a: can't become PDF", None]
    names = {k: {lang: set(__import__("re").findall(r"\{(\w+)\}", m)) for lang, m in v.items()} for k, v in messages.MESSAGES.items()}
    assert all(set(v) == set(messages.LANGUAGES) and len({frozenset(x) for x in v.values()}) == 1 for v in names.values())
    assert set(messages.MESSAGES) == set(J.CODES)


def test_cells_and_names(spark):
    d = spark.createDataFrame([(1e20, 0.1, 5.0, None, -1.5e-7)], "a double, b double, c double, d double, e double")
    assert list(d.select(*[text.cell_string(F.col(c), "double") for c in d.columns]).head()) == ["100000000000000000000", "0.1", "5", "", "-0.00000015"]
    n = spark.createDataFrame([("a b",), ("1x",), ("é-1",), ("",), ("Xml",)], "n string")
    assert [r[0] for r in n.select(text.xml_name(F.col("n"))).collect()] == ["a_b", "x", "é-1", "item", "_Xml"]


def test_files_in_and_out(spark, tmp_path):
    d = spark.createDataFrame([("a/x.txt", b"hello"), ("y.txt", b"y"), ("../z", b"no"), ("w", None)], "output string, result binary")
    got = {r.name: r.error_code for r in write_files(d, str(tmp_path / "o")).collect()}
    assert got == {"a/x.txt": None, "y.txt": None, "../z": "write_failed", "w": "write_failed"}
    back = {r.name: (r.size, r.error_code, r.content and bytes(r.content)) for r in read_files(spark, str(tmp_path / "o"), limit=3).collect()}
    assert back == {"x.txt": (5, "too_large", None), "y.txt": (1, None, b"y")}


def test_stream_converts_once(spark, tmp_path):
    from weftline.streaming.ingest import convert_stream

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("x,y\n1,2\n")
    for extra in ("b.bad", "c.tsv"):
        q = convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "json")
        q.awaitTermination()
        (tmp_path / "in" / extra).write_text("p\tq\n3\t4\n")
    q = convert_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck"), "json")
    q.awaitTermination()
    got = {r.output: (r.result and bytes(r.result).decode(), r.error_code) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got["a.json"] == ('[\n  {\n    "x": "1",\n    "y": "2"\n  }\n]\n', None)
    assert got["c.json"][1] is None and got["b.json"] == (None, "unknown_format") and len(got) == 3


def test_merge(spark):
    import numpy as np

    from weftline.functions.codecs import archives, images
    from weftline.operators.merge import merge

    png = images.write_png(np.zeros((2, 3, 4), np.uint8))
    rows = [(1, "b.png", png), (1, "a.png", png), (2, "x.txt", b"hi"), (2, "x.txt", b"ho"), (3, "bad.png", b"no"), (3, "ok.png", png), (4, "n.png", None), (5, "big.png", png * 50)]
    d = spark.createDataFrame(rows, "sel long, name string, content binary")
    got = {r.sel: r for r in merge(d, "sel", "pdf", limit=3000).collect()}
    assert got[1].output == "a.pdf" and bytes(got[1].result).count(b"/Type /Page ") == 2
    assert {k: r.error_code for k, r in got.items()} == {1: None, 2: "no_route", 3: "convert_failed", 4: "read_failed", 5: "too_large"}
    packed = {r.sel: r for r in merge(d.where("sel = 2"), "sel", "zip").collect()}
    assert [(e.name, e.data) for e in archives.read(bytes(packed[2].result), "zip")] == [("x.txt", b"hi"), ("x-2.txt", b"ho")]
    assert {r.error_code for r in merge(d.where("sel = 1"), "sel", "gif").collect()} == {"engine_missing"}


def test_document_columns(spark):
    from weftline.operators import documents as DM

    md = b"# One\n\nPara **b**\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n# Two\n\n    code\n"
    d = spark.createDataFrame([(1, bytearray(md)), (2, bytearray(b"just text")), (3, None)], "k long, raw binary")
    docs = DM.read_documents(d, "k", "raw", "md")
    rows = DM.chapters(DM.block_rows(docs, "k"), "k").orderBy("k", "pos").collect()
    assert [(r.k, r.kind, r.text, r.chapter) for r in rows] == [
        (1, "heading", "One", 1), (1, "paragraph", "Para b", 1), (1, "table", "a\tb\n1\t2", 1), (1, "heading", "Two", 2), (1, "code", "code", 2), (2, "paragraph", "just text", 0),
    ]
    titles = docs.select("k", DM.title_of(F.col("title"), F.col("blocks")).alias("t")).orderBy("k").collect()
    assert [r.t for r in titles] == ["One", "just text", "Document"]
    back = {r.k: bytes(r.result).decode() for r in DM.write_documents(docs, "k", "md").collect()}
    assert back[1] == "# One\n\nPara **b**\n\n| a | b |\n| --- | --- |\n| 1 | 2 |\n\n# Two\n\n```\ncode\n```\n" and back[3] == ""
    bad = DM.read_documents(spark.createDataFrame([(1, bytearray(b"x"))], "k long, raw binary"), "k", "raw", "docx").head()
    assert bad.error_code == "convert_failed" and bad.blocks is None


def test_analyse(spark):
    from weftline.operators.analyse import analyse

    d = spark.createDataFrame([(1, "a.png"), (1, "b.jpg"), (2, "a.docx"), (2, "b.xlsx"), (2, "c.docx"), (3, "x.zzz")], "sel int, name string")
    got = {}
    for r in analyse(d, "sel", engines=[]).collect():
        got.setdefault((r.sel, r.state), {})[r.target] = r.needed
    assert len(got[1, "open"]) == 16 and len(got[1, "blocked"]) == 10 and len(got[2, "open"]) == 10 and len(got[2, "blocked"]) == 19
    assert set(got[1, "merge"]) == {"pdf", "mp4", "webm", "mkv", "gif", "zip", "tar", "tgz", "tzst", "txz"} and len(got[2, "merge"]) == 5
    assert got[1, "blocked"]["mp4"] == "ffmpeg" and all(got[2, "blocked"].values()) and 3 not in {k[0] for k in got}


def test_script_languages(spark):
    from weftline.functions import lang as L

    rows = [(1, "ja", "日本語テキスト"), (1, "en", "words here"), (1, "de", "wörter"), (1, "zh", "中文"), (1, "ar", "مرحبا"), (2, "fr", "abc"), (2, "", "def"), (3, "es", "123"), (3, None, None)]
    d = spark.createDataFrame(rows, "k int, lang string, text string")
    got = {r.k: (r.other, r.east, r.right) for r in L.script_langs(d, "k", "lang", "text").collect()}
    assert got == {1: ("en", "ja", "ar"), 2: ("", None, None), 3: (None, None, None)}
    assert {r.k: r.lang for r in L.top_lang(d, "k", "lang", "text").collect()} == {1: "en", 2: ""}


@pytest.mark.parametrize(
    ("tag", "want"),
    [("EN", "en"), ("pt_br", "pt-BR"), ("zh-hant-tw", "zh-Hant-TW"), ("es-419", "es-419"), ("und", ""), ("mul-x", ""), ("x", ""), ("en-", ""), ("<b>", ""), (" de ", "de"), (None, "")],
)
def test_language_tags(spark, tag, want):
    from weftline.functions import lang as L
    from weftline.functions.codecs.office import tag as plain

    d = spark.createDataFrame([(tag,)], "t string").select(L.normalize_lang(F.col("t")).alias("n"), L.lang_or_und(F.col("t")).alias("u"), L.first_lang(F.lit("zxx"), F.col("t")).alias("f")).head()
    assert (d.n, d.u, d.f) == (want, want or "und", want) and plain(tag or "") == want


@pytest.mark.parametrize(
    ("html", "want"),
    [("<html lang='fr-ca'>", "fr-CA"), ("<HTML xml:lang=de class=x>", "de"), ("<html data-lang='xx'><meta http-equiv=Content-Language content='tr, en'>", "tr"), ("<p lang=es>", ""), ("<html lang=''>", "")],
)
def test_page_language(spark, html, want):
    from weftline.functions import lang as L

    assert spark.createDataFrame([(html,)], "h string").select(L.html_lang(F.col("h"))).head()[0] == want


def test_parts_are_bounded_by_entries_and_unreadable_archives_are_rows(spark):
    from pyspark.sql import functions as F

    from weftline.operators import convert as V

    n = 60_000
    d = spark.range(n).select(F.lit("a").alias("sel"), "id", F.concat(F.lit("f"), "id").alias("name"), F.lit("x").alias("content"))
    parts = V.pack(d, "sel", "name", "content", "zip", "id").select("n_entries").collect()
    assert len(parts) == 2 and sum(r.n_entries for r in parts) == n
    bad = spark.createDataFrame([("b", bytearray(b"no archive"), "zip")], "sel string, data binary, fmt string")
    assert [(r.sel, r.entry, r.error_code) for r in V.unpack(bad, "sel", "data", "fmt").collect()] == [("b", None, "unreadable")]


def test_job_chain(spark):
    """Every file keeps its row: converted, badly asked for, unplanned or broken."""
    from weftline.operators.run import run_files

    png = images.write_png(np.full((3, 4, 4), 200, np.uint8))
    rows = [("a.png", png, {"quality": "90", "crf": "nonsense"}), ("b.png", png, {"quality": "0"}), ("c.zzz", b"x", {}), ("d.png", b"broken", {}), ("e.mp3", b"x", None), ("f.webp", webp.write_webp(np.full((3, 4, 4), 9, np.uint8)), None), ("g.png", None, {})]
    files = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "name string, content binary, knobs map<string,string>, row int")
    got = {r.name: r for r in run_files(files, "jpg", knobs="knobs").collect()}
    assert len(got) == len(rows) and [got[r[0]].row for r in rows] == list(range(len(rows)))
    assert got["a.png"].output == "a.jpg" and photos.read_jpg(bytes(got["a.png"].result)).shape == (3, 4, 4)
    assert got["f.webp"].error_code is None
    codes = {n: r.error_code for n, r in got.items() if r.error_code}
    assert codes.pop("e.mp3") in ("no_route", "engine_missing") and got["b.png"].detail == "quality" and got["c.zzz"].output == "c.jpg"
    assert codes == {"b.png": "bad_options", "c.zzz": "unknown_format", "d.png": "convert_failed", "g.png": "read_failed"}
    assert {r.error_code for r in run_files(files, "nonsense").collect()} == {"no_target"}


@pytest.mark.parametrize(("knob", "value", "variant", "fails"), [
    ("max_height", "4321", "", True), ("max_height", " 720 ", "", False), ("preset", "ebook", "pdf", False), ("preset", "ebook", "video", True), ("preset", "fast", "", False),
    ("preset", "ebook", "", True), ("dpi", "35", "", True), ("dpi", "x", "", True), ("picture", "waveform", "", False), ("picture", "photo", "", True), ("at", "-1", "", True),
    ("every", "3600", "", False), ("duration", "0", "", True), ("icon_sizes", "app", "", False), ("icon_sizes", "16", "", True), ("pdfa", "maybe", "", False), ("merge", None, "", False),
    ("pages", "5-2", "", True), ("pages", "2-", "", False), ("unknown", "x", "", False), ("bitrate", "", "", False), ("bitrate", "97", "", True),
])
def test_every_knob(spark, knob, value, variant, fails):
    d = spark.createDataFrame([(knob, value, variant)], "knob string, value string, variant string")
    assert J.invalid_knobs(d).count() == int(fails)
