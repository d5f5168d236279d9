"""The catalogue: formats, conversion edges and knobs, as small static relations."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from pyspark.sql import DataFrame, SparkSession

CATEGORIES = ("image", "video", "audio", "document", "archive", "data", "text", "subtitle", "font")
ENGINES = ("ffmpeg", "imagemagick", "office", "ghostscript", "poppler", "rsvg")
ENGINE_NAMES = {
    "ffmpeg": "FFmpeg", "imagemagick": "ImageMagick", "office": "ONLYOFFICE", "ghostscript": "Ghostscript", "poppler": "Poppler", "rsvg": "librsvg",
}

# Category, id, extensions, media type, label.
FORMAT_LINES = """
image png png image/png PNG
image jpg jpg,jpeg image/jpeg JPEG
image gif gif image/gif GIF
image bmp bmp image/bmp BMP
image tiff tiff,tif image/tiff TIFF
image webp webp image/webp WebP
image apng apng image/apng Animated PNG (.apng)
image avif avif image/avif AVIF
image heic heic,heif image/heic HEIC
image psd psd image/vnd.adobe.photoshop Photoshop (.psd)
image xcf xcf image/x-xcf GIMP (.xcf)
image ico ico image/x-icon Icon (.ico)
image svg svg image/svg+xml SVG
image qoi qoi image/qoi QOI
image pnm ppm,pnm,pgm,pbm image/x-portable-pixmap Netpbm (.ppm/.pgm/.pbm)
image tga tga image/x-tga Targa (.tga)
image dds dds image/vnd-ms.dds DirectDraw Surface (.dds)
image exr exr image/x-exr OpenEXR (.exr)
video mp4 mp4,m4v video/mp4 MP4
video mkv mkv video/x-matroska Matroska (.mkv)
video webm webm video/webm WebM
video mov mov video/quicktime QuickTime (.mov)
video avi avi video/x-msvideo AVI
video flv flv video/x-flv Flash Video (.flv)
video wmv wmv video/x-ms-wmv Windows Media (.wmv)
video mpg mpg,mpeg video/mpeg MPEG-2 (.mpg)
video ts ts,m2ts video/mp2t MPEG-TS (.ts)
video 3gp 3gp video/3gpp 3GP
video ogv ogv video/ogg Ogg Theora (.ogv)
audio mp3 mp3 audio/mpeg MP3
audio wav wav audio/wav WAV
audio flac flac audio/flac FLAC
audio ogg ogg,oga audio/ogg Ogg Vorbis
audio aac aac audio/aac AAC
audio m4a m4a audio/mp4 M4A (AAC)
audio opus opus audio/opus Opus
audio wma wma audio/x-ms-wma Windows Media Audio (.wma)
audio aiff aiff,aif audio/aiff AIFF
audio ac3 ac3 audio/ac3 Dolby AC-3
document pdf pdf application/pdf PDF
document docx docx application/vnd.openxmlformats-officedocument.wordprocessingml.document Word (.docx)
document doc doc application/msword Word 97 (.doc)
document odt odt application/vnd.oasis.opendocument.text OpenDocument Text (.odt)
document rtf rtf application/rtf Rich Text (.rtf)
document xlsx xlsx application/vnd.openxmlformats-officedocument.spreadsheetml.sheet Excel (.xlsx)
document ods ods application/vnd.oasis.opendocument.spreadsheet OpenDocument Spreadsheet (.ods)
document pptx pptx application/vnd.openxmlformats-officedocument.presentationml.presentation PowerPoint (.pptx)
document odp odp application/vnd.oasis.opendocument.presentation OpenDocument Presentation (.odp)
document epub epub application/epub+zip EPUB
document ps ps application/postscript PostScript (.ps)
document eps eps application/postscript EPS
archive zip zip application/zip ZIP
archive tar tar application/x-tar TAR
archive tgz tar.gz,tgz application/gzip TAR + gzip (.tar.gz)
archive tzst tar.zst,tzst application/zstd TAR + zstd (.tar.zst)
archive txz tar.xz,txz application/x-xz TAR + xz (.tar.xz)
archive tbz2 tar.bz2,tbz2,tbz application/x-bzip2 TAR + bzip2 (.tar.bz2)
archive rar rar application/vnd.rar RAR
data csv csv text/csv CSV
data tsv tsv text/tab-separated-values TSV
data json json application/json JSON
data yaml yaml,yml application/yaml YAML
data xml xml application/xml XML
data toml toml application/toml TOML
text txt txt,text text/plain Plain text (.txt)
text md md,markdown text/markdown Markdown
text html html,htm,xhtml text/html HTML
subtitle srt srt application/x-subrip SubRip (.srt)
subtitle vtt vtt text/vtt WebVTT (.vtt)
subtitle ass ass,ssa text/x-ssa SubStation Alpha (.ass)
font ttf ttf font/ttf TrueType (.ttf)
font otf otf font/otf OpenType (.otf)
font woff woff font/woff WOFF
"""

# Named groups of formats that the edge rules use.
GROUPS = {
    "coded": "png jpg gif bmp tiff webp qoi pnm tga ico",
    "raster": "png jpg gif bmp tiff webp",
    "exotic": "heic psd avif xcf dds exr",
    "still": "png jpg bmp tiff pnm tga",
    "moving": "gif webp apng",
    "packed": "zip tar tgz tzst txz tbz2 rar",
    "packable": "zip tar tgz tzst txz",
    "tree": "json yaml xml toml",
    "read": "md html txt docx odt rtf pptx epub",
    "written": "md html txt pdf docx epub",
    "letter": "docx doc odt rtf",
}

# Fixed values, one family of edges a line: sources > targets | engine | cost in
# thousandths | lossy targets (* for all) | knobs | flags.  A group's name stands
# for its formats, @name for a category, and t:knob gives a knob to one target.
# A knob list in brackets goes to lossy targets only.  Later lines never repeat an
# edge of an earlier one with the same engine.  Flags: t terminal, i initial, m
# several outputs, v/p the choice list of the preset knob.
EDGE_RULES = """
coded > coded | - | 1000 | jpg gif ico | jpg:quality ico:icon_sizes |
coded > pdf | - | 1000 | | |
coded > svg | - | 1200 | | | t
coded > txt | - | 1200 | * | | t
packed > packable | - | 1000 | | |
!archive > packable | - | 2500 | | | ti
tree > tree | - | 1000 | | |
csv tsv > json yaml csv tsv md html xlsx | - | 1000 | | |
json yaml > csv tsv | - | 1000 | * | |
json yaml > xlsx | - | 1200 | | |
xlsx ods > csv tsv json yaml md html | - | 1200 | * | |
ods > xlsx | - | 1400 | * | |
xml toml > csv | - | 1200 | * | |
md > html txt pdf docx epub | - | 1000 | txt | |
txt > md html pdf docx epub | - | 1000 | | |
html > md txt epub | - | 1000 | md txt | |
html > pdf docx | - | 1200 | | |
docx odt rtf pptx epub > written | - | 1600 | md html txt epub | |
srt > vtt | - | 1000 | | |
vtt > srt | - | 1000 | * | |
srt vtt > txt | - | 1000 | * | | t
ttf otf > woff | - | 1000 | | |
woff > ttf otf | - | 1000 | | |
ttf > otf | - | 1000 | | |
@video > @video | ffmpeg | 1000 | * | preset crf max_height | v
@video > moving | ffmpeg | 1000 | * | max_height | t
@video > png | ffmpeg | 1000 | * | at every max_height | mt
@video > jpg | ffmpeg | 1000 | * | at every max_height quality | mt
@video > @audio | ffmpeg | 1000 | * | bitrate |
moving > mp4 webm mkv mov | ffmpeg | 1000 | * | crf | i
moving > moving | ffmpeg | 1300 | * | max_height | i
@audio > @audio | ffmpeg | 1000 | mp3 ogg aac m4a opus wma ac3 | (bitrate) |
@audio > png | ffmpeg | 1000 | * | picture | t
@audio > jpg | ffmpeg | 1000 | * | picture quality | t
@audio > mp4 webm mkv | ffmpeg | 1200 | * | picture crf | t
still > mp4 webm mkv mov | ffmpeg | 1200 | * | duration crf | ti
@subtitle > @subtitle | ffmpeg | 1300 | * | |
exotic > raster | imagemagick | 1000 | jpg gif webp | (quality) |
raster > raster | imagemagick | 1500 | jpg gif webp | (quality) |
raster > avif | imagemagick | 1000 | * | quality |
raster > pdf | imagemagick | 1500 | | |
raster > ico | imagemagick | 1500 | * | |
raster > psd exr | imagemagick | 1000 | | |
raster > dds | imagemagick | 1000 | * | |
ico > png | imagemagick | 1500 | | |
svg > png | imagemagick | 1300 | | dpi |
svg > jpg webp | imagemagick | 1300 | * | dpi quality |
pdf > png | imagemagick | 1500 | * | dpi pages | m
pdf > jpg | imagemagick | 1500 | * | dpi pages quality | m
eps > png | imagemagick | 1500 | * | dpi |
ps > png | imagemagick | 1500 | * | dpi | m
letter > pdf docx odt rtf html txt epub | office | 1000 | rtf txt html | pdf:pdfa |
html txt > pdf docx odt | office | 1000 | | pdf:pdfa |
epub > pdf docx odt | office | 1200 | | pdf:pdfa |
xlsx ods > pdf xlsx ods csv | office | 1000 | csv | pdf:pdfa |
csv > xlsx | office | 1200 | | |
csv > ods pdf | office | 1000 | | pdf:pdfa |
pptx odp > pdf pptx odp | office | 1000 | | pdf:pdfa |
pdf > pdf | ghostscript | 1000 | * | preset pdfa | ps
ps eps > pdf | ghostscript | 1000 | | |
pdf > ps | ghostscript | 1000 | | |
pdf > eps | ghostscript | 1000 | | pages |
pdf > png tiff | ghostscript | 1300 | * | dpi pages | m
pdf > jpg | ghostscript | 1300 | * | dpi pages quality | m
pdf > txt | ghostscript | 1400 | * | | ti
ps > png | ghostscript | 1200 | * | dpi | m
ps > jpg | ghostscript | 1200 | * | dpi quality | m
eps > png | ghostscript | 1200 | * | dpi |
eps > jpg | ghostscript | 1200 | * | dpi quality |
pdf > png tiff | poppler | 1000 | * | dpi pages | m
pdf > jpg | poppler | 1000 | * | dpi pages quality | m
pdf > txt | poppler | 1000 | * | | ti
pdf > svg | poppler | 1000 | * | pages | ti
pdf > eps | poppler | 1200 | | pages |
pdf > ps | poppler | 1200 | | |
svg > png | rsvg | 1000 | | dpi |
svg > pdf ps eps | rsvg | 1000 | | |
"""

#: Longest route, and the thousandths by which a lossy edge's cost counts.
MAX_STEPS, LOSSY = 3, 1400

# Knob, type, least, most, default; then choices by variant.
KNOB_ORDER = "merge preset quality crf max_height bitrate dpi pages pdfa picture at every duration icon_sizes".split()
KNOB_RANGES = {
    "quality": (1, 100, 85), "crf": (0, 51, 23), "max_height": (0, 4320, 0), "dpi": (36, 600, 150),
    "at": (0, 359999, 0), "every": (0, 3600, 0), "duration": (1, 600, 5),
}
KNOB_CHOICES = {
    ("preset", "video"): "copy ultrafast fast medium slow",
    ("preset", "pdf"): "screen ebook printer prepress",
    ("bitrate", ""): "96 128 192 256 320",
    ("picture", ""): "waveform spectrogram",
    ("icon_sizes", ""): "favicon app single",
    ("pdfa", ""): "true false",
    ("merge", ""): "true false",
}
KNOB_DEFAULTS = {"preset": "medium", "bitrate": "192", "picture": "waveform", "icon_sizes": "favicon", "pages": "", "pdfa": "false", "merge": "false"}
KNOB_DEFAULTS |= {k: str(v[2]) for k, v in KNOB_RANGES.items()}


@dataclass(frozen=True)
class Format:
    ord: int
    id: str
    ext: tuple[str, ...]
    mime: str
    category: str
    label: str


@dataclass(frozen=True)
class Edge:
    src: str
    dst: str
    engine: str
    cost: int
    lossy: bool
    knobs: tuple[str, ...]
    variant: str
    multi: bool
    terminal: bool
    initial: bool

    @property
    def key(self) -> str:
        return f"{self.src}>{self.dst}@{self.engine}"

    @property
    def weight(self) -> int:
        return self.cost * (LOSSY if self.lossy else 1000) // 1000


@cache
def formats() -> tuple[Format, ...]:
    rows = [line.split(" ", 4) for line in FORMAT_LINES.strip().splitlines()]
    return tuple(Format(i, name, tuple(ext.split(",")), mime, cat, label) for i, (cat, name, ext, mime, label) in enumerate(rows))


def _ids(words: str) -> list[str]:
    """Format ids of a rule's side: ids, groups, @category and !category (all but)."""
    out: list[str] = []
    for w in words.split():
        if w[0] in "@!":
            out += [f.id for f in formats() if (f.category == w[1:]) == (w[0] == "@")]
        else:
            out += GROUPS.get(w, w).split()
    return out


@cache
def edges() -> tuple[Edge, ...]:
    out: dict[str, Edge] = {}
    for line in EDGE_RULES.strip().splitlines():
        sides, engine, cost, lossy, knobs, flags = (x.strip() for x in line.split("|"))
        sources, targets = (_ids(x) for x in sides.split(" > "))
        engine = "" if engine == "-" else engine
        lossy_to = set(targets) if lossy == "*" else set(_ids(lossy))
        only_lossy, words = knobs.startswith("("), knobs.strip("()").split()
        for s in sources:
            for t in targets:
                if s == t and "s" not in flags:
                    continue
                own = [k.rpartition(":")[2] for k in words if ":" not in k or k.startswith(f"{t}:")]
                keep = t in lossy_to or not only_lossy
                variant = "video" if "v" in flags else "pdf" if "p" in flags else ""
                e = Edge(s, t, engine, int(cost), t in lossy_to, tuple(own if keep else ()), variant, "m" in flags, "t" in flags, "i" in flags)
                if e.key in out:
                    raise ValueError(f"edge {e.key} is given twice")
                out[e.key] = e
    return tuple(out.values())


def is_pack(e: Edge) -> bool:
    kind = {f.id: f.category for f in formats()}
    return kind[e.dst] == "archive" and kind[e.src] != "archive"


def formats_df(spark: SparkSession) -> DataFrame:
    rows = [(f.ord, f.id, list(f.ext), f.mime, f.category, f.label) for f in formats()]
    return spark.createDataFrame(rows, "ord int, id string, ext array<string>, mime string, category string, label string")


def edges_df(spark: SparkSession) -> DataFrame:
    rows = [
        (e.src, e.dst, e.engine, e.key, e.cost, e.weight, e.lossy, list(e.knobs), e.variant, e.multi, e.terminal, e.initial, is_pack(e))
        for e in edges()
    ]
    return spark.createDataFrame(
        rows,
        "src string, dst string, engine string, key string, cost int, weight int, lossy boolean, knobs array<string>, variant string,"
        " multi boolean, terminal boolean, initial boolean, pack boolean",
    )


def knobs_df(spark: SparkSession) -> DataFrame:
    """(knob, variant, ord, kind, least, most, choices, default)."""
    rows = []
    for i, k in enumerate(KNOB_ORDER):
        if k in KNOB_RANGES:
            lo, hi, _ = KNOB_RANGES[k]
            rows.append((k, "", i, "int", lo, hi, None, KNOB_DEFAULTS[k]))
        elif k == "pages":
            rows.append((k, "", i, "pages", None, None, None, ""))
        else:
            for (name, variant), words in KNOB_CHOICES.items():
                if name == k:
                    default = "ebook" if variant == "pdf" else KNOB_DEFAULTS[k]
                    rows.append((k, variant, i, "bool" if k in ("pdfa", "merge") else "select", None, None, words.split(), default))
    return spark.createDataFrame(
        rows, "knob string, variant string, ord int, kind string, least int, most int, choices array<string>, default string"
    )
