"""Command lines of external engines, from tables of codecs and the answers to knobs.

A line is only built, never run here: every word is checked to be a bare token.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from weftline.operators.jobs import MAX_OUTPUTS
from weftline.plans.catalog import KNOB_CHOICES, KNOB_RANGES, Edge, formats


@dataclass(frozen=True)
class Invocation:
    engine: str
    args: tuple[str, ...]
    outputs: tuple[str, ...]
    seconds: int


# Codecs by container, and sound codecs; {k} is the bit rate.
H264 = "-c:v libx264 -pix_fmt yuv420p"
VIDEO = {
    "mp4": f"{H264} -c:a aac -movflags +faststart", "mov": f"{H264} -c:a aac -movflags +faststart", "mkv": f"{H264} -c:a aac",
    "avi": f"{H264} -c:a libmp3lame", "webm": "-c:v libvpx-vp9 -b:v 0 -row-mt 1 -c:a libopus", "flv": f"{H264} -c:a aac", "ts": f"{H264} -c:a aac",
    "3gp": f"{H264} -c:a aac", "wmv": "-c:v wmv2 -pix_fmt yuv420p -c:a wmav2", "mpg": "-c:v mpeg2video -pix_fmt yuv420p -c:a mp2",
    "ogv": "-c:v libtheora -pix_fmt yuv420p -c:a libvorbis",
}
SOUND = {
    "mp3": "-c:a libmp3lame -b:a {rate}k", "aac": "-c:a aac -b:a {rate}k", "m4a": "-c:a aac -b:a {rate}k -f mp4", "ogg": "-c:a libvorbis -b:a {rate}k",
    "opus": "-c:a libopus -b:a {rate}k", "wma": "-c:a wmav2 -b:a {rate}k", "ac3": "-c:a ac3 -b:a {rate}k", "flac": "-c:a flac", "wav": "-c:a pcm_s16le",
    "aiff": "-c:a pcm_s16be",
}
SETTINGS = {
    "screen": (72, 300), "ebook": (150, 300), "printer": (300, 1200),
}
FILTERS = {
    "docx": "docx:MS Word 2007 XML", "odt": "odt", "rtf": "rtf:Rich Text Format", "txt": "txt:Text (encoded):UTF8", "html": "html:HTML (StarWriter)",
    "epub": "epub:EPUB", "xlsx": "xlsx:Calc MS Excel 2007 XML", "ods": "ods", "pptx": "pptx:Impress MS PowerPoint 2007 XML", "odp": "odp",
    "csv": "csv:Text - txt - csv (StarCalc):44,34,76,1,,0,false,true,false,false,false,-1",
}
REFUSED = "file: http: https: ftp: pipe: tcp: udp: rtsp: rtmp: concat: subfile: data: -safe -protocol_whitelist -dnosafer --infilter -shell %pipe% -sdevice=pipe".split()
EVEN = "scale=trunc(iw*0.5)*2:trunc(ih*0.5)*2"
MOVING = {"gif", "webp", "apng"}


def safe_argument(a: str) -> bool:
    """Whether a word of a command line is bare: no path, list or protocol."""
    if not a or len(a) > 4096 or re.search(r"[/\\\x00]|\.\.|\A@", a):
        return False
    low = a.lower()
    return not any(low.startswith(bad) or "=" + bad in low for bad in REFUSED)


class Knobs:
    """Typed answers: a number within its range, a choice, a page range."""

    def __init__(self, answers: Mapping[str, str], variant: str = ""):
        self.answers, self.variant = answers, variant

    def number(self, knob: str) -> int:
        lo, hi, default = KNOB_RANGES[knob]
        text = str(self.answers.get(knob, "")).strip()
        return min(max(int(text) if re.fullmatch(r"-?\d{1,9}", text) else default, lo), hi)

    def choice(self, knob: str, default: str) -> str:
        known = KNOB_CHOICES.get((knob, self.variant)) or KNOB_CHOICES.get((knob, "")) or ""
        value = self.answers.get(knob, "")
        return value if value in known.split() else default

    def yes(self, knob: str) -> bool:
        return str(self.answers.get(knob, "")).lower() in ("true", "1", "yes")

    def pages(self) -> tuple[int, int]:
        """(first, last), 0 for open; all pages where the answer is malformed."""
        m = re.fullmatch(r"\s*(\d{1,9})\s*(?:(-)\s*(\d{0,9}))?\s*", self.answers.get("pages", ""))
        if not m or int(m[1]) < 1:
            return 0, 0
        first = int(m[1])
        last = first if not m[2] else int(m[3] or 0)
        return (first, last) if last == 0 or last >= first else (0, 0)


def extension(fmt: str) -> str:
    return next((f.ext[0] for f in formats() if f.id == fmt), "bin")


def category(fmt: str) -> str:
    return next((f.category for f in formats() if f.id == fmt), "")


def encoder(dst: str, crf: int, preset: str) -> str:
    """The quality words of a container: a rate factor or a quantiser."""
    if "libx264" in VIDEO[dst]:
        return f"-crf {crf} -preset {preset}"
    if dst == "webm":
        return f"-crf {crf}"
    return f"-q:v {min(max(10 - crf // 5, 0), 10)}" if dst == "ogv" else f"-q:v {min(max(crf * 31 // 51, 1), 31)}"


def jpeg_scale(quality: int) -> int:
    return min(max(31 - quality * 29 // 100, 2), 31)


def height(h: int) -> str:
    return f"scale=-2:'min(ih,{h})'"


def ffmpeg(e: Edge, source: str, stem: str, k: Knobs) -> Invocation:
    out, kind, to = f"{stem}.{extension(e.dst)}", category(e.src), category(e.dst)
    start = ["-hide_banner", "-nostdin", "-y"]
    crf, tall, jpeg = k.number("crf"), k.number("max_height"), ["-q:v", str(jpeg_scale(k.number("quality")))] if e.dst == "jpg" else []
    spectrum = k.choice("picture", "waveform") == "spectrogram"
    preset = k.choice("preset", "medium")
    coded = lambda p: [*VIDEO[e.dst].split(), *encoder(e.dst, crf, p).split()]
    if kind == "image" and to == "video":
        still = [] if e.src in MOVING else ["-loop", "1", "-framerate", "25"]
        until = [] if e.src in MOVING else ["-t", str(k.number("duration"))]
        args = [*still, "-i", source, *until, *coded(preset), "-an", "-vf", EVEN]
    elif kind == to == "video" and preset == "copy":
        args = ["-i", source, "-c", "copy", *(["-movflags", "+faststart"] if e.dst in ("mp4", "mov") else [])]
    elif kind == to == "video":
        args = ["-i", source, *coded(preset), *(["-vf", height(tall)] if tall else [])]
    elif e.dst in MOVING:
        base = f"fps=12,{height(tall or 480)}:flags=lanczos"
        words = {
            "gif": ["-vf", base + ",split[a][b];[a]palettegen[p];[b][p]paletteuse", "-loop", "0", "-an"],
            "webp": ["-vf", base, *"-c:v libwebp -lossless 0 -q:v 75 -loop 0 -an".split()],
            "apng": ["-vf", base, *"-f apng -plays 0 -an".split()],
        }
        args = ["-i", source, *words[e.dst]]
    elif kind == "video" and to == "image":
        every, scale = k.number("every"), [height(tall)] if tall else []
        if every:
            args = ["-i", source, "-vf", ",".join([f"fps={1 / every:.6f}", *scale]), "-frames:v", str(MAX_OUTPUTS)]
        else:
            args = ["-ss", str(k.number("at")), "-i", source, *(["-vf", *scale] if scale else []), "-frames:v", "1"]
        return Invocation("ffmpeg", (*start, *args, *jpeg, f"{stem}-%03d.{extension(e.dst)}"), (), 600)
    elif kind == "audio" and to == "image":
        draw = "showspectrumpic=s=1600x480:legend=1" if spectrum else "showwavespic=s=1600x480:colors=0x2563eb:split_channels=1"
        args = ["-i", source, "-filter_complex", f"[0:a]{draw}[v]", "-map", "[v]", "-frames:v", "1", *jpeg]
    elif kind == "audio" and to == "video":
        draw = "showspectrum=s=1280x720:slide=scroll:legend=0" if spectrum else "showwaves=s=1280x720:mode=cline:rate=25:colors=0x2563eb"
        args = ["-i", source, "-filter_complex", f"[0:a]{draw},format=yuv420p[v]", "-map", "[v]", "-map", "0:a", *coded("medium"), "-shortest"]
    elif to == "audio":
        rate = k.answers.get("bitrate", "192")
        args = ["-i", source, *(["-vn"] if kind == "video" else []), *SOUND[e.dst].format(rate=rate if re.fullmatch(r"\d+", rate) else "192").split()]
    else:
        args = ["-i", source]
    return Invocation("ffmpeg", (*start, *args, out), (out,), 840)


def imagemagick(e: Edge, source: str, stem: str, k: Knobs) -> Invocation:
    first, last = k.pages()
    pick = f"[{first - 1}-{(last or 9999) - 1}]" if e.src == "pdf" and first else "[0]" if e.src in ("ico", "dds") else ""
    line = [
        *(["-density", str(k.number("dpi"))] if e.src in ("pdf", "ps", "eps", "svg") else []),
        *(["-background", "none"] if e.src == "svg" else []),
        source + pick,
        *(["-auto-orient"] if e.src in ("heic", "psd") else []),
        *(["-flatten"] if e.src in ("psd", "xcf") else []),
        *(["-colorspace", "sRGB"] if e.src == "exr" else []),
        *(["-quality", str(k.number("quality"))] if e.dst in ("jpg", "webp", "avif") else []),
        *("-background white -alpha remove -alpha off".split() if e.dst == "jpg" else []),
        *{"ico": "-define icon:auto-resize=256,128,64,48,32,16", "pdf": "-compress jpeg -quality 92", "dds": "-define dds:compression=dxt5"}.get(e.dst, "").split(),
    ]
    out = f"{stem}.{extension(e.dst)}"
    if e.multi:
        return Invocation("imagemagick", (*line, "-scene", "1", f"{stem}-%d.{extension(e.dst)}"), (), 600)
    return Invocation("imagemagick", (*line, out), (out,), 300)


def office(e: Edge, source: str, stem: str, k: Knobs) -> Invocation:
    family = "calc" if e.src in ("xlsx", "ods", "csv") else "impress" if e.src in ("pptx", "odp") else "writer"
    form = FILTERS.get(e.dst, e.dst)
    if e.dst == "pdf":
        form = f"pdf:{family}_pdf_Export" + (':{"SelectPdfVersion":{"type":"long","value":"2"}}' if k.yes("pdfa") else "")
    made = source.removesuffix("." + extension(e.src)) + "." + extension(e.dst)
    return Invocation("office", ("--convert-to", form, source), (made,), 600)


def ghostscript(e: Edge, source: str, stem: str, k: Knobs) -> Invocation:
    out = f"{stem}-%d.{extension(e.dst)}" if e.multi else f"{stem}.{extension(e.dst)}"
    first, last = k.pages()
    args = ["-q"]
    if e.dst == "pdf":
        args.append("-sDEVICE=pdfwrite")
        if e.src == "pdf":
            preset = k.choice("preset", "ebook")
            if preset == "prepress":
                args += [f"-dDownsample{c}Images=false" for c in ("Color", "Gray", "Mono")] + ["-dCompatibilityLevel=1.5", "-dPreserveAnnots=true"]
            else:
                fine, mono = SETTINGS[preset]
                for c in ("Color", "Gray", "Mono"):
                    args += [f"-dDownsample{c}Images=true", f"-d{c}ImageResolution={mono if c == 'Mono' else fine}"]
                args.append("-dCompatibilityLevel=1.5")
            args += ["-dEmbedAllFonts=true", "-dSubsetFonts=true", "-dCompressFonts=true", "-dDetectDuplicateImages=true"]
        args += ["-dEPSCrop"] * (e.src == "eps")
        args += ["-dPDFA=2", "-dPDFACompatibilityPolicy=1", "-sColorConversionStrategy=RGB"] * k.yes("pdfa")
    elif e.dst in ("png", "jpg", "tiff"):
        device = {"png": ["-sDEVICE=png16m"], "jpg": ["-sDEVICE=jpeg", f"-dJPEGQ={k.number('quality')}"], "tiff": ["-sDEVICE=tiff24nc"]}[e.dst]
        args += [*device, f"-r{k.number('dpi')}", "-dTextAlphaBits=4", "-dGraphicsAlphaBits=4", *["-dEPSCrop"] * (e.src == "eps")]
        if e.src == "pdf" and first:
            args += [f"-dFirstPage={first}", *[f"-dLastPage={last}"] * bool(last)]
    else:
        args.append({"ps": "-sDEVICE=ps2write", "eps": "-sDEVICE=eps2write", "txt": "-sDEVICE=txtwrite"}[e.dst])
        if e.dst == "eps":
            args += [f"-dFirstPage={first or 1}", f"-dLastPage={first or 1}"]
    return Invocation("ghostscript", (*args, f"-sOutputFile={out}", source), () if e.multi else (out,), 300 if e.dst == "txt" else 600)


def poppler(e: Edge, source: str, stem: str, k: Knobs) -> Invocation:
    out = f"{stem}.{extension(e.dst)}"
    first, last = k.pages()
    if e.dst in ("png", "jpg", "tiff"):
        form = {"png": ["-png"], "jpg": ["-jpeg", "-jpegopt", f"quality={k.number('quality')}"], "tiff": ["-tiff"]}[e.dst]
        span = [*(["-f", str(first)] if first else []), *(["-l", str(last)] if first and last else [])]
        return Invocation("poppler", ("pdftoppm", "-r", str(k.number("dpi")), *form, *span, source, stem), (), 600)
    if e.dst == "txt":
        return Invocation("poppler", ("pdftotext", "-layout", "-enc", "UTF-8", source, out), (out,), 300)
    span = [] if e.dst == "ps" else ["-f", str(first or 1), "-l", str(first or 1)]
    return Invocation("poppler", ("pdftocairo", f"-{e.dst}", *span, source, out), (out,), 300)


def rsvg(e: Edge, source: str, stem: str, k: Knobs) -> Invocation:
    out, dpi = f"{stem}.{extension(e.dst)}", k.number("dpi")
    fine = [f"--dpi-x={dpi}", f"--dpi-y={dpi}"] if e.dst == "png" else []
    return Invocation("rsvg", (f"--format={e.dst}", *fine, f"--output={out}", source), (out,), 300)


def slideshow(dst: str, stem: str, answers: Mapping[str, str]) -> Invocation:
    """Frames frame-001.png, ... as one video or moving picture."""
    k, out = Knobs(answers), f"{stem}.{extension(dst)}"
    line = ["-hide_banner", "-nostdin", "-y", "-framerate", f"{1 / k.number('duration'):.6f}", "-i", "frame-%03d.png"]
    if dst == "gif":
        line += ["-vf", f"{height(k.number('max_height') or 480)}:flags=lanczos,split[a][b];[a]palettegen[p];[b][p]paletteuse", "-loop", "0"]
    else:
        line += [*VIDEO[dst].split(), *encoder(dst, k.number("crf"), "medium").split(), "-r", "25", "-vf", EVEN]
    return Invocation("ffmpeg", (*line, out), (out,), 840)


BUILDERS = {"ffmpeg": ffmpeg, "imagemagick": imagemagick, "office": office, "ghostscript": ghostscript, "poppler": poppler, "rsvg": rsvg}


def build(e: Edge, answers: Mapping[str, str] | None = None, stem: str = "out") -> Invocation:
    """The command line of an engine's edge; every word of it is a bare token."""
    inv = BUILDERS[e.engine](e, f"in.{extension(e.src)}", stem, Knobs(answers or {}, e.variant))
    if bad := [a for a in inv.args if not safe_argument(a)]:
        raise ValueError(f"unsafe words: {bad}")
    return inv
