"""Main text of web pages by consensus paths of their hosts.

1. Each page's containers are scored by the text of the blocks they hold, less
   their link text.  A container's path is its chain of tags and classes (its
   id where it has no class), with digits generalised, kept as a 64-bit hash.
2. Per host, the pages' scores, relative to each page's best, are summed by path in
   Spark; the path with most votes wins.  Lists of links are counted too: those
   that many of the host's pages repeat are menus.
3. Each page is extracted again from the containers on its host's winning path, or,
   where it has none, from its own best container; either with the whole article or
   main element around it.

Navigation, page headers, footers, sidebars, notices, adverts, forms, reader comments
and whatever isn't text are left out at every step: by element, and by names of
classes that say nothing else ("ad-box", but not "alert-study").  What stands in an
article element is otherwise kept, lists of links and headers too.  A page is read in
time and memory proportional to its length, however deep or broken it is.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, materialise

#: Bytes of the hosts' winners, names and menus, that are broadcast at most.
FEW_BYTES = 16 << 20
#: A list of links is a menu if at least MENU_PAGES of a host's pages repeat it, and
#: one page in MENU_SHARE; a host of fewer pages can't tell.
MENU_PAGES, MENU_SHARE = 3, 4

TAG_END = re.compile(r"[>\"']")
TAG_NAME = re.compile(r"[A-Za-z][^\s/>]*")
MAIN = re.compile(r"<(?:article|h1)[\s>]", re.I)
ATTRIBUTE = re.compile(r"([A-Za-z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
# Element names and words of classes, ids and roles.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is no markup; all of it is left out.
RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in "script style noscript template svg textarea title iframe".split()}
CONTAINERS = set("article body center div main section table td".split())
LEFT_OUT = set("aside button canvas dialog footer form header head input label menu nav object option select".split())
TOP = {"html", "body", "main", "article"}
LEFT_OUT_WORDS = set(
    "ad ads advert advertisement adverts advertising adsense banner breadcrumb breadcrumbs comment comments commentlist consent contentinfo"
    " cookie cookies copyright disclaimer disqus footer form header login masthead menu modal nav navbar navigation navigations newsletter notice"
    " notices notification overlay pager pagination popup promo promotion promoted related respond search share sharing sidebar sidebars"
    " gdpr paywall topbar colophon signup skip social sponsor sponsored subscribe subscription toolbar tooltip widget widgets alert complementary".split()
)
# Words that leave the meaning of a name as it is.
NEUTRAL_WORDS = set(
    "area article articles bar block body bottom box btn button buttons container content cta dark entry fixed floating form global group holder icon icons inline inner item items js"
    " left light link links list main module my page panel post posts primary reader readers region right row secondary section site slot small sticky stories teaser text the"
    " thread top unit user web wrap wrapper".split()
)
LEFT_OUT_PART = re.compile(r"(?:advert|sidebar|cookie|breadcrumb|newsletter|sponsor|navbar|navig)[a-z]*|comments?(?!ar)[a-z]*|[a-z]+(?:nav|menu|banner|sidebar|footer|comments)")
# An opening tag that ends an open one of these, up to the nearest of the others.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"})}
CLOSES |= {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
DIGITS, APART = re.compile(r"\d+"), re.compile(r"[^A-Za-z0-9]+|(?<=[a-z])(?=[A-Z])")


def _says_left_out(name: str) -> bool:
    """Whether a class, id or role names what is left out, and nothing else."""
    words = {w.lower().rstrip("0123456789") for w in APART.split(name)} - {""}
    out = {w for w in words if w in LEFT_OUT_WORDS or LEFT_OUT_PART.fullmatch(w)}
    whole = re.sub(r"[^a-z0-9]+", "", name.lower()).rstrip("0123456789")
    return bool(out and words <= out | NEUTRAL_WORDS) or whole in LEFT_OUT_WORDS or bool(LEFT_OUT_PART.fullmatch(whole) and words <= {whole})


def _left_out(tag: str, attributes: str, by_words: bool = True, forms: bool = True, within: bool = False) -> tuple[bool, str]:
    """(whether the element is left out, its classes or else id as part of a path);
    within: it stands in an article or main element, whose headers are its own."""
    if (tag == "form" and not forms) or (tag == "header" and within):
        tag = "div"
    if not attributes.strip(" /\n\t\r"):
        return tag in LEFT_OUT, ""
    found = {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(attributes)}
    classes = found.get("class", "")
    path = ".".join(sorted({DIGITS.sub("#", c.lower()) for c in (classes or found.get("id", "")).split()}))
    if tag in LEFT_OUT:
        return True, path
    if tag in TOP:
        return False, path
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True, path
    return by_words and any(_says_left_out(x) for k in ("class", "id", "role") for x in found.get(k, "").split()), path


def tokens(source: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, attributes) of a page: kind is "text", "<" or "</"; a text is the
    name.  Comments, declarations and raw elements are left out.

    A tag ends at the first > outside quotes; where there is none, at the first >, in
    this tag and all that follow, so that no character is looked at more than thrice.
    A < that no > follows is text."""
    at, size, quotes = 0, len(source), True
    last = source.rfind(">")
    text_from = 0
    while at < size:
        at = source.find("<", at)
        if at < 0 or at > last and not source.startswith("<!--", at):
            break
        if source.startswith("<!--", at):
            end = source.find("-->", at + 4)
            yield "text", source[text_from:at], ""
            at = text_from = size if end < 0 else end + 3
            continue
        mark = source[at + 1 : at + 2]
        if mark in ("!", "?"):
            yield "text", source[text_from:at], ""
            at = text_from = source.find(">", at) + 1
            continue
        closing = mark == "/"
        name = TAG_NAME.match(source, at + 1 + closing)
        if not name:
            at += 1
            continue
        end = name.end()
        while quotes:
            m = TAG_END.search(source, end)
            if not m:
                quotes = False
            elif m[0] == ">":
                end = m.start()
                break
            else:
                close = source.find(m[0], m.end())
                quotes, end = close >= 0, close + 1
        if not quotes:
            end = source.find(">", name.end())
        yield "text", source[text_from:at], ""
        tag = name[0].lower()
        at = text_from = end + 1
        if closing:
            yield "</", tag, ""
        elif tag in RAW:
            m = RAW[tag].search(source, at)
            at = text_from = m.end() if m else size
        else:
            yield "<", tag, source[name.end() : end]
    yield "text", source[text_from:], ""


class Page:
    """Blocks and containers of a page.

    blocks: (text, characters in links, innermost container or -1, list number or 0);
    containers: their path's hash, tag and the container around each, or -1, which
    always stands before them."""

    #: What is relaxed while nothing is left of a page with an article or a main
    #: heading: the words of classes, then forms too, as some pages stand in one form
    #: or under one such class as a whole.
    RELAXED = ({}, {"by_words": False}, {"by_words": False, "forms": False})

    def __init__(self, source: str):
        for self.rules in self.RELAXED:
            self.blocks: list[tuple[str, int, int, int]] = []
            self.paths: list[int] = []
            self.tags: list[str] = []
            self.around: list[int] = []
            self.dropped = False
            self._parse(source)
            if self.blocks or not self.dropped or not MAIN.search(source):
                break

    def _parse(self, source: str) -> None:
        stack: list[tuple[str, int, bool, int]] = []  # tag, path, left out, container or -1
        open_: Counter[str] = Counter()
        text: list[str] = []
        held = -1
        links = link_chars = out = lists = 0
        in_list: list[int] = []

        def flush() -> None:
            nonlocal link_chars
            if text:
                joined = " ".join(entities.unescape("".join(text)).split())
                if joined:
                    self.blocks.append((joined, link_chars, held, in_list[-1] if in_list else 0))
                text.clear()
            link_chars = 0

        def pop() -> None:
            nonlocal links, out, held
            tag, _, left, container = stack.pop()
            open_[tag] -= 1
            if tag in BLOCKS:
                flush()
            if container >= 0:
                held = self.around[container]
            if left:
                out -= 1
            if tag == "a":
                links -= 1
            elif tag in ("ul", "ol") and in_list:
                in_list.pop()

        def add(piece: str) -> None:
            nonlocal link_chars
            if piece and not out:
                text.append(piece)
                if links:
                    link_chars += len(piece.strip())

        for kind, tag, attributes in tokens(source):
            if kind == "text":
                add(tag)
                continue
            if kind == "</":
                if open_[tag]:
                    while stack[-1][0] != tag:
                        pop()
                    pop()
                elif tag in BLOCKS:
                    flush()
                continue
            if tag == "br":
                add(" ")
                continue
            if tag in BLOCKS:
                flush()
                if tag in CLOSES:
                    ends, within = CLOSES[tag]
                    if any(open_[t] for t in ends):
                        for i in range(len(stack) - 1, -1, -1):
                            if stack[i][0] in within:
                                break
                            if stack[i][0] in ends:
                                while len(stack) > i:
                                    pop()
                                break
                if open_["p"]:  # a block ends an open paragraph
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] == "p":
                            while len(stack) > i:
                                pop()
                            break
                        if stack[i][0] in BLOCKS:
                            break
            if tag in VOID:
                continue
            left, classes = _left_out(tag, attributes, **self.rules, within=bool(open_["article"] or open_["main"]))
            self.dropped |= left and (tag == "form" or tag not in LEFT_OUT)
            path = stack[-1][1] if stack else 0
            if tag in BLOCKS:
                path = xxhash.xxh64_intdigest(f"{tag}.{classes}" if classes else tag, seed=path)
            container = -1
            if left:
                out += 1
            elif tag in CONTAINERS and not out:
                container = len(self.paths)
                self.paths.append(path)
                self.tags.append(tag)
                self.around.append(held)
                held = container
            if tag == "a":
                links += 1
            elif tag in ("ul", "ol"):
                lists += 1
                in_list.append(lists)
            open_[tag] += 1
            stack.append((tag, path, left, container))
        while stack:
            pop()
        flush()

    def _outermost(self, tag: str) -> list[int]:
        """Per container the outermost one of a tag that it is or stands in, or -1."""
        out: list[int] = []
        for c, above in enumerate(self.around):
            known = out[above] if above >= 0 else -1
            out.append(known if known >= 0 else c if self.tags[c] == tag else -1)
        return out

    def link_lists(self) -> dict[int, int]:
        """List number -> hash of its texts, of lists of three or more items, all of
        them links, that don't stand in an article."""
        items: dict[int, list[tuple[str, bool]]] = defaultdict(list)
        article = self._outermost("article")
        for t, link, c, number in self.blocks:
            if number and (c < 0 or article[c] < 0):
                items[number].append((t, link >= 0.9 * len(t)))
        return {n: xxhash.xxh64_intdigest("\n".join(t for t, _ in x)) for n, x in items.items() if len(x) >= 3 and all(is_link for _, is_link in x)}

    def scores(self) -> list[float]:
        """A block's characters without links count for its innermost container
        in full and halve with each container further out."""
        out = [0.0] * len(self.paths)
        menus = self.link_lists()
        for t, link, c, number in self.blocks:
            if c >= 0 and number not in menus:
                out[c] += float(len(t) - link) * (1 + min(3, t.count(",")) * 0.1)
        for c in range(len(out) - 1, -1, -1):
            if self.around[c] >= 0:
                out[self.around[c]] += out[c] / 2
        return out

    def best(self) -> int | None:
        """The path of the container that scores most, the first of equals."""
        scores = self.scores()
        top = max(range(len(scores)), key=lambda c: (scores[c], -c), default=None)
        return None if top is None or scores[top] <= 0 else self.paths[top]

    def votes(self) -> dict[int, tuple[int, int]]:
        """path -> (thousandths of the page's best score, containers around it)."""
        scores = self.scores()
        top = max(scores, default=0.0)
        out: dict[int, tuple[int, int]] = {}
        deep: list[int] = []
        for c, s in enumerate(scores):
            deep.append(deep[self.around[c]] + 1 if self.around[c] >= 0 else 0)
            if top > 0 and (v := round(1000 * s / top)):
                out[self.paths[c]] = max(out.get(self.paths[c], (0, 0)), (v, deep[c]))
        return out

    def _wide(self, path: int | None, blocks: list[tuple[str, int, int, int]]) -> list[bool]:
        """Whether each container is on the path or stands in one that is; with the
        outermost article around each, or else the outermost main, unless what that
        adds is for the greater part link text."""

        def spread(on: Collection[int]) -> list[bool]:
            out: list[bool] = []
            for c, above in enumerate(self.around):
                out.append(c in on or (above >= 0 and out[above]))
            return out

        on = {c for c, p in enumerate(self.paths) if p == path}
        inside = spread(on)
        used = {c for _, _, c, _ in blocks if c >= 0 and inside[c]}
        article, main = self._outermost("article"), self._outermost("main")
        first = {c for c in on if self.around[c] < 0 or not inside[self.around[c]]}
        holds = spread(first)  # of these only the ones with text
        with_text: set[int] = set()
        for c in used:
            while c not in with_text and holds[c]:
                with_text.add(c)
                if c in first:
                    break
                c = self.around[c]
        first &= with_text
        wide = on | {article[c] for c in first if article[c] >= 0}
        mains = {main[c] for c in first if article[c] < 0 <= main[c]}
        if mains:
            now, then = spread(wide), spread(mains)
            added = [(len(t), link) for t, link, c, _ in blocks if c >= 0 and then[c] and not now[c]]
            if 2 * sum(x for _, x in added) <= sum(x for x, _ in added):
                wide |= mains
        return spread(wide)

    def text(self, path: int | None, menus: Collection[int] | None = None) -> str:
        """The blocks within containers on ``path``, widened; on the page's best one
        where no container has it; all blocks where there is no container.  Lists of
        links outside an article are left out if they are in ``menus``; all of them
        without that."""
        drop = {n for n, h in self.link_lists().items() if menus is None or h in menus}
        blocks = [b for b in self.blocks if b[3] not in drop]
        wide = self._wide(path, blocks)
        if not any(wide[c] for _, _, c, _ in blocks if c >= 0):
            own = self.best()
            if own is None:
                return "\n\n".join(t for t, *_ in blocks)
            wide = self._wide(own, blocks)
        return "\n\n".join(t for t, _, c, _ in blocks if c >= 0 and wide[c])


def host_of(url: Column) -> Column:
    """The lower-cased authority of a URL; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)), F.lit(""))


_I64 = 1 << 64


def _signed(x: int) -> int:
    return x - _I64 if x >> 63 else x


def winning_paths(pages: DataFrame) -> DataFrame:
    """(host, path, menus) of (_host, _html): the path with most votes, and the hashes
    of the lists of links that the host's pages repeat, null for a host of too few
    pages.  A batch sums its own votes first, and Spark sums them up before the
    shuffle too; votes are whole thousandths, so their sum doesn't depend on the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            votes: dict[tuple[str, str, int, int], int] = defaultdict(int)
            for host, source in zip(batch.column("_host").to_pylist(), batch.column("_html").to_pylist(), strict=True):
                page = Page(source or "")
                votes[host, "page", 0, 0] += 1
                for path, (v, deep) in page.votes().items():
                    votes[host, "path", _signed(path), deep] += v
                for h in set(page.link_lists().values()):
                    votes[host, "list", _signed(h), 0] += 1
            keys = list(votes)
            kinds = (pa.string(), pa.string(), pa.int64(), pa.int32())
            cols = [pa.array([k[i] for k in keys], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([votes[k] for k in keys], pa.int64())], ["host", "kind", "hash", "deep", "vote"])

    votes = pages.select("_host", "_html").mapInArrow(run, "host string, kind string, hash long, deep int, vote long")
    summed = votes.groupBy("host", "kind", "hash", "deep").agg(F.sum("vote").alias("vote"))
    is_path, is_list = F.col("kind") == "path", F.col("kind") == "list"
    best = F.max(F.when(is_path, F.struct("vote", (-F.col("deep")).alias("shallow"), "hash")))
    # A list needs MENU_PAGES pages, so per host there are at most a third as many as pages have.
    often = F.collect_list(F.when(is_list & (F.col("vote") >= MENU_PAGES), F.struct("hash", "vote")))
    of = summed.groupBy("host").agg(best.alias("b"), often.alias("often"), F.sum(F.when(F.col("kind") == "page", F.col("vote"))).alias("pages"))
    menus = F.transform(F.filter("often", lambda x: x["vote"] * MENU_SHARE >= F.col("pages")), lambda x: x["hash"])
    return of.select("host", F.col("b.hash").alias("path"), F.when(F.col("pages") >= MENU_PAGES, menus).alias("menus"))


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), a row per input row.

    Null and empty html, and pages without text, give an empty text; pages without
    a host in their url share a host of their own; repeated rows get equal results;
    null page_ids pass; further columns are ignored; an empty table gives an empty
    result.  Very long, deep or broken pages take time and memory by their length.
    Winners of up to FEW_BYTES, measured first, are broadcast; more are joined by a
    shuffle that adaptive execution can split at a large host."""
    bound_batches(pages.sparkSession)
    own = pages.select(F.col(id_col).alias("_id"), F.col(url_col).alias("_url"), F.col(html_col).alias("_html"), host_of(F.col(url_col)).alias("_host"))
    winners = materialise(winning_paths(own), "winners")
    size = winners.agg(F.sum(F.octet_length("host") + 8 * F.coalesce(F.size("menus"), F.lit(0)) + 64)).head()[0] or 0
    side = F.broadcast(winners) if size <= FEW_BYTES else winners
    joined = own.join(side, F.col("_host") == F.col("host"), "left").select("_id", "_url", "_html", "path", "menus")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for source, path, menus in zip(*(batch.column(c).to_pylist() for c in ("_html", "path", "menus")), strict=True):
                known = None if menus is None else {m % _I64 for m in menus}
                texts.append(Page(source or "").text(None if path is None else path % _I64, known))
            cols = [batch.column("_id").cast(pa.int64()), batch.column("_url").cast(pa.string()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long")
