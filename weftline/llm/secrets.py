"""Secret scans: base patterns, and formats learnt by grammar inference.

Labelled credentials give, per format, a prefix tree.  Its statistically compatible
states of equal depth are merged (ALERGIA: all outgoing and stopping frequencies agree
within a Hoeffding bound, recursively), so a length is never lost, and states whose
symbols and classes of symbols agree within the bound share one distribution, so an
alphabet is kept and no symbol of it is missed for want of examples.  The result is a
probabilistic automaton that gives a string its likelihood, its end included.

Candidates are all parts of a text which an automaton gives a likelihood at all: its
fixed start (or, without one, a boundary before it) and what it accepts up to one of
its lengths, with a boundary after it.  A regular expression written from the
automaton finds them.  Each is scored by the log-likelihood ratio a character against
a background model of ordinary runs; those that reach the threshold become spans of
kind ``format``, the best first where they overlap.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame

from .common import bound_batches, id_and_text, map_text

KINDS = ("assign", "access", "hex", "format")

# The base patterns and the lengths they must reach.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS, HEX = r"AKIA[A-Z0-9]+", r"[0-9a-f]+"
ASSIGN_LENGTH, ACCESS_LENGTH, HEX_LENGTH = 8, 16, 32

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
_WORD = _UPPER + _LOWER + _DIGIT
# Published shapes of credentials, as (prefix, alphabet, length) parts.
FORMATS: dict[str, Sequence[tuple[str, str, int]]] = {
    "cloud access id": [("AKIA", _UPPER + "234567", 16)],
    "cloud secret": [("", _WORD + "+/", 40)],
    "code host token": [("ghp_", _WORD, 36)],
    "code host fine token": [("github_pat_", _WORD, 22), ("_", _WORD, 59)],
    "git lab token": [("glpat-", _WORD + "_-", 20)],
    "chat bot token": [("xoxb-", _DIGIT, 12), ("-", _DIGIT, 12), ("-", _WORD, 24)],
    "payment key": [("sk_live_", _WORD, 24)],
    "map key": [("AIza", _WORD + "_-", 35)],
    "package token": [("npm_", _WORD, 36)],
    "mail key": [("SG.", _WORD + "_-", 22), (".", _WORD + "_-", 43)],
    "signed web token": [("eyJ", _WORD + "_-", 33), (".eyJ", _WORD + "_-", 48), (".", _WORD + "_-", 43)],
    "hex key": [("", _DIGIT + "abcdef", 40)],
}


def labelled_credentials(each: int = 300, seed: int = 7) -> list[tuple[str, str]]:
    """(format, credential) rows of the published shapes, drawn by a fixed seed."""
    r = random.Random(seed)
    return [
        (name, "".join(p + "".join(r.choice(abc) for _ in range(n)) for p, abc, n in parts))
        for name, parts in FORMATS.items()
        for _ in range(each)
    ]


def _class(c: str) -> str:
    return "upper" if c in _UPPER else "lower" if c in _LOWER else "digit" if c in _DIGIT else c


def _shares(counts: Mapping[str, int]) -> dict[str, float]:
    """Frequencies of symbols and of their classes."""
    total, out = sum(counts.values()), Counter[str]()
    for c, n in counts.items():
        out[c] += n / total
        if (k := _class(c)) != c:
            out[k] += n / total
    return out


class Automaton:
    """A layered probabilistic automaton: next[state][symbol] = (state, count),
    stop[state], level[state]; states of one pool share their symbols' frequencies."""

    SMOOTH = 0.5

    def __init__(self, next_: list[dict[str, tuple[int, int]]], stop: list[int], level: list[int], bound: float):
        self.next, self.stop, self.level = next_, stop, level
        self.pools: list[Counter[str]] = []
        self.pool: list[int] = []
        for t in next_:
            own = Counter({c: n for c, (_, n) in t.items()})
            k = next((i for i, p in enumerate(self.pools) if own and self._agree(p, own, bound)), len(self.pools))
            if k == len(self.pools):
                self.pools.append(Counter())
            self.pools[k] += own
            self.pool.append(k)
        self.logs = [
            {c: math.log((n + self.SMOOTH) / (sum(p.values()) + self.SMOOTH * len(p))) for c, n in p.items()} for p in self.pools
        ]
        total = [stop[i] + sum(n for _, n in t.values()) for i, t in enumerate(next_)]
        self.ends = [math.log(n / t) if n else -math.inf for n, t in zip(stop, total, strict=True)]
        self.goes = [math.log((t - n) / t) if n < t else -math.inf for n, t in zip(stop, total, strict=True)]
        # A symbol of the pool that the state itself hasn't seen goes where most go.
        self.main = [max(t.values(), key=lambda x: (x[1], -x[0]))[0] if t else -1 for t in next_]
        self.lengths = sorted({d for d, n in zip(level, stop, strict=True) if n})

    @staticmethod
    def _agree(a: Mapping[str, int], b: Mapping[str, int], bound: float) -> bool:
        if not a:
            return False
        x, y = _shares(a), _shares(b)
        far = bound * (1 / math.sqrt(sum(a.values())) + 1 / math.sqrt(sum(b.values())))
        return all(abs(x.get(c, 0) - y.get(c, 0)) <= far for c in x.keys() | y.keys())

    def logp(self, text: str) -> float:
        """Log-likelihood of the whole text, its end included."""
        s, out = 0, 0.0
        for c in text:
            x = self.logs[self.pool[s]].get(c)
            if x is None or self.goes[s] == -math.inf:
                return -math.inf
            out += x + self.goes[s]
            s = self.next[s][c][0] if c in self.next[s] else self.main[s]
        return out + self.ends[s]

    def alphabets(self) -> list[str]:
        """Per depth all symbols that have a likelihood there."""
        out = [set[str]() for _ in range(max(self.lengths, default=0))]
        for s, d in enumerate(self.level):
            if d < len(out) and self.next[s]:
                out[d] |= self.pools[self.pool[s]].keys()
        return ["".join(sorted(x)) for x in out]

    def expressions(self) -> list[re.Pattern[str]]:
        """One expression a length, which every part with a likelihood matches, at its
        start; a format without a fixed start needs a boundary before it."""
        abc = self.alphabets()
        one = lambda x: re.escape(x) if len(x) == 1 else "[" + re.escape(x) + "]"
        out = []
        for n in self.lengths:
            if not n:
                continue
            body = "".join(f"{one(k)}{{{len(list(g))}}}" for k, g in itertools.groupby(abc[:n]))
            fixed = len(abc[0]) == 1
            before, after = ("", r"(?![A-Za-z0-9])") if fixed else (r"(?<![A-Za-z0-9])", f"(?!{one(abc[n - 1])})")
            out.append(re.compile(f"{before}(?={body}{after})"))
        return out


def infer(strings: Iterable[str], alpha: float = 0.002) -> Automaton:
    """Merge the compatible states of equal depth of the strings' prefix tree."""
    nxt: list[dict[str, list[int]]] = [{}]
    stop, level = [0], [0]
    for text in strings:
        s = 0
        for c in text:
            if c not in nxt[s]:
                nxt[s][c] = [len(nxt), 0]
                nxt.append({})
                stop.append(0)
                level.append(level[s] + 1)
            nxt[s][c][1] += 1
            s = nxt[s][c][0]
        stop[s] += 1
    bound = math.sqrt(0.5 * math.log(2 / alpha))

    def total(s: int) -> int:
        return stop[s] + sum(x[1] for x in nxt[s].values())

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return abs(f1 / n1 - f2 / n2) > bound * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            na, nb = total(a), total(b)
            if not na or not nb:
                continue
            if differ(stop[a], na, stop[b], nb):
                return False
            for c in nxt[a].keys() | nxt[b].keys():
                x, y = nxt[a].get(c), nxt[b].get(c)
                if differ(x[1] if x else 0, na, y[1] if y else 0, nb):
                    return False
                if x and y:
                    todo.append((x[0], y[0]))
        return True

    def fold(a: int, b: int) -> None:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            stop[a] += stop[b]
            for c, (to, n) in nxt[b].items():
                if c in nxt[a]:
                    nxt[a][c][1] += n
                    todo.append((nxt[a][c][0], to))
                else:
                    nxt[a][c] = [to, n]

    order, layer = [0], [0]
    while layer:
        red: list[int] = []
        for s in layer:
            for c in sorted(nxt[s]):
                b = nxt[s][c][0]
                if b in red:
                    continue
                for r in red:
                    if compatible(r, b):
                        nxt[s][c][0] = r
                        fold(r, b)
                        break
                else:
                    red.append(b)
        order += red
        layer = red
    number = {s: i for i, s in enumerate(order)}
    return Automaton([{c: (number[to], n) for c, (to, n) in nxt[s].items()} for s in order], [stop[s] for s in order], [level[s] for s in order], bound)


class Background:
    """A character's likelihood after the one before it, smoothed, from ordinary runs:
    words and names in several casings, paths, hosts, versions, dates, numbers."""

    SYMBOLS, SMOOTH = 67, 0.2

    def __init__(self, r: random.Random, each: int = 6000):
        syllables = (
            "an the tion er in re st ou ver le con ment ra es de ing ly po si ka al be ca ch da di do el en et fi fo ge ha he hi ho ic id il im io is it la li lo"
            " ma me mi mo na ne ni no nt of on op or pa pe pr qu ri ro sa se sh so su ta te ti to tr tu un ur us ut va ve vi wa we wi wo ya yo zu"
        ).split()
        word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 5)))
        number = lambda: str(r.randint(0, 10 ** r.randint(1, 6)))
        kinds = [
            lambda: "".join(word() for _ in range(3)),
            lambda: word() + "".join(word().capitalize() for _ in range(r.randint(1, 4))) + r.choice(["", "", number()]),
            lambda: "".join(word().capitalize() + r.choice(["", "", number(), "X"]) for _ in range(r.randint(1, 4))),
            lambda: r.choice("/._-").join(word() for _ in range(r.randint(2, 6))),
            lambda: r.choice("-.:").join(number() for _ in range(r.randint(2, 6))),
            lambda: r.choice("=-_.") * r.randint(8, 60),
            lambda: "_".join(word().upper() for _ in range(r.randint(1, 4))),
            lambda: "/".join([word(), word().capitalize(), word() + number()]) + "." + word()[:3],
        ]
        seen: dict[str, Counter[str]] = defaultdict(Counter)
        for i in range(each):
            last = ""
            for c in kinds[i % len(kinds)]():
                seen[last][c] += 1
                last = c
        share = lambda t, n: math.log((n + self.SMOOTH) / (sum(t.values()) + self.SMOOTH * self.SYMBOLS))
        self.logs = {a: {c: share(t, n) for c, n in t.items()} for a, t in seen.items()}
        self.unseen = {a: share(t, 0) for a, t in seen.items()}

    def logp(self, text: str) -> float:
        out, last = 0.0, ""
        for c in text:
            known = self.logs.get(last)
            out += known.get(c, self.unseen[last]) if known else -math.log(self.SYMBOLS)
            last = c
        return out


class Formats:
    """The automata of all formats and the background: learnt once, on the driver."""

    def __init__(self, labelled: Iterable[tuple[str, str]]):
        groups: dict[str, list[str]] = {}
        for name, text in labelled:
            groups.setdefault(name, []).append(text)
        self.automata = {name: infer(texts) for name, texts in sorted(groups.items())}
        self.plain = Background(random.Random(11))
        self.found_by = {name: list(zip(a.expressions(), [n for n in a.lengths if n], strict=True)) for name, a in self.automata.items()}

    def score(self, text: str) -> tuple[float, str]:
        """Log-likelihood ratio a character of the best format."""
        plain = self.plain.logp(text)
        return max(((a.logp(text) - plain) / max(1, len(text)), name) for name, a in self.automata.items())

    def _within_noise(self, name: str, text: str, start: int, n: int) -> bool:
        """Whether symbols of a format without a fixed start go on before the part, and
        are likelier its own than ordinary: then it is a piece of some longer string."""
        first = self.automata[name].logs[self.automata[name].pool[0]]
        a = start
        while len(first) > 1 and a > max(0, start - n) and text[a - 1] in first:
            a -= 1
        return a < start and sum(first[c] for c in text[a:start]) > self.plain.logp(text[a:start])

    def find(self, text: str, threshold: float) -> list[tuple[int, int]]:
        """Candidates of a text that reach the threshold, in order: the best ratio
        first, then the longer, then the earlier; what overlaps an earlier one is left."""
        found = []
        for name, ways in self.found_by.items():
            for way, n in ways:
                for m in way.finditer(text):
                    a, part = m.start(), text[m.start() : m.start() + n]
                    if self._within_noise(name, text, a, n):
                        continue
                    ratio = (self.automata[name].logp(part) - self.plain.logp(part)) / n
                    if ratio >= threshold:
                        found.append((-ratio * n, a, a + n))
        out: list[tuple[int, int]] = []
        for _, a, b in sorted(found):
            k = bisect.bisect(out, (a, b))
            if (k == 0 or out[k - 1][1] <= a) and (k == len(out) or b <= out[k][0]):
                out.insert(k, (a, b))
        return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns, leftmost and non-overlapping per
    kind, without matches that are too short; sorted by start, then kind."""
    out = [(m.start(), m.end(), 0) for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII) if len(m[2]) >= ASSIGN_LENGTH]
    out += [(m.start(), m.end(), 1) for m in re.finditer(ACCESS, text) if len(m[0]) >= ACCESS_LENGTH]
    # Runs are maximal, so a length in the pattern matches the same ones.
    out += [(m.start(), m.end(), 2) for m in re.finditer(rf"(?:{HEX[:-1]}){{{HEX_LENGTH},}}", text)]
    return sorted(out, key=lambda x: (x[0], x[2]))


def spans(text: str, formats: Formats, threshold: float) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, base and format spans).  Candidates within base spans are scored
    too; what a base span already marks exactly is no further span."""
    base = base_spans(text)
    marked = {(a, b) for a, b, _ in base}
    more = [(a, b, 3) for a, b in formats.find(text, threshold) if (a, b) not in marked]
    return base, sorted(base + more, key=lambda x: (x[0], x[2]))


def joined(found: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in found)


def scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", labelled: Iterable[tuple[str, str]] | None = None, threshold: float = 1.0
) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_format, base_sha256, spans), a row
    per input row; spans are ``kind:start:end`` in code points, end exclusive.

    labelled: (format, credential) rows, some thousands at most, from which the
    driver learns once; the automata, some hundred kilobytes, are broadcast.  A row
    is one row's work and nothing is shuffled; a text's time goes by its length.
    Null and empty texts have no spans; credentials of one format may differ in
    length, and empty ones are never found; repeated rows get equal results; null
    doc_ids pass; further columns are ignored; an empty table gives an empty result."""
    learnt = docs.sparkSession.sparkContext.broadcast(Formats(labelled if labelled is not None else labelled_credentials()))

    def run(texts: list[str]) -> dict[str, list]:
        formats = learnt.value
        out: dict[str, list] = {k: [] for k in ("n_assign", "n_access", "n_hex", "n_format", "base_sha256", "spans")}
        for t in texts:
            base, every = spans(t, formats, threshold)
            for i, k in enumerate(("n_assign", "n_access", "n_hex", "n_format")):
                out[k].append(sum(x[2] == i for x in every))
            out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
            out["spans"].append(joined(every))
        return out

    bound_batches(docs.sparkSession)
    schema = "n_assign long, n_access long, n_hex long, n_format long, base_sha256 string, spans string"
    return map_text(id_and_text(docs, id_col, text_col), run, schema, ["_id"]).withColumnRenamed("_id", "doc_id")
