import hashlib
import random
import re

import brute
import pytest

from weftline.llm import quality_rules as Q
from weftline.llm import secrets as S

TEXTS = [
    "", " \n ", "a b c d e f g h i j k.", "x y z w v x y z w v x y z w v", "line one is here.\nline one is here.\n\nother | nav | bar | x\n#$% && ||",
    "word " * 200, "One good sentence stands here, with words enough.\nHome\nAbout\nPrivacy policy\n", "é ü \x0b b\x1cc 1 2 3 4 5 6 7", "a\n" * 30,
    "He said it was fine, and so it was for all of them.\nTHIS!! IS!! ALL!! SHOUTING!! HERE!!\nword%%% word*** word$$$ more&&& and### so%%%",
]


def test_base_equals_brute_force(docs_of, clashing, odd_rows):
    got = {r.doc_id: r for r in Q.quality(docs_of(list(enumerate(TEXTS)))).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(t), t
    odd = Q.quality(clashing).collect()
    assert len(odd) == len(odd_rows)
    for r, (i, t) in zip(sorted(odd, key=lambda r: (r.doc_id is not None, r.doc_id or 0)), sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0)), strict=True):
        assert r.doc_id == i and r.n_words == brute.quality(t)[0]
    assert Q.quality(docs_of([])).count() == 0


def test_verdict_and_cleaning(docs_of):
    prose = "This is an ordinary sentence which says something and ends well.\n"
    rows = [
        (0, prose * 1 + "Another ordinary sentence follows, unlike the one before it.\nHome | News | Sport | Contact\nAll rights reserved"),
        (1, "Home | News | Sport | Contact | About | Help | Jobs | More\nOne | Two | Three | Four | Five | Six"),
        (2, "an unfinished line of prose that just stops in the middle without any mark"),
        (3, "WORD!! AFTER!! WORD!! IS!! SHOUTED!! IN!! THIS!! LINE!! AND!! ON!! IT!! GOES!!"),
    ]
    got = {r.doc_id: r for r in Q.quality(docs_of(rows)).collect()}
    assert [got[i].kept for i in range(4)] == [True, False, True, False]
    assert "Home" not in got[0].clean_text and "rights" not in got[0].clean_text and "Another" in got[0].clean_text
    assert got[1].clean_text == "" and got[1].removed_chars == got[1].word_chars


@pytest.mark.parametrize("line", ["Alle Rechte vorbehalten.", "Tous droits R\xc9SERV\xc9S.", "Pol\xedtica de privacidad.", "Hier klicken, um es zu sehen.", "Cliquez ici pour lire.", "Privacy policy."])
def test_boilerplate_in_four_languages(docs_of, line):
    prose = "This is an ordinary sentence which says something and ends well.\n"
    assert line not in Q.quality(docs_of([(1, prose + line)])).head().clean_text


def test_native_plan(docs_of):
    plan = Q.quality(docs_of([(1, "x")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)


@pytest.fixture(scope="module")
def formats():
    return S.Formats(S.labelled_credentials())


def test_automata_merge_states_and_keep_lengths_and_alphabets(formats):
    for name, a in formats.automata.items():
        shape = S.FORMATS[name]
        size = sum(len(p) + n for p, _, n in shape)
        assert len(a.next) == size + 1 and a.lengths == [size], name
        want = [{c} if fixed else set(abc) for p, abc, n in shape for c, fixed in [*((c, True) for c in p), *[("", False)] * n]]
        assert [set(x) for x in a.alphabets()] == want, name
        one = next(x for n, x in S.labelled_credentials() if n == name)
        assert a.logp(one) > a.logp(one[:-1]) == a.logp(one + one[-1]) == float("-inf")


def test_probabilities_sum_to_one():
    import itertools
    import math

    a = S.infer(["ab", "ac", "ab", "b", "bca", "c"] * 5)
    total = sum(math.exp(a.logp("".join(x))) for n in range(5) for x in itertools.product("abc", repeat=n))
    assert total == pytest.approx(1.0)
    assert a.lengths == [1, 2, 3]


def brute_find(text, formats, threshold):
    """Every part of every accepted length, scored; boundaries and order as documented."""
    found = []
    for name, a in formats.automata.items():
        fixed, last = len(a.alphabets()[0]) == 1, set(a.alphabets()[-1])
        for n in a.lengths:
            for i in range(len(text) - n + 1):
                part, after = text[i : i + n], text[i + n : i + n + 1]
                if a.logp(part) == float("-inf") or re.match("[A-Za-z0-9]" if fixed else "[" + re.escape("".join(last)) + "]", after):
                    continue
                if not fixed and i and (re.match("[A-Za-z0-9]", text[i - 1]) or formats._within_noise(name, text, i, n)):
                    continue
                if (ratio := a.logp(part) - formats.plain.logp(part)) >= threshold * n:
                    found.append((-ratio, i, i + n))
    out = []
    for _, a, b in sorted(found):
        if all(b <= x or y <= a for x, y in out):
            out.append((a, b))
    return sorted(out)


def brute_base(text):
    """The base patterns by hand: a scan of characters, without regular expressions."""
    out = []
    word, upper, hexa = set(S._WORD + "+/_.=-"), set(S._UPPER + S._DIGIT), set("0123456789abcdef")
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    i = 0
    while i < len(text):
        end = None
        for key in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            if low.startswith(key, i):
                for quote in (1, 0):
                    j = i + len(key)
                    if quote and text[j : j + 1] not in ("'", '"'):
                        continue
                    j += quote
                    while text[j : j + 1] == " ":
                        j += 1
                    if text[j : j + 1] not in (":", "="):
                        continue
                    j += 1
                    while text[j : j + 1] == " ":
                        j += 1
                    j += text[j : j + 1] in ("'", '"') and text[j : j + 1] != ""
                    k = j
                    while k < len(text) and text[k] in word:
                        k += 1
                    if k > j:
                        end = (j, k)
                        break
                break
        if end:
            if end[1] - end[0] >= 8:
                out.append((i, end[1], 0))
            i = end[1]
        else:
            i += 1
    for kind, start, chars, least in ((1, "AKIA", upper, 16), (2, "", hexa, 32)):
        i = 0
        while i < len(text):
            j = i + len(start)
            if text.startswith(start, i) and j < len(text) and text[j] in chars:
                while j < len(text) and text[j] in chars:
                    j += 1
                if j - i >= least:
                    out.append((i, j, kind))
                i = j
            else:
                i += 1
    return sorted(out, key=lambda x: (x[0], x[2]))


def test_base_and_formats_equal_brute_force(formats):
    rng = random.Random(6)
    keys = [x for _, x in S.labelled_credentials(3, seed=21)]
    pieces = [*keys, *(k[:-2] for k in keys[:6]), "password", "Token", "API_KEY", "apikey", "secret", "=", ":", '"', " ", " ", "AKIA", "abc123", "f" * 31, "0a" * 17, "é", "\n", "/", "word", "X1", "_"]
    for _ in range(150):
        t = "".join(rng.choice(pieces) for _ in range(rng.randint(1, 14)))
        base, every = S.spans(t, formats, 1.0)
        assert base == brute_base(t), t
        want = [(a, b, 3) for a, b in brute_find(t, formats, 1.0) if (a, b) not in {(x, y) for x, y, _ in base}]
        assert [x for x in every if x[2] == 3] == want, t


def test_false_alarms(formats):
    rng = random.Random(8)
    base64 = lambda n: "".join(rng.choice(S._WORD + "+/") for _ in range(n))
    for t in ("550e8400-e29b-41d4-a716-446655440000", "iPhone12ProMaxSilver256GB", "InternationalizationConfigurationManager", "ghp_aB3dE5gH7jK912345", "getUserAccountSettingsFromDatabaseByName"):
        assert formats.find(t, 1.0) == [], t
    assert sum(bool(formats.find(base64(rng.randint(41, 4000)), 1.0)) for _ in range(300)) <= 3
    syllables = ["ber", "lan", "ti", "mo", "ra", "so", "ne", "quil", "dor", "eth"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 5)))
    names = [rng.choice(["", "/", "_", "."]).join(word().capitalize() if rng.random() < 0.5 else word() for _ in range(rng.randint(1, 6))) for _ in range(20_000)]
    assert sum(len(formats.find(x, 1.0)) for x in names) == 0  # below 50 a million names


def test_held_out_credentials_score_high(formats):
    scores = [formats.score(x)[0] for _, x in S.labelled_credentials(40, seed=99)]
    assert sum(s >= 1.0 for s in scores) / len(scores) > 0.99
    plain = ["thisisaverylongordinaryword1", "2024-01-15T10:20:30.000", "http.example.com/foo/bar1", "internationalization2go", "product-name-version-1.2.3", "0123456789012345678901"]
    assert all(formats.score(x)[0] < 1.0 for x in plain)


def test_base_spans_by_hand():
    t = 'x PASSWORD = "abcd1234" token:short api_key=ABCDEFGHſecret=abcdefgh1 AKIA' + "A" * 12 + " AKIA123 " + "0a" * 16 + "g" + "f" * 31
    got = [(S.KINDS[k], t[a:b]) for a, b, k in S.base_spans(t)]
    assert got == [("assign", 'PASSWORD = "abcd1234'), ("assign", "api_key=ABCDEFGH"), ("access", "AKIA" + "A" * 12), ("hex", "0a" * 16)]


def test_scan(docs_of, clashing, odd_rows):
    key = "ghp_" + "aB3dE5gH7jK9" * 3
    rows = [(1, "é " + "token=abcdefgh and " + key), (2, None), (3, "nothing")]
    got = {r.doc_id: r for r in S.scan(docs_of(rows)).collect()}
    assert (got[1].n_assign, got[1].n_access, got[1].n_hex, got[1].n_format) == (1, 0, 0, 1)
    assert got[1].base_sha256 == hashlib.sha256(b"assign:2:16").hexdigest()
    assert got[1].spans == f"assign:2:16,format:21:{21 + len(key)}"
    assert got[2].spans == "" and got[2].base_sha256 == hashlib.sha256(b"").hexdigest() == got[3].base_sha256
    assert S.scan(clashing).count() == len(odd_rows) and S.scan(docs_of([])).count() == 0


def _format_spans(text, formats):
    return [text[a:b] for a, b, k in S.spans(text, formats, 1.0)[1] if k == 3]


def test_digit_free_credentials(formats):
    for key in ("sk_live_QwErTyUiOpAsDfGhJkLzXcVb", "glpat-ZxCvBnMqWeRtYuIoPaSd"):
        assert _format_spans(f"see {key} here", formats) == [key]


@pytest.mark.parametrize("name", [n for n in S.FORMATS if n not in ("cloud access id", "hex key")])
def test_credentials_glued_to_other_text(formats, name):
    keys = [x for n, x in S.labelled_credentials(20, seed=5) if n == name]
    found = 0
    for a, b in zip(keys[::2], keys[1::2], strict=True):
        t = f"home/users/someone/documents/settings/production/{a} and x={b}.backup"
        got = _format_spans(t, formats)
        found += (a in got) + (b in got)
    assert found >= 0.9 * len(keys)


def test_credentials_beside_base_spans_and_each_other(formats):
    a, b = "ghp_" + "aB3dE5gH7jK9" * 3, "npm_" + "Zy8wV6tS4rQ2" * 3
    assert _format_spans(f"{a}/AKIA{'Q2' * 8}", formats) == [a]
    assert _format_spans(f"{a}/{'0a' * 16}/{b}", formats) == [a, b]
    assert _format_spans(f"{a}.{b}", formats) == [a, b]
    for t in ("home/users/someone/documents/settings/production", "internationalization", "ThisIsAVeryLongClassName", "-" * 400, "www.example.com/some/path/index.html", "2024-01-15-10-20-30"):
        assert _format_spans(t, formats) == []
