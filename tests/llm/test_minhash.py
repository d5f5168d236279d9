import random

import brute
import numpy as np
import pytest

from weftline.llm import minhash as M


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"new{rng.randrange(10**6)}" for w in words)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [[f"w{rng.randrange(3000)}" for _ in range(rng.choice([3, 8, 40, 120]))] for _ in range(60)]
    out = [" ".join(w) for w in base]
    for w in base[:25]:
        out += [edited(rng, w, s) for s in (0, 0.01, 0.02, 0.04, 0.06, 0.2)]
    hot = [f"h{i}" for i in range(90)]
    out += [edited(rng, hot, 0.03) for _ in range(120)] + [" ".join(hot).upper()] * 5
    passage = " ".join(f"p{i}" for i in range(60))
    out += [passage + " " + " ".join(f"q{rng.randrange(10**6)}" for _ in range(30)) for _ in range(60)]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("block", "shingles"), [(512, 1 << 20), (16, 1 << 20), (512, 900)])
def test_components_equal_brute_force(docs_of, rows, block, shingles, monkeypatch):
    monkeypatch.setattr(M, "BLOCK", block)
    monkeypatch.setattr(M, "BLOCK_SHINGLES", shingles)
    want = brute.near(rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(docs_of(rows)).collect()}
    assert got == want


def test_odd_rows(clashing, odd_rows):
    got = M.near_duplicates(clashing).collect()
    assert len(got) == len(odd_rows)
    by = {r.doc_id: r for r in got}
    assert by[None].component_id is None and by[None].kept
    assert by[1].n_shingles == by[2].n_shingles == by[3].n_shingles == 0 and by[1].kept and by[2].kept and by[3].kept
    assert by[5].component_id == 4 and not by[5].kept and by[8].component_id == 4
    assert by[7].component_id == 6 and by[6].n_shingles == 59_996


def test_empty_table_and_keeping(docs_of, rows):
    assert M.near_duplicates(docs_of([])).count() == 0
    d = docs_of(rows[:120])
    decided = M.near_duplicates(d)
    kept = M.keep_first(d, decided)
    assert kept.columns == d.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, c in brute.near(rows[:120]).values()})


def test_bounds_miss_little():
    rng = np.random.default_rng(1)
    bounds = M.least_matches(0.75, 1e-6)
    assert [n for n, _ in bounds] == [32, 64, 96, 128]
    hits = rng.random((20_000, M.K)) < 0.75
    lost = np.zeros(len(hits), bool)
    for n, m in bounds:
        lost |= hits[:, :n].sum(axis=1) < m
    assert lost.mean() < 1e-3
    low = rng.random((2000, M.K)) < 0.3
    assert (low[:, :32].sum(axis=1) < bounds[0][1]).mean() > 0.5 and (low.sum(axis=1) < bounds[-1][1]).all()


def test_words_lower_only_ascii():
    assert M.words("AÉ\x0bB c") == ["aÉ".encode(), "b c".encode()]


def test_more_pairs_and_links_than_are_few(docs_of, rows, monkeypatch):
    from weftline.llm import common, components

    monkeypatch.setattr(common, "FEW", 5)
    monkeypatch.setattr(components, "FEW_EDGES", 5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in M.near_duplicates(docs_of(rows)).collect()}
    assert got == brute.near(rows)
