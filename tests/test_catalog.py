import pytest

from weftline.plans import catalog as C


def test_catalogue_counts():
    f, e = C.formats(), C.edges()
    assert len(f) == 73 and len({x.id for x in f}) == 73
    ext = [x for y in f for x in y.ext]
    assert len(ext) == len(set(ext)) == 95
    assert len({x.category for x in f}) == 9
    assert len(e) == 1221 and len({(x.src, x.dst) for x in e}) == 1138
    assert sum(x.lossy for x in e) == 601
    assert sum(x.terminal for x in e) == 484 and sum(x.initial for x in e) == 375
    assert sum(map(C.is_pack, e)) == 330


@pytest.mark.parametrize(
    ("engine", "n"),
    [("", 577), ("ffmpeg", 463), ("imagemagick", 110), ("office", 47), ("ghostscript", 13), ("poppler", 7), ("rsvg", 4)],
)
def test_edges_by_engine(engine, n):
    assert sum(e.engine == engine for e in C.edges()) == n


def test_edges_name_known_things():
    ids = {f.id for f in C.formats()}
    for e in C.edges():
        assert e.src in ids and e.dst in ids and e.cost > 0
        assert set(e.knobs) <= set(C.KNOB_ORDER)
    assert ids == {x for e in C.edges() for x in (e.src, e.dst)}


def test_every_built_in_edge_has_a_converter():
    from weftline.operators.convert import registry

    assert set(registry()) == {(e.src, e.dst) for e in C.edges() if not e.engine}
