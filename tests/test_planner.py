import heapq

import pytest

from weftline.plans import catalog as C
from weftline.plans import planner as P


def cheapest(engines):
    """A search over (format, steps, may go on), the other way round from joins."""
    by = {}
    for e in C.edges():
        if not e.engine or e.engine in engines:
            by.setdefault(e.src, []).append(e)
    out = {}
    for src in {f.id for f in C.formats()}:
        for e in by.get(src, []):
            if e.dst == src:
                out[src, src] = min(out.get((src, src), (9e9, 9)), (e.weight, 1))
        todo = [(e.weight, 1, e.dst, e.terminal) for e in by.get(src, []) if e.dst != src]
        heapq.heapify(todo)
        while todo:
            cost, hops, at, ends = heapq.heappop(todo)
            if (cost, hops) < out.get((src, at), (9e9, 9)):
                out[src, at] = (cost, hops)
            if hops < C.MAX_STEPS and not ends:
                for e in by.get(at, []):
                    if not e.initial and e.dst not in (src, at):
                        heapq.heappush(todo, (cost + e.weight, hops + 1, e.dst, e.terminal))
    return out


@pytest.mark.parametrize(("engines", "by_hops"), [((), {1: 577, 2: 37, 3: 16}), (C.ENGINES, {1: 1138, 2: 343, 3: 217})])
def test_routes(spark, engines, by_hops):
    got = {(r.src, r.dst): (r.cost, r.hops) for r in P.routes(spark, engines).collect()}
    assert {h: sum(x[1] == h for x in got.values()) for h in by_hops} == by_hops
    assert got == cheapest(engines)


def test_excluding_and_names(spark):
    r = P.route_words(P.routes(spark, excluding=["docx>pdf@office"])).where("src = 'docx' and dst = 'pdf'").head()
    assert "docx>pdf@office" not in r["keys"]
    assert r.line.startswith("docx → ")


@pytest.mark.parametrize(
    ("sources", "own", "every"),
    [(["png", "jpg"], 16, 26), (["docx", "xlsx"], 10, 29), (["mp3", "docx"], 5, 7), (["csv", "json"], 16, 23)],
)
def test_targets(spark, sources, own, every):
    s = spark.createDataFrame([(x,) for x in sources], "src string")
    have, full = P.routes(spark, ()), P.routes(spark)
    assert P.targets(s, have).count() == own
    assert P.targets(s, full).count() == every
    blocked = P.blocked_targets(s, have, full).collect()
    assert len(blocked) == every - own and all(r.needed for r in blocked)
