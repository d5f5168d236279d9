import brute
import pytest

import corpus_pipeline as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from weftline.llm.common import materialise, table

    docs = table(spark, SF, "documents")
    seen = [docs]
    for name, f in P.STAGES[:-1]:
        seen.append(materialise(f(spark, seen[-1], SF), name))
    return [*seen, P.STAGES[-1][1](spark, seen[-1], SF)]


def rows(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_each_stage_on_its_own_input(stages):
    docs, clean, exact, near, mixed, out = stages
    for s in stages[:-1]:
        assert s.columns == docs.columns
    assert set(rows(clean)) <= set(rows(docs))
    groups = {}
    for i, t in sorted(rows(clean).items(), key=lambda x: (-len(x[1]), x[0])):
        groups.setdefault("".join(t.split()), i)
    assert set(rows(exact)) == set(groups.values())
    assert set(rows(near)) == {c for _, c in brute.near(sorted(rows(exact).items())).values()}
    assert rows(mixed) == rows(near)
    assert {r.doc_id for r in out.collect()} == set(rows(mixed))


def test_run(spark, stages):
    assert {r.doc_id: r.ids_sha256 for r in P.run(spark, SF).collect()} == {r.doc_id: r.ids_sha256 for r in stages[-1].collect()}


def test_position_in_the_mix(spark, stages):
    from weftline.llm import mixing
    from weftline.llm.queries import mix_weights

    want = {r.doc_id: r["__position"] for r in mixing.mix(stages[3], mix_weights()).collect()}
    assert {r.doc_id: r.position for r in stages[-1].collect()} == want
    assert {r.doc_id: r.position for r in P.run(spark, SF).collect()} == want
    assert sorted(want.values()) == list(range(len(want))) and len(stages[4].inputFiles()) > 1


def test_odd_rows_pass_every_stage(spark, clashing, odd_rows, docs_of):
    from weftline.llm.common import materialise

    for docs in (clashing, docs_of([])):
        seen = [docs]
        for name, f in P.STAGES[:-1]:
            seen.append(materialise(f(spark, seen[-1], SF), name))
            assert seen[-1].columns == docs.columns
        out = P.STAGES[-1][1](spark, seen[-1], SF).collect()
        assert sorted(r.position for r in out) == list(range(len(out)))
        if docs is clashing:
            # 5 and 8 repeat 4's text, 2 and 3 are empty like 1, 7 is near 6, 8 has equal words
            assert {r.doc_id for r in out} <= {i for i, _ in odd_rows} and None in {r.doc_id for r in out}
            assert len(out) == len({r.doc_id for r in out}) == 4
        else:
            assert out == []
