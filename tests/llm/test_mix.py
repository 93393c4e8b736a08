import hashlib
import math

import pytest
from pyspark.sql import functions as F

import edge
from tridelta.llm import curriculum as cu
from tridelta.llm.queries import MIX


def brute(rows, plan):
    """Targets by raising a level step by step, takes by walking the words."""
    size = {k: sum(1 for _ in __import__("re").finditer(cu.WORD_RE, r[1] or "")) for k, r in enumerate(rows)}
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size[k] for k, r in enumerate(rows) if r[3] == s) for s in names}
    weight = {s: plan.weight(k % len(plan.knots)) for k, s in enumerate(names)}
    budget, open_, target = plan.budget_share * sum(total.values()), set(names), {}
    while open_:
        level = (budget - sum(target.values())) / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > plan.cap * total[s]}
        target.update({s: plan.cap * total[s] for s in full})
        open_ -= full
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
    taken = {k: 0 for k in size}
    for s in names:
        order = sorted((k for k, r in enumerate(rows) if r[3] == s), key=lambda k: (
            hashlib.md5(f"{plan.seed}:{'' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest(), rows[k][0] or -1, size[k]))
        left = math.floor(target[s] + 0.5)
        while left > 0 and total[s]:
            for k in order:
                n = min(left, size[k])
                taken[k] += n
                left -= n
    return size, total, target, taken


@pytest.fixture(scope="module")
def mixed(spark):
    rows = edge.texts() + [(100 + k, edge.prose(20 + k % 60, k), "en", f"s{k % 7}" if k % 3 else "a") for k in range(150)]
    return rows, cu.allocate(edge.frame(spark, rows), MIX).collect()


def test_against_brute_force(mixed):
    rows, got = mixed
    size, total, target, taken = brute(rows, MIX)
    want = sorted((r[0] or -1, size[k], total[r[3]], round(target[r[3]], 6), taken[k]) for k, r in enumerate(rows))
    assert sorted((r.row.doc_id or -1, r["size"], r.source_size, round(r.target, 6), r.taken) for r in got) == want
    assert all(r.taken <= 2 * r["size"] for r in got)


def test_positions_follow_the_integrated_schedule(mixed):
    rows, got = mixed
    names = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    for r in got:
        knots = MIX.knots[names.index(r.row.source) % 3]
        (t0, w0), (t1, w1) = knots
        for t in r.positions:
            assert t0 <= t <= t1
    for s in names:
        turn = names.index(s) % 3
        (t0, w0), (t1, w1) = MIX.knots[turn]
        own = sorted((t, r["size"]) for r in got if r.row.source == s for t in r.positions)
        at, target = 0, next(r.target for r in got if r.row.source == s)
        for t, n in own:  # the share of the integral up to t is the share of the target taken before
            share = (w0 * t + (w1 - w0) * t * t / 2) / MIX.weight(turn)
            assert abs(share - at / target) < 1e-6
            at += n


def test_mix_is_range_sorted_and_repeats(spark):
    df = edge.frame(spark, [(k, edge.prose(30, k), "en", "a" if k % 2 else "b") for k in range(60)])
    out = cu.mix(df, MIX)
    assert out.columns == df.columns
    again = [r.doc_id for r in cu.mix(df, MIX).collect()]
    assert [r.doc_id for r in out.collect()] == again and max(map(again.count, again)) == 2


def test_several_knots_and_empty_table(spark):
    plan = cu.MixPlan(knots=(((0.0, 1.0), (0.25, 3.0), (1.0, 0.0)),), budget_share=1.0)
    assert cu.allocate(edge.frame(spark, []), plan).count() == 0
    got = cu.allocate(edge.frame(spark, [(k, "a b c", "en", "x") for k in range(40)]), plan).collect()
    assert all(r.taken == 3 for r in got)
    ts = sorted(r.positions[0] for r in got)
    assert ts[0] == 0 and ts[-1] < 1 and len(set(ts)) == 40


def test_texts_without_words_are_never_taken(spark):
    got = cu.allocate(edge.frame(spark, [(1, None, "en", "a"), (2, "", "en", None), (3, " \n", "en", "b")]), MIX)
    assert got.agg(F.sum("taken"), F.max(F.size("positions"))).head()[:] == (0, 0)
