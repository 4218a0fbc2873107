"""Runs of late lines against a plain loop, with a seller that holds a third of all lines."""

import itertools
import random
from collections import defaultdict

import pytest

from helpers import frame, line
from latebound import operators as op


def made(n=900, seed=5):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        seller = 1 if i % 3 == 0 else rnd.randint(2, 25)
        late = rnd.random() < (0.75 if seller % 2 else 0.2)
        deliver = None if rnd.random() < 0.1 else 20 if late else 8
        out.append(line(rnd.randint(1, 400), seller, line_no=i, month=rnd.randint(0, 5), day=rnd.randint(0, 9),
                        deliver=deliver, estimate=12))
    return out


def plain(lines, min_run=3):
    per = defaultdict(list)
    for (order, no, product, seller, _, ordered, _, _, delivered, estimated, _) in lines:
        if delivered is not None:
            per[seller].append((ordered, order, no, product, int(delivered.date() > estimated.date())))
    out = {}
    for seller, rows in per.items():
        flags = [r[-1] for r in sorted(rows)]
        runs = [len(list(g)) for late, g in itertools.groupby(flags) if late]
        current = len(list(itertools.takewhile(bool, reversed(flags))))
        out[seller] = (len(flags), sum(flags), max(runs, default=0), current, sum(r >= min_run for r in runs))
    return out


def found(spark, lines, **options):
    df = op.delay_attribution(op.enrich(frame(spark, lines).repartition(7)))
    return {r[0]: tuple(r[1:]) for r in op.seller_late_streaks(df, **options).collect()}


@pytest.mark.parametrize(("rows_per_range", "min_run"), [(10, 3), (37, 2), (250_000, 5)])
def test_hot_seller(spark, rows_per_range, min_run):
    lines = made()
    want = plain(lines, min_run)
    assert found(spark, lines, rows_per_range=rows_per_range, min_run=min_run) == want
    assert want[1][0] > 250 and want[1][2] > 10       # the hot seller's longest run spans ranges


def test_all_late_none_late_and_undelivered(spark):
    lines = [line(i, 1, line_no=i, day=i, deliver=20) for i in range(8)]
    lines += [line(i, 2, line_no=i, day=i, deliver=5) for i in range(4)] + [line(1, 3, deliver=None)]
    assert found(spark, lines, rows_per_range=3) == {1: (8, 8, 8, 8, 1), 2: (4, 0, 0, 0, 0)}
    assert found(spark, []) == {}


def test_no_window_over_a_whole_seller(spark):
    df = op.seller_late_streaks(op.delay_attribution(op.enrich(frame(spark, made(200)))), rows_per_range=20)
    plan = df._jdf.queryExecution().analyzed().toString()
    windows = [w for w in plan.splitlines() if "windowspecdefinition" in w and "late" in w]
    assert windows and all("seller_id" in w and "_range" in w for w in windows)


def test_top_sellers_with_streaks(spark):
    lines = [line(i, s, line_no=i, day=i, deliver=20 if s == 1 or i % 2 else 5, price=f"{10 * s}.00")
             for s in (1, 2, 3, 4, 5) for i in range(6)]
    df = op.delay_attribution(op.enrich(frame(spark, lines)))
    scores = op.rfm_scores(op.seller_profile(op.seller_month(df)))
    got = op.streak_black_sellers(scores, op.seller_late_streaks(df), m_tier=1).collect()
    assert [(r["seller_id"], r["longest_streak"], r["current_streak"]) for r in got] == [(1, 6, 6)]
