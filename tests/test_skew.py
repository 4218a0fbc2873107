"""A seller holding a third of all lines: results equal a brute-force
computation, with the lines spread over many partitions."""

import random
from collections import defaultdict

from helpers import frame, line
from latebound import operators as op


def test_hot_seller_brute_force(spark):
    rnd = random.Random(5)
    lines = []
    for i in range(900):
        seller = 1 if i % 3 == 0 else rnd.randint(2, 40)
        ship, deliver = rnd.randint(1, 9), rnd.choice([None, 5, 10, 15, 20])
        lines.append(line(i // 2, seller, line_no=i, month=rnd.randint(0, 5), ship=ship, limit=5,
                          deliver=deliver, estimate=12, price=f"{rnd.randint(1, 999)}.{rnd.randint(0, 99):02d}"))
    df = frame(spark, lines).repartition(12)
    sm = {(r["seller_id"], r["m_idx"]): r for r in op.seller_month(op.delay_attribution(op.enrich(df))).collect()}

    want = defaultdict(lambda: {"lines": 0, "orders": set(), "delivered": 0, "late": 0, "seller_late": 0})
    for (order_id, _, _, seller, _, ordered, limit, shipped, delivered, estimated, price) in lines:
        key = (seller, ordered.year * 12 + ordered.month - 1)
        w = want[key]
        w["lines"] += 1
        w["orders"].add(order_id)
        if delivered is not None:
            w["delivered"] += 1
            late = (delivered.date() - estimated.date()).days > 0
            w["late"] += late
            w["seller_late"] += late and (shipped.date() - limit.date()).days > 0
    assert set(sm) == set(want)
    for key, w in want.items():
        r = sm[key]
        assert (r["lines"], r["orders"], r["delivered"], r["late"], r["seller_late"]) == \
            (w["lines"], len(w["orders"]), w["delivered"], w["late"], w["seller_late"])
    hot = sum(w["lines"] for (s, _), w in want.items() if s == 1)
    assert hot == 300
    prof = {r["seller_id"]: r for r in op.seller_profile(op.seller_month(op.delay_attribution(op.enrich(df)))).collect()}
    assert prof[1]["lines"] == 300
