"""Nearest neighbours against a plain search: copies, gaps, weights, values far from zero."""
import numpy as np

from inswing.operators import similar as V


def _plain(rows, k, w, rms, least):
    out = {}
    for pool, i, v in rows:
        near = []
        for other_pool, j, u in rows:
            both = [n for n in range(len(v)) if v[n] is not None and u[n] is not None]
            if other_pool != pool or j == i or len(both) < least:
                continue
            total = 0.0
            for n in both:
                total += (v[n] - u[n]) * (v[n] - u[n]) * (1.0 if w is None else w[n])
            near.append((float(np.sqrt(total / max(len(both), 1)) if rms else np.sqrt(total)), j))
        for rank, (d, j) in enumerate(sorted(near)[:k], 1):
            out[pool, i, rank] = (j, d)
    return out


def test_nearest_equals_plain_search(spark):
    rnd = np.random.default_rng(5)
    rows = []
    for n in range(150):
        v = [float(x) for x in rnd.integers(0, 4, 6) * 0.1 + (1e6 if n % 2 else 0)]  # many ties, and offsets that swamp a matrix product
        rows.append(("p" if n % 3 else "q", str(n), [None if rnd.random() < 0.1 else x for x in v]))
    rows += [("p", f"c{n}", rows[1][2]) for n in range(20)]
    df = spark.createDataFrame(rows, "pool string, id string, vec array<double>")
    for w, rms, least in ((None, False, 1), ([1.0, 0.5, 2.0, 1.0, 0.1, 1.0], False, 3), (None, True, 4)):
        got = {(r.pool, r.id, r["rank"]): (r.other, r.distance) for r in V.nearest(df, df, 4, w, rms, least, block=40).collect()}
        assert got == _plain(rows, 4, w, rms, least)
