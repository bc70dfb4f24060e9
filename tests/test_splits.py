"""Splits from summed cells against plain loops: splits without balls, null keys, null opponents and null values."""
from inswing.operators import evidence as E

SCHEMA = ("batter_id string, bowling_team string, faced boolean, is_four boolean, is_six boolean, runs_batter int, phase string, chasing boolean, "
          "batter_balls_before int, wickets_before int, required_rate double, format_group string, fell int")


def test_cells_equal_loops(spark, ws, monkeypatch):
    rows = [("a" if i % 5 else None, f"t{i % 3}" if i % 7 else None, i % 4 > 0, i % 6 == 4, i % 11 == 6, i % 5 if i % 13 else None, ("powerplay", "middle", None)[i % 3],
             (True, False, None)[i % 3], i % 40, i % 6, float(i % 15) if i % 2 else None, "T20", int(i % 17 == 0)) for i in range(400)]
    b = spark.createDataFrame(rows, SCHEMA)
    widths = []
    stage = ws.stage
    monkeypatch.setattr(ws, "stage", lambda df, name: (widths.append(len(df.columns)), stage(df, name))[1])
    got = {(r.batter_id, r.split): r.asDict() for r in E._split_long(ws, b.repartition(3), ["batter_id"], "fell").collect()}
    assert widths == [3 + len(E.FIELDS)]  # one narrow aggregate reads the balls

    def sums(some):
        hit = [r for r in some if r[2]]
        runs = [r[5] for r in hit if r[5] is not None]
        return [len(hit), sum(runs), sum(x * x for x in runs), sum(r[3] or r[4] for r in hit), sum(x == 0 for x in runs), sum(r[12] for r in some)]

    tests = {"phase:death": lambda r: r[6] == "death", "phase:middle": lambda r: r[6] == "middle", "chasing": lambda r: r[7] is True, "stage:30+": lambda r: r[8] >= 30,
             "pressure": lambda r: r[7] is True and r[10] is not None and r[10] >= 10}
    for who in ("a", None):
        mine = [r for r in rows if r[0] == who]
        assert {s for w, s in got if w == who and not (s or "opp:").startswith("opp:")} == set(E.SPLITS)
        for name, test in tests.items():
            r = got[who, name]
            assert [r[f"in_{f}"] for f in E.FIELDS] == sums([x for x in mine if test(x)]) and [r[f"t_{f}"] for f in E.FIELDS] == sums(mine)
    r = got["a", "opp:t1"]
    assert [r[f"in_{f}"] for f in E.FIELDS] == sums([x for x in rows if x[0] == "a" and x[1] == "t1"])
    assert ("a", None) in got and (None, "opp:t1") not in got
