"""Seconds to materialise each relation, in order of need."""
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tools.check import session  # noqa: E402
import inswing.catalog  # noqa: E402, F401
from inswing.plans.workspace import Workspace  # noqa: E402

sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
spark = session()
spark.range(10).groupBy("id").count().collect()
for go in range(int(sys.argv[2]) if len(sys.argv) > 2 else 2):
    ws = Workspace(spark, f"/root/testdata/sf{sf}")
    t = time.time()
    for name in ("ball_facts deliveries innings matches players_in_match wickets wicket_fielders batting_order keeper_inference persons "
                 "person_aliases style_observations player_metadata player_profile dismissals balls dis partnerships spells bat_innings "
                 "bowl_innings battles team_results").split():
        t0 = time.time()
        ws[name]
        print(f"{go} {name:20s} {time.time() - t0:6.2f}", flush=True)
    print("total", time.time() - t)
