"""Queries over the ball sequence and the working relations."""
from __future__ import annotations

from pyspark.sql import functions as F

from inswing.catalog.registry import add, query
from inswing.sources.fixture import reconciliation


def table(name: str, relation: str, spec: str, select: str | None = None) -> None:
    """A whole relation on both sides."""
    cols = [x.split(":")[0] for x in spec.split()]
    add(name, spec, f"SELECT {select or ', '.join(cols)} FROM {relation}", lambda ws: ws[relation].select(*cols))


table("S01_matches_scan", "matches", "match_id gender format_group match_type team_type competition season start_date:d "
      "venue team1 team2 winner result method win_by_runs:i win_by_wickets:i toss_winner toss_decision event_stage")
table("D01_running_score", "deliveries", "delivery_id score_before:i wickets_before:i legal_balls_before:i runs_total:i")
table("D02_batter_before", "deliveries", "delivery_id batter_id bowler_id non_striker_id batter_runs_before:i batter_balls_before:i")
table("D03_partnership_before", "deliveries", "delivery_id partnership_runs_before:i partnership_balls_before:i")
table("D04_ball_label", "deliveries", "delivery_id over:i ball_in_over:i ball_label",
      "delivery_id, over, ball_in_over, over || '.' || ball_in_over AS ball_label")
table("D05_phase", "deliveries", "delivery_id phase")
table("D06_chase", "deliveries", "delivery_id chasing:b target_runs:i balls_remaining:i runs_required:i required_rate:f current_rate:f")
table("D07_innings_totals", "innings", "match_id innings_no:i batting_team bowling_team target_runs:i target_overs:f total_runs:i total_wickets:i legal_balls:i")
table("D08_wicket_flags", "wickets", "delivery_id player_out_id kind bowler_credited:b counts_as_dismissal:b striker_out:b")
table("D09_balls", "balls", "delivery_id gender format_group team_type competition season year:i start_date:d batting_team bowling_team "
      "bowler_family bowler_arm bowler_style batter_hand batter_position:i faced:b wk:i striker_dismissed:b striker_credited:b")
table("D10_dis", "dis", "delivery_id player_out_id kind route batter_id bowler_id gender format_group start_date:d bowler_family score_before:i "
      "batter_balls_before:i required_rate:f")
table("D11_batting_order", "batting_order", "match_id innings_no:i person_id batting_position:i")
table("D12_keeper_inference", "keeper_inference", "match_id team person_id method confidence:f")
table("D13_dismissal_route", "dismissals", "delivery_id route route_prov route_confidence:f keeper_id keeper_method fielder_id substitute:b")
table("D14_innings_limit", "balls", "delivery_id wickets_in_hand:i innings_balls_limit:i limit_uncertain:b balls_left:i progress_pct:f")
table("D15_chase_state", "balls", "delivery_id chase_state")
table("D16_batter_stage", "balls", "delivery_id batter_stage")
table("D17_since_boundary", "balls", "delivery_id batter_balls_since_boundary:i team_balls_since_boundary:i")
table("D18_recent_window", "balls", "delivery_id recent_window:i recent_runs:i recent_wickets:i")
table("D19_streaks", "balls", "delivery_id team_dot_streak:i batter_dot_streak:i team_boundary_streak:i")
table("D20_partnerships", "partnerships", "partnership_id p1 p2 wicket_no:i first_seq:i last_seq:i first_over:i last_over:i score_start:i runs:i balls:i "
      "p1_runs:i p1_balls:i p2_runs:i p2_balls:i extras:i boundaries:i dots:i rotations:i last_delivery_id")
add("D21_partnership_end", "partnership_id ended ended_out", "SELECT partnership_id, ended, ended_out FROM partnerships",
    lambda ws: ws["partnerships"].withColumn("ended_out", F.get("ended_outs", F.lit(0))))
table("D22_spells", "spells", "match_id innings_no:i bowler_id over:i spell_no:i runs:i balls:i dots:i boundaries:i wickets:i first_seq:i last_seq:i")
table("D24_bat_innings", "bat_innings", "match_id innings_no:i batter_id team opponent runs:i balls:i fours:i sixes:i dots:i death_runs:i death_balls:i r10:i "
      "b10:i out_kind out_bowler_id out_delivery_id not_out:b position:i chasing:b won:b arrived_score:i arrived_wickets:i arrived_over:i "
      "req_at_arrival:i balls_left_at_arrival:i rrr_at_arrival:f first_seq:i last_seq:i")
table("D25_bowl_innings", "bowl_innings", "match_id innings_no:i bowler_id team opponent defending:b won:b balls:i runs:i wickets:i dots:i boundaries:i "
      "extras_balls:i death_balls:i death_runs:i death_wkts:i set_balls:i set_runs:i set_wkts:i best_burst12:i overs_bowled:i")
add("D26_battles", "batter_id bowler_id gender balls:i runs:i dots:i fours:i sixes:i matches:i first_date:d last_date:d pp_share:f death_share:f "
    "t20_share:f format_list outs:i batter_rpb:f batter_balls_all:i batter_out_rate:f bowler_rpb:f bowler_balls_all:i bowler_wkt_rate:f",
    "SELECT *, array_to_string(formats, ',') AS format_list FROM battles",
    lambda ws: ws["battles"].withColumn("format_list", F.array_join("formats", ",")))
table("D27_team_results", "team_results", "match_id ta tb winner_c i1_team i1_runs:i i1_wkts:i i1_balls:i i2_team i2_runs:i i2_wkts:i i2_balls:i")
add("D28_player_profile", "person_id name team_list genders first_match:d last_match:d matches:i batting_hand bowling_arm bowling_family bowling_style",
    "SELECT *, array_to_string(teams, ',') AS team_list, gender AS genders FROM player_profile",
    lambda ws: ws["player_profile"].withColumn("team_list", F.array_join("teams", ",")).withColumn("genders", F.array_join("genders", ",")))

add("S21_left_over_lines", "match_id innings_no:i l_orderkey:i l_linenumber:i left_over", "SELECT * FROM left_over_lines",
    lambda ws: ws["left_over_lines"].select("match_id", "innings_no", "at.l_orderkey", "at.l_linenumber", "left_over"))
add("S21_line_reconciliation", "what n:i", """SELECT 'lines' AS what, count(*) AS n FROM lineitem UNION ALL SELECT 'balls', count(*) FROM deliveries
    UNION ALL SELECT left_over, count(*) FROM left_over_lines GROUP BY 1 UNION ALL SELECT 'missing', (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM deliveries) - (SELECT count(*) FROM left_over_lines)""",
    reconciliation)
