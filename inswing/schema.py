"""Canonical table schemas and the fixed values of the domain."""
from __future__ import annotations

from pyspark.sql import types as T

S, I, F, B, D = (T.StringType(), T.IntegerType(), T.DoubleType(), T.BooleanType(), T.DateType())
TEXTS = T.ArrayType(S)


def struct(spec: list[tuple[str, T.DataType]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in spec])


# Names, types and order of the columns of the canonical tables.
PROVENANCE = [
    ("prov", S),
    ("prov_source_id", S),
    ("prov_method", S),
    ("prov_method_version", S),
    ("prov_confidence", F),
]

MATCHES = struct([
    ("match_id", S),
    ("source_id", S),
    ("source_ref", S),
    ("source_checksum", S),
    ("data_version", S),
    ("source_created", S),
    ("source_revision", I),
    ("gender", S),
    ("match_type", S),
    ("format_group", S),
    ("team_type", S),
    ("match_type_number", I),
    ("competition", S),
    ("event_match_number", S),
    ("event_group", S),
    ("event_stage", S),
    ("season", S),
    ("start_date", D),
    ("end_date", D),
    ("n_days", I),
    ("venue", S),
    ("city", S),
    ("team1", S),
    ("team2", S),
    ("toss_winner", S),
    ("toss_decision", S),
    ("toss_uncontested", B),
    ("winner", S),
    ("win_by_runs", I),
    ("win_by_wickets", I),
    ("win_by_innings", I),
    ("result", S),
    ("method", S),
    ("eliminator", S),
    ("balls_per_over", I),
    ("scheduled_overs", I),
    ("player_of_match", TEXTS),
    ("missing_flags", S),
    ("ingested_at", S),
])

INNINGS = struct([
    ("match_id", S),
    ("innings_no", I),
    ("batting_team", S),
    ("bowling_team", S),
    ("super_over", B),
    ("declared", B),
    ("forfeited", B),
    ("target_runs", I),
    ("target_overs", F),
    ("target_prov", S),
    ("penalty_runs_pre", I),
    ("penalty_runs_post", I),
    ("absent_hurt", TEXTS),
    ("total_runs", I),
    ("total_wickets", I),
    ("legal_balls", I),
])

PLAYERS_IN_MATCH = struct([
    ("match_id", S),
    ("team", S),
    ("person_id", S),
    ("name", S),
    ("identity_resolved", B),
])

DELIVERIES = struct([
    ("delivery_id", S),
    ("match_id", S),
    ("innings_no", I),
    ("seq", I),
    ("over", I),
    ("ball_in_over", I),
    ("ball_label", S),
    ("legal", B),
    ("batter_id", S),
    ("bowler_id", S),
    ("non_striker_id", S),
    ("batter", S),
    ("bowler", S),
    ("non_striker", S),
    ("runs_batter", I),
    ("runs_extras", I),
    ("runs_total", I),
    ("non_boundary", B),
    ("wides", I),
    ("noballs", I),
    ("byes", I),
    ("legbyes", I),
    ("penalty", I),
    ("is_four", B),
    ("is_six", B),
    ("n_wickets", I),
    ("source_id", S),
    ("score_before", I),
    ("wickets_before", I),
    ("legal_balls_before", I),
    ("batter_runs_before", I),
    ("batter_balls_before", I),
    ("partnership_runs_before", I),
    ("partnership_balls_before", I),
    ("phase", S),
    ("chasing", B),
    ("target_runs", I),
    ("balls_remaining", I),
    ("runs_required", I),
    ("required_rate", F),
    ("current_rate", F),
])

WICKETS = struct([
    ("delivery_id", S),
    ("match_id", S),
    ("innings_no", I),
    ("wicket_idx", I),
    ("player_out_id", S),
    ("player_out", S),
    ("kind", S),
    ("bowler_credited", B),
    ("counts_as_dismissal", B),
    ("striker_out", B),
    ("source_id", S),
])

WICKET_FIELDERS = struct([
    ("delivery_id", S),
    ("match_id", S),
    ("innings_no", I),
    ("wicket_idx", I),
    ("fielder_idx", I),
    ("fielder_id", S),
    ("fielder", S),
    ("substitute", B),
    ("source_id", S),
])

REVIEWS = struct([
    ("delivery_id", S),
    ("match_id", S),
    ("by_team", S),
    ("umpire", S),
    ("batter", S),
    ("decision", S),
    ("umpires_call", B),
    ("type", S),
])

REPLACEMENTS = struct([
    ("delivery_id", S),
    ("match_id", S),
    ("scope", S),
    ("team", S),
    ("player_in", S),
    ("player_out", S),
    ("reason", S),
    ("role", S),
])

POWERPLAYS = struct([
    ("match_id", S),
    ("innings_no", I),
    ("from_over", F),
    ("to_over", F),
    ("type", S),
])

PERSONS = struct([
    ("person_id", S),
    ("name", S),
    ("unique_name", S),
    ("external_ids", T.MapType(S, S)),
    ("source_id", S),
])

DELIVERY_TRACKING = struct([
    ("delivery_id", S),
    ("release_x_m", F),
    ("release_y_m", F),
    ("release_z_m", F),
    ("speed_release_kph", F),
    ("speed_pitch_kph", F),
    ("pitch_x_m", F),
    ("pitch_y_m", F),
    ("line_bucket", S),
    ("length_bucket", S),
    ("bounce_height_m", F),
    ("swing_deg", F),
    ("seam_deg", F),
    ("spin_rpm", F),
    ("arrival_x_m", F),
    ("arrival_z_m", F),
    ("trajectory_ref", S),
] + PROVENANCE)

DELIVERY_SHOT = struct([
    ("delivery_id", S),
    ("shot_type", S),
    ("shot_family", S),
    ("foot", S),
    ("direction_deg", F),
    ("distance_m", F),
    ("control", S),
    ("edge_type", S),
] + PROVENANCE)

DELIVERY_FIELDING = struct([
    ("delivery_id", S),
    ("fielder_id", S),
    ("position_label", S),
    ("x_m", F),
    ("y_m", F),
    ("action", S),
] + PROVENANCE)

DELIVERY_CONTACT = struct([
    ("delivery_id", S),
    ("contact_zone", S),
    ("contact_x", F),
    ("contact_y", F),
] + PROVENANCE)

PLAYER_METADATA = struct([
    ("person_id", S),
    ("field", S),
    ("value", S),
    ("prov", S),
    ("source_id", S),
    ("method", S),
    ("confidence", F),
    ("is_override", B),
    ("evidence", S),
])

SOURCE_MISSING_MATCHES = struct([
    ("start_date", D),
    ("competition", S),
    ("team1", S),
    ("team2", S),
    ("gender", S),
])

SOURCE_COVERAGE_PERIODS = struct([
    ("competition", S),
    ("coverage_from", D),
    ("coverage_to", D),
])

SOURCE_COVERAGE_PCT = struct([
    ("competition", S),
    ("have", I),
    ("of", I),
])

CANONICAL: dict[str, T.StructType] = {
    "matches": MATCHES,
    "innings": INNINGS,
    "players_in_match": PLAYERS_IN_MATCH,
    "deliveries": DELIVERIES,
    "wickets": WICKETS,
    "wicket_fielders": WICKET_FIELDERS,
    "reviews": REVIEWS,
    "replacements": REPLACEMENTS,
    "powerplays": POWERPLAYS,
    "persons": PERSONS,
    "delivery_tracking": DELIVERY_TRACKING,
    "delivery_shot": DELIVERY_SHOT,
    "delivery_fielding": DELIVERY_FIELDING,
    "delivery_contact": DELIVERY_CONTACT,
}

# Fixed values.
BOWLER_CREDITED = ("bowled", "caught", "caught and bowled", "lbw", "stumped", "hit wicket")
NOT_DISMISSAL = ("retired hurt", "retired not out")
FORMAT_GROUP = {"T20": "T20", "IT20": "T20", "ODI": "ODI", "ODM": "ODI", "Test": "Test", "MDM": "MDM"}
LIMITED_OVERS = ("T20", "ODI")
FULL_MEMBERS = ("India", "Australia", "England", "South Africa", "New Zealand", "Pakistan", "Sri Lanka",
                "West Indies", "Bangladesh", "Zimbabwe", "Ireland", "Afghanistan")
TEAM_RENAMES = {
    "Delhi Daredevils": "Delhi Capitals",
    "Kings XI Punjab": "Punjab Kings",
    "Royal Challengers Bangalore": "Royal Challengers Bengaluru",
    "Rising Pune Supergiants": "Rising Pune Supergiant",
}
