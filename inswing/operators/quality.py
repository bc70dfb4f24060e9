"""Data-quality checks: each returns the offending rows; the report counts them and keeps three examples."""
from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

INN = ["match_id", "innings_no"]
Tables = Mapping[str, DataFrame]


@dataclass(frozen=True)
class Check:
    id: str
    area: str
    severity: str
    rows: Callable[[Tables], DataFrame]


def _repeated(table: str, *keys: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t[table].groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def _where(table: str, test: str, *cols: str) -> Callable[[Tables], DataFrame]:
    return lambda t: t[table].filter(test).select(*cols)


def _same_match_twice(t: Tables) -> DataFrame:
    text = F.concat_ws("/", "total_runs", "total_wickets")
    totals = t["innings"].groupBy("match_id").agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("innings_no", text.alias("s")))), lambda x: x["s"]), ",").alias("totals"))
    return (
        t["matches"].join(totals, "match_id")
        .groupBy(F.least("team1", "team2").alias("a"), F.greatest("team1", "team2").alias("b"), "start_date", "venue",
                 "gender", "totals").agg(F.count("*").alias("n"), F.min("match_id").alias("first_id"))
        .filter("n > 1")
    )


def _penalties() -> Column:
    return F.coalesce("penalty_runs_pre", F.lit(0)) + F.coalesce("penalty_runs_post", F.lit(0))


def _innings_total(t: Tables) -> DataFrame:
    s = t["deliveries"].groupBy(*INN).agg(F.sum("runs_total").alias("r"))
    return t["innings"].join(s, INN).withColumn("recomputed", F.col("r") + _penalties()) \
        .filter("total_runs <> recomputed").select(*INN, "total_runs", "recomputed")


def _wickets_vs_xi(t: Tables) -> DataFrame:
    side = t["players_in_match"].groupBy("match_id", F.col("team").alias("batting_team")).agg(F.count("*").alias("xi"))
    fell = t["wickets"].filter("counts_as_dismissal").groupBy(*INN).agg(F.count("*").alias("n"))
    return fell.join(t["innings"], INN).join(side, ["match_id", "batting_team"]).filter("n >= xi").select(*INN, "n", "xi")


def _overs(t: Tables) -> DataFrame:
    per = t["matches"].groupBy("match_id").agg(F.min("balls_per_over").alias("bpo"))
    return t["deliveries"].groupBy(*INN, "over").agg(F.count_if("legal").alias("legal_balls")).join(per, "match_id")


def _short_over(t: Tables) -> DataFrame:
    last = F.max("over").over(Window.partitionBy(*INN))
    return _overs(t).withColumn("last_over", last).filter("over < last_over and legal_balls < bpo")


def _not_in_side(role: str, side: str) -> Callable[[Tables], DataFrame]:
    """Players on the ball who are neither in the side nor listed as a replacement."""
    def rows(t: Tables) -> DataFrame:
        on = t["deliveries"].join(t["innings"].filter("not super_over").select(*INN, F.col(side).alias("team")), INN) \
            .select("match_id", "team", F.col(f"{role}_id").alias("person_id"), F.col(role).alias("name")).distinct()
        swap = t["replacements"].select("match_id", F.col("player_in").alias("name"))
        return (
            on.join(t["players_in_match"].select("match_id", "team", "person_id"), ["match_id", "team", "person_id"], "left_anti")
            .join(swap, ["match_id", "name"], "left_anti").select("match_id", "name").distinct()
        )
    return rows


def _wicket_on(test: str, *kinds: str) -> Callable[[Tables], DataFrame]:
    def rows(t: Tables) -> DataFrame:
        ball = t["deliveries"].filter(test).select("delivery_id", "match_id")
        return t["wickets"].filter(F.col("kind").isin(*kinds)).join(ball, ["match_id", "delivery_id"]).select("delivery_id", "kind")
    return rows


def _player_out(t: Tables) -> DataFrame:
    gone = ~F.col("kind").isin("retired hurt", "retired not out", "retired out", "timed out")
    ball = t["deliveries"].select("match_id", "delivery_id", "batter_id", "non_striker_id")
    return t["wickets"].filter(gone).join(ball, ["match_id", "delivery_id"]).filter(
        "player_out_id <> batter_id and player_out_id <> non_striker_id").select("delivery_id", "player_out_id")


def _fielder_required(t: Tables) -> DataFrame:
    return t["wickets"].filter("kind in ('caught', 'stumped')").join(
        t["wicket_fielders"], ["delivery_id", "wicket_idx"], "left_anti").select("delivery_id", "kind")


def _fielder_not_in_side(t: Tables) -> DataFrame:
    f = t["wicket_fielders"].filter("not substitute and fielder_id is not null").join(
        t["innings"].select(*INN, F.col("bowling_team").alias("team")), INN)
    xi = t["players_in_match"].select("match_id", "team", F.col("person_id").alias("fielder_id"))
    return f.join(xi, ["match_id", "team", "fielder_id"], "left_anti").select("delivery_id", "fielder_id")


def _target(t: Tables) -> DataFrame:
    """Second-innings target against the first innings, by pivoting both innings onto one row."""
    def at(no: int, col: str) -> Column:
        return F.max(F.when(F.col("innings_no") == no, F.col(col)))
    both = t["innings"].filter("not super_over").groupBy("match_id").agg(
        at(2, "target_runs").alias("target_runs"), (at(1, "total_runs") + 1).alias("expected"))
    m = t["matches"].filter("format_group in ('T20', 'ODI') and method is null")
    return both.filter("target_runs <> expected").join(m, "match_id", "left_semi")


def _chase_result(t: Tables) -> DataFrame:
    m = t["matches"].filter("format_group in ('T20', 'ODI') and result is null").select("match_id", "winner")
    i = t["innings"].filter("innings_no = 2 and total_runs >= target_runs")
    return i.join(m, "match_id").filter(~F.col("winner").eqNullSafe(F.col("batting_team"))).select(
        "match_id", "batting_team", "total_runs", "target_runs", "winner")


def _innings_team(t: Tables) -> DataFrame:
    m = t["matches"].select("match_id", "team1", "team2").distinct()
    return t["innings"].join(m, "match_id").filter("batting_team <> team1 and batting_team <> team2").select("match_id", "batting_team")


CAUGHT = ("bowled", "lbw", "caught", "caught and bowled")
E, W = "ERROR", "WARN"
CHECKS: list[Check] = [
    Check("dup_match_id", "duplicate matches", E, _repeated("matches", "match_id")),
    Check("dup_match_fingerprint", "duplicate matches", W, _same_match_twice),
    Check("dup_delivery_id", "duplicate deliveries", E, _repeated("deliveries", "delivery_id")),
    Check("dup_delivery_seq", "duplicate deliveries", E, _repeated("deliveries", "match_id", "innings_no", "seq")),
    Check("runs_total_sum", "innings totals", E, _where("deliveries", "runs_total <> runs_batter + runs_extras",
                                                        "delivery_id", "runs_batter", "runs_extras", "runs_total")),
    Check("innings_total", "innings totals", E, _innings_total),
    Check("extras_sum", "extras", E, _where("deliveries", "runs_extras <> wides + noballs + byes + legbyes + penalty", "delivery_id")),
    Check("extras_combo", "extras", W, _where("deliveries", "wides > 0 and noballs > 0", "delivery_id")),
    Check("boundary_four_six", "extras", W, _where("deliveries", "runs_batter in (4, 6) and non_boundary", "delivery_id", "runs_batter")),
    Check("wickets_per_innings", "wicket totals", E, lambda t: t["wickets"].filter("counts_as_dismissal").groupBy(*INN).agg(
        F.count("*").alias("n")).filter("n > 10")),
    Check("wickets_vs_xi", "wicket totals", E, _wickets_vs_xi),
    Check("legal_per_over", "legal deliveries", W, lambda t: _overs(t).filter("legal_balls > bpo")),
    Check("short_over_mid_innings", "legal deliveries", W, _short_over),
    Check("identity_unresolved", "player identity", W, _where("players_in_match", "not identity_resolved", "match_id", "team", "name")),
    Check("identity_multi_name", "player identity", W, lambda t: t["players_in_match"].groupBy("person_id").agg(
        F.countDistinct("name").alias("n"), F.array_join(F.array_sort(F.collect_set("name")), ",").alias("name_list")).filter("n > 1")),
    Check("batter_not_in_xi", "player identity", W, _not_in_side("batter", "batting_team")),
    Check("bowler_not_in_xi", "team identity", E, _not_in_side("bowler", "bowling_team")),
    Check("innings_team", "team identity", E, _innings_team),
    Check("winner_team", "match identity", E, _where("matches", "winner <> team1 and winner <> team2", "match_id", "winner")),
    Check("match_required", "match identity", E, _where(
        "matches", "gender is null or match_type is null or start_date is null or team1 is null or team2 is null", "match_id")),
    Check("player_out_on_ball", "dismissal consistency", E, _player_out),
    Check("bowler_kind_non_striker", "dismissal consistency", E, _where("wickets", "bowler_credited and not striker_out", "delivery_id", "kind")),
    Check("dismissed_twice", "dismissal consistency", E, lambda t: t["wickets"].filter("counts_as_dismissal").groupBy(
        *INN, "player_out_id").agg(F.count("*").alias("n")).filter("n > 1")),
    Check("wicket_on_wide_kind", "dismissal consistency", E, _wicket_on("wides > 0", *CAUGHT)),
    Check("wicket_on_noball_kind", "dismissal consistency", E, _wicket_on("noballs > 0", *CAUGHT, "stumped")),
    Check("fielder_required", "fielder references", W, _fielder_required),
    Check("fielder_not_in_xi", "fielder references", W, _fielder_not_in_side),
    Check("keeper_unresolved", "fielder references", W, _where("dismissals", "route = 'CAUGHT_KEEPER_STATUS_UNKNOWN'", "delivery_id", "fielder")),
    Check("target_mismatch", "target/chase", W, _target),
    Check("chase_result", "target/chase", E, _chase_result),
    Check("chase_overshoot", "target/chase", W, _where("deliveries", "chasing and runs_required <= 0", "match_id", "delivery_id")),
    Check("context_required_rate", "target/chase", E, _where(
        "deliveries", "abs(required_rate - runs_required * 6.0D / balls_remaining) > 1e-6", "delivery_id")),
]


def report(tables: Tables, stage: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """One row per check: violations, status and up to three examples; the counts are distributed aggregates.

    `stage` writes a frame and hands out a scan of it. Checks run one after another and each leaves its row there, so the
    driver holds the plan and the broadcast tables of one check at a time, not of all.
    """
    out = None
    for c in CHECKS:
        rows = c.rows(tables)
        text = rows.select(F.to_json(F.struct(*rows.columns)).alias("example"))
        examples = F.array_distinct(F.array_compact(F.array(F.min("example"), F.max("example"), F.any_value("example"))))
        line = stage(text.agg(F.count("*").alias("violations"), examples.alias("examples")).select(
            F.lit(c.id).alias("id"), F.lit(c.area).alias("area"), F.lit(c.severity).alias("severity"), "violations",
            "examples", F.when(F.col("violations") == 0, "PASS").otherwise(c.severity).alias("status")), f"report-{c.id}")
        out = line if out is None else out.unionByName(line)
    return out


# ---- provenance and event rules

REQUIRED = {  # fixed values: provenance fields each class must carry
    "OBSERVED": ["prov_source_id"],
    "DERIVED": ["prov_method", "prov_method_version"],
    "RECONSTRUCTED": ["prov_source_id", "prov_method", "prov_method_version", "prov_confidence"],
    "MODELLED": ["prov_method", "prov_method_version", "prov_confidence"],
    "ILLUSTRATIVE": [],
}


def provenance_faults(rows: DataFrame, subject: str = "subject_id") -> DataFrame:
    """Rows whose provenance class lacks a field, whose confidence is out of range, or that show illustration as fact."""
    cls = F.col("prov")
    missing = F.lit(False)
    for name, need in REQUIRED.items():
        for col in need:
            missing = missing | ((cls == name) & F.col(col).isNull())
    fault = (
        F.when(cls.isNull() | ~cls.isin(*REQUIRED), "unknown class")
        .when((cls == "ILLUSTRATIVE") & F.col(subject).isNotNull(), "illustrative row tied to a subject")
        .when(missing, "required field missing")
        .when((F.col("prov_confidence") < 0) | (F.col("prov_confidence") > 1), "confidence out of range")
    )
    return rows.withColumn("fault", fault).filter("fault is not null")


def known_share(rows: DataFrame, attributes: list[str], by: list[str]) -> DataFrame:
    """Share of rows with each attribute known, in one conditional aggregate."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), *[
        (100.0 * F.count(a) / F.count(F.lit(1))).alias(f"{a}_pct") for a in attributes])
