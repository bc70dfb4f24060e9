"""Projection of the retail tables to ball-by-ball tables.

The rules are fixed column arithmetic (FIXTURES.md, section 3), so that the same tables can be derived in any engine.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.functions.columns import before
from inswing.operators import sequence
from inswing.plans.workspace import Workspace, relation
from inswing.schema import CANONICAL, DELIVERIES, SOURCE_COVERAGE_PCT, SOURCE_COVERAGE_PERIODS, \
    SOURCE_MISSING_MATCHES

# Fixed values of the projection: names of teams, players and grounds.
TEAMS = ["India", "Australia", "England", "South Africa", "New Zealand", "Pakistan", "Scotland", "Kings XI Punjab",
         "Royal Challengers Bangalore", "Nepal"]
FORENAMES = ["Amar", "Ben", "Colin", "Dev", "Evan", "Femi", "Gus", "Hari", "Ivo", "Jai", "Kit"]
SURNAMES = {
    "male": ["Alder", "Birch", "Cedar", "Damson", "Elm", "Fir", "Gorse", "Hazel", "Ivy", "Juniper"],
    "female": ["Kale", "Larch", "Maple", "Nettle", "Oak", "Pine", "Quince", "Rowan", "Sorrel", "Thorn"],
}
STYLES = {7: "Right-arm fast-medium", 8: "Slow left-arm orthodox", 9: "Legbreak", 10: "Left-arm fast"}
FIRST_DAY = "2015-01-01"


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def team_name(index: Column) -> Column:
    return _pick(TEAMS, index)


def person(gender: Column, team_index: Column, position: Column) -> Column:
    return F.concat(F.substring(gender, 1, 1), team_index.cast("string"), F.lit("p"), position.cast("string"))


def person_name(gender: Column, team_index: Column, position: Column) -> Column:
    last = F.when(gender == "male", _pick(SURNAMES["male"], team_index)).otherwise(
        _pick(SURNAMES["female"], team_index))
    return F.concat(_pick(FORENAMES, position - 1), F.lit(" "), last)


def match_columns(match_no: Column) -> dict[str, Column]:
    """Everything about a match that follows from its number."""
    team1 = match_no % 10
    return {
        "match_id": F.concat(F.lit("m"), match_no.cast("string")),
        "format_group": F.when(match_no % 4 == 0, "ODI").otherwise("T20"),
        "gender": F.when(match_no % 5 == 0, "female").otherwise("male"),
        "t1": team1.cast("int"),
        "t2": ((team1 + 1 + F.floor(match_no / 10) % 9) % 10).cast("int"),
        "start_date": F.date_add(F.lit(FIRST_DAY).cast("date"), ((match_no * 14) % 4000).cast("int")),
        "competition": F.when(match_no % 3 == 0, "League A").when(match_no % 3 == 1, "Cup"),
        "team_type": F.when(match_no % 3 == 0, "club").otherwise("international"),
        "scheduled_overs": F.when(match_no % 4 == 0, 50).otherwise(20),
        "method": F.when(match_no % 25 == 0, "D/L"),
    }


ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]


def _match_no() -> Column:
    return F.floor(F.col("l_orderkey") / 60)


def _lines(lineitem: DataFrame) -> DataFrame:
    """One row per line with the columns that do not depend on order."""
    ln, q, pk = F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_partkey")
    match_no = _match_no()
    wide = ln == 7
    noball = (ln == 6) & (q % 10 == 0)
    legal = ~wide & ~noball
    scored = (
        F.when(wide | (q >= 48) | (q <= 18), 0).when(q <= 34, 1).when(q <= 38, 2).when(q == 39, 3)
        .when(q <= 44, 4).otherwise(6)
    )
    kind = (
        F.when(~legal, F.lit(None)).when(q == 48, F.when(pk % 2 == 0, "bowled").otherwise("lbw"))
        .when(q == 49, "caught")
        .when(q == 50, F.when(pk % 3 == 0, "run out").when(pk % 3 == 1, "stumped").otherwise("caught and bowled"))
    )
    attrs = match_columns(match_no)
    match_id = F.col("match_id") if "match_id" in lineitem.columns else attrs["match_id"].alias("match_id")
    return lineitem.select(
        F.struct(*ORDER).alias("at"),
        match_id,
        (1 + F.floor(F.col("l_orderkey") / 30) % 2).cast("int").alias("innings_no"),
        match_no.alias("match_no"),
        attrs["format_group"].alias("format_group"),
        wide.cast("int").alias("wides"),
        noball.cast("int").alias("noballs"),
        legal.alias("legal"),
        scored.alias("runs_batter"),
        F.when(legal & (q <= 18) & (ln == 5) & (q % 9 == 0), 1).otherwise(0).alias("byes"),
        kind.alias("kind"),
        F.col("l_suppkey").alias("sk"),
    )


OVERLONG = 4  # an innings with this many times the legal balls it can hold is cut before it is shuffled


def _limit() -> Column:
    return F.when(F.col("format_group") == "ODI", 300).otherwise(120)


@relation("overlong_innings")
def overlong_innings(ws: Workspace) -> DataFrame:
    legal = _lines(ws.source("lineitem")).filter("legal")
    return legal.groupBy("match_id", "innings_no", "format_group").agg(F.count("*").alias("k")) \
        .filter(F.col("k") >= OVERLONG * _limit()).select("match_id", "innings_no")


@relation("last_places")
def last_places(ws: Workspace) -> DataFrame:
    """The place of the last legal ball that an overlong innings can hold.

    The row_number filter is pushed below the shuffle as a per-task limit, so an innings that holds a large share of the
    table sends only a few hundred rows per task. Innings that are not much too long are cut by their windows alone.
    """
    w = Window.partitionBy("match_id", "innings_no").orderBy("at")
    legal = _lines(ws.source("lineitem")).filter("legal").select("match_id", "innings_no", "format_group", "at")
    return (
        legal.join(ws["overlong_innings"], ["match_id", "innings_no"], "left_semi")
        .withColumn("n", F.row_number().over(w)).filter(F.col("n") <= 300)
        .filter(F.col("n") == _limit())
        .select("match_id", "innings_no", F.col("at").alias("last_at"))
    )


def _played(ws: Workspace) -> DataFrame:
    """Lines up to the last legal ball of their innings with what happened before each, and why a line is no ball: `left_over`."""
    inn = Window.partitionBy("match_id", "innings_no").orderBy("at")
    prev = before("match_id", "innings_no", order="at")
    whole = Window.partitionBy("match_id")
    c = F.col

    def run(x: Column) -> Column:
        return F.coalesce(F.sum(x).over(prev), F.lit(0)).cast("int")

    wkt = F.col("kind").isNotNull().cast("int")
    limit = _limit()
    extras = F.col("wides") + F.col("noballs") + F.col("byes")
    attrs = match_columns(_match_no())
    source = ws.source("lineitem").select(*ORDER, attrs["match_id"].alias("match_id"))
    cut = _lines(source).join(ws["last_places"], ["match_id", "innings_no"], "left").filter(
        c("last_at").isNull() | (c("at") <= c("last_at"))).select("match_id", "at.*")
    # only the given columns of a line are shuffled; the others are worked out again behind it
    rows = _lines(ws.spread(cut, "match_id")).withColumns({
        "runs_extras": extras.cast("int"), "runs_total": (F.col("runs_batter") + extras).cast("int"),
        "dismissals": wkt, "departures": wkt, "limit_balls": limit})
    rows = rows.withColumns({
        "seq": F.row_number().over(inn).cast("int"), "w0": run(F.col("dismissals")),
        "l0": run(F.col("legal").cast("int")), "s0": run(F.col("runs_total")),
    }).withColumn("left_over", F.when(c("l0") >= c("limit_balls"), "overs bowled").when(c("w0") >= 10, "all out"))
    target = F.sum(F.when((c("innings_no") == 1) & c("left_over").isNull(), c("runs_total"))).over(whole) + 1
    rows = rows.withColumn("target_runs", F.when(c("innings_no") == 2, target).cast("int"))
    return rows.withColumn("left_over", F.coalesce("left_over", F.when(c("s0") >= c("target_runs"), "target reached")))


@relation("left_over_lines")
def left_over_lines(ws: Workspace) -> DataFrame:
    """The lines that are no balls, each with the reason: its innings was over before it."""
    after = _lines(ws.source("lineitem")).join(ws["last_places"], ["match_id", "innings_no"]).filter(
        F.col("at") > F.col("last_at")).withColumn("left_over", F.lit("overs bowled"))
    keep = ["match_id", "innings_no", "at", "left_over"]
    return after.select(*keep).unionByName(_played(ws).filter("left_over is not null").select(*keep))


def reconciliation(ws: Workspace) -> DataFrame:
    """Lines, balls, and what is left over by reason; `missing` is what none of them accounts for, and must be zero."""
    def counted(df: DataFrame, what: Column) -> DataFrame:
        return df.groupBy(what.alias("what")).agg(F.count("*").alias("n"))
    parts = counted(ws.source("lineitem"), F.lit("lines")).unionByName(counted(ws["deliveries"], F.lit("balls"))).unionByName(
        counted(ws["left_over_lines"], F.col("left_over")))
    sign = F.when(F.col("what") == "lines", F.col("n")).otherwise(-F.col("n"))
    return parts.unionByName(parts.agg(F.sum(sign).alias("n")).select(F.lit("missing").alias("what"), "n"))


@relation("ball_facts")
def ball_facts(ws: Workspace) -> DataFrame:
    """Deliveries with their context, plus the kind of wicket and the fielder's number."""
    rows = _played(ws).filter("left_over is null").drop("left_over")
    attrs = match_columns(F.col("match_no"))
    first = F.col("innings_no") == 1
    credited = F.col("kind").isNotNull() & (F.col("kind") != "run out")
    on_strike = F.col("w0") + F.when(credited | (F.col("seq") % 2 == 1), 1).otherwise(2)
    over = F.floor(F.col("l0") / 6).cast("int")
    rows = rows.withColumns({
        "over": over, "gender": attrs["gender"],
        "bat_t": F.when(first, attrs["t1"]).otherwise(attrs["t2"]),
        "bat_pos": on_strike,
    }).withColumn("batter_id", person(F.col("gender"), F.col("bat_t"), F.col("bat_pos")))
    # the windows sort only what they need; everything that follows from a row by itself is added behind them
    rows = sequence.with_running_context(rows, order="at").withColumns({
        "scheduled_overs": attrs["scheduled_overs"],
        "bowl_t": F.when(first, attrs["t2"]).otherwise(attrs["t1"]),
        "ns_pos": 2 * F.col("w0") + 3 - F.col("bat_pos"),
        "bowl_pos": (7 + 2 * (F.floor(F.col("over") / 4) % 2) + F.col("over") % 2).cast("int"),
        "out_pos": F.when(F.col("kind").isNotNull(), F.col("w0") + 1),
        "field_pos": F.when(F.col("kind") == "caught", 1 + F.col("sk") % 6)
        .when(F.col("kind").isin("stumped", "run out"), 1).cast("int"),
    })
    people = {}
    for role, team, pos in (("batter", "bat_t", "bat_pos"), ("non_striker", "bat_t", "ns_pos"),
                            ("bowler", "bowl_t", "bowl_pos"), ("player_out", "bat_t", "out_pos"),
                            ("fielder", "bowl_t", "field_pos")):
        people[f"{role}_id"] = person(F.col("gender"), F.col(team), F.col(pos))
        people[role] = person_name(F.col("gender"), F.col(team), F.col(pos))
    rows = rows.withColumns(people | {
        "substitute": F.col("sk") % 50 == 0, "non_boundary": F.lit(False),
        "is_four": F.col("runs_batter") == 4, "is_six": F.col("runs_batter") == 6,
        "n_wickets": F.col("dismissals"), "legbyes": F.lit(0), "penalty": F.lit(0), "source_id": F.lit("projection"),
        "delivery_id": F.concat_ws(":", "match_id", "innings_no", "seq"),
        "phase": sequence.phase(F.col("format_group"), F.col("over"), F.col("scheduled_overs"), F.lit(False)),
    })
    rows = sequence.with_chase(rows)
    keep = [f.name for f in DELIVERIES.fields] + [
        "match_no", "kind", "player_out_id", "player_out", "fielder_id", "fielder", "substitute", "bat_t", "bowl_t"]
    return rows.select(*keep)


@relation("deliveries", written=False)
def deliveries(ws: Workspace) -> DataFrame:
    return ws["ball_facts"].select(*[F.col(f.name).cast(f.dataType) for f in DELIVERIES.fields])


@relation("innings")
def innings(ws: Workspace) -> DataFrame:
    facts = ws["ball_facts"].withColumn("dismissals", F.col("n_wickets"))
    totals = sequence.innings_totals(facts)
    about = facts.groupBy("match_id", "innings_no").agg(
        F.min("match_no").alias("match_no"), F.min("bat_t").alias("bat_t"), F.min("bowl_t").alias("bowl_t"),
        F.min("target_runs").alias("target_runs"))
    attrs = match_columns(F.col("match_no"))
    none = F.lit(None)
    second = F.col("innings_no") == 2
    full = totals.join(about, ["match_id", "innings_no"]).select(
        "match_id", "innings_no", team_name(F.col("bat_t")).alias("batting_team"),
        team_name(F.col("bowl_t")).alias("bowling_team"), F.lit(False).alias("super_over"),
        F.lit(False).alias("declared"), F.lit(False).alias("forfeited"), "target_runs",
        F.when(second, attrs["scheduled_overs"]).alias("target_overs"),
        F.when(second, "DERIVED").alias("target_prov"), none.alias("penalty_runs_pre"),
        none.alias("penalty_runs_post"), none.alias("absent_hurt"), F.col("runs").alias("total_runs"),
        "total_wickets", "legal_balls")
    return _typed(full, "innings")


@relation("matches")
def matches(ws: Workspace) -> DataFrame:
    def at(no: int, col: str) -> Column:
        return F.max(F.when(F.col("innings_no") == no, F.col(col)))
    per = ws["innings"].groupBy("match_id").agg(
        at(1, "total_runs").alias("r1"), at(2, "total_runs").alias("r2"), at(2, "total_wickets").alias("w2"))
    per = per.withColumn("match_no", F.expr("cast(substring(match_id, 2) as bigint)"))
    attrs = match_columns(F.col("match_no"))
    for name in attrs:
        if name != "match_id":
            per = per.withColumn(name, attrs[name])
    n = F.col("match_no")
    per = (
        per
        .withColumn("team1", team_name(F.col("t1"))).withColumn("team2", team_name(F.col("t2")))
        .withColumn("chased", F.col("r2") >= F.col("r1") + 1)
        .withColumn("tied", F.col("r2") == F.col("r1"))
        .withColumn("winner", F.when(F.col("chased"), F.col("team2")).when(F.col("tied"), F.lit(None))
                    .otherwise(F.col("team1")))
        .withColumn("result", F.when(F.col("tied"), "tie"))
        .withColumn("win_by_runs", F.when(~F.col("chased") & ~F.col("tied"), F.col("r1") - F.col("r2")))
        .withColumn("win_by_wickets", F.when(F.col("chased"), 10 - F.col("w2")))
        .withColumn("match_type", F.when((n % 4 == 0) & (F.col("team_type") == "club"), "ODM")
                    .when(n % 4 == 0, "ODI").when(F.col("team_type") == "international", "IT20").otherwise("T20"))
        .withColumn("season", F.year("start_date").cast("string"))
        .withColumn("end_date", F.col("start_date")).withColumn("n_days", F.lit(1))
        .withColumn("venue", F.concat(F.lit("Ground "), (n % 7).cast("string")))
        .withColumn("city", F.concat(F.lit("City "), (n % 7).cast("string")))
        .withColumn("event_stage", F.when(n % 15 == 0, "Final"))
        .withColumn("toss_winner", F.when(n % 2 == 0, F.col("team1")).otherwise(F.col("team2")))
        .withColumn("toss_decision", F.when(n % 2 == 0, "bat").otherwise("field"))
        .withColumn("toss_uncontested", F.lit(False))
        .withColumn("balls_per_over", F.lit(6))
        .withColumn("source_id", F.lit("projection"))
    )
    return _typed(per, "matches")


def _typed(df: DataFrame, name: str) -> DataFrame:
    """Canonical column order and types; absent columns are null."""
    have = set(df.columns)
    return df.select(*[
        (F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in CANONICAL[name].fields])


@relation("players_in_match")
def players_in_match(ws: Workspace) -> DataFrame:
    m = ws["matches"].select("match_id", F.expr("cast(substring(match_id, 2) as bigint)").alias("match_no"), "gender")
    attrs = match_columns(F.col("match_no"))
    g, t, p = F.col("gender"), F.col("t"), F.col("p")
    return _typed(
        m.withColumn("t", F.explode(F.array(attrs["t1"], attrs["t2"])))
        .withColumn("p", F.explode(F.sequence(F.lit(1), F.lit(11))))
        .select("match_id", team_name(t).alias("team"), person(g, t, p).alias("person_id"),
                person_name(g, t, p).alias("name"), F.lit(True).alias("identity_resolved")), "players_in_match")


@relation("wickets")
def wickets(ws: Workspace) -> DataFrame:
    w = ws["ball_facts"].filter("kind is not null")
    for name, col in sequence.wicket_flags(F.col("kind")).items():
        w = w.withColumn(name, col)
    w = w.withColumn("wicket_idx", F.lit(0)).withColumn("striker_out", F.col("player_out_id") == F.col("batter_id"))
    return _typed(w, "wickets")


@relation("wicket_fielders")
def wicket_fielders(ws: Workspace) -> DataFrame:
    f = ws["ball_facts"].filter("fielder_id is not null")
    return _typed(f.withColumn("wicket_idx", F.lit(0)).withColumn("fielder_idx", F.lit(0)), "wicket_fielders")


@relation("persons")
def persons(ws: Workspace) -> DataFrame:
    who = ws["players_in_match"].select("person_id", "name").distinct()
    ids = F.create_map(F.lit("key_scorebook"), F.concat(F.lit("sb-"), F.col("person_id")))
    return _typed(who.withColumn("unique_name", F.concat_ws(" ", "name", "person_id"))
                  .withColumn("external_ids", ids).withColumn("source_id", F.lit("projection")), "persons")


def _nothing(name: str, schema):
    @relation(name)
    def build(ws: Workspace) -> DataFrame:
        return ws.spark.createDataFrame([], schema)
    return build


for _name in ("reviews", "replacements", "powerplays", "delivery_tracking", "delivery_shot", "delivery_fielding",
              "delivery_contact"):
    _nothing(_name, CANONICAL[_name])


@relation("style_observations")
def style_observations(ws: Workspace) -> DataFrame:
    """External attributes: the free text of a bowling style by position, and the batting hand."""
    p = ws["persons"].select(
        "person_id", F.regexp_extract("person_id", r"p(\d+)$", 1).cast("int").alias("pos"),
        F.substring("person_id", 2, 1).cast("int").alias("t"))
    style = F.when(F.col("t") % 5 != 0, F.create_map(
        *[x for k, v in STYLES.items() for x in (F.lit(k), F.lit(v))])[F.col("pos")])
    s = F.col("t") + F.col("pos")
    hand = F.when(s % 7 == 0, F.lit(None)).when(s % 3 == 0, "left").otherwise("right")
    field = F.inline(F.array(
        F.struct(F.lit("bowling_style").alias("field"), style.alias("value")),
        F.struct(F.lit("batting_hand").alias("field"), hand.alias("value"))))
    return p.select("person_id", field).filter("value is not null")


@relation("source_coverage_periods")
def source_coverage_periods(ws: Workspace) -> DataFrame:
    """Coverage of a competition starts with the month of its first match."""
    m = ws["matches"].filter("competition is not null").groupBy("competition").agg(
        F.trunc(F.min("start_date"), "month").alias("coverage_from"), F.max("start_date").alias("coverage_to"))
    return m.select(*[F.col(f.name).cast(f.dataType) for f in SOURCE_COVERAGE_PERIODS.fields])


@relation("source_coverage_pct")
def source_coverage_pct(ws: Workspace) -> DataFrame:
    m = ws["matches"].filter("competition is not null").groupBy("competition").agg(F.count("*").alias("have"))
    return m.withColumn("of", F.ceil(F.col("have") * 1.1)).select(
        *[F.col(f.name).cast(f.dataType) for f in SOURCE_COVERAGE_PCT.fields])


@relation("source_missing_matches")
def source_missing_matches(ws: Workspace) -> DataFrame:
    """One match in forty is listed a second time, a week later, as missing from the source."""
    m = ws["matches"].filter(F.expr("cast(substring(match_id, 2) as bigint) % 40 = 1"))
    return m.select(F.date_add("start_date", 7).alias("start_date"), "competition", "team1", "team2", "gender") \
        .select(*[F.col(f.name).cast(f.dataType) for f in SOURCE_MISSING_MATCHES.fields])
