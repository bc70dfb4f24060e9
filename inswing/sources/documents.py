"""Ingest of nested match documents into the canonical tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from inswing.operators import sequence
from inswing.schema import CANONICAL, FORMAT_GROUP
from inswing.functions.columns import lookup

DOCUMENT = """
meta struct<data_version:string, created:string, revision:int>,
info struct<balls_per_over:int, city:string, dates:array<string>, event:struct<name:string, match_number:string, `group`:string, stage:string>, gender:string,
  match_type:string, match_type_number:int, outcome:struct<winner:string, by:struct<runs:int, wickets:int, innings:int>, result:string, method:string, eliminator:string>,
  overs:int, player_of_match:array<string>, players:map<string,array<string>>, registry:struct<people:map<string,string>>, season:string, team_type:string,
  teams:array<string>, toss:struct<winner:string, decision:string, uncontested:boolean>, venue:string>,
innings array<struct<team:string, target:struct<runs:int, overs:double>, super_over:boolean, declared:boolean, forfeited:boolean, absent_hurt:array<string>,
  penalty_runs:struct<pre:int, post:int>, powerplays:array<struct<`from`:double, `to`:double, type:string>>,
  overs:array<struct<over:int, deliveries:array<struct<actual_delivery:string, batter:string, bowler:string, non_striker:string,
    runs:struct<batter:int, extras:int, total:int, non_boundary:boolean>, extras:struct<wides:int, noballs:int, byes:int, legbyes:int, penalty:int>,
    wickets:array<struct<player_out:string, kind:string, fielders:array<struct<name:string, substitute:boolean>>>>,
    review:struct<`by`:string, umpire:string, batter:string, decision:string, umpires_call:boolean, type:string>,
    replacements:struct<`match`:array<struct<team:string, `in`:string, `out`:string, reason:string>>, role:array<struct<`in`:string, `out`:string, reason:string, role:string>>>>>>>>>
"""
# The keys a document may carry.
INFO_KEYS = ("balls_per_over bowl_out city dates event gender match_type match_type_number missing officials outcome overs player_of_match players "
             "registry season supersubs team_type teams toss venue").split()
INNINGS_KEYS = "team overs powerplays target absent_hurt penalty_runs declared forfeited super_over miscounted_overs".split()
DELIVERY_KEYS = "actual_delivery batter bowler non_striker runs extras wickets replacements review".split()


def read_folder(spark: SparkSession, path: str) -> DataFrame:
    """(source_ref, content, sha256) of every JSON file below a folder; a document is a row, so files spread over tasks."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").load(path)
    return files.select(F.col("path").alias("source_ref"), F.col("content").cast("string").alias("content"), F.sha2("content", 256).alias("sha256"))


def verify_manifest(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose checksum differs from the manifest, or that the manifest lists and the folder lacks."""
    return manifest.join(files.select("source_ref", "sha256"), "source_ref", "left").filter(~F.col("sha256").eqNullSafe(F.col("expected")))


def read_register(spark: SparkSession, path: str) -> DataFrame:
    """Register CSV: every key_* column that is filled becomes an external id."""
    rows = spark.read.option("header", "true").csv(path)
    keys = [k for k in rows.columns if k.startswith("key_")]
    ids = F.map_from_arrays(F.array(*[F.lit(k) for k in keys]), F.array(*keys)) if keys else F.create_map().cast("map<string,string>")
    return rows.select(F.col("identifier").alias("person_id"), "name", "unique_name", F.map_filter(ids, lambda k, v: F.length(v) > 0).alias("external_ids"))


def parse(files: DataFrame) -> DataFrame:
    stem = F.regexp_extract("source_ref", r"([^/]+?)(\.json)?$", 1)
    return files.select("source_ref", "content", "sha256", stem.alias("match_id"), F.from_json("content", DOCUMENT).alias("d"))


def judged(files: DataFrame) -> DataFrame:
    """Each document with the reason it cannot be used, or null; of several copies of a match the first source wins."""
    info, inn = F.col("d.info"), F.col("d.innings")
    rows = parse(files)
    balls = F.flatten(F.transform(F.flatten(F.transform(inn, lambda i: F.coalesce(i["overs"], F.array()))), lambda o: F.coalesce(o["deliveries"], F.array())))
    reason = (
        F.when(info.isNull(), "missing info").when(info["gender"].isNull() | ~info["gender"].isin("male", "female"), "missing gender")
        .when(F.coalesce(F.size(info["dates"]), F.lit(0)) < 1, "missing dates").when(F.coalesce(F.size(info["teams"]), F.lit(0)) != 2, "needs two teams")
        .when(F.exists(inn, lambda i: i["team"].isNull() | ~F.array_contains(info["teams"], i["team"])), "innings team unknown")
        .when(F.exists(inn, lambda i: F.exists(F.coalesce(i["overs"], F.array()), lambda o: o["over"].isNull())), "over number missing")
        .when(F.exists(balls, lambda b: b["batter"].isNull() | b["bowler"].isNull()), "batter or bowler missing"))
    first = F.row_number().over(Window.partitionBy("match_id").orderBy(reason.isNotNull(), "source_ref"))
    rows = rows.withColumns({"reason": reason, "copy": first})
    return rows.withColumn("reason", F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("copy") > 1, "duplicate match")).drop("copy")


def quarantine(files: DataFrame) -> DataFrame:
    return judged(files).filter("reason is not null").select("source_ref", "match_id", "reason")


def drift(files: DataFrame) -> DataFrame:
    """Unknown keys at each level of the documents and how often they occur."""
    rows = "array<map<string,string>>"
    info = files.select(F.lit("info").alias("level"), F.explode(F.json_object_keys(F.get_json_object("content", "$.info"))).alias("key")).filter(~F.col("key").isin(*INFO_KEYS))
    inn = files.select(F.explode(F.from_json(F.get_json_object("content", "$.innings"), rows)).alias("m"))
    ball = inn.select(F.explode(F.from_json(F.col("m")["overs"], rows)).alias("o")).select(F.explode(F.from_json(F.col("o")["deliveries"], rows)).alias("b"))
    out = info.unionByName(inn.select(F.lit("innings").alias("level"), F.explode(F.map_keys("m")).alias("key")).filter(~F.col("key").isin(*INNINGS_KEYS)))
    out = out.unionByName(ball.select(F.lit("delivery").alias("level"), F.explode(F.map_keys("b")).alias("key")).filter(~F.col("key").isin(*DELIVERY_KEYS)))
    return out.groupBy("level", "key").agg(F.count("*").alias("n"))


def field_presence(files: DataFrame) -> DataFrame:
    """Every path of the documents down to a ball: occurrences and the documents that have it."""
    rows = "array<map<string,string>>"
    top = files.select("source_ref", F.explode(F.json_object_keys(F.get_json_object("content", "$.info"))).alias("k")).select("source_ref", F.concat(F.lit("info."), "k").alias("path"))
    inn = files.select("source_ref", F.explode(F.from_json(F.get_json_object("content", "$.innings"), rows)).alias("m"))
    ball = inn.select("source_ref", F.explode(F.from_json(F.col("m")["overs"], rows)).alias("o")).select("source_ref", F.explode(F.from_json(F.col("o")["deliveries"], rows)).alias("b"))
    paths = top.unionByName(inn.select("source_ref", F.explode(F.map_keys("m")).alias("k")).select("source_ref", F.concat(F.lit("innings."), "k").alias("path")))
    paths = paths.unionByName(ball.select("source_ref", F.explode(F.map_keys("b")).alias("k")).select("source_ref", F.concat(F.lit("delivery."), "k").alias("path")))
    return paths.groupBy("path").agg(F.count("*").alias("n"), F.countDistinct("source_ref").alias("documents"))


def person_id(people: Column, name: Column) -> Column:
    """Registered id of a name, else a flagged id derived from the name."""
    return F.coalesce(people[name], F.when(name.isNotNull(), F.concat(F.lit("unres:"), F.substring(F.sha1(name), 1, 10))))


def _typed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CANONICAL[name].fields])


def ingest(files: DataFrame, source_id: str = "documents") -> dict[str, DataFrame]:
    """Canonical tables of the usable documents."""
    good = judged(files).filter("reason is null")
    i = F.col("d.info")
    fmt = lookup(FORMAT_GROUP, i["match_type"])
    dates = F.transform(i["dates"], lambda x: F.to_date(x))
    people = F.coalesce(i["registry"]["people"], F.create_map().cast("map<string,string>"))
    m = good.withColumns({
        "people": people, "fmt": fmt, "bpo": F.coalesce(i["balls_per_over"], F.lit(6)), "sched": i["overs"], "t1": i["teams"][0], "t2": i["teams"][1]})
    o, e, toss = i["outcome"], i["event"], i["toss"]
    matches = m.select(
        "match_id", F.lit(source_id).alias("source_id"), "source_ref", F.col("sha256").alias("source_checksum"), F.col("d.meta.data_version").alias("data_version"),
        F.col("d.meta.created").alias("source_created"), F.col("d.meta.revision").alias("source_revision"), i["gender"].alias("gender"), i["match_type"].alias("match_type"),
        F.col("fmt").alias("format_group"), i["team_type"].alias("team_type"), i["match_type_number"].alias("match_type_number"), e["name"].alias("competition"),
        e["match_number"].alias("event_match_number"), e["group"].alias("event_group"), e["stage"].alias("event_stage"), i["season"].alias("season"), F.array_min(dates).alias("start_date"),
        F.array_max(dates).alias("end_date"), F.size(dates).alias("n_days"), i["venue"].alias("venue"), i["city"].alias("city"), F.col("t1").alias("team1"), F.col("t2").alias("team2"),
        toss["winner"].alias("toss_winner"), toss["decision"].alias("toss_decision"), toss["uncontested"].alias("toss_uncontested"), o["winner"].alias("winner"), o["by"]["runs"].alias("win_by_runs"),
        o["by"]["wickets"].alias("win_by_wickets"), o["by"]["innings"].alias("win_by_innings"), o["result"].alias("result"), o["method"].alias("method"), o["eliminator"].alias("eliminator"),
        F.col("bpo").alias("balls_per_over"), F.col("sched").alias("scheduled_overs"), i["player_of_match"].alias("player_of_match"))
    xi = m.select("match_id", "people", F.explode(i["players"]).alias("team", "names")).select("match_id", "people", "team", F.explode("names").alias("name")).select(
        "match_id", "team", person_id(F.col("people"), F.col("name")).alias("person_id"), "name", F.col("people")[F.col("name")].isNotNull().alias("identity_resolved"))
    inn = m.select("match_id", "people", "fmt", "bpo", "sched", "t1", "t2", F.posexplode("d.innings").alias("p", "v")).withColumn("innings_no", F.col("p") + 1)
    raw = inn.select("match_id", "innings_no", "people", "fmt", "bpo", "sched", F.coalesce("v.super_over", F.lit(False)).alias("super_over"), F.col("v.target").alias("target"),
                     (F.coalesce("v.penalty_runs.pre", F.lit(0)) + F.coalesce("v.penalty_runs.post", F.lit(0))).alias("pen"), F.posexplode("v.overs").alias("op", "ov"))
    raw = raw.select("*", F.col("ov.over").alias("over"), F.posexplode("ov.deliveries").alias("bp", "b")).drop("ov")
    x, r, w = F.col("b.extras"), F.col("b.runs"), F.coalesce("b.wickets", F.expr("cast(array() as array<struct<player_out:string, kind:string, fielders:array<struct<name:string, substitute:boolean>>>>)"))
    zero = F.lit(0)
    counts = lambda k: ~k["kind"].isin("retired hurt", "retired not out")
    balls = raw.repartition("match_id").withColumns({
        "seq": F.row_number().over(Window.partitionBy("match_id", "innings_no").orderBy("op", "bp")).cast("int"),
        "wides": F.coalesce(x["wides"], zero), "noballs": F.coalesce(x["noballs"], zero), "byes": F.coalesce(x["byes"], zero), "legbyes": F.coalesce(x["legbyes"], zero),
        "penalty": F.coalesce(x["penalty"], zero), "runs_batter": F.coalesce(r["batter"], zero), "runs_extras": F.coalesce(r["extras"], zero), "runs_total": F.coalesce(r["total"], zero),
        "non_boundary": F.coalesce(r["non_boundary"], F.lit(False)), "wk": w, "departures": F.size(w), "dismissals": F.size(F.filter(w, counts)), "actual_delivery": F.col("b.actual_delivery")})
    first = F.sum(F.when(F.col("innings_no") == 1, F.col("runs_total"))).over(Window.partitionBy("match_id")) + F.max(F.when(F.col("innings_no") == 1, F.col("pen"))).over(Window.partitionBy("match_id"))
    derive = (F.col("innings_no") == 2) & F.col("fmt").isin("T20", "ODI") & ~F.col("super_over")
    target = F.coalesce(F.col("target.runs"), F.when(derive, first + 1))
    limit_overs = F.coalesce(F.col("target.overs"), F.when(F.col("super_over"), 1.0), F.col("sched").cast("double"))
    balls = balls.withColumns({
        "delivery_id": F.concat_ws(":", "match_id", "innings_no", "seq"), "legal": (F.col("wides") == 0) & (F.col("noballs") == 0), "batter": F.col("b.batter"), "bowler": F.col("b.bowler"),
        "non_striker": F.col("b.non_striker"), "is_four": (F.col("runs_batter") == 4) & ~F.col("non_boundary"), "is_six": (F.col("runs_batter") == 6) & ~F.col("non_boundary"),
        "n_wickets": F.col("departures"), "source_id": F.lit(source_id), "target_runs": target.cast("int"), "limit_balls": sequence.overs_to_balls(limit_overs, F.col("bpo")),
        "format_group": F.col("fmt"), "phase": sequence.phase(F.col("fmt"), F.col("over"), F.col("sched"), F.col("super_over")),
        **{f"{k}_id": person_id(F.col("people"), F.col(f"b.{k}")) for k in ("batter", "bowler", "non_striker")}})
    totals = balls.groupBy("match_id", "innings_no").agg(F.sum("runs_total").alias("runs"), F.sum("dismissals").alias("total_wickets"), F.count_if("legal").alias("legal_balls"), F.min("target_runs").alias("tr"))
    balls = sequence.with_chase(sequence.with_running_context(balls))
    innings = inn.join(totals, ["match_id", "innings_no"], "left").withColumns({
        "batting_team": F.col("v.team"), "bowling_team": F.when(F.col("v.team") == F.col("t1"), F.col("t2")).otherwise(F.col("t1")), "super_over": F.coalesce("v.super_over", F.lit(False)),
        "declared": F.coalesce("v.declared", F.lit(False)), "forfeited": F.coalesce("v.forfeited", F.lit(False)), "target_runs": F.coalesce("v.target.runs", "tr"),
        "target_prov": F.when(F.col("v.target.runs").isNotNull(), "OBSERVED").when(F.col("tr").isNotNull(), "DERIVED"), "penalty_runs_pre": F.col("v.penalty_runs.pre"),
        "target_overs": F.coalesce(F.col("v.target.overs"), F.when(F.col("v.target.runs").isNull() & F.col("tr").isNotNull(), F.col("sched").cast("double"))),
        "penalty_runs_post": F.col("v.penalty_runs.post"), "absent_hurt": F.col("v.absent_hurt"),
        "total_runs": F.coalesce("runs", F.lit(0)) + F.coalesce("v.penalty_runs.pre", F.lit(0)) + F.coalesce("v.penalty_runs.post", F.lit(0))})
    fell = balls.select("delivery_id", "match_id", "innings_no", "people", "batter", "source_id", F.posexplode("wk").alias("wicket_idx", "k"))
    flags = sequence.wicket_flags(F.col("k.kind"))
    wickets = fell.select("delivery_id", "match_id", "innings_no", "wicket_idx", person_id(F.col("people"), F.col("k.player_out")).alias("player_out_id"), F.col("k.player_out").alias("player_out"),
                          F.col("k.kind").alias("kind"), *[v.alias(n) for n, v in flags.items()], (F.col("k.player_out") == F.col("batter")).alias("striker_out"), "source_id")
    fielders = fell.select("delivery_id", "match_id", "innings_no", "wicket_idx", "people", "source_id", F.posexplode("k.fielders").alias("fielder_idx", "f")).select(
        "delivery_id", "match_id", "innings_no", "wicket_idx", "fielder_idx", person_id(F.col("people"), F.col("f.name")).alias("fielder_id"), F.col("f.name").alias("fielder"),
        F.coalesce("f.substitute", F.lit(False)).alias("substitute"), "source_id")
    rv = balls.filter("b.review is not null").select("delivery_id", "match_id", F.col("b.review.by").alias("by_team"), "b.review.umpire", "b.review.batter", "b.review.decision", "b.review.umpires_call", "b.review.type")
    rp = balls.select("delivery_id", "match_id", F.inline("b.replacements.match")).select("delivery_id", "match_id", F.lit("match").alias("scope"), "team", F.col("in").alias("player_in"), F.col("out").alias("player_out"), "reason")
    pp = inn.select("match_id", "innings_no", F.inline("v.powerplays")).select("match_id", "innings_no", F.col("from").alias("from_over"), F.col("to").alias("to_over"), "type")
    out = {"matches": matches, "players_in_match": xi, "innings": innings, "deliveries": balls, "wickets": wickets, "wicket_fielders": fielders, "reviews": rv, "replacements": rp, "powerplays": pp}
    return {name: _typed(df, name) for name, df in out.items()}


def to_documents(tables) -> DataFrame:
    """Canonical tables back to one nested JSON document per match; a match's balls are bounded by its innings."""
    wk = tables["wickets"].join(tables["wicket_fielders"].groupBy("delivery_id", "wicket_idx").agg(F.sort_array(F.collect_list(F.struct("fielder_idx", F.col("fielder").alias("name"), "substitute"))).alias("f")),
                                ["delivery_id", "wicket_idx"], "left")
    wk = wk.groupBy("match_id", "delivery_id").agg(F.sort_array(F.collect_list(F.struct("wicket_idx", "player_out", "kind", "f"))).alias("w"))
    d = tables["deliveries"].join(wk, ["match_id", "delivery_id"], "left").select(
        "match_id", "innings_no", "over", "seq", F.struct(
            "batter", "bowler", "non_striker", F.struct(F.col("runs_batter").alias("batter"), F.col("runs_extras").alias("extras"), F.col("runs_total").alias("total")).alias("runs"),
            F.struct("wides", "noballs", "byes", "legbyes", "penalty").alias("extras"),
            F.transform("w", lambda x: F.struct(x["player_out"].alias("player_out"), x["kind"].alias("kind"), F.transform(x["f"], lambda y: F.struct(y["name"].alias("name"), y["substitute"].alias("substitute"))).alias("fielders"))).alias("wickets")).alias("b"))
    over = d.groupBy("match_id", "innings_no", "over").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "b"))), lambda x: x["b"]).alias("deliveries"))
    inn = over.groupBy("match_id", "innings_no").agg(F.sort_array(F.collect_list(F.struct("over", "deliveries"))).alias("overs")).join(
        tables["innings"].select("match_id", "innings_no", F.col("batting_team").alias("team")), ["match_id", "innings_no"])
    inn = inn.groupBy("match_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("innings_no", "team", "overs"))), lambda x: F.struct(x["team"].alias("team"), x["overs"].alias("overs"))).alias("innings"))
    side = tables["players_in_match"].groupBy("match_id", "team").agg(F.sort_array(F.collect_list("name")).alias("names")).groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("team", "names"))).alias("players"))
    reg = tables["players_in_match"].groupBy("match_id").agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("name", "person_id")))).alias("people"))
    m = tables["matches"].join(inn, "match_id").join(side, "match_id").join(reg, "match_id")
    info = F.struct("balls_per_over", "city", F.array(F.col("start_date").cast("string")).alias("dates"), "gender", "match_type", F.col("scheduled_overs").alias("overs"), "season", "team_type",
                    F.array("team1", "team2").alias("teams"), "venue", "players", F.struct("people").alias("registry"), F.struct(F.col("competition").alias("name"), F.col("event_stage").alias("stage")).alias("event"),
                    F.struct("winner", F.struct(F.col("win_by_runs").alias("runs"), F.col("win_by_wickets").alias("wickets")).alias("by"), "result", "method").alias("outcome"))
    doc = F.to_json(F.struct(F.struct(F.lit("1.1").alias("data_version")).alias("meta"), info.alias("info"), "innings"))
    return m.select(F.concat("match_id", F.lit(".json")).alias("source_ref"), doc.alias("content")).withColumn("sha256", F.sha2("content", 256))
