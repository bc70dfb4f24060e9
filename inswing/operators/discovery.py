"""Unusual patterns, per-player index tables, edges and token search."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from inswing.functions.columns import ranked, ratio
from inswing.functions.stats import Z90, benjamini_hochberg, binomial_tail, mean_diff, poisson_tail, two_sided
from inswing.plans.filters import major
from inswing.plans.workspace import Workspace


def c(name: str) -> Column:
    return F.col(name)


def _n(test: str) -> Column:
    return F.count_if(F.expr(test))


def matchup_candidates(ws: Workspace, min_pair: int = 60, min_batter: int = 500, min_outs: int = 4, excess: float = 2.2) -> DataFrame:
    """Battles with far more dismissals than the batter's usual rate predicts, or scoring far above it at little cost."""
    r = c("runs_batter").cast("long")
    b = ws["balls"].filter(major("batting_team", "bowling_team"))
    keys = ["batter_id", "format_group", "gender"]

    def sums(*by: str) -> DataFrame:
        return b.groupBy(*by).agg(_n("faced").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("q"), _n("striker_credited").alias("outs"), F.max("start_date").alias("last_date"),
                                  F.countDistinct("match_id").alias("matches"))
    usual = sums(*keys).select(*keys, *[c(x).alias(f"b_{x}") for x in ("n", "s", "q", "outs")]).filter(c("b_n") >= min_batter)
    p = sums(*keys, "bowler_id").filter(c("n") >= min_pair).join(usual, keys).withColumn("expected", c("n") * c("b_outs") / c("b_n"))
    p = p.withColumn("z", mean_diff("s", "q", "n", "b_s", "b_q", "b_n")).withColumn("tail", poisson_tail("outs", "expected"))
    many = (c("outs") >= min_outs) & (c("outs") >= excess * c("expected"))
    fast = (c("z.diff") > 0) & (c("z.p") < 0.0027) & (c("outs") <= F.greatest(F.lit(1.0), c("expected") * 0.5)) & (c("n") >= 1.5 * min_pair)
    return p.withColumn("what", F.when(many, "dismissals").when(fast, "scoring")).filter("what is not null").withColumn("p", F.when(many, c("tail")).otherwise(c("z.p"))).drop("z", "tail")


ROUTES = ("BOWLED", "LBW", "CAUGHT_KEEPER", "STUMPED", "RUN_OUT", "CAUGHT_BOWLER")  # fixed values: routes that say something about a batter


def route_candidates(ws: Workspace, min_outs: int = 30, min_route: int = 6, ratio_min: float = 1.8) -> DataFrame:
    """Players who get out one way far more often than batters at positions 1 to 7 do (binomial tail against their share)."""
    d = ws["dis"].filter("counts_as_dismissal").filter(major("batting_team", "bowling_team"))
    pool = d.filter("batter_position <= 7").groupBy("gender", "format_group", "route").agg(F.count("*").alias("pk"))
    pool = pool.withColumn("share", c("pk") / F.sum("pk").over(Window.partitionBy("gender", "format_group")))
    rows = d.groupBy("player_out_id", "gender", "format_group", "route").agg(F.count("*").alias("k"))
    rows = rows.withColumn("n", F.sum("k").over(Window.partitionBy("player_out_id", "format_group")))
    j = rows.filter(c("route").isin(*ROUTES) & (c("n") >= min_outs) & (c("k") >= min_route)).join(pool, ["gender", "format_group", "route"])
    return j.filter(c("k") / c("n") >= ratio_min * c("share")).withColumn("p", binomial_tail("k", "n", "share"))


def partnership_candidates(ws: Workspace, min_stands: int = 15, min_balls: int = 500, lift: float = 1.8) -> DataFrame:
    """Pairs whose runs per broken stand are far above those of all stands of the format and gender.

    Stands are about exponential, so the mean of w of them has a deviation of mean / sqrt(w)."""
    keys = ["format_group", "gender"]
    sums = [F.sum("runs").alias("runs"), F.count_if(c("ended") == "wicket").alias("w")]
    rows = ws["partnerships"].filter(major("batting_team", "bowling_team"))
    usual = rows.groupBy(*keys).agg(*sums).select(*keys, (c("runs") / c("w")).alias("typical"))
    p = rows.groupBy(*keys, "p1", "p2").agg(*sums, F.count("*").alias("stands"), F.sum("balls").alias("balls")).filter((c("stands") >= min_stands) & (c("balls") >= min_balls))
    p = p.join(usual, keys).withColumn("w1", F.greatest("w", F.lit(1))).withColumn("average", c("runs") / c("w1"))
    z = (c("average") - c("typical")) / (c("typical") / F.sqrt("w1"))
    return p.filter(c("average") >= lift * c("typical")).withColumn("p", two_sided(z))


def years(ws: Workspace, since: int) -> DataFrame:
    """Balls, runs and squared runs of each batter's years, with the sums of the three years before."""
    r = c("runs_batter").cast("long")
    b = ws["balls"].filter("faced").filter(major("batting_team", "bowling_team")).filter(c("year") >= since)
    y = b.groupBy("batter_id", "format_group", "gender", "year").agg(F.count("*").alias("n"), F.sum(r).alias("s"), F.sum(r * r).alias("q"))
    w = Window.partitionBy("batter_id", "format_group", "gender").orderBy("year").rangeBetween(-3, -1)
    return y.withColumns({f"{x}_past": F.sum(x).over(w) for x in ("n", "s", "q")})


def year_candidates(ws: Workspace, min_balls: int = 150, min_past: int = 400, z_min: float = 2.5, d_min: float = 0.12, since: int = 2021) -> DataFrame:
    """A batter's latest year, or the one before where the latest is short, against the three before it, if the change is large and clear."""
    y = years(ws, since)
    latest = y.agg(F.max("year").alias("latest"))
    enough = y.join(F.broadcast(latest), c("year") >= c("latest") - 1).filter(c("n") >= min_balls)  # one row
    now = ranked(enough, ["batter_id", "format_group", "gender"], [F.desc("year")], 1, "pick").filter(c("n_past") >= min_past)
    out = now.select("*", F.inline(F.array(mean_diff("s", "q", "n", "s_past", "q_past", "n_past")))).withColumn("change", 100 * c("diff"))
    half = (c("hi") - c("lo")) / 2  # Z90 standard errors
    return out.filter((F.abs("diff") * Z90 >= z_min * half) & (F.abs("diff") >= d_min))


def within_reach(ws: Workspace, competitions: tuple[str, ...], gap: float = 0.08, places: int = 6) -> DataFrame:
    """Batters ranked second to sixth in runs or sixes of a competition that is covered in full, close behind the leader and active in its latest season."""
    b = ws["balls"].filter(c("competition").isin(*competitions))
    per = b.groupBy("competition", c("batter_id").alias("person_id")).agg(F.sum("runs_batter").alias("runs"), F.count_if("is_six").alias("sixes"), F.max("year").alias("last"))
    rows = per.select("competition", "person_id", "last", F.inline(F.array(*[F.struct(F.lit(x).alias("what"), c(x).cast("long").alias("v")) for x in ("runs", "sixes")])))
    latest = b.groupBy("competition").agg(F.max("year").alias("latest"))
    lead = rows.groupBy("competition", "what").agg(F.max("v").alias("lead"))
    best = ranked(rows, ["competition", "what"], [F.desc("v"), F.asc("person_id")], places).join(lead, ["competition", "what"]).join(latest, "competition")
    return best.filter((c("last") == c("latest")) & (c("v") < c("lead")) & (c("lead") - c("v") <= gap * c("lead")))


def did_not_know(rows: DataFrame, keys: list[str], q: float = 0.01) -> DataFrame:
    """Candidates that survive false-discovery control within their type."""
    return benjamini_hochberg(rows, keys, "p", q).filter("passed")


def player_index(ws: Workspace) -> DataFrame:
    """Best three innings, best two spells and first four partners of every player, as rows of one table."""
    inn = ranked(ws["bat_innings"].withColumn("key", F.concat_ws("|", "match_id", "innings_no")), ["batter_id"], [F.desc("runs"), F.asc("balls"), F.asc("key")], 3).select(
        c("batter_id").alias("person_id"), F.lit("innings").alias("what"), "rank", "key")
    sp = ranked(ws["bowl_innings"].withColumn("key", F.concat_ws("|", "match_id", "innings_no")), ["bowler_id"], [F.desc("wickets"), F.asc("runs"), F.asc("key")], 2).select(
        c("bowler_id").alias("person_id"), F.lit("spell").alias("what"), "rank", "key")
    both = ws["partnerships"].select("runs", F.inline(F.array(F.struct(c("p1").alias("person_id"), c("p2").alias("key")), F.struct(c("p2").alias("person_id"), c("p1").alias("key")))))
    mates = ranked(both.groupBy("person_id", "key").agg(F.sum("runs").alias("r")), ["person_id"], [F.desc("r"), F.asc("key")], 4).select("person_id", F.lit("partner").alias("what"), "rank", "key")
    return inn.unionByName(sp).unionByName(mates)


def edges(ws: Workspace) -> DataFrame:
    """Typed neighbours in one schema: players, battles, innings, spells, deliveries, competitions, rivalries, partnerships and teams."""
    def edge(df: DataFrame, st: str, sk, relation: str, dt: str, dk, rank=None) -> DataFrame:
        return df.select(F.lit(st).alias("src_type"), sk.alias("src_key"), F.lit(relation).alias("relation"), F.lit(dt).alias("dst_type"), dk.alias("dst_key"),
                         (F.lit(1) if rank is None else c("rank")).cast("int").alias("rank"))
    k = lambda *x: F.concat_ws("|", *x)
    pi = player_index(ws)
    parts = [edge(pi.filter("what = 'innings'"), "player", c("person_id"), "best innings", "innings", k("key", "person_id"), True),
             edge(pi.filter("what = 'spell'"), "player", c("person_id"), "best spell", "spell", k("key", "person_id"), True),
             edge(pi.filter("what = 'partner'"), "player", c("person_id"), "partner", "player", c("key"), True)]
    foe = ranked(ws["battles"].filter("outs > 0"), ["batter_id"], [F.desc("outs"), F.asc("balls"), F.asc("bowler_id")], 3)
    parts.append(edge(foe, "player", c("batter_id"), "dismissed by", "battle", k("batter_id", "bowler_id"), True))
    parts += [edge(ws["battles"], "battle", k("batter_id", "bowler_id"), "player", "player", c(x)) for x in ("batter_id", "bowler_id")]
    inn, sp = ws["bat_innings"], ws["bowl_innings"]
    parts += [edge(inn, "innings", k("match_id", "innings_no", "batter_id"), "match", "match", c("match_id")), edge(inn, "innings", k("match_id", "innings_no", "batter_id"), "player", "player", c("batter_id")),
              edge(inn.filter("out_bowler_id is not null"), "innings", k("match_id", "innings_no", "batter_id"), "dismissed by", "player", c("out_bowler_id")),
              edge(sp, "spell", k("match_id", "innings_no", "bowler_id"), "match", "match", c("match_id")), edge(sp, "spell", k("match_id", "innings_no", "bowler_id"), "player", "player", c("bowler_id"))]
    top = ranked(inn, ["match_id"], [F.desc("runs"), F.asc("balls"), F.asc("innings_no"), F.asc("batter_id")], 3)
    parts.append(edge(top, "match", c("match_id"), "top innings", "innings", k("match_id", "innings_no", "batter_id"), True))
    d = ws["dis"]
    parts += [edge(d, "delivery", c("delivery_id"), "battle", "battle", k("batter_id", "bowler_id")), edge(d, "delivery", c("delivery_id"), "match", "match", c("match_id"))]
    fin = ws["team_results"].filter("event_stage = 'Final' and competition is not null")
    parts.append(edge(fin, "competition", k("competition", "gender"), "final", "match", c("match_id")))
    t = ws["team_results"]
    last = ranked(t, ["ta", "tb", "gender"], [F.desc("start_date"), F.asc("match_id")], 1)
    parts.append(edge(last, "rivalry", k("ta", "tb", "gender"), "latest match", "match", c("match_id"), True))
    stand = ranked(ws["partnerships"], ["p1", "p2"], [F.desc("runs"), F.asc("balls"), F.asc("partnership_id")], 1)
    parts.append(edge(stand, "partnership", k("p1", "p2"), "biggest stand", "match", c("match_id"), True))
    parts += [edge(ws["partnerships"].select("p1", "p2").distinct(), "partnership", k("p1", "p2"), "player", "player", c(x)) for x in ("p1", "p2")]
    rv = t.select("gender", F.inline(F.array(F.struct(c("ta").alias("team"), c("tb").alias("o")), F.struct(c("tb").alias("team"), c("ta").alias("o"))))).groupBy("team", "o", "gender").agg(F.count("*").alias("n"))
    rv = ranked(rv, ["team", "gender"], [F.desc("n"), F.asc("o")], 3)
    parts.append(edge(rv, "team", k("team", "gender"), "rivalry", "rivalry", k(F.least("team", "o"), F.greatest("team", "o"), "gender"), True))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tension(ws: Workspace) -> DataFrame:
    """The ball of each innings before which most was at stake: the last 24 balls of a chase, more so when about 1.4 runs a ball
    are needed; a batter within six of a fifty or a hundred; the death overs."""
    needed = c("runs_required") / c("balls_left")
    finish = F.when(c("chasing") & c("balls_left").between(1, 24) & (c("runs_required") > 0), 3 + F.greatest(F.lit(0.0), 2 - 2 * F.abs(needed - 1.4))).otherwise(0.0)
    milestone = F.when(c("batter_runs_before").between(44, 49) | c("batter_runs_before").between(94, 99), 2.5).otherwise(0.0)
    score = finish + milestone + F.when(c("phase") == "death", 1.0).otherwise(0.0)
    return ws["balls"].withColumn("tension", F.round(score, 9)).groupBy("match_id", "innings_no").agg(F.max(F.struct("tension", "seq", "delivery_id")).alias("x")).select(
        "match_id", "innings_no", "x.delivery_id", "x.tension")


# ---------------------------------------------------------------- search

TOKEN = r"[a-z0-9'*/.-]+"
STOP = ("the", "a", "an", "of", "in", "on", "at", "to", "for", "and", "v", "vs", "by", "is", "was", "with")  # fixed values


def tokens(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))), F.array(*[F.lit(s) for s in STOP]))


def search_rows(ws: Workspace) -> DataFrame:
    """(token, entity) rows of players, teams, competitions and matches, weighted by how much play stands behind each."""
    p = ws["player_profile"].select(F.lit("player").alias("kind"), c("person_id").alias("key"), F.array_join("aliases", " ").alias("text"), c("matches").alias("weight"))
    t = ws["team_results"]
    teams = t.select(F.explode(F.array("ta", "tb")).alias("key")).groupBy("key").agg(F.count("*").alias("weight")).select(F.lit("team").alias("kind"), "key", c("key").alias("text"), "weight")
    comp = t.filter("competition is not null").groupBy(c("competition").alias("key")).agg(F.count("*").alias("weight")).select(F.lit("competition").alias("kind"), "key", c("key").alias("text"), "weight")
    match = t.select(F.lit("match").alias("kind"), c("match_id").alias("key"), F.concat_ws(" ", "team1", "team2", "season", "venue").alias("text"), F.lit(1).cast("long").alias("weight"))
    docs = p.unionByName(teams).unionByName(comp).unionByName(match)
    return docs.select("kind", "key", "weight", F.explode(tokens(c("text"))).alias("token"))


def search(queries: DataFrame, rows: DataFrame, k: int = 5) -> DataFrame:
    """Queries (query_id, text) against the token rows: exact 1.0, prefix of three letters and more 0.75; all tokens or all but one must hit.

    A prefix joins on its first three letters, so candidates meet by key and not by scanning every token.
    """
    q = queries.select("query_id", tokens(c("text")).alias("ts")).select("query_id", F.size("ts").alias("need"), F.explode("ts").alias("q"))
    exact = q.join(rows, c("q") == c("token")).select("query_id", "need", "q", "kind", "key", "weight", F.lit(1.0).alias("s"))
    stem = rows.withColumn("stem", F.substring("token", 1, 3))
    pre = q.filter(F.length("q") >= 3).withColumn("stem", F.substring("q", 1, 3)).join(stem, "stem").filter(F.col("token").startswith(F.col("q")) & (c("token") != c("q"))).select(
        "query_id", "need", "q", "kind", "key", "weight", F.lit(0.75).alias("s"))
    hit = exact.unionByName(pre).groupBy("query_id", "need", "kind", "key", "q").agg(F.max("s").alias("s"), F.max("weight").alias("weight"))
    g = hit.groupBy("query_id", "need", "kind", "key").agg(F.count("*").alias("found"), F.sum("s").alias("total"), F.max("weight").alias("weight"))
    g = g.filter(c("found") >= F.greatest(F.lit(1), c("need") - F.when(c("need") >= 3, 1).otherwise(0))).withColumn("score", c("total") / c("need") + F.log10(1.0 + c("weight")) / 10)
    return ranked(g, ["query_id", "kind"], [F.desc(F.round("score", 9)), F.asc("key")], k)


def alias_resolution(ws: Workspace, clear: float = 3.0) -> DataFrame:
    """The best-known bearer of each last name; ambiguous unless it has `clear` times the matches of the second."""
    bearers = ws["player_profile"].select(F.element_at(F.split("name", " "), -1).alias("alias"), "person_id", "matches")
    two = ranked(bearers, ["alias"], [F.desc("matches"), F.desc("person_id")], 2)
    first, second = c("rank") == 1, c("rank") == 2
    return two.groupBy("alias").agg(F.max(F.when(first, c("person_id"))).alias("person_id"), F.coalesce(
        F.max(F.when(first, c("matches"))) < clear * F.max(F.when(second, c("matches"))), F.lit(False)).alias("ambiguous"))
