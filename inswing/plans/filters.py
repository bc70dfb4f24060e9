"""Typed filter grammar over balls, dismissals and per-innings tables.

Match-level keys hold for any table with match columns; ball-level keys need the ball. Unknown keys are rejected.
"""
from __future__ import annotations

from dataclasses import asdict, dataclass, fields
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from inswing.schema import FULL_MEMBERS, TEAM_RENAMES

MATCH_LEVEL = frozenset("format team_type competition year_from year_to opposition gender full_members team before_date".split())
BALL_EQUAL = "phase bowler_family bowler_arm bowler_style bowler_id batter_id chase_state batter_stage non_striker_id".split()
BALL_BOUNDS = {
    "over_from": ("over", ">=", -1), "over_to": ("over", "<=", -1),  # overs are counted from 1 by the caller
    "wk_from": ("wickets_before", ">=", 0), "wk_to": ("wickets_before", "<=", 0),
    "faced_from": ("batter_balls_before", ">=", 0), "faced_to": ("batter_balls_before", "<=", 0),
    "rrr_from": ("required_rate", ">=", 0), "innings_no": ("innings_no", "=", 0),
}
BALL_LEVEL = frozenset(BALL_EQUAL) | frozenset(BALL_BOUNDS) | {"chasing"}
WHOLE = frozenset("year_from year_to over_from over_to wk_from wk_to faced_from faced_to innings_no".split())
TRUTH = frozenset({"chasing", "full_members"})
SIDES = {"batter": ("batting_team", "bowling_team"), "bowler": ("bowling_team", "batting_team"),
         "library": ("team", "opponent")}


def team_names(team: str) -> list[str]:
    """A team under its current and former names."""
    now = TEAM_RENAMES.get(team, team)
    return sorted({now, team} | {old for old, new in TEAM_RENAMES.items() if new == now})


def major(a: str, b: str) -> Column:
    """Leagues, plus internationals between full members."""
    both = F.col(a).isin(*FULL_MEMBERS) & F.col(b).isin(*FULL_MEMBERS)
    return (F.col("team_type") == "club") | both


@dataclass(frozen=True)
class Filters:
    format: str | None = None
    team_type: str | None = None
    competition: str | None = None
    year_from: int | None = None
    year_to: int | None = None
    opposition: str | None = None
    team: str | None = None
    gender: str | None = None
    full_members: bool | None = None
    before_date: str | None = None
    phase: str | None = None
    bowler_family: str | None = None
    bowler_arm: str | None = None
    bowler_style: str | None = None
    chasing: bool | None = None
    bowler_id: str | None = None
    batter_id: str | None = None
    over_from: int | None = None
    over_to: int | None = None
    wk_from: int | None = None
    wk_to: int | None = None
    faced_from: int | None = None
    faced_to: int | None = None
    rrr_from: float | None = None
    innings_no: int | None = None
    chase_state: str | None = None
    batter_stage: str | None = None
    non_striker_id: str | None = None

    @classmethod
    def parse(cls, given: dict) -> "Filters":
        extra = set(given) - {f.name for f in fields(cls)}
        if extra:
            raise ValueError(f"unknown filters: {', '.join(sorted(extra))}")
        values = {}
        for key, value in given.items():
            if value is None or value == "" or value == "all":
                continue
            if key in WHOLE:
                value = int(value)
            elif key == "rrr_from":
                value = float(value)
            elif key in TRUTH:
                value = value is True or str(value).lower() in ("true", "1")
            values[key] = value
        return cls(**values)

    def active(self) -> dict:
        return {k: v for k, v in asdict(self).items() if v is not None}

    def has_ball_level(self) -> bool:
        return not BALL_LEVEL.isdisjoint(self.active())

    def conditions(self, perspective: str = "batter", ball_level: bool = True) -> list[Column]:
        on = self.active()
        own, other = SIDES[perspective]
        tests = []
        for key, col in (("format", "format_group"), ("team_type", "team_type"), ("competition", "competition"),
                         ("gender", "gender")):
            if key in on:
                tests.append(F.col(col) == on[key])
        if "year_from" in on:
            tests.append(F.col("year") >= on["year_from"])
        if "year_to" in on:
            tests.append(F.col("year") <= on["year_to"])
        if "before_date" in on:
            tests.append(F.col("start_date") < F.lit(str(on["before_date"])).cast("date"))
        if on.get("full_members"):
            tests.append(major(own, other))
        for key, col in (("team", own), ("opposition", other)):
            if key in on:
                tests.append(F.col(col).isin(*team_names(on[key])))
        if not ball_level:
            return tests
        tests += [F.col(k) == on[k] for k in BALL_EQUAL if k in on]
        if "chasing" in on:
            tests.append(F.coalesce("chasing", F.lit(False)) == on["chasing"])
        for key, (col, op, shift) in BALL_BOUNDS.items():
            if key in on:
                bound = on[key] + shift
                tests.append({">=": F.col(col) >= bound, "<=": F.col(col) <= bound, "=": F.col(col) == bound}[op])
        return tests

    def apply(self, df: DataFrame, perspective: str = "batter", ball_level: bool = True) -> DataFrame:
        tests = self.conditions(perspective, ball_level)
        return df.filter(reduce(and_, tests)) if tests else df


def require_supported(filters: Filters, allowed: frozenset[str]) -> Filters:
    """Refuse a question whose filters its answer would not honour."""
    extra = set(filters.active()) - allowed
    if extra:
        raise ValueError(f"filters not supported here: {', '.join(sorted(extra))}")
    return filters
