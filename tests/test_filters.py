import pytest

from inswing.plans.filters import Filters, require_supported, team_names


def test_unknown_key_is_rejected():
    with pytest.raises(ValueError):
        Filters.parse({"pitch": "dry"})


def test_values_are_coerced_and_blanks_are_inactive():
    f = Filters.parse({"year_from": "2019", "chasing": "true", "phase": "all", "competition": "", "rrr_from": "7"})
    assert f.active() == {"year_from": 2019, "chasing": True, "rrr_from": 7.0}
    assert f.has_ball_level()


def test_match_level_only(spark):
    assert not Filters(format="T20").has_ball_level()
    assert len(Filters(format="T20", phase="death").conditions(ball_level=False)) == 1


def test_renamed_team_matches_under_both_names():
    assert team_names("Punjab Kings") == team_names("Kings XI Punjab") == ["Kings XI Punjab", "Punjab Kings"]


def test_unsupported_filter_is_refused():
    with pytest.raises(ValueError):
        require_supported(Filters(phase="death"), frozenset({"format"}))
