"""Report runners and ad-hoc SQL. The scoreboard that every report reads is written once
by ``plans/pipeline.py`` (see ``plans/versions.py``)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

from huddle.operators import headtohead as h2h
from huddle.operators import leaderboards as lb
from huddle.operators import luck as lk

SCOREBOARD_VIEW = "matchups"
RAW_VIEW = "matchups_raw"


def adhoc(spark: SparkSession, sql: str, scoreboard: DataFrame | None = None,
          raw: DataFrame | None = None) -> DataFrame | None:
    """Run any SQL over the scoreboard view ``matchups`` (and ``matchups_raw``,
    the team-weeks before the win flag, when given).

    Returns the lazy result, or ``None`` when the statement does not parse or
    resolve (errors raised while executing surface when the caller acts).
    """
    if scoreboard is not None:
        scoreboard.createOrReplaceTempView(SCOREBOARD_VIEW)
    if raw is not None:
        raw.createOrReplaceTempView(RAW_VIEW)
    try:
        return spark.sql(sql)
    except AnalysisException as exc:  # includes parse errors
        print(f"Error executing query: {exc}")
        return None


def run_season_stats(m_rank: DataFrame, n: int = 10, per_league: bool = True) -> dict[str, DataFrame]:
    """The eight season stats over a ``rank``-rule scoreboard, all rows."""
    return {
        "most_high_weeks_list": lb.most_high_weeks_list(m_rank),
        "top_scores_all": lb.top_scores_all(m_rank, n, per_league),
        "most_low_weeks_list": lb.most_low_weeks_list(m_rank),
        "low_scores_all": lb.low_scores_all(m_rank, n, per_league),
        "own_low_wins": lb.own_low_wins(m_rank),
        "own_high_losses": lb.own_high_losses(m_rank),
        "win_points_profile": lb.win_points_profile(m_rank),
        "loss_points_profile": lb.loss_points_profile(m_rank),
    }


def run_report(m: DataFrame, weeks=(1, 14), n: int = 10, per_league: bool = True) -> dict[str, DataFrame]:
    """The weekly report over a ``beats``-rule scoreboard, completed weeks."""
    return {
        "standings": lb.standings(m, weeks),
        "top_scores": lb.top_scores(m, n, per_league, weeks),
        "low_scores": lb.low_scores(m, n, per_league, weeks),
        "consistency": lb.consistency(m, weeks),
        "high_week_counts": lb.high_week_counts(m, weeks),
        "low_week_counts": lb.low_week_counts(m, weeks),
        "wins_vs_low_opp": h2h.wins_vs_low_opp(m, weeks),
        "losses_vs_high_opp": h2h.losses_vs_high_opp(m, weeks),
        "avg_points_in_wins": lb.avg_points_in_wins(m, weeks),
        "avg_points_in_losses": lb.avg_points_in_losses(m, weeks),
        "avg_margin": h2h.avg_margin(m, weeks),
        "dominant_wins": h2h.dominant_wins(m, n, per_league, weeks),
        "closest_matchups": h2h.closest_matchups(m, n, per_league, weeks),
        "volatility": h2h.volatility(m, weeks),
        "head_to_head": h2h.head_to_head(m, weeks),
        "luck": lk.luck(m, weeks),
    }


def run_draft_report(picks: DataFrame, players: DataFrame, totals: DataFrame,
                     draft_rosters: DataFrame, users: DataFrame, n: int = 10,
                     per_league: bool = True,
                     enriched: DataFrame | None = None) -> dict[str, DataFrame]:
    """The six draft-value reports. With ``enriched`` (the output of
    ``draft.enrich_picks``, e.g. written bucketed by league) all six derive from
    that one table instead of joining the inputs again per report."""
    from huddle.operators import draft as dr
    if enriched is None:
        return {
            "late_round_steals": dr.late_round_steals(picks, players, totals, draft_rosters,
                                                      users, n, per_league),
            "bracket_averages": dr.bracket_averages(picks, players, totals),
            "positional_performance": dr.positional_performance(picks, players, totals),
            "worst_value_picks": dr.worst_value_picks(picks, players, totals, draft_rosters,
                                                      users, n, per_league),
            "biggest_busts": dr.biggest_busts(picks, players, totals, draft_rosters, users, n,
                                              per_league),
            "skill_steals": dr.skill_steals(picks, players, totals, draft_rosters, users, n,
                                            per_league),
        }
    e = enriched
    return {
        "late_round_steals": dr.steals_from(e, n, per_league),
        "bracket_averages": dr.bracket_averages_from(e),
        "positional_performance": dr.positional_performance_from(e),
        "worst_value_picks": dr.worst_value_picks_from(e, n, per_league),
        "biggest_busts": dr.biggest_busts_from(e, n, per_league),
        "skill_steals": dr.steals_from(e, n, per_league, skill_only=True),
    }
