"""Names, codes and thresholds the results depend on.

Nothing here is logic. Each block is a plain list that must stay as it is for
results to agree with the published panel; callers may pass their own values.
"""

from __future__ import annotations

# Columns known before anything is played (who, when, against whom).
IDENTITY = [
    "season", "name", "element", "code", "id", "position", "team", "round", "GW",
    "fixture", "opponent_team", "was_home", "kickoff_time", "kickoff_time_formatted",
    "modified", "provenance",
]

# Columns whose value exists before the deadline of the period.
PRE_DEADLINE = [
    "value", "selected", "transfers_in", "transfers_out", "transfers_balance", "xP",
    "loaned_in", "loaned_out", "status", "chance_of_playing", "news",
]

# Columns that only exist once the period is over.
OUTCOME = [
    "minutes", "starts", "goals_scored", "assists", "own_goals", "penalties_missed",
    "penalties_saved", "yellow_cards", "red_cards", "saves", "clean_sheets",
    "goals_conceded", "winning_goals", "total_points", "bonus", "bps", "influence",
    "creativity", "threat", "ict_index", "ea_index", "expected_goals",
    "expected_assists", "expected_goal_involvements", "expected_goals_conceded",
    "team_h_score", "team_a_score", "defensive_contribution", "tackles", "recoveries",
    "clearances_blocks_interceptions", "mng_win", "mng_draw", "mng_loss",
    "mng_clean_sheets", "mng_goals_scored", "mng_underdog_win", "mng_underdog_draw",
    "attempted_passes", "completed_passes", "key_passes", "big_chances_created",
    "big_chances_missed", "dribbles", "fouls", "offside", "open_play_crosses",
    "penalties_conceded", "tackled", "target_missed", "errors_leading_to_goal",
    "errors_leading_to_goal_attempt",
]

# Raw string columns that cleaning turns into doubles.
NUMERIC = [
    "round", "minutes", "total_points", "value", "selected", "transfers_in",
    "transfers_out", "transfers_balance", "xP", "goals_scored", "assists",
    "clean_sheets", "goals_conceded", "bonus", "bps",
]

# Group codes. Rows of the dropped code follow other scoring rules.
DROPPED_GROUPS = ["AM"]
GROUP_RECODES = {"GKP": "GK"}

# Fields taken from one history entry of a per-entity document.
HISTORY_FIELDS = [
    "round", "minutes", "total_points", "value", "selected", "transfers_in",
    "transfers_out", "transfers_balance", "opponent_team", "was_home", "goals_scored",
    "assists", "clean_sheets", "goals_conceded", "own_goals", "penalties_saved",
    "penalties_missed", "yellow_cards", "red_cards", "saves", "bonus", "bps",
    "influence", "creativity", "threat", "ict_index", "expected_goals",
    "expected_assists", "expected_goal_involvements", "expected_goals_conceded",
    "defensive_contribution", "tackles", "recoveries",
    "clearances_blocks_interceptions", "starts", "kickoff_time",
]

# Layout of a vendored season folder and of a capture run folder.
PERIOD_FILE = "gws/merged_gw.csv"
BRIDGE_FILE = "players_raw.csv"
SEASON_FILES = ["gws/merged_gw.csv", "fixtures.csv", "teams.csv", "players_raw.csv"]
BOOTSTRAP_FILE = "bootstrap-static.json.gz"
SUMMARY_FILES = "element-summary/*.json.gz"
MANIFEST_FILE = "manifest.json"

# What was unusual about a season.
SEASON_NOTES = {
    "2019-20": "COVID: suspended March-June, restarted behind closed doors",
    "2020-21": "COVID: behind closed doors throughout, condensed calendar",
    "2022-23": "World Cup mid-season break, November-December",
    "2025-26": "Defensive-contribution scoring introduced",
    "2026-27": "Defensive-contribution scoring; season in progress",
}

# Letters that have no canonical decomposition, and what replaces them.
UNDECOMPOSED_LETTERS = {
    "đ": "d", "ð": "d", "ł": "l", "ø": "o", "þ": "th", "æ": "ae", "œ": "oe", "ß": "ss",
    "ı": "i",
}

# Column order of a logged prediction.
PREDICTION_COLUMNS = ["code", "name", "position", "team", "value", "prediction", "rank"]

# Thresholds.
FULL_EXPOSURE = 90.0
STARTED_EXPOSURE = 60
PRICE_BUCKETS = 10
MIN_FIT_ROWS = 200
MIN_ENTITY_PERIODS = 5
MIN_FIT_ENTITIES = 5
FALLBACK_STRENGTH = 10.0
MIN_BETWEEN = 1e-6
FIRST_SCORED_PERIOD = 6
MIN_GROUP = 5
TOP_K = 20
REPORTED_DISAGREEMENTS = 50
