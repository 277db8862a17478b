"""Fixed values that must equal the reference's for equal results."""

# --- fixed values (reference semantics) -------------------------------------
ROLLING_WINDOW = 10          # previous games in a team's form window
MIN_PERIODS = 3              # non-null games needed before a rolling value exists

FEATURE_COLS = [
    "h_roll_scored", "h_roll_conceded",
    "a_roll_scored", "a_roll_conceded",
    "comb_scoring", "comb_conceded",
    "h_roll_shots_ot", "a_roll_shots_ot", "comb_shots_ot",
    "h_roll_corners", "a_roll_corners",
    "h_roll_over25", "a_roll_over25", "comb_over25",
    "h_roll_btts", "a_roll_btts",
    "home_adv_score", "shot_ratio",
    "league_enc",
]
ODDS_FEATURE_COLS = ["ip_avg_over25", "ip_b365_over25", "ip_avg_home", "ip_avg_draw"]
TARGET_COLS = ["target_over25", "target_btts", "target_home_win", "target_draw", "target_away_win"]
TRAIN_ID_COLS = ["match_id", "match_date", "competition", "home_team", "away_team"]
LIVE_ID_COLS = ["match_id", "match_date", "home_team", "away_team"]

DEFAULT_ODDS = (2.10, 3.20, 3.40)                       # home, draw, away
BOOKMAKER_WHITELIST = ["sportybet", "onexbet", "bet365", "betway"]
H2H_MARKET = "h2h"
DRAW_OUTCOME = "Draw"
FINISHED_SHORT_CODES = ["FT", "AET", "PEN"]
DEFAULT_KICKOFF = "15:00"
UNKNOWN_LEAGUE = "Unknown League"

HIGH_CONF_THRESHOLD = 0.62
CONFIDENCE_TIERS = [0.55, 0.60, 0.65, 0.70]
MIN_TIER_ROWS = 30
MIN_TRAIN_ROWS = 50
MIN_BACKTEST_ROWS = 5
CV_FOLDS = 5
SEED = 42

FOREST_PARAMS = dict(num_trees=300, max_depth=10, min_leaf=5)
LOGIT_C = 0.5
LOGIT_MAX_ITER = 1000

DIGEST_BRAND = "Pitchside"          # our own label; the brand text is a parameter
DIGEST_HEADER = "⚽ *{brand} Daily Picks* ⚽\n\n"
DIGEST_FOOTER = "_Automated forecast · {brand} ML pipeline_"
DIGEST_SLOTS = 3
DIGEST_EMPTY_SLOT = "—"
ONELINE_LIMIT = 900
ONELINE_KEEP = 880
