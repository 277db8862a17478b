"""Semantics on hand-made frames (FIXTURES.md §3) and brute-force properties."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from pitchside.operators import features as feat
from pitchside.operators import metrics as MT
from pitchside.operators import odds as O
from pitchside.operators import report as R
from pitchside.operators import upsert as U
from pitchside.operators.ranking import sequence_number
from pitchside.operators.rolling import prior_rolling_means
from pitchside.functions.columns import json_ascii
from pitchside.sources import payloads as P
from pitchside.sources.season_csv import parse_match_date

D0 = dt.date(2024, 1, 1)


def brute_roll(series, window=10, min_periods=3):
    """pandas shift(1).rolling(window, min_periods).mean() semantics, in plain Python."""
    out = []
    for i in range(len(series)):
        prev = series[max(0, i - window):i]
        vals = [v for v in prev if v is not None]
        out.append(sum(vals) / len(vals) if len(vals) >= min_periods else None)
    return out


def test_rolling_frame_nulls_and_min_periods(spark):
    scores = [1, 2, None, 0, 3, 1, 2, None, 4, 0, 1, 2]
    rows = [(i, D0 + dt.timedelta(days=7 * i), "A", float(s) if s is not None else None)
            for i, s in enumerate(scores)]
    df = spark.createDataFrame(rows, "match_id long, match_date date, team string, v double")
    for bucket in (None, F.floor(F.datediff("match_date", F.lit("1970-01-01")) / 14)):
        got = {r.match_id: r.roll_v for r in prior_rolling_means(
            df, key="team", order=[F.col("match_date"), F.col("match_id")], values=["v"],
            window=10, min_periods=3, bucket=bucket).collect()}
        want = brute_roll([float(s) if s is not None else None for s in scores])
        assert [got[i] for i in range(len(scores))] == want


def _random_sides(spark, n=600, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        team = "HOT" if rnd.random() < 0.35 else f"T{rnd.randint(0, 9)}"
        if rnd.random() < 0.03:
            team = None
        day = None if rnd.random() < 0.04 else D0 + dt.timedelta(days=rnd.randint(0, 60))
        v = None if rnd.random() < 0.15 else float(rnd.randint(0, 4))
        rows.append((i, day, team, 1, v))
    return spark.createDataFrame(rows, "match_id long, match_date date, team string, is_home int, v double")


@pytest.mark.parametrize("window,bucket_days", [(10, 1), (10, 7), (3, 2), (1, 5)])
def test_bucketed_window_equals_plain_window(spark, window, bucket_days):
    df = _random_sides(spark)
    order = feat.form_order()
    plain = prior_rolling_means(df, key="team", order=order, values=["v"], window=window, min_periods=1)
    bucketed = prior_rolling_means(df, key="team", order=order, values=["v"], window=window,
                                   min_periods=1, bucket=feat.form_bucket(bucket_days))
    a = sorted((r.match_id, r.roll_v) for r in plain.collect())
    b = sorted((r.match_id, r.roll_v) for r in bucketed.collect())
    assert a == b


def _matches(spark, rows):
    return spark.createDataFrame(rows, "match_id long, match_date date, competition string, home_team string, "
                                       "away_team string, home_score double, away_score double, status string")


def test_no_leakage_own_score_never_changes_own_features(spark):
    rnd = random.Random(3)
    teams = ["A", "B", "C", "D"]
    base = []
    for i in range(40):
        h, a = rnd.sample(teams, 2)
        base.append((i, D0 + dt.timedelta(days=i), "L", h, a, float(rnd.randint(0, 3)), float(rnd.randint(0, 3)),
                     "FINISHED"))
    changed = [r if r[0] != 25 else r[:5] + (9.0, 9.0, "FINISHED") for r in base]
    cols = ["h_roll_scored", "a_roll_scored", "h_roll_over25", "comb_conceded"]
    f1 = feat.team_form_features(_matches(spark, base)).filter("match_id = 25").select(*cols).collect()
    f2 = feat.team_form_features(_matches(spark, changed)).filter("match_id = 25").select(*cols).collect()
    assert f1 == f2


def test_scheduled_game_occupies_slot_and_counts_as_zero_indicator(spark):
    rows = [(i, D0 + dt.timedelta(days=i), "L", "A", f"X{i}", 3.0, 1.0, "FINISHED") for i in range(3)]
    rows.append((3, D0 + dt.timedelta(days=3), "L", "A", "X3", None, None, "SCHEDULED"))
    rows.append((4, D0 + dt.timedelta(days=4), "L", "A", "X4", 1.0, 1.0, "FINISHED"))
    f = {r.match_id: r for r in feat.team_form_features(_matches(spark, rows)).collect()}
    assert f[4].h_roll_scored == 3.0                 # the NULL game is skipped by the mean
    assert f[4].h_roll_over25 == 0.75                # ... but counts as "not over 2.5"


def test_league_codes_alphabetical_and_unknown(spark):
    rows = [(1, D0, "Zeta", "A", "B", 1.0, 0.0, "FINISHED"), (2, D0, "Alpha", "C", "D", 1.0, 0.0, "FINISHED"),
            (3, D0, None, "E", "F", 1.0, 0.0, "FINISHED")]
    got = {r.match_id: r.league_enc for r in feat.league_encode(_matches(spark, rows)).collect()}
    assert got == {1: 1, 2: 0, 3: -1}


def _entries(spark, feed):
    docs = spark.createDataFrame([(D0, 0, json.dumps(feed))], "feed_date date, page int, body string")
    return P.odds_entries(docs)


def test_first_whitelisted_bookmaker_only(spark):
    feed = [
        {"home_team": "Ham", "away_team": "Ars", "bookmakers": [
            {"key": "pinnacle", "markets": [{"key": "h2h", "outcomes": [{"name": "Ham", "price": 9.0}]}]},
            {"key": "bet365", "markets": [
                {"key": "spreads", "outcomes": [{"name": "Ham", "price": 7.0}]},
                {"key": "h2h", "outcomes": [{"name": "Ham", "price": 1.4}, {"name": "Draw", "price": 4.0},
                                            {"name": "Ham", "price": 1.5}]}]},
            {"key": "betway", "markets": [{"key": "h2h", "outcomes": [{"name": "Ars", "price": 3.4}]}]}]},
        {"home_team": "Che", "away_team": "Liv", "bookmakers": [{"key": "onexbet", "markets": []}]},
        {"home_team": "Eve", "away_team": "Ful"},
    ]
    got = {r.home_team: (r.odds_home, r.odds_draw, r.odds_away)
           for r in P.odds_per_match(_entries(spark, feed)).collect()}
    assert got["Ham"] == (1.5, 4.0, 3.4)           # last price wins, no fall-through to betway
    assert got["Che"] == (2.10, 3.20, 3.40)
    assert got["Eve"] == (2.10, 3.20, 3.40)


def test_fuzzy_containment_first_position_wins(spark):
    feed = [{"home_team": "Real Madrid", "away_team": "Getafe"},
            {"home_team": "Alaves", "away_team": "Real Sociedad"},
            {"home_team": "Madrid B", "away_team": "Real"},
            {"home_team": "Real Madrid", "away_team": "Getafe", "bookmakers": [
                {"key": "betway", "markets": [{"key": "h2h", "outcomes": [{"name": "Real Madrid", "price": 1.2}]}]}]}]
    odds = P.odds_map(P.odds_per_match(_entries(spark, feed)))
    fx = spark.createDataFrame([
        (1, D0, "REAL MADRID", "Getafe"),      # exact (case-insensitive): dict keeps first pos, last value
        (2, D0, "Sociedad", "Nobody"),         # home name contained in entry 1 only
        (3, D0, "Nobody", "Getafe"),           # away contained in entry 0
        (4, D0, "Real", "Zzz"),                # contained in 0, 1 and 2 → the first (0)
        (5, D0, "Nobody", "Else"),             # none → defaults
        (6, dt.date(2024, 2, 1), "Real", "X"),  # other day: the feed is per day → defaults
    ], "match_id long, match_date date, home_team string, away_team string")
    got = {r.match_id: (r.odds_home, r.odds_source) for r in O.enrich_odds(fx, odds).collect()}
    assert got[1] == (1.2, "exact")
    assert got[2][1] == "fuzzy" and got[3][1] == "fuzzy" and got[4][1] == "fuzzy"
    assert got[5] == (2.10, "default") and got[6] == (2.10, "default")
    pos = {r.match_id: r.pos for r in O.fuzzy_positions(
        O.exact_odds(fx, odds).filter(F.col("__xh").isNull()), odds).collect()}
    assert pos == {2: 1, 3: 0, 4: 0}


def test_fixture_payload_errors_and_defaults(spark):
    ok = {"errors": [], "response": [
        {"fixture": {"id": 7, "date": "2024-05-01T19:45:00+00:00", "status": {"short": "AET"}},
         "league": {"name": "Premier League"}, "teams": {"home": {"name": "A"}, "away": {"name": "B"}},
         "goals": {"home": 2, "away": 2}},
        {"fixture": {"id": 8}, "league": {}, "teams": {"home": {"name": "C"}, "away": {"name": "D"}}, "goals": {}}]}
    bad = {"errors": {"token": "invalid"}, "response": ok["response"]}
    empty = {"errors": {}, "response": []}
    docs = spark.createDataFrame([("2024-05-01", json.dumps(d)) for d in (ok, bad, empty)],
                                 "request_date string, body string")
    got = {r.match_id: r for r in P.parse_fixtures(docs).collect()}
    assert set(got) == {7, 8}
    assert (got[7].status, got[7].match_time, got[7].competition) == ("FINISHED", "19:45", "Premier League")
    assert (got[8].status, got[8].match_time, got[8].competition, str(got[8].match_date)) == \
        ("SCHEDULED", "15:00", "Unknown League", "2024-05-01")


def test_high_confidence_threshold_on_unrounded_probability(spark):
    df = spark.createDataFrame([(1, 0.62), (2, 0.38), (3, 0.619999), (4, 0.380001), (5, 0.6199999)],
                               "match_id long, over_2_5_probability double")
    got = {r.match_id: (r.high_conf_pick, r.over_2_5_probability) for r in R.prediction_post(df).collect()}
    assert got[1][0] and got[2][0] and not got[3][0] and not got[4][0]
    assert got[5] == (False, 0.62)                 # rounds to 0.62 but the flag used the raw value


def test_auc_matches_brute_force_with_ties(spark):
    rnd = random.Random(11)
    rows = [(i, rnd.randint(0, 1), rnd.randint(0, 20) / 20) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, y int, p double")
    pos = [p for _, y, p in rows if y == 1]
    neg = [p for _, y, p in rows if y == 0]
    want = sum((1.0 if a > b else 0.5 if a == b else 0.0) for a in pos for b in neg) / (len(pos) * len(neg))
    assert abs(MT.auc_roc(df).first().auc - want) < 1e-9


def test_metrics_zero_division(spark):
    df = spark.createDataFrame([(1, 0, 0.1), (2, 0, 0.2)], "doc_id long, y int, p double")
    r = MT.classification_metrics(df).first()
    assert (r.precision, r.recall, r.accuracy) == (0.0, 0.0, 1.0)


def test_stratified_folds_balanced(spark):
    rows = [(i, 1 if i % 3 == 0 else 0) for i in range(1000)]
    df = spark.createDataFrame(rows, "doc_id long, y int")
    counts = MT.stratified_folds(df, "doc_id", "y").groupBy("y", "fold").count().collect()
    by_class = {}
    for r in counts:
        by_class.setdefault(r.y, []).append(r["count"])
    assert all(max(v) - min(v) <= 1 and len(v) == 5 for v in by_class.values())


def test_sequence_number_equals_row_number(spark):
    rnd = random.Random(5)
    rows = [(i, rnd.choice(["a", "b"]), rnd.randint(0, 50) / 50) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string, p double")
    order = [F.col("p").desc(), F.col("id")]
    got = sequence_number(df, order=order, buckets=[F.floor((1 - F.col("p")) * 7)], partition=["g"])
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy(*order)))
    assert sorted(map(tuple, got.select("id", "rn").collect())) == sorted(map(tuple, want.select("id", "rn").collect()))


def test_upsert_replace_and_replay(spark):
    from pitchside.sources.store import STORE_SCHEMA
    row = lambda i, hs, st: (i, D0, "15:00", "L", "A", "B", hs, 0, st, 2.1, 3.2, 3.4)
    old = spark.createDataFrame([row(1, None, "SCHEDULED"), row(2, 1, "FINISHED")], STORE_SCHEMA)
    b = spark.createDataFrame([row(1, 3, "FINISHED"), row(1, 4, "FINISHED"), row(3, 0, "SCHEDULED")], STORE_SCHEMA)
    b = U.stamp(b.withColumn("o", F.monotonically_increasing_id()), 1, "o").drop("o")
    once = U.upsert_matches(old, b)
    twice = U.upsert_matches(U.conform(once), b)
    got = {r.match_id: (r.home_score, r.status) for r in once.collect()}
    assert got == {1: (4, "FINISHED"), 2: (1, "FINISHED"), 3: (0, "SCHEDULED")}
    assert sorted(map(tuple, U.conform(once).collect())) == sorted(map(tuple, U.conform(twice).collect()))


def test_json_ascii_matches_python(spark):
    texts = ['{"3":"A vs B: Over 2.5 62%","4":"—"}', "café \U0001F525"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.e for r in df.select(json_ascii(F.col("t")).alias("e")).collect()]
    assert got == [json.dumps(t, ensure_ascii=True)[1:-1].replace('\\"', '"') for t in texts]


def test_day_first_dates(spark):
    df = spark.createDataFrame([("23/08/1997",), ("23/08/97",), ("5/8/2001",), ("not a date",), ("31/02/1999",)],
                               "t string")
    got = [r.d for r in df.select(parse_match_date(F.col("t")).alias("d")).collect()]
    assert got == [dt.date(1997, 8, 23), dt.date(1997, 8, 23), dt.date(2001, 8, 5), None, None]


def test_oneline_digest_truncation(spark):
    rows = [(i, D0, f"Home{i:03d}", f"Away{i:03d}", 0.7 + i / 10000) for i in range(120)]
    picks = spark.createDataFrame(rows, "match_id long, match_date date, home_team string, away_team string, "
                                        "over_2_5_probability double")
    r = R.digest_oneline(picks).first()
    lines = [f"Home{i:03d} v Away{i:03d}: O2.5 {round((0.7 + i / 10000) * 100):.0f}%"
             for i in sorted(range(120), key=lambda i: -(0.7 + i / 10000))]
    full = " | ".join(lines)
    assert r.details == full[:880] + "...(+119 more, see app)"


def test_no_python_udf_in_flagship_plan(spark):
    import __spark_entry__ as E
    plan = E.entry(spark)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_daily_digest_lines_join_to_one_message(spark):
    from pitchside import constants as C
    rows = [(i, D0, f"H{i}", f"A{i}", "19:00", 0.63 + (i % 30) / 100, 0.5) for i in range(95)]
    picks = spark.createDataFrame(rows, "match_id long, match_date date, home_team string, away_team string, "
                                        "match_time string, over_2_5_probability double, btts_probability double")
    parts = sorted((r.line_no, r.text) for r in R.daily_digest(picks).collect())
    assert [p for p, _ in parts] == list(range(97))
    order = sorted(rows, key=lambda r: (-r[5], r[0]))
    body = "".join(f"🔥 *{h} vs {a}*  ⏰ {t}\n   Over 2.5: *{p * 100:.1f}%*  ·  BTTS: *{b * 100:.1f}%*\n\n"
                   for _, _, h, a, t, p, b in order)
    want = C.DIGEST_HEADER.format(brand="Pitchside") + body + C.DIGEST_FOOTER.format(brand="Pitchside")
    assert "".join(m for _, m in parts) == want


def test_daily_digest_keeps_undated_picks_and_shows_over05(spark):
    rows = [(1, None, "A", "B", None, 0.7, None, 0.9), (2, None, "C", "D", "", 0.8, 0.5, float("nan"))]
    picks = spark.createDataFrame(rows, "match_id long, match_date date, home_team string, away_team string, match_time string, "
                                        "over_2_5_probability double, btts_probability double, over_0_5_probability double")
    lines = {r.line_no: r.text for r in R.daily_digest(picks).collect()}
    assert sorted(lines) == [0, 1, 2, 3] and "Over 0.5" not in lines[1] and "  ·  Over 0.5: *90.0%*  ·  BTTS: *0.0%*" in lines[2]


def test_rescheduled_fixture_gets_the_odds_of_its_day(spark):
    fx = spark.createDataFrame([(1, D0, "Ab", "Cd"), (1, D0 + dt.timedelta(days=1), "Ab", "Cd")],
                               "match_id long, match_date date, home_team string, away_team string")
    odds = spark.createDataFrame([(D0, 0, "ab fc vs x", 1.1, 2.0, 3.0), (D0 + dt.timedelta(days=1), 0, "ab fc vs y", 9.1, 2.0, 3.0)],
                                 "feed_date date, pos long, norm_key string, odds_home double, odds_draw double, odds_away double")
    got = sorted((r.match_date, r.odds_home) for r in O.enrich_odds(fx, odds).collect())
    assert got == [(D0, 1.1), (D0 + dt.timedelta(days=1), 9.1)]


def test_plain_folder_layout_wide_header_and_unknown_first_column(spark, tmp_path):
    from pitchside.sources.season_csv import read_season_csv
    folder = tmp_path / "2324"
    folder.mkdir()
    filler = [f"X{i}" for i in range(70)]
    head = ["Referee", "Div", "Date", "HomeTeam", "AwayTeam", "FTHG", "FTAG", *filler, "AvgH"]
    lines = [",".join(head), ",".join(['"Dean, M"', "E0", "12/08/2023", "A", "B", "", "", *["1"] * 70, "1.5"]),
             ",".join(["x", "E0", "13/08/2023", "C", "D", "2", "1", *["1"] * 70, "2.5"]),
             ",".join(["x", "E0", "14/08/2023", "E", "F", "0", "0", *["1"] * 70, "3.5"])]
    (folder / "E0.csv").write_text("\n".join(lines) + "\n\n")
    rows = sorted(read_season_csv(spark, str(tmp_path)).collect(), key=lambda r: -r.match_id)
    assert [(r.match_id, r.season, r.home_team, r.avg_home) for r in rows] == [(-1, "2324", "C", 2.5), (-2, "2324", "E", 3.5)]


def test_nan_is_missing_like_null(spark):
    nan = float("nan")
    rows = [(i, D0 + dt.timedelta(days=i), "L", "A", f"X{i}", 2.0, 2.0, "FINISHED") for i in range(3)]
    rows.append((3, D0 + dt.timedelta(days=3), "L", "A", "X3", nan, nan, "FINISHED"))
    rows.append((4, D0 + dt.timedelta(days=4), "L", "A", "X4", 1.0, 0.0, "FINISHED"))
    f = {r.match_id: r for r in feat.team_form_features(_matches(spark, rows)).collect()}
    t = {r.match_id: r for r in feat.with_targets(_matches(spark, rows)).collect()}
    assert f[4].h_roll_scored == 2.0 and f[4].h_roll_over25 == 0.75
    assert t[3].target_over25 == 0 and t[3].target_draw == 0


def test_season_csv_mixed_headers_by_name(spark, tmp_path):
    from pitchside.sources.season_csv import read_season_csv
    a = tmp_path / "season=2324" / "E0"
    b = tmp_path / "season=2425" / "D1"
    a.mkdir(parents=True)
    b.mkdir(parents=True)
    (a / "E0.csv").write_text(
        "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG,HS,AS,Avg>2.5\n"
        "E0,12/08/2023,Arsenal,Forest,2,1,15,6,1.72\n"
        "E0,12/08/2023,Arsenal,Forest,2,1,15,6,1.72\n"          # identical copy: still its own id
        "E0,13/08/23,Brentford,Spurs,,,9,12,1.60\n")             # no score: dropped
    (b / "D1.csv").write_text(
        "Date,Div,AwayTeam,HomeTeam,FTAG,FTHG,Avg>2.5\n"         # reordered, no shots
        "18/08/2024,D1,Bayern,Wolfsburg,3,0,0\n"
        "not a date,D1,Mainz,Koln,1,1,2.05\n")
    df = read_season_csv(spark, str(tmp_path))
    rows = sorted(df.collect(), key=lambda r: r.match_id, reverse=True)
    assert len(rows) == 4 and len({r.match_id for r in rows}) == 4 and all(r.match_id < 0 for r in rows)
    wolf = [r for r in rows if r.home_team == "Wolfsburg"][0]
    assert (wolf.away_team, wolf.home_score, wolf.away_score, wolf.season) == ("Bayern", 0.0, 3.0, "2425")
    assert wolf.h_shots is None and wolf.avg_over25 == 0.0 and wolf.target_away_win == 1
    assert [r.match_date for r in rows if r.home_team == "Koln"] == [None]
    ars = [r for r in rows if r.home_team == "Arsenal"]
    assert len(ars) == 2 and ars[0].h_shots == 15.0 and str(ars[0].match_date) == "2023-08-12"


def test_undated_games_last_and_null_team_has_no_form(spark):
    rows = [(i, D0 + dt.timedelta(days=i), "L", "A", f"X{i}", 1.0, 0.0, "FINISHED") for i in range(1, 4)]
    rows.append((0, None, "L", "A", "X0", 5.0, 5.0, "FINISHED"))     # undated, smallest id: still last
    rows.append((9, D0 + dt.timedelta(days=9), "L", "A", "X9", 0.0, 0.0, "FINISHED"))
    rows += [(20 + i, D0 + dt.timedelta(days=i), "L", None, f"Y{i}", 1.0, 1.0, "FINISHED") for i in range(5)]
    f = {r.match_id: r for r in feat.team_form_features(_matches(spark, rows)).collect()}
    assert f[9].h_roll_scored == 1.0                 # the undated 5-goal game is not before it
    assert f[0].h_roll_scored == 0.75                # it comes after all dated games: (1+1+1+0)/4
    assert all(f[20 + i].h_roll_scored is None for i in range(5))


def test_season_files_in_many_splits_keep_gapless_ids(spark, tmp_path):
    """Files cut into several input splits, with unplayed rows between: ids are the places among the kept rows."""
    from pitchside.sources.season_csv import read_season_csv

    lines = [f"L,{1 + i % 28:02d}/03/2024,H{i},A{i},{'' if i % 3 == 0 else i % 5},{i % 4}" for i in range(900)]
    for k, folder in enumerate(("2324", "24[x]25")):
        (tmp_path / folder).mkdir()
        for j in range(2):
            part = lines[450 * j:450 * (j + 1)]
            header = "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG" if j == 0 else "X,Div,Date,HomeTeam,AwayTeam,FTHG,FTAG"
            text = "\n".join([header, *(x if j == 0 else "9," + x for x in part)])
            (tmp_path / folder / f"f{j}.csv").write_text(text + "\n")
    kept = [x.split(",")[2] for x in lines if x.split(",")[4]]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        rows = sorted(read_season_csv(spark, str(tmp_path)).collect(), key=lambda r: -r.match_id)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [r.match_id for r in rows] == [-i for i in range(1, 2 * len(kept) + 1)]
    assert [r.home_team for r in rows] == kept * 2 and [r.season for r in rows] == ["2324"] * len(kept) + ["24[x]25"] * len(kept)


def test_season_scan_parses_only_known_columns(spark, tmp_path):
    from pitchside.sources import season_csv as SC

    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "a.csv").write_text("X1,Div,X2,Date,HomeTeam,AwayTeam,FTHG,FTAG,X3\n1,L,2,01/02/2024,A,B,1,0,9\n")
    heads = SC.file_headers(spark, str(tmp_path))
    sources = {"FTHG": "home_score", "FTAG": "away_score", "HomeTeam": "home_team"}
    (places, files), = SC._layouts(heads, sources)
    scan = SC.scan_layout(spark, files, dict(zip(sources.values(), places)))
    plan = scan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<c5:string,c7:string,c8:string>" in plan
    assert [(r.home_score, r.away_score, r.home_team) for r in scan.collect()] == [(1.0, 0.0, "A")]


def test_season_audit_names_what_is_not_read(spark, tmp_path):
    from pitchside.sources.season_csv import read_season_csv, season_audit

    (tmp_path / "2324").mkdir()
    good = "Div,Date,HomeTeam,AwayTeam,FTHG,FTAG\nL,01/02/2024,A,B,1,0\n"
    (tmp_path / "2324" / "E0.csv").write_text(good)
    (tmp_path / "2324" / "D1.csv.gz").write_bytes(b"\x1f\x8b broken")
    (tmp_path / "2324" / "I1.csv").write_bytes(b"")
    (tmp_path / "2324" / "F1.csv").write_text("Date,HomeTeam\n")
    expected = spark.createDataFrame([(p,) for p in ("2324/E0.csv", "2324/SP1.csv", "2425/", "2324")], "path string")
    got = {(r.path, r.reason, r.bytes) for r in season_audit(spark, str(tmp_path), expected).collect()}
    assert got == {("2324/D1.csv.gz", "unreadable", 9), ("2324/I1.csv", "empty", 0), ("2324/F1.csv", "no scores", 14),
                   ("2324/SP1.csv", "missing", None), ("2425", "missing", None)}
    assert [r.home_team for r in read_season_csv(spark, str(tmp_path)).collect()] == ["A"]
    assert season_audit(spark, str(tmp_path)).count() == 3


def test_equal_probabilities_are_numbered_in_several_groups(spark):
    """A third of a day's rows with one probability: numbers as row_number(), in groups bounded by the span of ids."""
    from pitchside.operators import report as R
    from pitchside.operators.ranking import sequence_number

    rnd = random.Random(8)
    rows = [(i * 40_000, "d1" if i % 5 else "d2", rnd.choice([0.62, 0.62, 0.5, 0.6200001, 0.0, None, rnd.random()])) for i in range(600)]
    df = spark.createDataFrame(rows, "match_id long, day string, over_2_5_probability double").repartition(4)
    got = {(r.match_id): r.rn for r in sequence_number(df, order=R.slate_order(), buckets=R.slate_buckets(), partition=["day"], name="rn").collect()}
    for day in ("d1", "d2"):
        order = sorted((r for r in rows if r[1] == day), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        assert [got[r[0]] for r in order] == list(range(1, len(order) + 1))
    tied = df.where("over_2_5_probability = 0.62 AND day = 'd1'")
    assert tied.groupBy(*[b.alias(f"b{k}") for k, b in enumerate(R.slate_buckets())]).count().agg(F.max("count")).first()[0] <= 2 < tied.count() / 20
