"""Prediction post-processing, slate reports, KPIs and the daily digest texts.

All string work is built-in column functions (``format_string`` after
``bround`` so the rounding is Python's half-even), evaluated per row or per
(day) group — no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions.columns import json_ascii, num_text, pct_text

PROB_COLS = ["over_2_5_probability", "btts_probability", "prob_home_win", "prob_draw", "prob_away_win"]


def prediction_post(scored: DataFrame, threshold: float = C.HIGH_CONF_THRESHOLD) -> DataFrame:
    """P-16: confidence = |p - 0.5|; flag on the *unrounded* p (two-sided); then round to 4."""
    p = F.col("over_2_5_probability")
    flag = (p >= threshold) | (p <= 1 - threshold)
    conf = F.abs(p - 0.5)
    out = scored.withColumns({"high_conf_pick": flag, "over25_confidence": F.bround(conf, 4)})
    return out.withColumns({c: F.bround(F.col(c), 4) for c in PROB_COLS if c in scored.columns})


def high_conf_picks(df: DataFrame, threshold: float = C.HIGH_CONF_THRESHOLD) -> DataFrame:
    """F-06: the flag when present, else the one-sided fallback ``p >= threshold``."""
    if "high_conf_pick" in df.columns:
        return df.filter(F.col("high_conf_pick"))
    return df.filter(F.col("over_2_5_probability") >= threshold)


def min_probability(df: DataFrame, slider_pct: int) -> DataFrame:
    """F-05: ``p >= slider/100``."""
    return df.filter(F.col("over_2_5_probability") >= slider_pct / 100)


def display_row(df: DataFrame) -> DataFrame:
    """P-17: the fixture-table texts."""
    dash = F.lit(C.DIGEST_EMPTY_SLOT)
    odds = F.format_string("%s / %s / %s", num_text(F.col("odds_home"), 2),
                           num_text(F.col("odds_draw"), 2), num_text(F.col("odds_away"), 2))
    has_odds = F.col("odds_home").isNotNull() & (F.col("odds_home") != 0)
    x12 = F.format_string("%s%% / %s%% / %s%%", *[num_text(F.col(c) * 100, 0)
                                                  for c in ("prob_home_win", "prob_draw", "prob_away_win")])
    return df.select(
        "match_id",
        F.coalesce(F.col("match_time"), dash).alias("time_text"),
        "home_team", "away_team",
        pct_text(F.col("over_2_5_probability")).alias("over25_text"),
        pct_text(F.col("btts_probability")).alias("btts_text"),
        x12.alias("x12_text"),
        F.when(has_odds, odds).otherwise(dash).alias("odds_text"),
        F.when(F.col("high_conf_pick"), F.lit("✅")).otherwise(F.lit("")).alias("star"),
    )


def confidence_band(df: DataFrame) -> DataFrame:
    """P-18: confidence %, bar colour (> 60 green) and bar width ``min(conf, 100)``."""
    conf = F.col("over25_confidence") * 200
    return df.select(
        "match_id", conf.alias("conf_pct"),
        F.when(conf > 60, F.lit("green")).otherwise(F.lit("amber")).alias("bar"),
        num_text(F.least(conf, F.lit(100.0)), 0).alias("bar_width"))


def slate_kpis(df: DataFrame, day: str = "match_date") -> DataFrame:
    """A-04 per day: fixtures, high-confidence picks (flag, else p >= 0.62), mean p × 100."""
    p = F.col("over_2_5_probability")
    hc = F.col("high_conf_pick") if "high_conf_pick" in df.columns else p >= C.HIGH_CONF_THRESHOLD
    return df.groupBy(day).agg(
        F.count(F.lit(1)).alias("fixtures"),
        F.sum(F.when(hc, 1).otherwise(0)).alias("high_conf"),
        F.bround(F.avg(p) * 100, 9).alias("avg_over25_pct"))


def slate_order() -> list[Column]:
    """Dashboard default: probability descending (ties by match id)."""
    return [F.col("over_2_5_probability").desc(), F.col("match_id").asc()]


PROBABILITY_BANDS = 1_000_000
ID_SPAN = 1 << 16


def slate_buckets() -> list[Column]:
    """Buckets along :func:`slate_order` for :func:`sequence_number`: probability bands, the probabilities in a band, and
    spans of match ids, so that equal probabilities are numbered in as many groups as their ids need."""
    p = F.col("over_2_5_probability")
    return [p.isNull(), F.floor((1 - p) * PROBABILITY_BANDS), -p, F.floor(F.col("match_id") / ID_SPAN)]


def first_picks(picks: DataFrame, n: int, day: str = "match_date") -> DataFrame:
    """T-06: the first ``n`` picks per day in slate order (plans as a WindowGroupLimit,
    which keeps only ``n`` rows per day per task before the shuffle)."""
    w = Window.partitionBy(day).orderBy(*slate_order())
    return picks.withColumn("pick_no", F.row_number().over(w)).filter(F.col("pick_no") <= n)


def _pct0(c: str) -> Column:
    return num_text(F.col(c) * 100, 0)


def digest_line(over05: bool = False) -> Column:
    """A-13 per-pick block: teams, optional kickoff, Over 2.5, optionally Over 0.5 (where known), BTTS percentages."""
    low = F.col("over_0_5_probability") if over05 else F.lit(None).cast("double")
    t = F.coalesce(F.col("match_time"), F.lit(""))
    btts = F.coalesce(F.col("btts_probability"), F.lit(0.0))
    return F.concat(
        F.lit("🔥 *"), F.col("home_team"), F.lit(" vs "), F.col("away_team"), F.lit("*"),
        F.when(t != "", F.concat(F.lit("  ⏰ "), t)).otherwise(F.lit("")),
        F.lit("\n   Over 2.5: *"), num_text(F.col("over_2_5_probability") * 100, 1), F.lit("%*"),
        F.when(low.isNotNull() & ~F.isnan(low), F.concat(F.lit("  ·  Over 0.5: *"), num_text(low * 100, 1), F.lit("%*")))
        .otherwise(F.lit("")),
        F.lit("  ·  BTTS: *"), num_text(btts * 100, 1), F.lit("%*\n\n"))


def daily_digest(picks: DataFrame, brand: str = C.DIGEST_BRAND, day: str = "match_date") -> DataFrame:
    """A-13: the free-form digest as its lines: ``(day, line_no, text)``.

    Line 0 is the header, then one line per pick in slate order, then the footer;
    the texts of a day joined in ``line_no`` order are the single message of the
    reference.  Picks are ranked without a per-day window
    (:func:`sequence_number` over probability bands), and no day is gathered
    into one row.
    """
    from .ranking import sequence_number

    ranked = sequence_number(picks, order=slate_order(), buckets=slate_buckets(), partition=[day], name="line_no")
    lines = ranked.select(day, "line_no", digest_line("over_0_5_probability" in picks.columns).alias("text"))
    ends = picks.groupBy(day).agg(F.count(F.lit(1)).alias("n")).select(day, F.explode(F.array(
        F.struct(F.lit(0).cast("long").alias("line_no"), F.lit(C.DIGEST_HEADER.format(brand=brand)).alias("text")),
        F.struct((F.col("n") + 1).alias("line_no"), F.lit(C.DIGEST_FOOTER.format(brand=brand)).alias("text")))).alias("x"))
    return lines.unionByName(ends.select(day, "x.line_no", "x.text"))


def slot_line() -> Column:
    return F.concat(F.col("home_team"), F.lit(" vs "), F.col("away_team"),
                    F.lit(": Over 2.5 "), _pct0("over_2_5_probability"), F.lit("%"))


def digest_slots(picks: DataFrame, day: str = "match_date") -> DataFrame:
    """A-14: three template slots per day; >3 picks fold ``(+N more, see app)`` into slot 3."""
    n = picks.groupBy(day).agg(F.count(F.lit(1)).alias("n_picks"))
    top = first_picks(picks, C.DIGEST_SLOTS, day).withColumn("line", slot_line())
    slots = top.groupBy(day).agg(*[F.max(F.when(F.col("pick_no") == i, F.col("line"))).alias(f"slot{i}")
                                   for i in range(1, C.DIGEST_SLOTS + 1)])
    out = n.join(slots, day)
    dash = F.lit(C.DIGEST_EMPTY_SLOT)
    more = F.concat(F.col("slot3"), F.lit(" (+"), (F.col("n_picks") - 3).cast("string"), F.lit(" more, see app)"))
    return out.select(day, "n_picks",
                      F.coalesce("slot1", dash).alias("slot1"),
                      F.coalesce("slot2", dash).alias("slot2"),
                      F.when(F.col("n_picks") > 3, more).otherwise(F.coalesce("slot3", dash)).alias("slot3"))


def digest_payload_json(slots: DataFrame, day: str = "match_date") -> DataFrame:
    """X-01: the five template variables as JSON text, separators and escapes like ``json.dumps``."""
    obj = json_object({"1": F.date_format(day, "dd MMMM yyyy"), "2": F.col("n_picks").cast("string"),
                       "3": F.col("slot1"), "4": F.col("slot2"), "5": F.col("slot3")})
    return slots.select(day, obj.alias("content_variables"))


def json_object(fields: dict[str, Column]) -> Column:
    """A JSON object of text values as ``json.dumps`` writes it: ``", "`` and ``": "`` between, ASCII only."""
    def member(name: str, value: Column) -> Column:
        text = F.to_json(F.struct(F.coalesce(value, F.lit("")).alias(name)))     # {"name":"value"}
        return F.concat(F.lit(f'"{name}": '), F.substring(
            text, F.lit(len(name) + 5), F.length(text) - F.lit(len(name) + 5)))

    return json_ascii(F.concat(F.lit("{"), F.concat_ws(", ", *[member(n, v) for n, v in fields.items()]), F.lit("}")))


def oneline_payload_json(oneline: DataFrame, brand: str = C.DIGEST_BRAND) -> DataFrame:
    """The four template variables of the one-line message (brand, counted picks, "today", details) per day."""
    count = F.concat(F.col("n_picks").cast("string"), F.lit(" High-Confidence Pick"),
                     F.when(F.col("n_picks") != 1, "s").otherwise(""))
    return oneline.withColumn("content_variables", json_object(
        {"1": F.lit(brand), "2": count, "3": F.lit("today"), "4": F.col("details")})).drop("details")


ONELINE_MIN_LINE = 12     # len(" v ") + len(": O2.5 ") + len("0%"): no line is shorter


def digest_oneline(picks: DataFrame, day: str = "match_date") -> DataFrame:
    """A-15: lines joined by `` | ``; over 900 chars → first 880 + ``...(+{n-1} more, see app)``.

    Only the first ``k`` lines can reach the output, where ``k`` lines are
    already longer than the limit, so only those are collected per day
    (a per-day top-k) — exact for any number of picks.
    """
    k = C.ONELINE_LIMIT // (ONELINE_MIN_LINE + 3) + 2
    n = picks.groupBy(day).agg(F.count(F.lit(1)).alias("n_picks"))
    line = F.concat(F.col("home_team"), F.lit(" v "), F.col("away_team"), F.lit(": O2.5 "),
                    _pct0("over_2_5_probability"), F.lit("%"))
    top = first_picks(picks, k, day).select(day, F.struct("pick_no", line.alias("line")).alias("x"))
    joined = top.groupBy(day).agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")),
                                                           lambda x: x["line"]), " | ").alias("details"))
    d = F.col("details")
    cut = F.concat(F.substring(d, 1, C.ONELINE_KEEP), F.lit("...(+"),
                   (F.col("n_picks") - 1).cast("string"), F.lit(" more, see app)"))
    return n.join(joined, day).select(
        day, "n_picks", F.when(F.length(d) > C.ONELINE_LIMIT, cut).otherwise(d).alias("details"))
