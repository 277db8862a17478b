r"""Quality rules: a threshold table compiled into one projection, without user functions.

Every rule of :data:`RULES` is a ratio of two base counts with a lower and an
upper bound; :func:`verdict` turns the table into one boolean column.  Words are
``[^\x20\x09-\x0D]+``.

Defined cases: a null text has no words and counts as empty; ratios of a text
without words are 0; repeated rows are judged each for itself; an empty table
gives an empty result; further columns are untouched by :func:`score`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the counted symbols, frequent function words of four languages
SYMBOLS = "#*$%&|<>"
STOP_WORDS = (
    "the of and to in a is that for it as was with be by on not he this are or his from at which but have an had they "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass "
    "de la le et les des en un du une que est pour qui dans par sur pas au plus avec ce il sont "
    "el y los se del las por con no su para al lo como más o pero sus le ha me si sin"
).split()
WINDOW = 8


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")


def n_repeat_words(w: Column, window: int = WINDOW) -> Column:
    """Words covered by windows whose word sequence occurs at least twice in the text.

    Distinct window hashes prove that no window repeats.  Only other texts
    compare the windows themselves: equal ones become neighbours after sorting
    (window, position), and their positions, in order, cover ``window`` words
    each less the overlap.  (Elements are read one by one: ``slice`` inside a
    lambda copies the whole array every time.)
    """
    starts = F.sequence(F.lit(0), F.size(w) - F.lit(window))

    def at(i: Column) -> list[Column]:
        return [F.get(w, i + j) for j in range(window)]

    hashes = F.transform(starts, lambda i: F.xxhash64(*at(i)))
    grams = F.transform(starts, lambda i: F.struct(F.concat_ws(" ", *at(i)).alias("g"), i.alias("i")))

    def covered(sorted_grams: Column) -> Column:
        n = F.size(sorted_grams)
        repeated = F.filter(sorted_grams, lambda x, j: (
            ((j > 0) & (F.get(sorted_grams, j - 1)["g"] == x["g"]))
            | ((j < n - 1) & (F.get(sorted_grams, j + 1)["g"] == x["g"]))))
        positions = F.sort_array(F.transform(repeated, lambda x: x["i"]))
        return F.aggregate(positions, F.struct(F.lit(-window).alias("last"), F.lit(0).alias("n")),
                           lambda acc, p: F.struct(p.alias("last"),
                                                   (acc["n"] + F.least(F.lit(window), p - acc["last"])).alias("n")),
                           lambda acc: acc["n"])

    all_differ = _let(hashes, lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(w) <= window, F.lit(0)).when(all_differ, F.lit(0)).otherwise(_let(F.sort_array(grams), covered))


def n_dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def n_of(text: Column, characters: str) -> Column:
    """How often any of the characters occurs."""
    rest = text
    for c in characters:
        rest = F.replace(rest, F.lit(c), F.lit(""))
    return F.octet_length(text) - F.octet_length(rest)


def base_counts(text: Column) -> dict[str, Column]:
    """The counts that the rules use, as columns over ``text`` (null: empty) and its words ``__w``."""
    w = F.col("__w")
    return {
        "n_words": F.size(w).cast("long"),
        "word_chars": F.char_length(F.array_join(w, "")).cast("long"),
        "n_symbols": n_of(text, SYMBOLS).cast("long"),
        "n_dup_lines": n_dup_lines(text).cast("long"),
        "n_repeat_words": n_repeat_words(w).cast("long"),
        "n_stop_words": F.size(F.filter(w, lambda x: x.isin(STOP_WORDS))).cast("long"),
        "n_lines": (n_of(text, "\n") + 1).cast("long"),
        "n_shouts": n_of(text, "!?").cast("long"),
        "n_upper": (F.char_length(text) - F.char_length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
    }


# rule: (numerator, denominator, lower bound, upper bound); a text is kept when every ratio lies within its bounds
RULES: tuple[tuple[str, str, float, float], ...] = (
    ("n_words", "one", 20, float("inf")),
    ("word_chars", "n_words", 2.0, 15.0),
    ("n_symbols", "n_words", 0.0, 0.2),
    ("n_stop_words", "n_words", 0.02, 0.9),
    ("n_dup_lines", "n_lines", 0.0, 0.5),
    ("n_shouts", "n_words", 0.0, 0.5),
    ("n_upper", "word_chars", 0.0, 0.5),
)


def verdict(rules=RULES) -> Column:
    """The table as one boolean over the base counts: every ratio within its bounds."""
    keep = F.lit(True)
    for top, below, low, high in rules:
        ratio = F.col(top).cast("double") if below == "one" else F.coalesce(
            F.try_divide(F.col(top).cast("double"), F.col(below).cast("double")), F.lit(0.0))
        keep = keep & (ratio >= F.lit(float(low))) & (ratio <= F.lit(float(high)))
    return keep


def score(docs: DataFrame, rules=RULES) -> DataFrame:
    """``docs`` with the base counts, ``base_failed`` and ``kept`` (names of its own columns are replaced if equal)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    counted = docs.withColumn("__w", words(text)).withColumns(base_counts(text)).drop("__w")
    failed = (F.col("n_words") < 20) | (F.lit(100) * F.col("n_repeat_words") > F.lit(30) * F.col("n_words"))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & verdict(rules))


_STOP_SQL = ", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))

ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
g AS (SELECT rid, i, array_to_string(w[i : i + 7], ' ') AS g
      FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1),
rep AS (SELECT rid, sum(least(8, coalesce(nxt - i, 8))) AS n
        FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nxt FROM r) GROUP BY rid),
ln AS (SELECT rid, count(*) - count(DISTINCT l) AS n
       FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d)
       WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
b AS (SELECT doc_id, len(w)::BIGINT AS n_words,
             length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
             coalesce(ln.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(w, lambda x: x IN ({_STOP_SQL}))) AS n_stop_words,
             len(string_split(t, chr(10))) AS n_lines,
             length(t) - length(regexp_replace(t, '[!?]+', '', 'g')) AS n_shouts,
             length(t) - length(regexp_replace(t, '\p{{Lu}}+', '', 'g')) AS n_upper
      FROM w LEFT JOIN rep USING (rid) LEFT JOIN ln USING (rid)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_words >= 20
       AND word_chars / n_words::DOUBLE BETWEEN 2.0 AND 15.0
       AND n_symbols / n_words::DOUBLE BETWEEN 0.0 AND 0.2
       AND n_stop_words / n_words::DOUBLE BETWEEN 0.02 AND 0.9
       AND n_dup_lines / n_lines::DOUBLE BETWEEN 0.0 AND 0.5
       AND n_shouts / n_words::DOUBLE BETWEEN 0.0 AND 0.5
       AND n_upper / word_chars::DOUBLE BETWEEN 0.0 AND 0.5 AS kept
FROM f
"""
