"""Season result CSVs (S-01, P-01..P-03, U-01): one csv scan per header layout.

Files of one folder tree may carry different headers (columns added, removed
or reordered between seasons, unknown columns anywhere).  A multi-file
``read.csv(header=True)`` applies one header to every file, so values land in
wrong columns.  Here the first line of every input split is read
(:func:`file_headers`; the reader stops there), files are grouped by where their
header has the known columns, and every group is one csv scan with an explicit
schema of which only those columns are parsed.  The scans together read the data
once; their union is the outer column union of the reference.  Only file names and
header positions reach the driver, as for any file scan.

:func:`season_audit` names what was not read: expected files that are missing, empty
and unreadable ones, and those without the score columns.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null
from ..operators.features import with_targets
from ..session import run_dir

# --- fixed values: source column names of the season files → canonical names ----
COLUMN_MAP = {
    "Div": "competition", "Date": "date_text", "HomeTeam": "home_team", "AwayTeam": "away_team",
    "FTHG": "home_score", "FTAG": "away_score",
    "HS": "h_shots", "AS": "a_shots", "HST": "h_shots_ot", "AST": "a_shots_ot",
    "HC": "h_corners", "AC": "a_corners",
    "Avg>2.5": "avg_over25", "B365>2.5": "b365_over25",
    "AvgH": "avg_home", "AvgD": "avg_draw", "AvgA": "avg_away",
    "B365H": "b365_home", "B365D": "b365_draw", "B365A": "b365_away",
}
TEXT_COLS = {"competition", "date_text", "home_team", "away_team"}
TWO_DIGIT_PIVOT = 76      # two-digit years <= 76 are 20xx, others 19xx (within 50 years of 2026)


def parse_match_date(text: Column, pivot: int = TWO_DIGIT_PIVOT) -> Column:
    """P-02: day-first date, four- or two-digit year; anything else → NULL.

    Spark's ``yy`` always means 20xx, so a two-digit year is widened with a
    pivot (like the reference's date parser) and parsed as four digits.
    """
    t = F.trim(text)
    four = F.try_to_date(t, "d/M/yyyy")
    yy = F.regexp_extract(t, r"^\d{1,2}/\d{1,2}/(\d{2})$", 1)
    head = F.regexp_extract(t, r"^(\d{1,2}/\d{1,2}/)\d{2}$", 1)
    yi = yy.try_cast("int")
    year = F.when(yi <= pivot, yi + 2000).otherwise(yi + 1900)
    two = F.when(yy != "", F.try_to_date(F.concat(head, year.cast("string")), "d/M/yyyy"))
    return F.coalesce(four, two)


SKIP_BAD = {"recursiveFileLookup": True, "ignoreMissingFiles": True, "ignoreCorruptFiles": True}


def _path() -> Column:
    """The decoded path of the file a row comes from."""
    return _decoded(F.col("_metadata.file_path"))


def _decoded(raw: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), raw)


def _first_lines(rows):
    """The first non-blank line of a split; the rest of the split is not read."""
    return itertools.islice((r for r in rows if r.line.strip()), 1)


def file_headers(spark: SparkSession, root: str) -> DataFrame:
    """One row per readable file: ``file_path`` and ``names`` (the header cells), stored once.

    A session of its own keeps every split in a partition of its own, where only the first line is taken.
    """
    alone = spark.newSession()
    alone.conf.set("spark.sql.files.openCostInBytes", alone.conf.get("spark.sql.files.maxPartitionBytes"))
    lines = alone.read.options(**SKIP_BAD).text(root).select(
        _path().alias("file_path"), F.col("_metadata.file_block_start").alias("start"),
        F.regexp_replace("value", "^\ufeff", "").alias("line"))
    first = spark.createDataFrame(lines.rdd.mapPartitions(_first_lines).map(tuple), "file_path string, start long, line string")
    path = run_dir(spark, "season_headers")
    first.where("start = 0").select(
        "file_path", F.transform(F.split("line", ","), lambda c: F.trim(F.btrim(F.trim(c), F.lit('"')))).alias("names")).write.parquet(path)
    return spark.read.parquet(path)


MOST_SPLITS = 100_000     # offset rows that are broadcast; more are joined by shuffle


def line_numbers(rows: DataFrame) -> DataFrame:
    """P-03 helper: ``__n`` = 1-based position of each row in the concatenation of all files (folder
    order, then file, then line order).

    ``__pos`` counts the kept rows of a scan task, so inside a split it runs without gaps: a row's place is its distance
    from the split's first.  Split counts become offsets in three small steps: splits of a file, files of a folder,
    folders.  The rows themselves are not moved or sorted.
    """
    def before(of: DataFrame, part: list[str], order: str, count: str, name: str) -> DataFrame:
        w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return of.withColumn(name, F.coalesce(F.sum(count).over(w), F.lit(0)))

    splits = rows.groupBy("__dir", "file_path", "__blk").agg(F.count(F.lit(1)).alias("__c"), F.min("__pos").alias("__first"))
    files = splits.groupBy("__dir", "file_path").agg(F.sum("__c").alias("__fc"))
    folders = files.groupBy("__dir").agg(F.sum("__fc").alias("__dc"))
    folder_off = before(folders, [], "__dir", "__dc", "__do").select("__dir", "__do")     # one row per season folder
    file_off = before(files, ["__dir"], "file_path", "__fc", "__fo").select("__dir", "file_path", "__fo")
    split_off = before(splits, ["file_path"], "__blk", "__c", "__so").select("__dir", "file_path", "__blk", "__so", "__first")
    offs = (split_off.join(file_off, ["__dir", "file_path"]).join(folder_off, "__dir")
            .select("file_path", "__blk", (F.col("__so") + F.col("__fo") + F.col("__do") + 1 - F.col("__first")).alias("__off")))
    path = run_dir(rows.sparkSession, "season_splits")
    offs.write.parquet(path)
    offs = rows.sparkSession.read.parquet(path)
    offs = F.broadcast(offs) if offs.count() <= MOST_SPLITS else offs
    return rows.join(offs, ["file_path", "__blk"]).withColumn("__n", F.col("__off") + F.col("__pos")).drop("__off")


def season_of(path: Column) -> Column:
    """The season of a file: its ``season=...`` folder, else the name of the folder it lies in."""
    tagged = F.regexp_extract(path, r"season=([^/]+)", 1)
    return F.when(tagged != "", tagged).otherwise(F.regexp_extract(path, r"([^/]+)/[^/]+$", 1))


def _literal(path: str) -> str:
    """A path as a pattern that matches only itself."""
    return re.sub(r"([\\\[\]{}*?])", r"\\\1", path)


def _layouts(heads: DataFrame, sources: dict[str, str]) -> list[tuple[tuple[int, ...], list[str]]]:
    """Files by where their header has the known columns (0: it has not): (places in the order of ``sources``, paths)."""
    places = F.array(*[F.array_position("names", F.lit(src)).cast("int") for src in sources])
    groups = heads.groupBy(places.alias("places")).agg(F.array_sort(F.collect_list("file_path")).alias("files"))
    return [(tuple(r.places), r.files) for r in groups.orderBy("places").collect()]      # file names and layouts


def scan_layout(spark: SparkSession, files: list[str], places: dict[str, int]) -> DataFrame:
    """One csv scan of files with one layout: path, split and the known columns; only those are parsed."""
    schema = ", ".join(f"c{i} STRING" for i in range(1, max(places.values()) + 1))
    raw = spark.read.options(**SKIP_BAD, header=True, mode="PERMISSIVE", ignoreLeadingWhiteSpace=False).schema(schema).csv(
        [_literal(f) for f in files])

    def pick(canon: str) -> Column:
        at = places.get(canon, 0)
        text = F.col(f"c{at}") if at else F.lit(None).cast("string")
        return text if canon in TEXT_COLS else nan_to_null(F.trim(text).try_cast("double"))

    return raw.select(_path().alias("file_path"), F.col("_metadata.file_block_start").alias("__blk"),
                      *[pick(c).alias(c) for c in places])


def read_season_csv(spark: SparkSession, root: str) -> DataFrame:
    """S-01: all season files → canonical columns, ``season`` from the path, rows without
    both final scores dropped, targets added, ``match_id`` = -(position among the rows kept).

    Columns absent from every file are absent from the result (so the
    feature set adapts, P-13); columns absent from some files are NULL there.
    Files that cannot be read are left out; :func:`season_audit` names them.
    """
    heads = file_headers(spark, root)
    # the score columns are needed to tell played matches; files without them keep no row
    sources = {**{"FTHG": "home_score", "FTAG": "away_score", "Date": "date_text"}, **COLUMN_MAP}
    layouts = [(dict(zip(sources.values(), places)), files) for places, files in _layouts(heads, sources)]
    always = {"home_score", "away_score", "date_text"}
    canon = [c for c in COLUMN_MAP.values() if c in always or any(places[c] for places, _ in layouts)]
    kept = None
    for places, files in layouts:
        if places["home_score"] and places["away_score"]:
            part = scan_layout(spark, files, {c: places[c] for c in canon}).dropna(subset=["home_score", "away_score"])
            kept = part if kept is None else kept.unionByName(part)
    if kept is None:
        kept = spark.createDataFrame([], "file_path string, __blk long, " + ", ".join(
            f"{c} {'string' if c in TEXT_COLS else 'double'}" for c in canon))
    path = run_dir(spark, "season_rows")          # numbered and counted from the stored rows, not from the files again
    kept.select("*", F.regexp_extract("file_path", r"^(.*)/[^/]+$", 1).alias("__dir"),
                F.monotonically_increasing_id().alias("__pos")).write.parquet(path)
    out = line_numbers(spark.read.parquet(path)).select(
        season_of(F.col("file_path")).alias("season"), *canon, (-F.col("__n")).alias("match_id"))
    return with_targets(out.withColumns({"match_date": parse_match_date(F.col("date_text")), "status": F.lit("FINISHED")}))


def season_audit(spark: SparkSession, root: str, expected: DataFrame | None = None) -> DataFrame:
    """What of a season tree is not read: (path below ``root``, reason, bytes), one row per file.

    ``expected`` has a column ``path`` of files or folders below ``root`` that should hold at least one file.  Reasons:
    ``missing`` (expected, not there; bytes null), ``empty`` (no bytes), ``unreadable`` (bytes, but not one line could be
    read), ``no scores`` (its header lacks a score column, so no row of it counts).  A file that breaks off after its first
    lines counts as read.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(root)
    base = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toUri().getPath().rstrip("/") + "/"
    below = lambda c: F.substring_index(c, base, -1)
    files = spark.read.format("binaryFile").options(recursiveFileLookup=True).load(root)
    # the file index has all files, the scan of their lengths (not of their contents) leaves out those without bytes
    names = spark.createDataFrame([(n,) for n in files.inputFiles()], "name string").select(below(_decoded(F.col("name"))).alias("path"))
    sizes = files.select(below(_path()).alias("path"), F.col("length").alias("bytes"))
    listed = names.join(sizes, "path", "left").select("path", F.coalesce("bytes", F.lit(0)).alias("bytes"))
    scored = F.array_contains("names", "FTHG") & F.array_contains("names", "FTAG")
    read = file_headers(spark, root).select(below(F.col("file_path")).alias("path"), scored.alias("scored"))
    reason = (F.when(F.col("bytes") == 0, "empty").when(F.col("scored").isNull(), "unreadable").when(~F.col("scored"), "no scores"))
    out = listed.join(read, "path", "left").select("path", reason.alias("reason"), "bytes").where("reason IS NOT NULL")
    if expected is None:
        return out
    # a file lies in each of its parent folders: equi-joined with what is expected
    parts = F.split("path", "/")
    there = listed.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/")))
                          .alias("path")).distinct()
    missing = expected.select(F.rtrim(F.col("path"), F.lit("/")).alias("path")).distinct().join(there, "path", "left_anti")
    return out.unionByName(missing.select("path", F.lit("missing").alias("reason"), F.lit(None).cast("long").alias("bytes")))
