"""Layout of station files, found for a whole fleet in one job.

Everything is decided from the head of a file: a few rows, so long tables of head texts stay
small. Only the check of location columns reads data rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogbank import constants as K
from fogbank.functions.text import cell_text, folded_texts, is_phenomenon_value, sheet_letter
from fogbank.operators.segments import join_on
from fogbank.session import materialise

HEAD_ROWS = K.HEADER_SEARCH_ROWS + K.SUBHEADER_ROWS


@dataclass
class Layout:
    """``files``: one row per file with its rows and measure columns (``c_temp`` ...);
    ``locations``: location columns; ``excluded``: columns right of the measures that are not."""

    files: DataFrame
    locations: DataFrame
    excluded: DataFrame


def contains_any(text: Column, words: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def any_text(texts: Column | str, words: Sequence[str]) -> Column:
    return F.exists(texts, lambda t: contains_any(t, words))


def is_metadata(texts: Column | str) -> Column:
    return any_text(texts, K.METADATA_KEYWORDS)


def is_measure(texts: Column | str) -> Column:
    """A known measure, direction or datetime word, or a unit in parentheses."""
    words = [w for ws in K.MEASURE_KEYWORDS.values() for w in ws]
    words += [*K.WIND_DIRECTION_KEYWORDS, *K.DATETIME_KEYWORDS]
    unit = r"[（(]\s*(?:" + "|".join(K.UNITS) + r")\s*[）)]"
    return any_text(texts, words) | F.exists(texts, lambda t: t.rlike(unit))


def head_table(rows: DataFrame) -> DataFrame:
    """One row per file: width, n_rows and ``head``, its first rows with folded texts.

    All later steps are expressions on this row, so the file is read once for its layout.
    """
    first = F.when(F.col("r") < HEAD_ROWS, F.struct(F.col("r").cast("int").alias("r"), "fields"))
    per_file = rows.groupBy("file").agg(
        F.max(F.size("fields")).alias("width"), (F.max("r") + 1).alias("n_rows"),
        F.sort_array(F.collect_list(first)).alias("_head"))
    return per_file.select("file", "width", "n_rows", F.arrays_zip(
        F.col("_head.r").alias("r"), folded_texts("_head.fields").alias("t")).alias("head"))


def once(value: Column, then) -> Column:
    """``then(value)``, with the value worked out once however often ``then`` reads it.

    Spark joins the steps on a row into one expression: a column read inside a loop over cells would be worked out per cell.
    """
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _first_index(texts: Column, words: Sequence[str]) -> Column:
    return F.array_min(F.transform(texts, lambda t, i: F.when(contains_any(t, words), i)))


def with_shapes(heads: DataFrame) -> DataFrame:
    """Header row, datetime column and first data row.

    The header row has 年月日時 in its first column, else the most measure words (two or
    more), else it is row 0. Up to three rows below it without a datetime belong to the
    header. ``data_start_fixed`` is the first data row for the fixed datetime column.
    """
    words = [w for m in K.REQUIRED_MEASURES for w in K.MEASURE_KEYWORDS[m]]

    def hits(texts: Column) -> Column:
        return reduce(lambda a, b: a + b, [
            F.when(any_text(texts, [w]), 1).otherwise(0) for w in words])

    searched = F.filter("head", lambda x: x["r"] < K.HEADER_SEARCH_ROWS)
    exact = F.array_min(F.transform(searched, lambda x: F.when(
        F.get(x["t"], F.lit(0)) == K.HEADER_KEYWORD, x["r"])))
    best = F.array_max(F.transform(searched, lambda x: F.struct(hits(x["t"]).alias("n"), (-x["r"]).alias("r"))))
    out = heads.withColumn("_best", best).withColumn("header_row", F.coalesce(
        exact, F.when(F.col("_best.n") >= 2, -F.col("_best.r")), F.lit(0)).cast("int"))
    dt = once(F.col("header_row"), lambda h: F.array_min(F.transform(
        F.filter("head", lambda x: x["r"] <= h), lambda x: _first_index(x["t"], K.DATETIME_KEYWORDS))))
    out = out.withColumn("dt_col", F.coalesce(dt, F.lit(0)).cast("int"))

    def start(column: Column) -> Column:
        def after(at: Column) -> Column:
            filled = F.array_min(F.transform("head", lambda x: F.when((x["r"] > at["h"]) & (F.get(x["t"], at["c"]) != ""), x["r"])))
            most = F.least(at["h"] + 1 + K.SUBHEADER_ROWS, F.col("n_rows"))
            return F.least(F.coalesce(filled, most), most).cast("int")

        return once(F.struct(F.col("header_row").alias("h"), column.alias("c")), after)

    return (out.withColumn("data_start", start(F.col("dt_col")))
            .withColumn("data_start_fixed", start(F.lit(K.FIXED_DATETIME_COLUMN))).drop("_best"))


def with_headers(shapes: DataFrame) -> DataFrame:
    """``columns``: per column with any header text its number and the texts from the top down."""
    used = once(F.col("data_start"), lambda start: F.filter("head", lambda x: x["r"] < start))
    last = F.greatest(F.col("width") - 1, F.lit(0))

    def texts(used: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.struct(
            c.alias("c"), F.filter(F.transform(used, lambda x: F.get(x["t"], c)), lambda t: t != "").alias("texts")))

    return shapes.withColumn("columns", F.filter(once(used, texts), lambda x: F.size(x["texts"]) > 0))


def _unclaimed(name: str, taken: list[str]):
    def test(x: Column) -> Column:
        ok = x[name] & ~x["meta"] & (x["c"] != F.col("dt_col"))
        for other in taken:
            ok &= F.coalesce(x["c"] != F.col(other), F.lit(True))
        return ok
    return test


def assign_measures(headers: DataFrame) -> DataFrame:
    """Columns of the measures and the wind direction, and the kind of every header.

    A column belongs to the first measure it matches that has no column yet, left to right.
    That equals letting the measures choose in order, each its leftmost free column.
    """
    def described(x: Column) -> Column:
        return F.struct(
            x["c"].alias("c"), x["texts"].alias("texts"), is_metadata(x["texts"]).alias("meta"),
            is_measure(x["texts"]).alias("measure"),
            *[any_text(x["texts"], words).alias(m) for m, words in K.MEASURE_KEYWORDS.items()],
            any_text(x["texts"], K.WIND_DIRECTION_KEYWORDS).alias("direction"))

    out = headers.withColumn("columns", F.transform("columns", described))
    taken: list[str] = []
    for name in [*K.MEASURE_KEYWORDS, "direction"]:
        target = "c_wind_deg" if name == "direction" else f"c_{name}"
        free = F.filter("columns", _unclaimed(name, list(taken)))
        out = out.withColumn(target, F.array_min(F.transform(free, lambda x: x["c"])))
        taken.append(target)
    last = F.greatest(*[F.col(c) for c in taken])
    return out.withColumn("last_measure", F.coalesce(last, F.col("dt_col")))


def described_files(rows: DataFrame) -> DataFrame:
    return assign_measures(with_headers(with_shapes(head_table(rows))))


def check_columns(rows: DataFrame, columns: DataFrame) -> DataFrame:
    """Do the non-blank values of each column look like codes?

    ``columns`` holds (file, c, mode, start). Adds n_values, n_bad, ok and up to five bad samples in
    the order they were met. All values count, so a column that turns bad late is seen. A column
    without values passes.
    """
    column = ["file", "c", "mode"]
    # Only the columns to look at are taken out of a row; a sheet's width bounds the list.
    wanted = columns.groupBy("file").agg(F.collect_list(F.struct("c", "mode", "start")).alias("_look"))
    data = (rows.select("file", "r", "fields").join(wanted, "file")
            .select("file", "r", "fields", F.explode("_look").alias("x")).filter(F.col("r") >= F.col("x.start"))
            .select("file", "r", "x.c", "x.mode", cell_text(F.get("fields", F.col("x.c"))).alias("t"))
            .filter(F.col("t").isNotNull() & (F.col("t") != "")).withColumn("_bad", ~is_phenomenon_value("t")))
    counts = data.groupBy(*column).agg(F.count(F.lit(1)).alias("n_values"), F.count_if("_bad").alias("n_bad"))
    # The five earliest bad texts: tasks keep five per column before anything is shuffled.
    earliest = Window.partitionBy(*column).orderBy("r")
    samples = (data.filter("_bad").groupBy(*column, "t").agg(F.min("r").alias("r"))
               .withColumn("_i", F.row_number().over(earliest)).filter(F.col("_i") <= 5)
               .groupBy(*column).agg(F.transform(F.sort_array(F.collect_list(F.struct("r", "t"))), lambda x: x["t"]).alias("samples")))
    checked = columns.join(counts, column, "left").join(samples, column, "left").fillna(0, subset=["n_values", "n_bad"])
    return (checked.withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
            .withColumn("ok", F.col("n_bad") <= F.col("n_values") * K.CODE_CHECK_TOLERANCE))


def unique_names(columns: DataFrame, where: Column | None = None) -> DataFrame:
    """Columns (file, c, name): a name that stands further left in its sheet gets the column's letter behind it."""
    again = F.row_number().over(Window.partitionBy("file", "name").orderBy("c")) > 1
    again = again if where is None else again & where
    return columns.withColumn("_again", again).withColumn("name", F.when(F.col("_again"), F.concat(
        "name", F.lit("("), sheet_letter("c"), F.lit(")"))).otherwise(F.col("name"))).drop("_again")


def detect(rows: DataFrame, layout: str = "auto") -> Layout:
    """Layout of every file. ``auto`` falls back to the fixed columns where it finds too little.

    File heads, the verdicts on columns and the layouts are written once: they are a few rows
    per file, and every later step reads them.
    """
    if layout not in ("auto", "fixed"):
        raise ValueError(f"layout must be auto or fixed, not {layout!r}")
    described = materialise(described_files(rows), "file-heads")
    # Small: as many rows as there are columns to look at, from one row per file.
    beside = (described.select("file", "last_measure", "data_start", F.explode("columns").alias("x"))
              .filter(F.col("x.c") > F.col("last_measure"))
              .select("file", "data_start", F.col("x.c").alias("c"), F.col("x.texts")[0].alias("header"),
                      (F.col("x.meta") | F.col("x.measure")).alias("known")))
    numbers_only = F.col("header").rlike(r"^[\d.\-/]+$")
    auto = (beside.filter(~F.col("known") & ~numbers_only)
            .select("file", "c", F.col("header").alias("name"), F.col("data_start").alias("start"),
                    F.lit("auto").alias("mode")))
    first, last = K.FIXED_LOCATION_COLUMNS
    name_row = F.filter("head", lambda x: x["r"] == K.FIXED_NAME_ROW)[0]["t"]
    fixed = (described.filter(F.col("width") > first)
             .select("file", F.col("data_start_fixed").alias("start"), name_row.alias("_names"),
                     F.explode(F.sequence(F.lit(first), F.least(F.lit(last), F.col("width") - 1))).alias("c"))
             .select("file", "c", F.coalesce(F.nullif(F.get("_names", F.col("c")), F.lit("")),
                                             F.concat(F.lit("地点_"), sheet_letter("c"))).alias("name"),
                     "start", F.lit("fixed").alias("mode")))
    candidates = auto.unionByName(fixed) if layout == "auto" else fixed
    verdicts = materialise(check_columns(rows, candidates), "column-checks")
    found = verdicts.filter("ok").groupBy("file").agg(F.max(F.col("mode") == "auto").alias("_auto"))
    any_measure = F.coalesce(*[F.col(f"c_{m}") for m in K.MEASURES]).isNotNull()
    files = described.join(found, "file", "left").withColumn(
        "_located", F.coalesce("_auto", F.lit(False)))
    if layout == "fixed":
        source = F.lit("fixed")
    else:
        source = F.when(F.col("_located") & any_measure, "auto").otherwise("auto+fixed")
    files = files.withColumn("source", source).withColumn(
        "_mode", F.when(F.col("_located") & F.lit(layout == "auto"), "auto").otherwise("fixed"))
    is_fixed = F.col("source") == "fixed"
    columns = {}
    for m in K.MEASURES:
        fallback = F.lit(K.FIXED_MEASURE_COLUMNS.get(m)).cast("int")
        columns[f"c_{m}"] = (F.when(is_fixed, fallback)
                             .when(F.col("source") == "auto", F.col(f"c_{m}"))
                             .otherwise(F.coalesce(F.col(f"c_{m}"), fallback)))
    columns["c_wind_deg"] = F.when(~is_fixed, F.col("c_wind_deg"))
    columns["dt_col"] = F.when(is_fixed, F.lit(K.FIXED_DATETIME_COLUMN)).otherwise(F.col("dt_col"))
    columns["data_start"] = F.when(is_fixed, F.col("data_start_fixed")).otherwise(F.col("data_start"))
    files = files.withColumns(columns)

    chosen = join_on(verdicts, files.select("file", "_mode"), ["file"]).filter(F.col("mode") == F.col("_mode"))
    in_file = Window.partitionBy("file").orderBy("c")
    letter = sheet_letter("c")
    # Windows over the columns of one sheet.
    locations = (unique_names(chosen.filter("ok"), F.col("mode") == "auto").withColumn("ordinal", F.row_number().over(in_file))
                 .withColumn("location_id", letter)
                 .select("file", "location_id", "c", "ordinal", "name"))
    rejected = chosen.filter(~F.col("ok")).select(
        "file", "c", letter.alias("letter"), F.col("name").alias("header"),
        F.concat(F.lit(K.REASON_BAD_VALUES), F.when(F.size("samples") > 0, F.concat(
            F.lit(": "), F.array_join("samples", ", "))).otherwise("")).alias("reason"))
    named_away = (beside.filter("known").join(files.filter(F.col("_mode") == "auto").select("file"), "file", "left_semi")
                  .select("file", "c", letter.alias("letter"), "header",
                          F.lit(K.REASON_NOT_LOCATION).alias("reason")))
    files = files.drop("_auto", "_located", "_mode", "data_start_fixed", "last_measure", "columns", "head", "n_rows")
    return Layout(materialise(files, "file-layouts"), locations, rejected.unionByName(named_away))
