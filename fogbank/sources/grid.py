"""Station files: CSV text to rows of fields, splittable and in any of three encodings."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fogbank.functions.text import ColumnLike, col
from fogbank.operators.segments import join_on

_QUOTED = '"[^"]*+(?:""[^"]*+)*+'
#: A cell with its comma: quoted and closed, quoted to the end of the text, or plain.
CELL = rf'({_QUOTED}"[^,]*+,|{_QUOTED}\z|[^",][^,]*+,|,)'
OPEN = rf"^{_QUOTED}\z"
#: Inside and tail of a quoted cell.
CLOSED = r'^"([^"]*+(?:""[^"]*+)*+)"([^,]*+),\z'


def check_extension(path: str) -> None:
    """Folders and globs are filtered by extension; a named file must be a CSV file."""
    extension = os.path.splitext(path.rstrip("/"))[1].lower()
    if extension not in ("", ".csv"):
        raise ValueError(f"unsupported file type {extension}: station files are read as .csv")


def read_lines(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.[cC][sS][vV]") -> DataFrame:
    """Decoded lines (file, block, pos, value) of CSV files, cut anywhere."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    for path in paths:
        check_extension(path)
    lines = (spark.read.option("pathGlobFilter", pattern).text(paths)
             .select(F.col("_metadata.file_path").alias("file"),
                     F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("pos"), "value"))
    return decode_lines(lines)


def read_rows(spark: SparkSession, paths: str | Sequence[str], pattern: str = "*.[cC][sS][vV]") -> DataFrame:
    """Rows (file, r, fields) of CSV files: r counts non-blank rows from 0, blank fields are null.

    A file whose last quoted cell is never closed has no rows; ``broken_files`` names it.
    """
    return rows_from_lines(read_lines(spark, paths, pattern))


def decode_lines(lines: DataFrame) -> DataFrame:
    """Raw lines to text: UTF-8 (with or without a mark) if the whole file is, else Windows-31J.

    The text source keeps the bytes of a line as they are, and no byte of a two-byte character
    can be a line break or a quote, so a file can be cut at lines before its encoding is known.
    Bytes that fit neither encoding are an error.
    """
    spark = lines.sparkSession
    verdict = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("_utf8"))
    setting = "spark.sql.legacy.javaCharsets"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        text = F.when(F.col("_utf8"), F.col("value")).otherwise(
            F.decode(F.col("value").cast("binary"), "windows-31j"))
        decoded = join_on(lines, verdict, ["file"]).withColumn("value", text).drop("_utf8")
    finally:
        spark.conf.set(setting, before)
    return decoded.withColumn("value", F.regexp_replace("value", "^\ufeff", ""))


def ends_open(line: Column) -> Column:
    """Whether a line that starts a row ends inside a quoted cell: the cell that reaches the end has no closing quote."""
    last = F.element_at(F.regexp_extract_all(F.concat(line, F.lit(",")), F.lit(CELL), F.lit(1)), -1)
    return F.contains(line, F.lit('"')) & last.rlike(OPEN)


def running_state(df: DataFrame, keys: Sequence[str], order: str, out0: str, out1: str) -> DataFrame:
    """States after every row of an automaton of two states, for either state (``out0``: 0, ``out1``: 1) it can begin in.

    The columns ``f0`` and ``f1`` map a row's entry state to its exit state. Such a map keeps the state, turns it or fixes it, so
    a run of maps is known by the last fixed state and the number of turns since, and maps of runs compose like those of rows.
    """
    along = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    turned = df.withColumn("_turns", F.sum((F.col("f0") & ~F.col("f1")).cast("int")).over(along))
    fixed = F.last(F.when(F.col("f0") == F.col("f1"), F.struct(F.col("f0").alias("state"), "_turns")), ignorenulls=True).over(along)
    odd = (F.col("_turns") - F.coalesce("_fixed._turns", F.lit(0))) % 2 == 1
    return (turned.withColumn("_fixed", fixed).withColumns({
        out0: F.coalesce("_fixed.state", F.lit(False)) != odd, out1: F.coalesce("_fixed.state", F.lit(True)) != odd}).drop("_turns", "_fixed"))


def scan_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with their states and row starts for either state their block can begin in, and one row per block:
    the state it does begin in, the rows before it, and whether its file ends inside a quoted cell."""
    value = F.col("value")
    local = lines.withColumns({"f0": ends_open(value), "f1": ~F.contains(value, F.lit('"')) | ends_open(F.concat(F.lit('"'), value))})
    local = running_state(local, ["file", "block"], "pos", "_after0", "_after1").drop("f0", "f1")
    by_line = Window.partitionBy("file", "block").orderBy("pos")
    inside = by_line.rowsBetween(Window.unboundedPreceding, 0)
    text = F.trim("value") != ""
    for s in (0, 1):
        local = local.withColumn(f"_in{s}", F.lag(f"_after{s}", 1, bool(s)).over(by_line))
        local = local.withColumn(f"_s{s}", F.sum((~F.col(f"_in{s}") & text).cast("int")).over(inside))
    blocks = local.groupBy("file", "block").agg(
        F.max_by("_after0", "pos").alias("f0"), F.max_by("_after1", "pos").alias("f1"), F.max("_s0").alias("_n0"), F.max("_s1").alias("_n1"))
    blocks = running_state(blocks, ["file"], "block", "_after", "_unused")
    along = Window.partitionBy("file").orderBy("block")
    blocks = blocks.withColumn("_quoted", F.lag("_after", 1, False).over(along))
    own = F.when(F.col("_quoted"), F.col("_n1")).otherwise(F.col("_n0"))
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return local, blocks.select("file", "block", "_quoted", (F.sum(own).over(along) - own).alias("_before"),
                                F.last("_after").over(whole).alias("_open"))


def broken_files(lines: DataFrame) -> DataFrame:
    """Files (file) that end inside a quoted cell."""
    return scan_lines(lines)[1].filter("_open").select("file").distinct()


def rows_from_lines(lines: DataFrame) -> DataFrame:
    """Lines (file, block, pos, value) to rows (file, r, fields).

    A quoted cell may hold line breaks, so whether a line starts a row depends on all lines before it. Every line maps the state
    it is met in (between cells, inside quotes) to the state it leaves; the maps are composed inside file blocks, whose size
    Spark bounds, and then from block to block. A quote inside a cell that does not begin with one is text.
    """
    local, blocks = scan_lines(lines)
    placed = join_on(local, blocks.filter(~F.col("_open")).drop("_open"), ["file", "block"])
    own = lambda name: F.when(F.col("_quoted"), F.col(f"{name}1")).otherwise(F.col(f"{name}0"))
    placed = placed.select("file", "block", "pos", "value", (F.col("_before") + own("_s") - 1).alias("r"),
                           (~own("_in")).alias("_start"), own("_after").alias("_goes_on"))
    placed = placed.filter(~(F.col("_start") & (F.trim("value") == "")))
    whole = F.col("_start") & ~F.col("_goes_on")
    # Only rows that really span lines are grouped.
    joined = (placed.filter(~whole).groupBy("file", "r")
              .agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "pos", "value"))),
                                            lambda x: x["value"]), "\n").alias("value")))
    text = placed.filter(whole).select("file", "r", "value").unionByName(joined)
    return text.select("file", "r", split_fields("value").alias("fields"))


def split_fields(line: ColumnLike) -> Column:
    """Fields of one CSV record; the quotes around a cell are removed and empty fields are null.

    What follows a closing quote belongs to the cell. Quotes of a cell that does not begin with one are text.
    """
    text = col(line)
    parts = F.regexp_extract_all(F.concat(text, F.lit(",")), F.lit(CELL), F.lit(1))
    plain = F.split(text, ",", -1)

    def unquoted(x: Column) -> Column:
        inner, tail = (F.regexp_extract(x, CLOSED, i) for i in (1, 2))
        return F.when(x.startswith('"'), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), tail)).otherwise(F.substr(x, F.lit(1), F.length(x) - 1))

    fields = F.when(F.contains(text, F.lit('"')), F.transform(parts, unquoted)).otherwise(plain)
    return F.transform(fields, lambda x: F.nullif(x, F.lit("")))


def cells(rows: DataFrame) -> DataFrame:
    """Long form (file, r, c, text) of the non-blank fields."""
    return (rows.select("file", "r", F.posexplode("fields").alias("c", "text"))
            .filter(F.col("text").isNotNull()))


def output_prefix(file: ColumnLike) -> Column:
    """Station name from a file name: up to the first underscore, then up to the first space."""
    name = F.regexp_replace(F.regexp_extract(col(file), r"([^/]*)$", 1), r"\.[^.]*$", "")
    return F.substring_index(F.substring_index(name, "_", 1), " ", 1)
