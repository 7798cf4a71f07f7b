"""Cell-level text functions: folding, phenomenon codes, wind words, sheet letters."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fogbank import constants as K

ColumnLike = Column | str

# What str.strip() removes once compatibility spaces have been folded to U+0020.
_BLANKS = " \t\x0b\x0c\x1c\x1d\x1e\x1f\x85\u2028\u2029"
#: Assigned planes with characters that fold; surrogates are none.
_PLANES = ((0x80, 0xD800), (0xE000, 0x10000), (0x10000, 0x20000), (0x2F800, 0x2FA20))


def _folds() -> dict[str, str]:
    """Characters whose NFKC form differs, with that form."""
    points = (chr(p) for block in _PLANES for p in range(*block))
    return {c: folded for c in points if (folded := unicodedata.normalize("NFKC", c)) != c}


_FOLDS = _folds()
_FOLD_FROM = "".join(c for c, folded in _FOLDS.items() if len(folded) == 1)
_FOLD_TO = "".join(folded for folded in _FOLDS.values() if len(folded) == 1)
_LONGER = {c: folded for c, folded in _FOLDS.items() if len(folded) > 1}


def _composed() -> dict[str, str]:
    """Pairs of a letter and a mark (accent, voice mark of a kana) that are one character, with it. Hangul is no pair of this kind."""
    out = {}
    for p in (p for block in _PLANES for p in range(*block)):
        parts = unicodedata.decomposition(chr(p)).split()
        if len(parts) == 2 and not parts[0].startswith("<"):
            pair = "".join(chr(int(x, 16)) for x in parts)
            if len(one := unicodedata.normalize("NFC", pair)) == 1:
                out[pair] = unicodedata.normalize("NFKC", one)
    return out


_COMPOSED = _composed()
_MARKS = "".join(sorted({pair[1] for pair in _COMPOSED}))
_REPLACED = {**_LONGER, **_COMPOSED}


def _folded(text: Column) -> Column:
    """NFKC of a text from built-in functions: all folds of single characters, and letters with one mark behind them.

    Plain ASCII is left alone; characters that fold to several, which are rare, are looked up one by one.
    """
    single = F.translate(text, _FOLD_FROM, _FOLD_TO)
    # One literal, which the optimizer turns into a map; no folded text holds these control characters.
    table = F.str_to_map(F.lit("\x02".join(f"{a}\x01{b}" for a, b in _REPLACED.items())), F.lit("\x02"), F.lit("\x01"))
    pieces = F.regexp_extract_all(single, F.lit(f"(?s).[{_MARKS}]?"), F.lit(0))
    # A character before a mark that it does not join is looked up alone.
    looked_up = F.array_join(F.transform(pieces, lambda p: F.coalesce(
        F.try_element_at(table, p), F.concat(F.coalesce(F.try_element_at(table, F.substring(p, 1, 1)), F.substring(p, 1, 1)),
                                             F.substring(p, 2, 1)))), "")
    rare = F.translate(single, "".join(_LONGER) + _MARKS, "") != single
    return (F.when(F.octet_length(text) == F.char_length(text), text)
            .when(rare, looked_up).otherwise(single))


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.str.normalize("NFKC")


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StringType())))
def _folded_rows(rows: pd.Series) -> pd.Series:
    def fold(text):
        if text is None:
            return ""
        return unicodedata.normalize("NFKC", text).replace("\n", "").replace("\r", "").strip()
    return rows.map(lambda table: [[fold(t) for t in row] for row in table])


def folded_texts(rows: ColumnLike) -> Column:
    """``cell_text(full=True)`` of rows of cells, for the heads of files."""
    return _folded_rows(col(rows))


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cell_text(cell: ColumnLike, full: bool = False) -> Column:
    """Comparable form of a cell; never null.

    The default folds characters with built-in functions and is meant for data cells; it equals NFKC but for letters with
    several marks typed apart and Hangul in single jamo. ``full=True`` runs complete NFKC in a
    vectorised UDF and is meant for the few header cells of a file.
    """
    text = F.coalesce(col(cell).cast("string"), F.lit(""))
    if full:
        text = _nfkc(text)
    else:
        text = _folded(text)
    return F.btrim(F.translate(text, "\n\r", ""), F.lit(_BLANKS))


def is_blank(cell: ColumnLike) -> Column:
    return cell_text(cell) == ""


_NUMBER = r"^(?i)[+-]?(?:(?:\d+\.?\d*|\.\d+)(?:e[+-]?\d+)?|inf(?:inity)?)$"


def _plain_double(text: Column) -> Column:
    # Only texts that are numbers reach the cast: it would also read Java's "1.5d", and a
    # failing cast costs far more than the pattern.
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def number(cell: ColumnLike) -> Column:
    """Numeric coercion; anything else, and NaN, is null."""
    text = F.btrim(col(cell).cast("string"), F.lit(_BLANKS))
    return _plain_double(text)


def phenomenon_code(cell: ColumnLike) -> Column:
    """Code 0..10 of a text cell: "/" is 0, otherwise the largest number in the text."""
    text = cell_text(cell)
    largest = F.array_max(
        F.regexp_extract_all(text, F.lit(r"(\d+)"), F.lit(1)).cast("array<double>"))
    return (F.when(text == "/", F.lit(0))
            .when(largest <= K.MAX_CODE, largest.cast("int")))


def phenomenon_code_number(value: ColumnLike) -> Column:
    """Code of a numeric cell: truncated toward zero, kept when 0..10."""
    v = col(value).cast("double")
    return F.when((v > -1) & (v < K.MAX_CODE + 1), v.cast("int"))


def is_phenomenon_value(cell: ColumnLike) -> Column:
    """Could this non-blank text cell be a code: "/" or separated numbers, each 0..10?"""
    token, gap = r"(?:0?\d|10)", r"[\s,、/・]"
    return cell_text(cell).rlike(f"^(?:/|{gap}*{token}(?:{gap}+{token})*{gap}*)$")


def is_phenomenon_number(value: ColumnLike) -> Column:
    v = col(value).cast("double")
    return F.coalesce((v == F.floor(v)) & v.between(0, K.MAX_CODE), F.lit(False))


_DEGREES = {word: 22.5 * i for i, word in enumerate(K.COMPASS)}


def wind_degrees(cell: ColumnLike) -> Column:
    """Degrees of a wind cell; calm and unreadable cells are null."""
    text = cell_text(cell)
    words = F.create_map(*[F.lit(x) for pair in _DEGREES.items() for x in pair])
    value = _plain_double(text)
    return (F.when(text.isin(*K.CALM_WORDS), F.lit(None).cast("double"))
            .when(text.isin(*K.COMPASS), F.try_element_at(words, text))
            .when(value.between(0, 360), value % 360.0))


def sheet_letter(index: ColumnLike) -> Column:
    """Spreadsheet letters of a 0-based column, up to three letters."""
    c = col(index).cast("int")

    def letter(v: Column) -> Column:
        return F.char(v + 65)

    two, three = c - 26, c - 702
    return (F.when(c < 26, letter(c))
            .when(c < 702, F.concat(letter(F.floor(two / 26)), letter(two % 26)))
            .otherwise(F.concat(letter(F.floor(three / 676)),
                                letter(F.floor(three / 26) % 26), letter(three % 26))))
