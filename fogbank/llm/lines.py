"""Quality rules from cross-document line frequency.

Lines are normalised (A-Z lowered, white space as one blank, digits as 0) and hashed. Per host the distinct documents that
hold a line are counted, and over all hosts; copies of one text count as one document, so a text is not rejected for being
copied. A line is removed from the documents of a host of which more than ``per_host`` hold it, and everywhere if more than ``anywhere``
do; the limits are numbers, so a line is as common in a large host as in a small one. A document that loses more than
``lost`` of its words is depleted and rejected.

Base rules per document come from the words: too few of them, or too many inside repeated three-word windows.

Defined cases: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows give
repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogbank.llm.common import map_texts, texts_of
from fogbank.session import materialise

SCHEMA = ("doc_id bigint, host string, text_hash bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, "
          "n_repeat_words bigint, lines array<struct<h: bigint, n: int>>")
SPACE = b" \t\n\r\x0b\x0c"
SYMBOLS = b"#*$%&|<>"
DIGITS = bytes.maketrans(b"123456789", b"000000000")


def repeated(words: list[bytes], width: int = 3) -> int:
    """Words inside windows of ``width`` words that the text holds twice or more."""
    if len(words) <= width:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64)
    n = len(seen) + 1
    if n ** width < 1 << 62:
        key = ids[: len(ids) - width + 1].copy()
        for k in range(1, width):
            key = key * n + ids[k: len(ids) - width + 1 + k]
    else:
        _, first = np.unique(ids[:-2] * n + ids[1:-1], return_inverse=True)
        key = first * n + ids[2:]
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(len(key), dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), dtype=bool)
    for k in range(width):
        covered[k: len(words) - width + 1 + k] |= twice
    return int(covered.sum())


def described(text: str | None) -> tuple:
    from xxhash import xxh64_intdigest as h

    raw = (text or "").encode()
    words = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACE)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    earlier, again, lines = set(), 0, {}
    for line in raw.split(b"\n"):
        parts = line.lower().split()
        if not parts:
            continue
        again += line in earlier
        earlier.add(line)
        k = h(b" ".join(parts).translate(DIGITS)) - (1 << 63)
        lines[k] = lines.get(k, 0) + len(parts)
    return (h(raw) - (1 << 63), len(words), chars, symbols, again, repeated(words),
            [{"h": k, "n": n} for k, n in lines.items()])


def measures(docs: DataFrame, key: str, text: str, host: str) -> DataFrame:
    def make():
        def apply(chunk: pa.RecordBatch) -> dict:
            found = list(zip(*map(described, chunk.column("text").to_pylist())))
            names = ["text_hash", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lines"]
            return {"doc_id": chunk.column("doc_id"), "host": chunk.column("host"), **dict(zip(names, map(list, found)))}

        return apply

    return map_texts(texts_of(docs, key, text, host=F.col(host).cast("string")), SCHEMA, make)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", per_host: int = 10,
           anywhere: int = 30, lost: float = 0.7, min_words: int = 50, max_repeat: int = 50) -> DataFrame:
    """The measures, ``n_removed`` words, ``base_failed`` and ``kept`` of every document."""
    base = materialise(measures(docs, key, text, host).withColumn("row", F.monotonically_increasing_id()), "line-measures")
    known = base.withColumn("host", F.struct("host"))  # a null host is equal to itself inside a struct
    # One row per text: its hosts and its lines, each once.
    distinct = known.groupBy("text_hash").agg(F.collect_set("host").alias("hosts"), F.first("lines.h").alias("lines"))
    held = (distinct.select(F.explode("lines").alias("h"), "hosts").select("h", F.explode(F.concat(F.array(F.lit(None).cast("struct<host: string>")), "hosts")).alias("host"))
            .groupBy("h", "host").agg(F.count("*").alias("docs")))
    everywhere = held.where(F.col("host").isNull() & (F.col("docs") > anywhere)).select("h")
    common = materialise(held.where(F.col("host").isNotNull() & (F.col("docs") > per_host)).select("host", "h")
                         .unionByName(everywhere.withColumn("host", F.lit(None).cast("struct<host: string>"))), "common-lines")
    lines = known.select("row", "host", F.explode("lines").alias("line")).select("row", "host", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    by_host, by_all = common.where("host IS NOT NULL"), common.where("host IS NULL").select(F.col("h").alias("all_h"))
    removed = (lines.join(by_host.withColumn("here", F.lit(True)), ["host", "h"], "left").join(by_all, F.col("h") == F.col("all_h"), "left")
               .where(F.col("here") | F.col("all_h").isNotNull()).groupBy("row").agg(F.sum("n").alias("n_removed")))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))
    depleted = F.col("n_removed") > lost * F.col("n_words")
    return (base.drop("lines").join(removed, "row", "left").withColumn("n_removed", F.coalesce("n_removed", F.lit(0)))
            .withColumn("base_failed", failed).withColumn("kept", ~failed & ~depleted).drop("row", "text_hash"))
