"""Quotes anywhere: rows of files cut at every line against the csv module, broken files alone."""

import csv
import io
import random

from fogbank.sources import grid


def replay(text):
    rows = [[f or None for f in row] for row in csv.reader(io.StringIO(text))]
    return [r for r in rows if r]


def test_quotes_anywhere_cut_at_every_line(spark):
    rng = random.Random(11)
    pieces = ["a", "b", '"', '""', ",", "\n", " ", "x\"y", '"q,\n"', ""]
    texts = []
    while len(texts) < 150:
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(1, 25)))
        if t.strip() and not any(x != "" and x.strip() == "" for x in t.split("\n")):
            texts.append(t)
    lines, want = [], {}
    for k, t in enumerate(texts):
        state = closed(t)
        parts = t.split("\n")
        for cut in range(len(parts)):
            name = f"{k}/{cut}"
            lines += [(name, int(i >= cut), i, v) for i, v in enumerate(parts)]
            want[name] = replay(t) if state else None
    df = spark.createDataFrame(lines, "file string, block long, pos long, value string")
    got = {}
    for r in sorted(grid.rows_from_lines(df).collect(), key=lambda r: (r["file"], r["r"])):
        got.setdefault(r["file"], []).append((r["r"], r["fields"]))
    broken = {r["file"] for r in grid.broken_files(df).collect()}
    assert broken == {n for n, w in want.items() if w is None} and broken
    for name, rows in want.items():
        if rows is not None:
            assert [f for _, f in got.get(name, [])] == rows, (name, texts[int(name.split("/")[0])])
            assert [r for r, _ in got.get(name, [])] == list(range(len(rows)))


def closed(text):
    """Whether a reader, one character at a time, ends outside quotes."""
    state = "start"
    for c in text:
        if state == "start":
            state = "quoted" if c == '"' else "start" if c in ",\n" else "plain"
        elif state == "plain":
            state = "start" if c in ",\n" else "plain"
        elif state == "quoted":
            state = "seen" if c == '"' else "quoted"
        else:
            state = "quoted" if c == '"' else "start" if c in ",\n" else "plain"
    return state != "quoted"
