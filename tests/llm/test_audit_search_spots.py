"""Filter audit, ranked search and spot fingerprints against brute force in Python, and on odd inputs."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from fogbank.llm import audit, matrix, queries, retrieval, spots
from fogbank.llm.katz import unpack
from fogbank.session import materialise

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def table(spark, rows):
    return spark.createDataFrame([(i, t, None, s, len(t) if t else None) for i, t, s in rows], DOCS)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns whose names clash with results."""
    long = " ".join(f"word{i % 977}" for i in range(60_000))
    rows = [(1, "The cat sat on the mat. #1", "a"), (1, "The cat sat on the mat. #1", "a"), (2, None, "a"), (3, "", None), (None, "a b c d e f g h", None),
            (4, " \n\t ", "b"), (5, long, "b"), (6, long + " the end of it", None), (7, "x", "c"), (None, None, None), (8, "x", ""), (9, "ÀB É zwei DREI", "a"),
            (10, "x", "c"), (None, "x", "c"), (1, "another text with id one", "a")]
    return (table(spark, rows).withColumns({c: F.lit("?") for c in ("part", "step", "score", "rank", "item_id", "seg", "kind", "h", "fails", "digest", "shard", "next")}))


def slow_audit(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    good, toxic = ({d for d, q, x in labels if d is not None and v(q, x)} for v in (lambda q, x: q == 1, lambda q, x: x == 1))
    rows = []
    for i, t, s in docs:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": t in first and (i is None or first[t] < i)}
        rows.append((s or "", {f for f, x in fails.items() if x}, i in good, i in toxic))
    out = {}
    for order in permutations("ABCDE"):
        for part in {r[0] for r in rows}:
            for step, f in enumerate(order, 1):
                mine = [r for r in rows if r[0] == part]
                left = [r for r in mine if not r[1] & set(order[:step - 1])]
                gone = [r for r in left if f in r[1]]
                out[part, "".join(order), step] = [len(left) - len(gone), len(gone), sum(f in r[1] for r in mine) - len(gone),
                                                   sum(r[1] == {f} for r in mine), sum(r[2] for r in gone), sum(r[3] for r in gone)]
    share = Counter()
    for (part, order, step), v in out.items():
        share[part, order[step - 1]] += v[1]
    return {k: (*v, share[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r)[3:] for r in df.select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


def test_audit_by_brute_force(spark, odd):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (8, 1, None), (10, None, 1), (77, 1, 1)], "doc_id bigint, quality int, toxic int").withColumn("n", F.lit(5))
    docs = [(r["doc_id"], r["text"], r["source"]) for r in odd.collect()]
    assert audited(audit.filter_audit(odd, labels)) == slow_audit(docs, [tuple(r)[:3] for r in labels.collect()])
    assert audit.filter_audit(odd.limit(0), labels).collect() == []
    assert len(audit.filter_audit(odd, labels.limit(0)).collect()) == 600 * len({s or "" for *_, s in docs})


def test_audit_of_the_table(spark):
    docs = duckdb.sql(f"SELECT doc_id, text, source FROM '{SMALL}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"SELECT doc_id, quality, toxic FROM '{SMALL}/labels.parquet'").fetchall()
    assert audited(queries.op11_filter_audit(spark, SMALL)) == slow_audit(docs, labels)


def test_matrix_numbers_hold_for_all_shards(spark, odd, monkeypatch):
    """Small shards and ranges: equal words have one number, different ones different numbers, and rows add up to the texts."""
    monkeypatch.setattr(matrix, "RANGE", 50)
    texts = {r["doc_id"]: r["text"] or "" for r in odd.collect() if r["doc_id"] in (4, 5, 6, 7, 9)}
    need = table(spark, [(i, t, "p") for i, t in texts.items()]).select("doc_id", "text", F.lit("p").alias("part")).repartition(3)
    stored = materialise(matrix.shards(need, matrix.split_at_spaces, words=True, mark=audit.marks, size=30), "shards")
    seen, numbers = 0, {}
    for row in matrix.numbered(stored).collect():
        starts, columns, counts = (unpack(row[k], kind) for k, kind in (("starts", np.int64), ("columns", np.int64), ("counts", np.uint32)))
        for i, (a, b) in zip(unpack(row["doc_id"], np.int64), zip(starts, starts[1:])):
            words = Counter(re.findall(r"[^\x20\x09-\x0D]+", texts[i]))
            assert sorted(counts[a:b].tolist()) == sorted(words.values()) and len(set(columns[a:b].tolist())) == b - a
            seen += 1
            numbers[i] = set(columns[a:b].tolist())
    words = {i: set(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in texts.items()}
    assert seen == len(texts) and all(len(numbers[i] & numbers[j]) == len(words[i] & words[j]) for i in texts for j in texts)


def slow_search(docs, items, top=10):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(cut(t))) for i, t, *_ in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total = len(held), sum(k for *_, k in held)
    df = Counter(w for _, c, _ in held for w in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10 ** 9 * c[w]) // (1000 * c[w] + 8 * m)) for w in cut(text) if w in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=repr)


def test_search_by_brute_force(spark, odd, monkeypatch):
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    items = [(1, "The cat, the CAT and a mat"), (2, None), (3, "word5 word6 word7 end of x"), (None, "x é zwei"), (4, "nothing-there"), (5, "")]
    bench = spark.createDataFrame(items + [(1, "Zzz the other text of one id")], "item_id bigint, text string").withColumn("doc_id", F.lit(0))
    want = slow_search(docs, items)
    for size, block in ((1 << 21, retrieval.BLOCK), (5, 1)):
        monkeypatch.setattr(matrix.shards, "__defaults__", (False, None, size))
        stored = retrieval.index(odd.repartition(3))
        assert rows_of(retrieval.search(stored, bench, block=block)) == want, size
    assert retrieval.ranked_search(odd.limit(0), bench).collect() == [] and retrieval.ranked_search(odd, bench.limit(0)).collect() == []


def test_search_of_the_table(spark, monkeypatch):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    items = duckdb.sql(f"SELECT item_id, text FROM '{SMALL}/benchmark.parquet'").fetchall()
    want = slow_search(docs, items)
    assert rows_of(queries.op12_ranked_search(spark, SMALL)) == want
    # Bad bounds cost time, never results.
    monkeypatch.setattr(retrieval, "SPARE", 0.01)
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert rows_of(retrieval.ranked_search(table(spark, [(i, t, None) for i, t in docs]), bench)) == want


def test_sketches_bound_every_impact():
    rng = np.random.default_rng(4)
    shard = retrieval.Shard.__new__(retrieval.Shard)
    shard.distinct = rng.integers(1, 60, 40)
    shard.some = np.arange(40)
    shard.hash = np.sort(rng.integers(0, 1 << 63, 500, dtype=np.uint64))
    shard.code = np.concatenate([np.sort(rng.choice(500, k, replace=False)) for k in shard.distinct])
    impact = rng.integers(1, 1_000_000, len(shard.code))
    starts = np.append(0, np.cumsum(shard.distinct))
    for docs, sketch in retrieval.sketches(shard, impact):
        for d, own in zip(docs, sketch):
            for c, x in zip(shard.code[starts[d]:starts[d + 1]], impact[starts[d]:starts[d + 1]]):
                cells = [own[k, retrieval.cells_of(shard.hash[c:c + 1], k, own.shape[1])[0]] for k in range(retrieval.HASHES)]
                assert int(min(cells)) * retrieval.STEP >= x


def slow_signatures(text):
    words = [w for w in re.split(r"[^\w]|_", text.lower()) if w]
    content = [w for w in words if w not in spots.ANCHORS]
    out, before = set(), 0
    for w in words:
        if w not in spots.ANCHORS:
            before += 1
        elif before < len(content):
            out.add(hashlib.md5(" ".join([w, *content[before:before + 2]]).encode()).hexdigest()[:8])
    if not out and words:
        out = {hashlib.md5(" ".join(words).encode()).hexdigest()[:8]}
    return sorted(out)


def slow_fingerprints(docs):
    """``docs`` in the order that each is followed by the next one."""
    out = []
    for k, (i, t) in enumerate(docs):
        t, follow = t or "", docs[(k + 1) % len(docs)][1] or ""
        half = len(t) // 2
        edited = t[:len(t) - half] + follow[:half]
        a, b, c = slow_signatures(t), slow_signatures(edited), slow_signatures(follow)

        def near(x, y):
            if not x or not y:
                return float(x == y)
            far = abs(math.floor(math.log(len(x)) / math.log(1.25)) - math.floor(math.log(len(y)) / math.log(1.25))) > spots.REACH
            return 0.0 if far else len(set(x) & set(y)) / len(set(x) | set(y))

        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "".join(a), "".join(b), round(near(a, b), 9), round(near(a, c), 9), len(a)))
    return sorted(out, key=repr)


def spotted(df):
    return rows_of(df.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", F.round("near_edited", 9), F.round("near_next", 9), "n_signatures"))


def test_spots_by_brute_force(spark):
    docs = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet' ORDER BY doc_id DESC").fetchall()
    want = slow_fingerprints(docs)
    assert spotted(queries.op13_spot_fingerprints(spark, SMALL)) == want
    shuffled = table(spark, [(i, t, None) for i, t in random.Random(2).sample(docs, len(docs))])
    assert spotted(spots.fingerprints(shuffled, rows=7)) == want


def test_spots_of_uneven_ids_and_odd_rows(spark, odd):
    docs = [(10 ** 15 + 3 * k, f"the cat {k} sat on the mat number {k}") for k in range(60)] + [(k, f"of dogs {k % 7} and of birds") for k in range(40)] + [(-5, ""), (-9, None)]
    want = slow_fingerprints(sorted(docs, key=lambda r: -r[0]))
    assert spotted(spots.fingerprints(table(spark, [(i, t, None) for i, t in docs]), rows=8)) == want
    found = spots.fingerprints(odd, rows=2)
    got = found.collect()
    assert sorted((str(r["doc_id"]), r["n_chars"]) for r in got) == sorted((str(r["doc_id"]), len(r["text"] or "")) for r in odd.collect())
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    same = {}
    for r in odd.withColumnRenamed("text", "t").select("t").collect():
        same.setdefault(r["t"] or "", None)
    prints = {}
    texts = {(r["doc_id"], len(r["text"] or "")): r["text"] or "" for r in odd.collect()}
    for r in got:
        assert prints.setdefault(texts[r["doc_id"], r["n_chars"]], r["fingerprint"]) == r["fingerprint"]
    # Ids fall, then the rows without one follow; each row is the next one of exactly one row.
    order = odd.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).orderBy(F.col("doc_id").desc_nulls_last(), F.xxhash64("t").desc()).collect()
    assert spotted(found) == slow_fingerprints([(r["doc_id"], r["t"]) for r in order])
    assert spots.fingerprints(odd.limit(0)).collect() == []
    one = spots.fingerprints(table(spark, [(1, "the lone cat", None)])).first()
    assert one["near_next"] == 1 and one["edited_sha256"] == hashlib.sha256(b"the lothe lo"[:12]).hexdigest()


def test_fingerprints_run_without_python(spark):
    plan = queries.op13_spot_fingerprints(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
