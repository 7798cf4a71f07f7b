"""Secret scans whose false positives a random forest removes.

Candidates are unbroken runs of 20 or more key-like characters, and values of 8 or more characters assigned to key-like names. Each
gets features: length, character classes and entropy; how likely its character transitions are in ordinary text; the
share of it that dictionary words cover; known beginnings of keys; the path (source) it stands in; the words beside it. The
forest (Spark ML) is trained on the labelled findings of all texts: findings labelled by rule (keys of a known form,
unnamed values that mix small and capital letters and digits at random, named values that are no words and no place holders), and
in the place of the first findings of every text made-up ones: keys of each known form, short passwords and pass phrases behind a name (true), and
place holders, words, numbers, digests and paths (false). Bare secrets, short ones and ones without a digit are so learned wherever
the texts have none. Transitions and dictionary are counted in all texts.

Defined cases: null and empty texts have no candidates; runs below 20 characters without a key-like name, and named values
below 8, are none; repeated rows give repeated findings; without a candidate in any text there is no finding; an empty table
gives an empty result. Starts and ends are code points, end exclusive. A candidate is read whole, however long.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogbank.llm.common import map_texts, texts_of
from fogbank.session import materialise

FEATURES = ("length", "entropy", "digits", "lower", "upper", "other", "switches", "transition", "dictionary", "repeat",
            "named", "assigned", "quoted", "hex", "form", "path", "beside")
SCHEMA = ("doc_id bigint, start bigint, `end` bigint, sha256 string, labelled boolean, made boolean, features array<double>")
NAMES = r"(?:token|secret|passw(?:or)?d|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|auth|credentials?|bearer)"
ASSIGNED = re.compile(rf"(?i){NAMES}[A-Za-z0-9_-]{{0,24}}[\"']?(?:\s{{0,4}}(?:=>|=|:)\s{{0,4}}[\"']?|\s{{1,4}}[\"'])([^\s\"'<>,;()]{{8,}})")
RUN = re.compile(r"eyJ[\w-]{8,}(?:\.[\w-]+)+|[A-Za-z0-9+/_=-]{20,}")
NAMED = re.compile(rf"(?i){NAMES}[A-Za-z0-9_-]{{0,24}}[\"']?(?:\s{{0,4}}(?:=>|=|:)\s{{0,4}}[\"']?|\s{{1,4}}[\"'])$")
MAY = rf"(?i)[A-Za-z0-9+/_=-]{{20,}}|{NAMES}"
EQUALS = re.compile(r"(?:=>?\s*[\"']?|[:\s]\s*[\"'])$")
#: Forms of keys that services give out.
FORMS = re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_\w{30,}|glpat-[\w-]{20,}|xox[abprs]-[A-Za-z0-9-]{10,}|"
                   r"[sr]k_(?:live|test)_[A-Za-z0-9]{16,}|AIza[\w-]{35}|eyJ[\w-]{8,}(?:\.[\w-]+){0,2}|npm_[A-Za-z0-9]{30,}|SG\.[\w.-]{20,}")
PLACE_HOLDER = re.compile(r"(?i)(?:your|example|sample|dummy|change|insert|placeholder|xxx|<|\*\*|\.\.\.|1234567|abcdef0)")
AROUND = 40


def candidates(text: str) -> list[tuple[int, int]]:
    found = {(m.start(1), m.end(1)) for m in ASSIGNED.finditer(text)}
    taken = sorted(found)
    for m in RUN.finditer(text):
        if not any(a < m.end() and m.start() < b for a, b in taken):
            found.add(m.span())
    return sorted(found)


def entropy(s: str) -> float:
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values())


#: Characters of a transition: those of ASCII, the others counted as ``?``.
PAIRS = 128


def pair_keys(low: str) -> np.ndarray:
    """Numbers of the pairs of neighbouring characters."""
    points = np.frombuffer(low.encode("ascii", "replace"), np.uint8).astype(np.int64)
    return points[:-1] * PAIRS + points[1:]


class Language:
    """Transitions and words of ordinary text. Characters beyond ASCII count as one."""

    def __init__(self, pairs: dict[int, int], words: Iterable[str]):
        counts = np.zeros(PAIRS * PAIRS)
        for k, n in pairs.items():
            counts[k] = n
        singles = counts.reshape(PAIRS, PAIRS).sum(axis=1)
        size = int((singles > 0).sum()) + 1
        floor = math.log(1 / size) if size > 1 else -1.0
        self.pair = np.where(counts > 0, np.log((counts + 1) / (np.repeat(singles, PAIRS) + size)), floor - 3)
        self.words = set(words)
        self.longest = max(map(len, self.words), default=0)

    def transition(self, s: str) -> float:
        return float(self.pair[pair_keys(s.lower())].sum()) / max(1, len(s) - 1)

    def coverage(self, s: str) -> float:
        low, at, covered = s.lower(), 0, 0
        while at < len(low):
            n = next((n for n in range(min(self.longest, len(low) - at), 2, -1) if low[at: at + n] in self.words), 0)
            covered += n
            at += n or 1
        return covered / max(1, len(s))


def features(value: str, before: str, after: str, path: str, language: Language) -> list[float]:
    n = len(value)
    kinds = ["d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "o" for c in value]
    beside = re.findall(r"[^\W\d_]+", before[-AROUND:])[-2:] + re.findall(r"[^\W\d_]+", after[:AROUND])[:2]
    return [float(n), entropy(value), *[kinds.count(k) / n for k in "dluo"],
            sum(a != b for a, b in zip(kinds, kinds[1:])) / max(1, n - 1), language.transition(value), language.coverage(value),
            max(Counter(value).values()) / n, float(bool(NAMED.search(before[-AROUND:]))), float(bool(EQUALS.search(before[-8:]))),
            float(before[-1:] in "\"'" and before != "" and after[:1] == before[-1:]), float(bool(re.fullmatch(r"[0-9a-fA-F]+", value))), float(bool(FORMS.match(value))),
            float(sum(map(ord, path)) % 64), sum(language.coverage(w) for w in beside) / max(1, len(beside))]


def rule(value: str, before: str) -> bool:
    """Label of a finding, by its form, its looks or its name."""
    if PLACE_HOLDER.search(value) or max(Counter(value).values()) > len(value) / 2:
        return False
    if FORMS.match(value):
        return True
    digit, small, capital = (any(f(c) for c in value) for f in (str.isdigit, str.islower, str.isupper))
    if NAMED.search(before[-AROUND:]):
        if digit and (small or capital):
            return entropy(value) >= 2.5
        return not digit and bool(EQUALS.search(before[-8:])) and len(value) >= 16 and entropy(value) >= 3
    return digit and small and capital and entropy(value) >= 4 and sum(map(str.isdigit, value)) >= 3 and "/" not in value[1:-1]


def made_up(rng: np.random.Generator, words: list[str]) -> list[tuple[str, str | None, bool]]:
    """Values with what stands before them (None: what stood there) and their labels."""
    alphabet = np.array(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"))
    some = lambda n, at=0: "".join(rng.choice(alphabet[at:], n))
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    hexes = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    said = list(rng.choice(words, 4)) if words else ["some", "words", "of", "use"]
    named = ["password=", "secret: '", 'api_key = "', "token="][int(rng.integers(4))]
    plain = f"the {said[0]} "
    short = rng.permutation(list(some(5) + digits(3) + "!"))
    return [("AKIA" + some(16).upper(), plain, True), ("ghp_" + some(36), plain, True), (f"eyJ{some(24)}.eyJ{some(60)}.{some(43)}", plain, True),
            ("sk_live_" + some(24), plain, True), (some(40) + "=", plain, True), ("".join(short), named, True), (said[0].capitalize() + digits(3), named, True),
            ("".join(rng.choice(words, 5)) if words else "correcthorsebatterystaple", "password=", True),
            ("".join(rng.choice(alphabet[26:52], 24)), "password=", True), (hexes(40), named, True), (hexes(32), named, True),
            ("x" * 24, None, False), ("your_token_goes_here_1", named, False), (f"example{rng.integers(1, 9)}" * 3, named, False),
            ("-".join(said) + "1", plain, False), ("0123456789" * 3, named, False), (digits(24), plain, False), (hexes(40), plain, False),
            (hexes(64), plain, False), ("/".join(said) + "/" + "_".join(said), plain, False), ("".join(said) + "".join(said), plain, False),
            (said[0] + "ing", f"the {NAMES_SAID[int(rng.integers(3))]}: ", False), ("=" * 30, plain, False), ("-" * 30, plain, False)]


NAMES_SAID = ("secret", "token", "password")
#: So many findings of a text carry made-up ones.
EACH = 2


def language_of(docs: DataFrame, words: int = 2000) -> Language:
    """Transitions and the most frequent words of all texts. Spark adds up the counts of the tasks; the driver gets one number
    per pair of ASCII characters, and ``words`` words."""

    def make():
        def apply(chunk: pa.RecordBatch) -> dict:
            pairs, known = np.zeros(PAIRS * PAIRS, np.int64), Counter()
            for text in chunk.column("text").to_pylist():
                low = (text or "").lower()
                pairs += np.bincount(pair_keys(low), minlength=PAIRS * PAIRS)
                known.update(re.findall(r"[^\W\d_]{3,}", low))
            seen = np.flatnonzero(pairs)
            return {"pair": [*seen.tolist(), *[None] * len(known)], "word": [*[None] * len(seen), *known], "n": [*pairs[seen].tolist(), *known.values()]}

        return apply

    counts = map_texts(docs.select("text"), "pair int, word string, n bigint", make).groupBy("pair", "word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "secrets-language")
    pairs = {r["pair"]: r["n"] for r in counts.where("pair IS NOT NULL").collect()}
    often = counts.where("word IS NOT NULL AND n > 1").orderBy(F.desc("n"), "word").limit(words).collect()
    return Language(pairs, [r["word"] for r in often])


def scanned(docs: DataFrame, language) -> DataFrame:
    """Findings, and the made-up ones (``made``) that stand in the place of the first of every text."""
    import hashlib

    def make():
        lang: Language = language.value
        words = sorted(lang.words)

        def apply(chunk: pa.RecordBatch) -> dict:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "end", "sha256", "labelled", "made", "features")}

            def put(doc, a, b, value, before, after, path, label, made=False):
                for k, v in zip(out, (doc, a, b, None if made else hashlib.sha256(value.encode()).hexdigest(), label, made,
                                      features(value, before, after, path, lang))):
                    out[k].append(v)

            for doc, text, path in zip(*[chunk.column(c).to_pylist() for c in ("doc_id", "text", "path")]):
                for k, (a, b) in enumerate(candidates(text or "")):
                    value, before, after = text[a:b], text[max(0, a - 2 * AROUND): a], text[b: b + 2 * AROUND]
                    put(doc, a, b, value, before, after, path or "", rule(value, before))
                    if k < EACH:
                        for fake, said, label in made_up(np.random.default_rng(sum(map(ord, value)) + a), words):
                            put(doc, a, b, fake, before if said is None else said, " " if said is None else after, path or "", label, True)
            return out

        return apply

    return map_texts(docs, SCHEMA, make)


def find_secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source", trees: int = 30, depth: int = 6,
                 seed: int = 13) -> DataFrame:
    """``doc_id, start, end, sha256, score``: the findings left, with the hash of the value instead of the value.

    Transitions and dictionary are counted in all texts, and the forest learns from the findings of all texts.
    """
    need = texts_of(docs, key, text, path=F.col(path).cast("string"))
    language = docs.sparkSession.sparkContext.broadcast(language_of(need))
    scan = materialise(scanned(need.where(F.col("text").rlike(MAY)), language), "secrets-scanned")
    found, known = scan.where("NOT made"), scan.select(F.col("labelled").cast("double").alias("label"), array_to_vector("features").alias("x"))
    kinds = {r["label"] for r in known.groupBy("label").count().collect()}
    if kinds != {0.0, 1.0}:
        return found.where("labelled").select("doc_id", "start", "end", "sha256", F.lit(1.0).alias("score"))
    forest = RandomForestClassifier(featuresCol="x", labelCol="label", numTrees=trees, maxDepth=depth, seed=seed).fit(known)
    scored = forest.transform(found.withColumn("x", array_to_vector("features")))
    return (scored.select("doc_id", "start", "end", "sha256", vector_to_array("probability")[1].alias("score"))
            .where(F.col("score") >= 0.5))
