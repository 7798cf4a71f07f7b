"""Personal data: exact base patterns, and a character BiLSTM-CRF that adds what the patterns miss.

Base spans follow four patterns, leftmost and without overlap per kind; matches that fail their check (address parts, number
of digits, Luhn) are dropped and not tried again. So two numbers side by side can hide each other. The tagger is trained on
windows around labelled spans of a bounded sample, also with labelled spans put side by side, and finds the borders.

All text around a digit or @ (no kind can do without) is cut into overlapping windows. Their emissions are merged, weighted
by the distance to the window's ends, and one best path is decoded over each whole stretch. A decoded span is added if it
passes its kind's check and overlaps no base span.

Defined cases: a null text counts as empty and has no spans (the digest of the empty text); repeated rows give repeated
results; with no labelled span to learn from, only base spans are found; an empty table gives an empty result. Time and
memory grow with the characters near digits and @, however long a text is.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogbank.llm.common import hash_sample, map_rows, map_texts, replaced, texts_of
from fogbank.llm.tagger import Tagger, codes

KINDS = ("email", "ip", "card", "phone")
SCHEMA = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_spans bigint"
TRIGGER = "[0-9@]"
REACH, WINDOW, STRIDE = 32, 64, 32

# The e-mail pattern, from its @: the part before is read backwards, so that long words cost nothing.
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match never starts inside a run of digits that an earlier start has tried.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
LOOSE_PHONE = re.compile(r"\+?\(?[0-9][\x20().0-9-]+[0-9]")

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def passes(kind: int, s: str) -> bool:
    if kind == 1:
        parts = [p.lstrip("0") or "0" for p in s.split(".")]
        return all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == 2:
        d = only_digits(s)
        return 16 <= len(d) <= 19 and luhn(d)
    if kind == 3:
        return 8 <= len(only_digits(s)) <= 15
    return True


def emails(text: str) -> list[tuple[int, int]]:
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def base_spans(text: str) -> list[Span]:
    """By kind as listed, then start."""
    found = [(0, a, b) for a, b in emails(text)]
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if passes(kind, m[0])]
    return found


def joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def stretches(text: str) -> list[tuple[int, int]]:
    """All places within REACH of a digit or @, as disjoint stretches."""
    out: list[tuple[int, int]] = []
    for m in re.finditer(r"[0-9@]+", text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def sound(text: str, kind: int, a: int, b: int) -> bool:
    """The exact check of an added span: its form, its digits, and no letter or digit goes on beside it."""
    s = text[a:b]
    beside = text[a - 1: a] + text[b: b + 1]
    if any(c.isalnum() for c in beside):
        return False
    if kind == 0:
        return bool(EMAIL.fullmatch(s))
    if kind == 1:
        more = re.match(r"\.[0-9]", text[b: b + 2]) or (a > 1 and text[a - 1] == "." and text[a - 2].isdigit())
        return bool(IP.fullmatch(s)) and passes(1, s) and not more
    if kind == 2:
        return bool(CARD.fullmatch(s)) and passes(2, s)
    plain = only_digits(s)
    return bool(LOOSE_PHONE.fullmatch(s)) and passes(3, s) and (s[0] == "+" or len(s) - len(plain) >= 2) and not IP.fullmatch(s)


def tagged(model: Tagger, pieces: list[str], at_once: int = 256) -> list[list[Span]]:
    """Spans decoded over whole pieces from merged windows."""
    out: list[list[Span]] = [[] for _ in pieces]
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    taper = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)
    at = 0
    while at < len(order):
        some = [order[at]]
        while at + len(some) < len(order) and len(some) < at_once and \
                (len(some) + 1) * len(pieces[order[at + len(some)]]) <= max(at_once * 128, len(pieces[order[at]])):
            some.append(order[at + len(some)])
        at += len(some)
        lengths = np.array([len(pieces[i]) for i in some])
        longest = max(WINDOW, -(-int(lengths.max()) // STRIDE) * STRIDE)
        ids = np.zeros((len(some), longest), dtype=np.int64)
        for row, i in enumerate(some):
            ids[row, : lengths[row]] = codes(pieces[i])
        total = np.zeros((len(some), longest, model.tags), np.float32)
        weight = np.zeros(longest, np.float32)
        starts = list(range(0, longest - WINDOW + 1, STRIDE))
        for k in range(0, len(starts), max(1, 512 // len(some))):
            group = starts[k: k + max(1, 512 // len(some))]
            e = model.emissions(np.concatenate([ids[:, s: s + WINDOW] for s in group]))
            for j, s in enumerate(group):
                total[:, s: s + WINDOW] += e[j * len(some): (j + 1) * len(some)] * taper[:, None]
                weight[s: s + WINDOW] += taper
        tags = model.decode(total / weight[None, :, None], lengths)
        for row, i in enumerate(some):
            t = tags[row, : lengths[row]]
            for a in np.flatnonzero(t % 2 == 1):
                b = a + 1
                while b < len(t) and t[b] == t[a] + 1:
                    b += 1
                out[i].append((int(t[a] - 1) // 2, int(a), int(b)))
    return out


def find(texts: list[str], model: Tagger | None) -> list[tuple[list[Span], list[Span]]]:
    """Base spans and all spans (sorted alike) of every text."""
    base = [base_spans(t) for t in texts]
    extra: list[list[Span]] = [[] for _ in texts]
    if model:
        places = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
        for (i, a, _), spans in zip(places, tagged(model, [texts[i][a:b] for i, a, b in places])):
            for k, s, e in spans:
                s, e = a + s, a + e
                while s < e and texts[i][s] == " ":
                    s += 1
                while s < e and texts[i][e - 1] == " ":
                    e -= 1
                if e > s and sound(texts[i], k, s, e) and not any(x < e and s < y for _, x, y in base[i]):
                    extra[i].append((k, s, e))
    return [(b, sorted(b + x)) for b, x in zip(base, extra)]


def redact(text: str, spans: list[Span]) -> str:
    """The text with every span as its kind in brackets; overlapping spans become one."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def examples(texts: list[str], per_text: int, rng: np.random.Generator, least: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """``least`` windows or more and their tags. Numbers that only fail a checksum keep the label of their form."""
    pool: list[tuple[int, str]] = []
    places = []
    for t in texts:
        spans = base_spans(t) + [(2, m.start(), m.end()) for m in CARD.finditer(t)
                                 if 16 <= len(only_digits(m[0])) <= 19 and not luhn(only_digits(m[0]))]
        spans = [s for s in spans if not any(o != s and o[0] == 3 and o[1] <= s[1] and s[2] <= o[2] for o in spans)]
        pool += [(k, t[a:b]) for k, a, b in spans if b - a < WINDOW // 2]
        around = stretches(t)
        for i in rng.permutation(len(around))[:per_text]:
            places.append((t, spans, *around[i]))
    if not pool:
        return np.zeros((0, WINDOW), np.int64), np.zeros((0, WINDOW), np.int64)
    x, y = [], []

    def add(text: str, spans: list[Span]) -> None:
        at = int(rng.integers(0, max(1, len(text) - WINDOW + 1)))
        ids, tags = np.zeros(WINDOW, np.int64), np.zeros(WINDOW, np.int64)
        piece = text[at: at + WINDOW]
        ids[: len(piece)] = codes(piece)
        for k, a, b in spans:
            for p in range(max(a, at), min(b, at + WINDOW)):
                tags[p - at] = 1 + 2 * k if p == a else 2 + 2 * k
        x.append(ids)
        y.append(tags)

    for t, spans, a, b in places * max(1, -(-least // (2 * len(places)))):
        add(t[a:b], [(k, s - a, e - a) for k, s, e in spans if s < b and e > a])
        # The same place with one to three known spans side by side.
        before, after = re.sub(r"[0-9@+]", "", t[a: a + REACH]).rstrip(), re.sub(r"[0-9@+]", "", t[b - REACH: b]).lstrip()
        text = before[int(rng.integers(0, len(before) + 1)):]  # texts also begin and end near a number
        text, marks = text and text + " ", []
        for k in rng.integers(0, len(pool), int(rng.integers(1, 4))):
            kind, s = pool[int(k)]
            if kind == 3 and rng.random() < 0.3:
                s = s.split(" ", 1)[-1] if " " in s else s  # without the country
            marks.append((kind, len(text), len(text) + len(s)))
            text += s + str(rng.choice([" ", " ", ", ", "; ", "\n"]))
        add(text + after[: int(rng.integers(0, len(after) + 1))], marks)
    return np.array(x), np.array(y)


def learn(docs: DataFrame, rows: int = 500, per_text: int = 3, epochs: int = 6) -> Tagger | None:
    """Tagger from the ``rows`` texts with a digit or @ that come first by a hash of the id, ``per_text`` places of each."""
    some = hash_sample(docs, rows, F.col("text").rlike(TRIGGER))
    x, y = examples([r["text"] for r in some], per_text, np.random.default_rng(11))
    if not len(x):
        return None
    model = Tagger(1 + 2 * len(KINDS))
    model.fit(x, y, epochs)
    return model


def personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = 500) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every row."""
    need = texts_of(docs, key, text)
    model = docs.sparkSession.sparkContext.broadcast(learn(need, rows))  # a few thousand numbers

    def make():
        nothing = hashlib.sha256(b"").hexdigest()

        def apply(chunk: pa.RecordBatch) -> dict:
            texts = [t or "" for t in chunk.column("text").to_pylist()]
            found = find(texts, model.value)
            count = [[sum(s[0] == k for s in b) for b, _ in found] for k in range(4)]
            return {"doc_id": chunk.column("doc_id"), **dict(zip(("n_email", "n_ip", "n_card", "n_phone"), count)),
                    "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() if b else nothing for b, _ in found],
                    "spans": [joined(s) for _, s in found], "n_spans": [len(s) for _, s in found]}

        return apply

    # Texts without a digit or @ hold no span: they need not travel to Python.
    asked = need.withColumn("text", F.when(F.col("text").rlike(TRIGGER), F.col("text")))
    return map_texts(asked, SCHEMA, make)


def redacted(docs: DataFrame, key: str = "doc_id", text: str = "text", length: str = "n_chars", rows: int = 500) -> DataFrame:
    """All rows and columns, every span replaced in the text; the column ``length``, if there, follows the new text."""
    model = docs.sparkSession.sparkContext.broadcast(learn(texts_of(docs, key, text), rows))
    trigger = re.compile(TRIGGER)

    def make():
        def apply(chunk: pa.RecordBatch) -> pa.RecordBatch:
            texts = chunk.column(text).to_pylist()
            some = [i for i, t in enumerate(texts) if t and trigger.search(t)]
            found = find([texts[i] for i in some], model.value)
            changed = {i: redact(texts[i], s) for i, (_, s) in zip(some, found) if s}
            if not changed:
                return chunk
            chunk = replaced(chunk, text, pa.array([changed.get(i, t) for i, t in enumerate(texts)], pa.string()))
            if length in chunk.schema.names:
                old = chunk.column(length).to_pylist()
                chunk = replaced(chunk, length, pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(old)], pa.int64()))
            return chunk

        return apply

    return map_rows(docs, make, text)
