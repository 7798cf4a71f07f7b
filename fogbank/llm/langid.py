"""Language identification: averaged hashed subword embeddings, a linear softmax, calibrated rejection.

A text is the mean of the embeddings of its character n-grams (inside words, borders included), hashed to a fixed
number of rows. Embeddings and softmax are trained together by stochastic gradient descent on segments of a bounded
sample of labelled texts, and on made-up texts of no language, which are a class of their own: letters of a segment in any
order, letters and syllables at random, a letter again and again. A second part of the sample, never trained on, sets the
temperature of the scores and, against made-up texts, the score below which a text is rejected. For prediction, embeddings and softmax weights multiply to one small table of
logits per hash row, so that a text costs one look-up per n-gram, whatever its length.

Defined cases: a null text or one without letters gets ``und`` with score 0 and is rejected; ties between languages go
to the first in order of code points; repeated rows give repeated results; without labelled rows every text is ``und``;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogbank.llm.common import hash_sample, map_rows, map_texts, texts_of

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean"
UNKNOWN = "und"
ORDERS = (1, 2, 3)
BITS = 15
PART = 1 << 18
_TOP = 0x32400  # no letters beyond
_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """Lower-case letter of every code point; 32 for what is no letter."""
    global _letters
    if _letters is None:
        out = np.full(_TOP, 32, dtype=np.uint32)
        for c in range(_TOP):
            if (ch := chr(c)).isalpha():
                low = ch.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _letters = out
    return _letters


def grams(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """Hash rows of the n-grams of all texts, one array per order with -1 where none starts, and each text's end."""
    codes = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le"), dtype=np.uint32)
    ends = np.cumsum(np.fromiter((len(t) + 2 for t in texts), dtype=np.int64, count=len(texts)))
    c = letters()[np.minimum(codes, _TOP - 1)]
    c = np.where(codes < _TOP, c, np.uint32(32))
    gap = c == 32
    out, h, n = [], np.full(len(c), 0x811C9DC5, dtype=np.uint32), len(c)
    for order in range(1, max(ORDERS) + 1):
        h = h[: n - order + 1] * np.uint32(0x01000193) ^ c[order - 1:] * np.uint32(0x9E3779B1)
        # Inside an n-gram no gap may stand but at its ends, and it holds a letter.
        ok = ~gap[: n - order + 1] if order == 1 else None
        if order == 2:
            ok = ~(gap[: n - 1] & gap[1:])
        elif order > 2:
            ok = ~np.logical_or.reduce([gap[k: n - order + 1 + k] for k in range(1, order - 1)])
        rows = (h ^ h >> np.uint32(15)) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)
        full = np.full(n, -1, dtype=np.int32)
        full[: n - order + 1] = np.where(ok, rows.astype(np.int32), -1)
        if order in ORDERS:
            out.append(full)
    return out, ends


def parts(texts: list[str], size: int = PART) -> Iterator[tuple[list[int], list[str]]]:
    """Lists of texts with ``size`` characters together; a longer text comes in several pieces."""
    owners, pieces, used = [], [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(len(text), 1), size):
            piece = text[at: at + size]
            if used + len(piece) > size and pieces:
                yield owners, pieces
                owners, pieces, used = [], [], 0
            owners.append(i)
            pieces.append(piece)
            used += len(piece)
    if pieces:
        yield owners, pieces


@dataclass
class Model:
    langs: list[str]
    logits: np.ndarray  # (rows + 1, langs + 1); the last row is for "none", the last column for no language
    temperature: float = 1.0
    threshold: float = 0.0

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities (texts, langs), and which texts have a letter."""
        if not texts:
            return np.zeros((0, len(self.langs))), np.zeros(0, dtype=bool)
        total, n = np.zeros((len(texts), len(self.langs) + 1)), np.zeros(len(texts))
        for owners, pieces in parts(texts):
            found, ends = grams(pieces)
            starts = np.append(0, ends[:-1])
            for rows in found:
                np.add.at(total, owners, np.add.reduceat(self.logits[rows], starts, axis=0))
                np.add.at(n, owners, np.add.reduceat((rows >= 0).astype(np.float64), starts))
        z = total / np.maximum(n, 1)[:, None] / self.temperature
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return (e / e.sum(axis=1, keepdims=True))[:, :-1], n > 0


def segments(texts: list[str], labels: np.ndarray, rng: np.random.Generator, each: int = 4) -> tuple[list[str], np.ndarray]:
    """Pieces of a few to many words, so that the model learns what short and mixed texts look like."""
    out, y = [], []
    for text, label in zip(texts, labels):
        words = text.split()
        for k in range(each):
            size = int(2 ** rng.uniform(1, 7))
            at = int(rng.integers(0, max(1, len(words) - size + 1)))
            out.append(" ".join(words[at: at + size]))
            y.append(label)
    return out, np.array(y)


def made_up(texts: list[str], rng: np.random.Generator) -> list[str]:
    """Texts of no language, as long as the given ones."""
    letters = sorted({c for t in texts for c in t.lower() if c.isalpha()}) or ["x"]
    vowels = [c for c in letters if c in "aeiouyäöü"] or letters
    other = [c for c in letters if c not in vowels] or letters
    out = []
    for k, text in enumerate(texts):
        held = [c for c in text.lower() if c.isalpha()]
        kind = k % 4
        if kind == 0:
            held = list(rng.permutation(held)) if held else held
        elif kind == 1:
            held = list(rng.choice(letters, len(held)))
        elif kind == 2:
            # Open syllables, some of them long: words of a language that nobody taught.
            while len(sounds := "".join(rng.choice(other) + rng.choice(vowels) * int(rng.integers(1, 3)) for _ in range(len(held) // 2 + 1))) < len(held):
                pass
            held = list(sounds)
        else:
            held = [str(rng.choice(letters))] * min(len(held), int(rng.integers(1, 12)))
        at = iter(held)
        out.append("".join(next(at, "") if c.isalpha() else c for c in text))
    return out


def train(texts: list[str], labels: list[str], dim: int = 12, epochs: int = 3, rate: float = 4.0, batch: int = 64,
          keep: float = 0.998, others: float = 0.3, least_steps: int = 300, seed: int = 7) -> Model | None:
    """Model from labelled texts; every fifth text only calibrates it. ``others``: made-up segments per labelled one.

    Few texts are gone through more often, for ``least_steps`` steps.
    """
    langs = sorted(set(labels))
    if not langs:
        return None
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    fit = np.arange(len(texts)) % 5 != 4
    if not fit.any() or not (~fit).any():
        fit[:] = True
    seg, seg_y = segments([t for t, f in zip(texts, fit) if f], y[fit], rng)
    copied = rng.permutation(len(seg))[:int(others * len(seg))]
    seg, seg_y = seg + made_up([seg[i] for i in copied], rng), np.append(seg_y, np.full(len(copied), len(langs)))
    rows, ends = grams(seg)
    starts = np.append(0, ends[:-1])
    # One list of hash rows per segment.
    stacked = np.stack(rows, axis=1).reshape(-1)
    valid = stacked >= 0
    counts = np.add.reduceat(valid.astype(np.int64), starts * len(rows))
    flat = stacked[valid]
    firsts = np.cumsum(counts) - counts
    E = rng.normal(0, 1 / dim, (1 << BITS, dim)).astype(np.float32)
    W = np.zeros((dim, len(langs) + 1), dtype=np.float32)
    usable = np.flatnonzero(counts > 0)
    per_epoch = max(1, -(-len(usable) // batch))
    epochs = max(epochs, -(-least_steps // per_epoch))
    steps, step = epochs * per_epoch, 0
    for _ in range(epochs):
        order = rng.permutation(usable)
        for b in range(0, len(order), batch):
            some = order[b: b + batch]
            n = counts[some]
            idx = flat[np.repeat(firsts[some] - np.append(0, np.cumsum(n)[:-1]), n) + np.arange(n.sum())]
            bounds = np.cumsum(n) - n
            x = np.add.reduceat(E[idx], bounds, axis=0) / n[:, None]
            z = x @ W
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(some)), seg_y[some]] -= 1
            lr = rate * (1 - step / steps)
            back = (p @ W.T / n[:, None]).astype(np.float32)
            W -= (lr / len(some) * (x.T @ p)).astype(np.float32)
            np.add.at(E, idx, -lr * np.repeat(back, n, axis=0))
            step += 1
    logits = np.vstack([E @ W, np.zeros((1, len(langs) + 1), np.float32)]).astype(np.float32)
    model = Model(langs, logits)
    held, held_y = [t for t, f in zip(texts, fit) if not f], y[~fit]
    if held:
        short, short_y = segments(held, held_y, rng, each=2)
        calibrate(model, held + short, np.append(held_y, short_y), made_up(held, rng), len(held), keep)
    return model


def calibrate(model: Model, texts: list[str], y: np.ndarray, junk: list[str], whole: int, keep: float) -> None:
    """Temperature of least log loss; threshold between the scores of the ``whole`` first, known texts and those of ``junk``.

    It lies half way from the score that all but 5 % of the junk stays below to the one that the share ``keep`` of the known texts
    reaches. Where the two overlap, it is as low as can be: a text of unknown n-grams alone, an even guess, never passes.
    """
    found = []
    for t in np.geomspace(0.3, 4, 20):
        model.temperature = float(t)
        p, some = model.scores(texts)
        found.append((-np.log(np.maximum(p[np.arange(len(y)), y], 1e-9))[some].sum(), float(t)))
    model.temperature = min(found)[1]
    p, some = model.scores(texts[:whole])
    known = np.sort(p.max(axis=1)[some])
    p, some = model.scores(junk)
    other = np.sort(p.max(axis=1)[some])
    if len(known):
        low = known[int((1 - keep) * len(known))]
        high = other[int(0.95 * len(other))] if len(other) else 0.0
        model.threshold = max(float((low + high) / 2) if high < low else 0.0, 1 / (len(model.langs) + 1) + 0.05)


def sample(docs: DataFrame, lang: str, learn: Column, rows: int) -> tuple[list[str], list[str]]:
    """At most ``rows`` labelled texts, the lowest by a hash of the id, so that reruns agree."""
    known = hash_sample(docs, rows, learn & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return [r["text"] for r in known], [r["lang"] for r in known]


def trained(docs: DataFrame, held_out: Column, key: str, text: str, lang: str, sample_rows: int) -> tuple[DataFrame, Model | None]:
    need = texts_of(docs, key, text, lang=F.col(lang).cast("string"), held_out=F.coalesce(held_out, F.lit(False)))
    return need, train(*sample(need, "lang", ~F.col("held_out"), sample_rows))


def judged(model: Model | None, texts: list[str]) -> dict[str, list]:
    """Language, score and rejection of every text."""
    if model is None:
        return {"lang_pred": [UNKNOWN] * len(texts), "score": [0.0] * len(texts), "rejected": [True] * len(texts)}
    p, some = model.scores(texts)
    score = np.where(some, p.max(axis=1), 0.0)
    return {"lang_pred": [model.langs[b] if s else UNKNOWN for b, s in zip(p.argmax(axis=1), some)], "score": score,
            "rejected": ~some | (score < model.threshold)}


def identify(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", lang: str = "lang",
             sample_rows: int = 2000) -> DataFrame:
    """Predicted language, calibrated score and rejection of every text.

    ``held_out`` tells the rows nothing is learned from. ``sample_rows`` bounds the labelled texts that train the model on
    the driver; a longer sample changes little, as the model has 2**15 rows only.
    """
    need, model = trained(docs, held_out, key, text, lang, sample_rows)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2**15 rows

    def make():
        def apply(chunk: pa.RecordBatch) -> dict:
            texts = [t or "" for t in chunk.column("text").to_pylist()]
            return {"doc_id": chunk.column("doc_id"), "held_out": chunk.column("held_out"), **judged(shared.value, texts)}

        return apply

    return map_texts(need, SCHEMA, make)


def accepted(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample_rows: int = 2000) -> DataFrame:
    """The rows whose text is not rejected, with all their columns; the model learns from all labelled rows.

    Without any labelled row nothing is known to reject texts by, so all rows stay.
    """
    _, model = trained(docs, F.lit(False), key, text, lang, sample_rows)
    if model is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def apply(chunk: pa.RecordBatch) -> pa.RecordBatch:
            texts = [t or "" for t in chunk.column(text).to_pylist()]
            return chunk.filter(pa.array([not r for r in judged(shared.value, texts)["rejected"]], pa.bool_()))

        return apply

    return map_rows(docs, make, text)
