"""Token counts of a BPE vocabulary with word ends, by rank-synchronous array merging.

The distinct pre-tokens of a chunk of texts form one ragged array of symbols. In every round each sequence finds its
lowest-ranked pair and merges all of its occurrences, for all sequences at once; sequences without a known pair leave
the array with the number of their symbols. A text's count is the sum over its pre-tokens.

Defined cases: a null text counts as empty (0 bytes, 0 tokens); added tokens inside a text count as one each, as the
tokenizer file's default has it; repeated rows give repeated results; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fogbank.llm.common import map_texts, texts_of

SCHEMA = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"
#: A task remembers the counts of about this many words, then forgets them all; it is only a memo.
MEMO = 600_000
NONE = np.iinfo(np.int32).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies (a fixed format)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + other.index(b)) for b in range(256)]


class Vocabulary:
    """The parts of a tokenizer file that counting needs, as arrays."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, ids = spec["model"], spec["model"]["vocab"]
        end = model["end_of_word_suffix"] or ""
        letters = byte_letters()
        self.inner = np.array([ids[c] for c in letters], dtype=np.int64)
        self.last = np.array([ids[c + end] for c in letters], dtype=np.int64)
        keys, new = [], []
        for left, right in model["merges"]:
            keys.append(ids[left] << 20 | ids[right])
            new.append(ids[left + right])
        order = np.argsort(np.array(keys, dtype=np.int64), kind="stable")
        self.keys = np.array(keys, dtype=np.int64)[order]
        self.ranks = order.astype(np.int32)
        self.new = np.array(new, dtype=np.int64)[order]
        self.pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.added = [t["content"] for t in spec["added_tokens"]]

    def symbols(self, words: list[bytes]) -> np.ndarray:
        """How many symbols are left of each (non-empty) word when no pair is known any more."""
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(sizes) - 1
        ids[ends] = self.last[flat[ends]]
        out = sizes.copy()
        who = np.arange(len(words))
        while len(who):
            starts = np.cumsum(sizes) - sizes
            key = np.append(ids[:-1] << 20 | ids[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(self.keys[at] == key, self.ranks[at], NONE)
            rank[starts + sizes - 1] = NONE  # a pair never spans two words
            best = np.minimum.reduceat(rank, starts)
            each = np.repeat(best, sizes)
            hit = np.flatnonzero((rank == each) & (each != NONE))
            if len(hit):
                # Of overlapping occurrences (a a a) every second one, from the left.
                head = np.append(True, np.diff(hit) != 1)
                run = np.maximum.accumulate(np.where(head, np.arange(len(hit)), 0))
                hit = hit[(np.arange(len(hit)) - run) % 2 == 0]
                ids[hit] = self.new[at[hit]]
            owner = np.repeat(np.arange(len(who)), sizes)
            gone = np.zeros(len(ids), dtype=bool)
            gone[hit + 1] = True
            sizes = sizes - np.bincount(owner[hit], minlength=len(who))
            out[who] = sizes
            live = best != NONE
            ids = ids[~gone & live[owner]]
            who, sizes = who[live], sizes[live]
        return out


class Counter:
    """Counts the tokens of texts; remembers the counts of blank-separated words it has met."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.vocabulary, self.known = vocabulary, {}
        self.find = regex.compile(vocabulary.pattern).findall
        self.added = regex.compile("|".join(map(regex.escape, sorted(vocabulary.added, key=len, reverse=True))))
        self.marks = tuple(vocabulary.added)

    def words(self, text: str) -> tuple[list[str], int]:
        """Normalised words between blanks and line ends, and how many added tokens stand in the text."""
        if any(m in text for m in self.marks):
            pieces = self.added.split(text)
            parts = [self.words(piece)[0] for piece in pieces]
            return [w for words in parts for w in words], len(pieces) - 1
        if not text.isascii():
            # The tokenizer lower-cases each character by itself: no final sigma.
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower().replace("\n", " ").split(" "), 0

    def learn(self, new: list[str]) -> None:
        """A pre-token never holds white space, so a word's count is the sum over its pre-tokens."""
        found = [self.find(w) for w in new]
        pieces = list({p for each in found for p in each})
        sizes = dict(zip(pieces, self.vocabulary.symbols([p.encode() for p in pieces]).tolist())) if pieces else {}
        self.known.update(zip(new, [sum(map(sizes.__getitem__, each)) for each in found]))

    def count(self, texts: list[str]) -> list[int]:
        split = [self.words(t) for t in texts]
        if len(self.known) > MEMO:
            self.known = {}
        new = set().union(*[words for words, _ in split]).difference(self.known)
        if new:
            self.learn(list(new))
        get = self.known.__getitem__
        return [sum(map(get, words)) + extra for words, extra in split]


def count_tokens(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``n_tokens > limit`` of every text. ``tokenizer`` is a file the driver can read."""
    with open(tokenizer, encoding="utf-8") as f:
        content = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file

    def make():
        counter = Counter(Vocabulary(content.value))

        def apply(chunk: pa.RecordBatch) -> dict:
            texts = [t or "" for t in chunk.column("text").to_pylist()]
            n = counter.count(texts)
            return {"doc_id": chunk.column("doc_id"), "n_bytes": [len(t.encode()) for t in texts], "n_tokens": n,
                    "over_limit": [x > limit for x in n]}

        return apply

    return map_texts(texts_of(docs, key, text), SCHEMA, make)
