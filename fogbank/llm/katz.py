"""Language-model scores by Katz backoff over words.

Bigrams back off to words, words to one unknown word. Counts up to ``K`` are discounted by Good-Turing, larger ones by
``RESERVE``, so that every history leaves something to back off to; backoff weights are computed from the exact sums over
all words seen after a history, so every distribution sums to one.

Work and volume. Texts are cut into blocks of about ``BLOCK`` tokens, stored once as word numbers and the block's own
vocabulary. A block asks for counts once per distinct word and bigram, not per token: it sends sorted arrays of 64-bit
hashes with its own training counts, cut by hash range; the tables of counts are summed per range, and a block gets the
totals back in the order it asked. Of all blocks that hold a bigram one is its owner, so that sums over the distinct words
after a history are again sums over blocks, exchanged per history in the same way. Hot words and bigrams appear once per
block, whatever their share of the tokens, and no range depends on a hot key. All tables lie in the shared folder.

Words and bigrams are told apart by 64-bit hashes.

Defined cases: a null text is empty and has one token, its end; repeated rows count as often as they stand and score alike;
without training rows a token's probability is 1 (only the unknown word exists); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fogbank.llm.common import chunks, texts_of
from fogbank.session import materialise

K = 5
RESERVE = 0.01
BLOCK = 1 << 21
RANGE = 1 << 20
WORDS, PAIRS = 0, 1
OUT = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def pack(values: np.ndarray) -> bytes:
    """Bytes of an array, like places together, compressed."""
    import zstandard

    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), -1).T.tobytes() if len(values) else b""
    return zstandard.ZstdCompressor(level=1).compress(raw)


def unpack(data: bytes, kind) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype=np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel() if len(raw) else np.zeros(0, kind)


def pack_sorted(keys: np.ndarray) -> bytes:
    return pack(np.diff(keys, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


def pair_key(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    k = before * np.uint64(0x9E3779B97F4A7C15) + word
    k ^= k >> np.uint64(29)
    k *= np.uint64(0xBF58476D1CE4E5B9)
    return k ^ k >> np.uint64(32)


def cut(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Borders of the hash ranges in sorted keys."""
    part = ((keys >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return np.searchsorted(part, np.arange(ranges + 1, dtype=np.uint64))


def blocks(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The stored blocks: ids, flags (1: held out, 2: null id), words per text, word numbers, hashes of the words."""
    types = pa.schema([("g", pa.int64()), ("doc_id", pa.binary()), ("flags", pa.binary()), ("size", pa.binary()),
                       ("ids", pa.binary()), ("vocab", pa.binary()), ("tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from xxhash import xxh64_intdigest as h

        base, made = TaskContext.get().partitionId() << 32, 0
        known: dict[bytes, int] = {}
        doc, flags, size, ids, held_tokens = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            vocab = np.fromiter(map(h, known), dtype=np.uint64, count=len(known))
            row = [[base + made], [pack(np.array(doc, dtype=np.int64))], [pack(np.array(flags, dtype=np.uint8))], [pack(np.array(size, dtype=np.uint32))],
                   [pack(np.concatenate(ids) if ids else np.zeros(0, np.uint32))], [pack(vocab)], [held_tokens]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, types)], schema=types)

        for chunk in chunks(batches):
            for d, text, out in zip(*[chunk.column(c).to_pylist() for c in ("doc_id", "text", "held_out")]):
                words = (text or "").encode().lower().split()
                ids.append(np.array([known.setdefault(w, len(known)) for w in words], dtype=np.uint32))
                doc.append(d or 0)
                flags.append(out | (d is None) << 1)
                size.append(len(words))
                held_tokens += len(words) + 1
                if held_tokens >= block:
                    yield flush()
                    known, doc, flags, size, ids, held_tokens = {}, [], [], [], [], 0
                    made += 1
        if doc:
            yield flush()

    return docs.mapInArrow(run, "g bigint, doc_id binary, flags binary, size binary, ids binary, vocab binary, tokens bigint")


class Block:
    """A block's tokens with histories: word numbers, the distinct words and bigrams in order of their hashes."""

    def __init__(self, row):
        self.held = unpack(row["flags"], np.uint8) % 2 == 1
        size = unpack(row["size"], np.uint32).astype(np.int64)
        ids = unpack(row["ids"], np.uint32)
        vocab = unpack(row["vocab"], np.uint64)
        end, begin = len(vocab), len(vocab) + 1
        # Two numbers no word has: the end of a text, and its begin, which is a history only.
        self.hash = np.append(vocab, np.array([0x0E4D, 0xBE61], dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        self.sizes = size + 1
        ends = np.cumsum(self.sizes) - 1
        self.starts = ends - size
        n = int(self.sizes.sum())
        self.token = np.full(n, end, dtype=np.int64)
        inner = np.ones(n, dtype=bool)
        inner[ends] = False
        self.token[inner] = ids
        self.before = np.empty(n, dtype=np.int64)
        self.before[1:] = self.token[:-1]
        self.before[self.starts] = begin
        self.train = np.repeat(~self.held, self.sizes)
        self.word_order = np.argsort(self.hash[:end + 1])
        self.words = end + 1
        pairs, self.of = np.unique(self.before * (end + 2) + self.token, return_inverse=True)
        self.pair_before, self.pair_word = pairs // (end + 2), pairs % (end + 2)
        key = pair_key(self.hash[self.pair_before], self.hash[self.pair_word])
        self.pair_order = np.argsort(key)
        self.pair_key = key[self.pair_order]

    def asked(self) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """Kind, sorted hashes, own training counts."""
        words = np.bincount(self.token[self.train], minlength=self.words)
        pairs = np.bincount(self.of[self.train], minlength=len(self.pair_key))
        return [(WORDS, self.hash[self.word_order], words[self.word_order]), (PAIRS, self.pair_key, pairs[self.pair_order])]


def requests(stored: DataFrame, ranges: int) -> DataFrame:
    def run(frames):
        for frame in frames:
            for _, row in frame.iterrows():
                for kind, keys, counts in Block(row).asked():
                    at = cut(keys, ranges)
                    rows = [(kind, p, row["g"], pack_sorted(keys[a:b]), pack(counts[a:b].astype(np.uint32)))
                            for p, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                    yield pd.DataFrame(rows, columns=["kind", "part", "g", "keys", "counts"])

    return stored.mapInPandas(run, "kind int, part int, g bigint, keys binary, counts binary")


ANSWER = "kind int, part int, g bigint, total binary, own binary, n bigint, types bigint, ofs array<bigint>"


def answers(asked: DataFrame) -> DataFrame:
    """Totals for every request, in its order, and owner marks; rows with a null ``g`` hold sums over a range's table."""

    def run(frames):
        held = pd.concat([f for f in frames if len(f)] or [pd.DataFrame(columns=["kind", "part", "g", "keys", "counts"])])
        for (kind, part), rows in held.groupby(["kind", "part"]):
            rows = rows.sort_values("g")
            keys = [unpack_sorted(k) for k in rows["keys"]]
            counts = np.concatenate([unpack(c, np.uint32) for c in rows["counts"]])
            distinct, of = np.unique(np.concatenate(keys), return_inverse=True)
            total = np.bincount(of, counts).astype(np.int64)
            own = np.zeros(len(of), dtype=np.uint8)
            some = np.flatnonzero(counts)
            own[some[np.unique(of[some], return_index=True)[1]]] = 1
            seen = total[total > 0]
            few = np.bincount(seen[seen <= K + 1], minlength=K + 2)
            out, at = [(kind, part, None, None, None, int(seen.sum()), len(seen), few[1:K + 2].tolist())], 0
            for g, k in zip(rows["g"], keys):
                b = at + len(k)
                out.append((kind, part, g, pack(total[of[at:b]]), pack(own[at:b]) if kind == PAIRS else None, None, None, None))
                at = b
            yield pd.DataFrame(out, columns=["kind", "part", "g", "total", "own", "n", "types", "ofs"]).astype(
                {"g": "Int64", "n": "Int64", "types": "Int64"})

    return asked.mapInPandas(run, ANSWER)


def discounts(n: list[int]) -> np.ndarray:
    """What is kept of a count of 1 to K, by Good-Turing; ``n``: how many types have counts 1 to K + 1.

    Where the counts of counts give no proper discount (small or odd corpora), absolute discounting takes its place.
    """
    r = np.arange(1, K + 1)
    n = np.array(n, dtype=float)
    if (n > 0).all():
        over = (K + 1) * n[K] / n[0]
        if over < 1:
            kept = ((r + 1) * n[1:] / n[:-1] / r - over) / (1 - over)
            if ((kept > 0) & (kept < 1)).all():
                return kept * r
    off = n[0] / (n[0] + 2 * n[1]) if n[0] > 0 and n[1] > 0 else 0.5
    return r - off


class Params:
    def __init__(self, tokens: int, types: int, words: list[int], pairs: list[int]):
        self.tokens, self.types = tokens, types
        self.word, self.pair = discounts(words), discounts(pairs)
        taken = float(((np.arange(1, K + 1) - self.word) * np.array(words[:K])).sum()) + RESERVE * (types - sum(words[:K]))
        self.unknown = taken / tokens if tokens else 1.0

    @staticmethod
    def kept(count: np.ndarray, low: np.ndarray) -> np.ndarray:
        return np.where(count > K, count - RESERVE, np.append(0.0, low)[np.minimum(count, K)])

    def word_probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.kept(count, self.word) / max(self.tokens, 1), self.unknown)


STEP = ("kind int, part int, g bigint, keys binary, left binary, mass binary, doc_id binary, flags binary, n_tokens binary, "
        "n_known binary, base binary, score binary, need_doc binary, need_key binary, need_count binary")
DONE, OWNED, NEEDED = 2, 3, 4


def scored_block(row, got: pd.DataFrame, params: Params, ranges: int) -> list[dict]:
    """What a block can score by itself, its share of the sums per history, and the histories whose weight it needs."""
    block = Block(row)
    got = got.sort_values("part")
    total = {k: np.concatenate([unpack(t, np.int64) for t in got["total"][got["kind"] == k]]) for k in (WORDS, PAIRS)}
    own = np.concatenate([unpack(t, np.uint8) for t in got["own"][got["kind"] == PAIRS]]).astype(bool)
    count = np.empty(block.words + 1, dtype=np.int64)
    count[block.word_order] = total[WORDS]
    count[-1] = count[block.words - 1]  # as many begins as ends
    seen = np.empty(len(block.pair_key), dtype=np.int64)
    owner = np.empty(len(block.pair_key), dtype=bool)
    seen[block.pair_order], owner[block.pair_order] = total[PAIRS], own
    word_p = params.word_probability(count)
    kept = params.kept(seen, params.pair)
    history = np.maximum(count[block.pair_before], 1)
    log_p = np.where(seen > 0, np.log10(np.where(seen > 0, kept, 1) / history), np.log10(word_p[block.pair_word]))
    base = np.log10((count + 1) / (params.tokens + 1 * (params.types + 1)))
    sums = lambda v: np.add.reduceat(v, block.starts)
    # Sums per history over the bigrams owned here.
    mine = owner & (seen > 0)
    left = np.bincount(block.pair_before[mine], (seen - kept)[mine], minlength=len(block.hash))
    mass = np.bincount(block.pair_before[mine], word_p[block.pair_word[mine]], minlength=len(block.hash))
    out = []

    def put(kind: int, numbers: np.ndarray, **arrays: np.ndarray) -> None:
        order = np.argsort(block.hash[numbers])
        keys = block.hash[numbers][order]
        at = cut(keys, ranges)
        out.extend({"kind": kind, "part": p, "keys": pack_sorted(keys[a:b]), **{k: pack(v[order][a:b]) for k, v in arrays.items()}}
                   for p, (a, b) in enumerate(zip(at, at[1:])) if b > a)

    some = np.unique(block.pair_before[mine])
    put(OWNED, some, left=left[some], mass=mass[some])
    # Tokens that back off need their history's weight, unless the history was never seen (its weight is 1).
    off = np.flatnonzero((seen[block.of] == 0) & (count[block.before] > 0))
    owner_doc = np.repeat(np.arange(len(block.sizes)), block.sizes)[off]
    needed, which = np.unique(block.before[off], return_inverse=True)
    put(NEEDED, needed)
    order = np.argsort(block.hash[needed])
    place = np.empty(len(needed), dtype=np.int64)
    place[order] = np.arange(len(needed))
    out.append({"kind": DONE, "doc_id": row["doc_id"], "flags": row["flags"], "n_tokens": pack(block.sizes),
                "n_known": pack(sums((count[block.token] > 0).astype(np.int64))), "base": pack(sums(base[block.token])),
                "score": pack(sums(log_p[block.of])), "need_doc": pack(owner_doc.astype(np.uint32)),
                "need_key": pack(place[which].astype(np.uint32)), "need_count": pack(count[needed][order])})
    return [{"g": row["g"], **o} for o in out]


def weights(step: DataFrame) -> DataFrame:
    """log10 of the unnormalised backoff weight (still to be divided by the history's count), in the order asked."""

    def run(frames):
        held = pd.concat([f for f in frames if len(f)] or [pd.DataFrame(columns=["kind", "part", "g", "keys", "left", "mass"])])
        for part, rows in held.groupby("part"):
            owned, needed = rows[rows["kind"] == OWNED].sort_values("g"), rows[rows["kind"] == NEEDED]
            if not len(needed):
                continue
            keys = np.concatenate([np.zeros(0, np.uint64), *[unpack_sorted(k) for k in owned["keys"]]])
            distinct, of = np.unique(keys, return_inverse=True)
            left, mass = [np.bincount(of, np.concatenate([np.zeros(0), *[unpack(x, np.float64) for x in owned[c]]]),
                                      minlength=len(distinct)) for c in ("left", "mass")]
            weight = np.log10(left) - np.log10(np.maximum(1 - mass, 1e-12))
            yield pd.DataFrame([(part, g, pack(weight[np.searchsorted(distinct, unpack_sorted(k))]))
                                for g, k in zip(needed["g"], needed["keys"])], columns=["part", "g", "weight"])

    return step.mapInPandas(run, "part int, g bigint, weight binary")


def finished(row, got: pd.DataFrame, tokens: int) -> pd.DataFrame:
    score = unpack(row["score"], np.float64)
    if len(got):
        weight = np.concatenate([unpack(w, np.float64) for w in got.sort_values("part")["weight"]])
        alpha = weight - np.log10(unpack(row["need_count"], np.int64))
        score = score + np.bincount(unpack(row["need_doc"], np.uint32), alpha[unpack(row["need_key"], np.uint32)], minlength=len(score))
    flags = unpack(row["flags"], np.uint8)
    ids = pd.arrays.IntegerArray(unpack(row["doc_id"], np.int64), flags >= 2)
    return pd.DataFrame({"doc_id": ids, "held_out": flags % 2 == 1, "n_tokens": unpack(row["n_tokens"], np.int64),
                         "n_known": unpack(row["n_known"], np.int64), "train_tokens": np.full(len(score), tokens, dtype=np.int64),
                         "base_score": unpack(row["base"], np.float64), "score": score})


def score(docs: DataFrame, held_out: Column, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """Scores of every text; the model learns from the rows for which ``held_out`` is not true."""
    spark = docs.sparkSession
    need = texts_of(docs, key, text, held_out=F.coalesce(held_out, F.lit(False)))
    stored = materialise(blocks(need, block), "katz-blocks")
    tokens = stored.agg(F.sum("tokens")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-tokens // RANGE))
    given = materialise(answers(requests(stored, ranges).repartition(ranges, "part")), "katz-counts")
    stats = {r["kind"]: r for r in given.where("g IS NULL").groupBy("kind").agg(
        F.sum("n").alias("n"), F.sum("types").alias("types"),
        F.array(*[F.sum(F.col("ofs")[i]) for i in range(K + 1)]).alias("ofs")).collect()}
    words, pairs = stats.get(WORDS), stats.get(PAIRS)
    none = [0] * (K + 1)
    params = Params(words["n"] if words else 0, words["types"] if words else 0, words["ofs"] if words else none, pairs["ofs"] if pairs else none)

    columns = [c.split()[0] for c in STEP.split(", ")]

    def own_part(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = [[o.get(c) for c in columns] for o in scored_block(left.iloc[0], right, params, ranges)]
        return pd.DataFrame(rows, columns=columns, dtype=object)

    asked = given.where("g IS NOT NULL").select("g", "kind", "part", "total", "own")
    step = materialise(stored.groupBy("g").cogroup(asked.groupBy("g")).applyInPandas(own_part, STEP), "katz-steps")
    weight = weights(step.where(F.col("kind").isin(OWNED, NEEDED)).select("kind", "part", "g", "keys", "left", "mass").repartition(ranges, "part"))

    def last(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return finished(left.iloc[0], right, params.tokens)

    return step.where(F.col("kind") == DONE).groupBy("g").cogroup(weight.groupBy("g")).applyInPandas(last, OUT)
