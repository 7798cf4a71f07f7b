"""Sparse document-term matrices in shards, for the operators that count words of whole tables.

A shard holds the rows of some neighbouring texts in compressed sparse form: the distinct words of each text as numbers, sorted,
with their counts. Within a shard a word's number is its place in the shard's vocabulary, which is ordered by the words' 64-bit
hashes; shards are cut at about ``SHARD`` words, one text at least. Arrays travel and are stored packed (see ``katz.pack``).

``numbered`` gives words numbers that hold for all shards: every shard sends its vocabulary once, cut by hash range, the task
of a range numbers the words it meets (by the words themselves, not by their hashes), and the shards get the numbers back in
the order they asked. A frequent word is sent once per shard, whatever its share of the text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fogbank.llm.common import chunks
from fogbank.llm.katz import cut, pack, unpack
from fogbank.session import materialise

SHARD = 1 << 21
#: Distinct words a task numbers at once, about.
RANGE = 1 << 20
SCHEMA = ("shard bigint, n_docs bigint, n_words bigint, n_vocab bigint, null_id binary, doc_id binary, words binary, distinct binary, "
          "codes binary, counts binary, hashes binary, vocab binary, part binary, parts array<string>, flags binary, digest binary")
#: ``n_docs`` counts the texts with a word; ``words`` and ``distinct`` are per text.
#: Splits texts into words: the words of all texts in one array, and how many each has.
Split = Callable[[pa.Array], tuple[pa.Array, np.ndarray]]
#: Flags (0 to 255) and 16-byte digests of texts.
Mark = Callable[[list], tuple[np.ndarray, bytes]]


def split_at_spaces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Maximal runs of anything but space, \\t, \\n, \\v, \\f and \\r."""
    lists = pc.ascii_split_whitespace(texts)
    words = lists.flatten()
    real = pc.greater(pc.binary_length(words), 0)
    sizes = np.bincount(np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))[real.to_numpy(zero_copy_only=False)], minlength=len(texts))
    return words.filter(real), sizes


def hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest as h

    return np.fromiter(map(h, words), dtype=np.uint64, count=len(words))


def pack_text(words: list[bytes]) -> bytes:
    """Words without white space, compressed."""
    import zstandard

    return zstandard.ZstdCompressor(level=1).compress(b"\n".join(words))


def unpack_text(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    return raw.split(b"\n") if raw else []


def shards(docs: DataFrame, split: Split, words: bool = False, mark: Mark | None = None, size: int = SHARD) -> DataFrame:
    """The shards of ``doc_id, part, text``; with ``words`` they hold the vocabulary itself, else only its hashes.

    A null text is empty; a null part is the empty text.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    types = to_arrow_schema(StructType.fromDDL(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 32, 0
        held: dict[str, list] = {k: [] for k in ("doc", "null", "part", "words", "sizes", "flags", "digest")}

        def flush() -> pa.RecordBatch:
            sizes = np.concatenate(held["sizes"])
            coded = pa.chunked_array(held["words"], pa.string()).combine_chunks().dictionary_encode()
            known = coded.dictionary.cast(pa.binary()).to_pylist()
            key = hashes(known)
            order = np.argsort(key, kind="stable")
            rank = np.empty(len(known), dtype=np.int64)
            rank[order] = np.arange(len(known))
            v = max(len(known), 1)
            cells = np.sort(np.repeat(np.arange(len(sizes)), sizes) * v + rank[coded.indices.to_numpy(zero_copy_only=False)])
            first = np.flatnonzero(np.append(True, cells[1:] != cells[:-1])) if len(cells) else np.zeros(0, dtype=np.int64)
            row, code = np.divmod(cells[first], v)
            parts = pa.chunked_array(held["part"], pa.string()).combine_chunks().dictionary_encode()
            u32 = lambda x: pack(np.asarray(x).astype(np.uint32))
            out = {"shard": base + made, "n_docs": int((sizes > 0).sum()), "n_words": int(sizes.sum()), "n_vocab": len(known),
                   "null_id": pack(np.concatenate(held["null"]).astype(np.uint8)), "doc_id": pack(np.concatenate(held["doc"])),
                   "words": u32(sizes), "distinct": u32(np.bincount(row, minlength=len(sizes))), "codes": u32(code),
                   "counts": u32(np.diff(np.append(first, len(cells)))),
                   "hashes": None if words else pack(np.diff(key[order], prepend=np.uint64(0))),
                   "vocab": pack_text([known[i] for i in order]) if words else None,
                   "part": u32(parts.indices.to_numpy()), "parts": parts.dictionary.to_pylist(),
                   "flags": pack(np.concatenate(held["flags"])) if mark else None, "digest": b"".join(held["digest"]) if mark else None}
            for some in held.values():
                some.clear()
            return pa.RecordBatch.from_arrays([pa.array([out[f.name]], f.type) for f in types], schema=types)

        kept = 0
        for chunk in chunks(batches):
            texts = chunk.column("text").fill_null("")
            ids = chunk.column("doc_id")
            found, sizes = split(texts)
            held["words"].append(found)
            held["sizes"].append(sizes)
            held["doc"].append(ids.fill_null(0).to_numpy())
            held["null"].append(ids.is_null().to_numpy(zero_copy_only=False))
            held["part"].append(chunk.column("part").fill_null(""))
            if mark:
                flags, digest = mark(texts.cast(pa.binary()).to_pylist())
                held["flags"].append(flags)
                held["digest"].append(digest)
            kept += len(found)
            if kept >= size:
                yield flush()
                kept, made = 0, made + 1
        if held["doc"]:
            yield flush()

    return docs.select("doc_id", "part", "text").mapInArrow(run, SCHEMA)


def requests(stored: DataFrame, ranges: int) -> DataFrame:
    """Every shard's vocabulary, cut by hash range."""

    def run(frames):
        for frame in frames:
            for shard, vocab in zip(frame["shard"], frame["vocab"]):
                known = unpack_text(vocab)
                at = cut(hashes(known), ranges)
                rows = [(p, shard, pack_text(known[a:b])) for p, (a, b) in enumerate(zip(at, at[1:])) if b > a]
                yield pd.DataFrame(rows, columns=["range", "shard", "vocab"])

    return stored.select("shard", "vocab").mapInPandas(run, "range int, shard bigint, vocab binary")


def numbers(asked: DataFrame, ranges: int) -> DataFrame:
    """A number for every word asked for, in the order asked: place among the words of its task, times ranges, plus its range.

    All requests for a range meet in one task, so equal words get equal numbers and different words different ones.
    """

    def run(frames):
        held = pd.concat([f for f in frames if len(f)] or [pd.DataFrame(columns=["range", "shard", "vocab"])])
        held = held.sort_values(["range", "shard"])
        for part, rows in held.groupby("range"):
            words = [pa.array(unpack_text(v), pa.binary()) for v in rows["vocab"]]
            place = pa.chunked_array(words).combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            ends = np.cumsum([len(w) for w in words])
            yield pd.DataFrame([(part, shard, pack(place[end - len(w):end] * ranges + part)) for shard, w, end in zip(rows["shard"], words, ends)],
                               columns=["range", "shard", "numbers"])

    return asked.repartition(ranges, "range").mapInPandas(run, "range int, shard bigint, numbers binary")


CSR = ("shard bigint, null_id binary, doc_id binary, part binary, parts array<string>, flags binary, digest binary, "
       "starts binary, columns binary, counts binary")


def numbered(stored: DataFrame) -> DataFrame:
    """The shards with word numbers that hold for all of them: row starts, columns (numbers) and counts of the matrix."""
    spark = stored.sparkSession
    total = stored.agg(F.sum("n_vocab")).first()[0] or 0
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE))
    given = materialise(numbers(requests(stored, ranges), ranges), "matrix-numbers")

    def own(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        row = left.iloc[0]
        of = np.concatenate([np.zeros(0, np.int64), *[unpack(n, np.int64) for n in right.sort_values("range")["numbers"]]])
        starts = np.append(0, np.cumsum(unpack(row["distinct"], np.uint32).astype(np.int64)))
        out = {"starts": pack(starts), "columns": pack(of[unpack(row["codes"], np.uint32)])}
        names = [c.split()[0] for c in CSR.split(", ")]
        return pd.DataFrame([[out.get(c, row.get(c)) for c in names]], columns=names)

    left = stored.select("shard", "null_id", "doc_id", "part", "parts", "flags", "digest", "distinct", "codes", "counts")
    return left.groupBy("shard").cogroup(given.groupBy("shard")).applyInPandas(own, CSR)
