"""SpotSigs: document fingerprints from chains of content words that follow common words. DataFrame functions only.

Signatures. A text's words are its runs of letters and digits, in small letters. Where a word of ``ANCHORS`` (common words of five
languages) stands, it forms a signature with the next ``CHAIN`` words that are no anchors, or with as many as there are, one at
least. A text in which no anchor has such a word after it has one signature, its whole sequence of words. The fingerprint is the
sorted set of the signatures' digests, eight hexadecimal digits each: equal texts have equal fingerprints, and fingerprints can
be compared without the texts.

Likeness is the Jaccard similarity of two sets, pruned by length. Sets are partitioned by length, partition k from ``RATIO``^-k
signatures on; two sets whose partitions lie so far apart that their similarity cannot reach ``LEAST`` are not compared, and
count as unlike (0). All others get their exact similarity.

Documents in order. Every document meets the next one by falling id. Ids are cut into segments of 2^k neighbouring numbers, k
so that no segment holds more than ``ROWS`` rows if ids allow it; a segment is sorted in one task, and only the head of a segment crosses to
the segment before it. Texts move once.

Defined cases: a null text is empty, and texts without a letter or digit have the empty set; two empty sets are alike (1), an
empty and another one are not (0). Rows with equal ids stand by falling XXH64 of their text; null ids come after all others, in the
same order. A table of one row is its own next document. An empty table gives an empty result.
"""

from __future__ import annotations

from math import floor, log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fogbank.llm.common import texts_of
from fogbank.session import materialise

#: Common words of English, German, French, Spanish and Italian, fixed.
ANCHORS = (
    "a", "about", "after", "all", "also", "am", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "do", "for", "from", "had",
    "has", "have", "he", "her", "his", "i", "if", "in", "into", "is", "it", "its", "more", "no", "not", "of", "on", "or", "our", "she", "so",
    "than", "that", "the", "their", "there", "they", "this", "to", "was", "we", "were", "what", "which", "who", "will", "with", "would", "you",
    "aber", "als", "auch", "auf", "aus", "bei", "das", "dass", "dem", "den", "der", "des", "die", "ein", "eine", "einen", "einer", "es",
    "für", "hat", "ich", "im", "ist", "mit", "nach", "nicht", "noch", "nur", "oder", "sich", "sie", "sind", "um", "und", "von", "wie", "wir", "zu",
    "au", "aux", "avec", "ce", "ces", "cette", "dans", "elle", "est", "et", "il", "je", "la", "le", "les", "mais", "ne", "nous", "ou", "par",
    "pas", "plus", "pour", "qui", "sa", "se", "son", "sont", "sur", "un", "une", "vous",
    "al", "como", "con", "de", "del", "el", "ella", "en", "era", "los", "las", "lo", "más", "muy", "o", "para", "pero", "por", "que", "sin",
    "su", "sus", "y", "ya", "che", "di", "e", "gli", "non", "per", "si", "sono", "una", "uno")
CHAIN = 2
RATIO, LEAST = 0.8, 0.1
#: Partitions further apart than this hold no two sets with a similarity of LEAST.
REACH = 1 + floor(log(LEAST) / log(RATIO))
ROWS = 2048
DIGITS = 8


def signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the sorted set of the signatures of ``text`` in ``out``."""
    words, places, content = f"_{out}_words", f"_{out}_places", f"_{out}_content"
    split = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    marked = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*ANCHORS), i)), lambda i: i.isNotNull())

    def digest(c) -> Column:
        return F.substring(F.md5(c), 1, DIGITS)

    def chain(i: Column, j: Column) -> Column:
        # j anchors stand before the one at i, so i - j content words do.
        return F.when(i - j < F.size(content), digest(F.concat_ws(" ", F.get(words, i), *[F.get(content, i - j + c) for c in range(CHAIN)])))

    some = F.filter(F.transform(places, chain), lambda s: s.isNotNull())
    whole = F.when(F.size(words) > 0, F.array(digest(F.concat_ws(" ", words)))).otherwise(F.array().cast("array<string>"))
    return (df.withColumn(words, split)
            .withColumns({places: marked, content: F.filter(words, lambda w: ~w.isin(*ANCHORS))})
            .withColumn(out, F.sort_array(F.array_distinct(some)))
            .withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(whole)).drop(words, places, content))


def partition(signature_set: Column) -> Column:
    """Length partition of a set; the empty set has none."""
    return F.floor(F.log(F.nullif(F.size(signature_set), F.lit(0)).cast("double")) / F.lit(log(1 / RATIO))).cast("int")


def likeness(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    far = F.abs(partition(a) - partition(b)) > REACH
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).when((F.size(a) == 0) | (F.size(b) == 0) | far, F.lit(0.0))
            .otherwise(both.cast("double") / (F.size(a) + F.size(b) - both)))


def segments(need: DataFrame, rows: int = ROWS) -> DataFrame:
    """``need`` with ``kind`` (1: null id) and ``seg``; both rise while ids fall."""
    low, high, n, nulls = need.agg(F.min("doc_id"), F.max("doc_id"), F.count("doc_id"), F.count_if(F.col("doc_id").isNull())).first()
    fine = lambda k: F.bitwise_not(F.shiftright("doc_id", k))
    k = max(0, min(62, ((high - low + 1) * rows // n).bit_length() - 1)) if n else 0
    # Where ids are uneven, finer segments keep the fullest one small.
    while k and (need.where("doc_id IS NOT NULL").groupBy(fine(k).alias("s")).count().agg(F.max("count")).first()[0] > 2 * rows):
        k = max(0, k - 2)
    bits = min(62, (max(nulls, 1) // rows).bit_length())
    by_hash = F.bitwise_not(F.shiftright("h", 63 - bits))
    return need.withColumn("kind", F.col("doc_id").isNull().cast("int")).withColumn("seg", F.when(F.col("doc_id").isNull(), by_hash).otherwise(fine(k)))


def before(held: DataFrame) -> DataFrame:
    """``kind, seg, to_kind, to_seg``: every segment that holds rows with the one before it; the first one follows the last."""
    held = held.select("kind", "seg", F.shiftright("seg", 12).alias("block"))
    near = held.withColumn("before", F.lag("seg").over(Window.partitionBy("kind", "block").orderBy("seg")))
    # Blocks of 4,096 segments: the one window over all of them sees a row per block.
    blocks = held.groupBy("kind", "block").agg(F.min("seg").alias("low"), F.max("seg").alias("high"))
    order = Window.orderBy("kind", "block")
    last = F.max(F.struct("kind", "high")).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    border = blocks.select("kind", "block", "low", F.coalesce(F.lag(F.struct("kind", "high")).over(order), last).alias("b"))
    return near.join(border, ["kind", "block"]).select(
        "kind", "seg", F.when(F.col("before").isNull(), F.col("b.kind")).otherwise(F.col("kind")).alias("to_kind"),
        F.coalesce("before", "b.high").alias("to_seg"))


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """``doc_id, text, sigs`` and the same of the next document, ``next_text, next_sigs``."""
    need = texts_of(docs, key, text).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    cut = segments(need, rows)
    order = Window.partitionBy("kind", "seg").orderBy(F.col("doc_id").desc_nulls_last(), F.col("h").desc())
    # The tasks that read keep their heads only, before anything is shuffled.
    heads = materialise(cut.withColumn("at", F.row_number().over(order)).where("at = 1").select("kind", "seg", "text"), "spots-heads")
    heads = heads.join(before(heads), ["kind", "seg"]).select(F.col("to_kind").alias("kind_"), F.col("to_seg").alias("seg_"), F.col("text").alias("text_"))
    heads = signatures(heads, "text_", "sigs_")
    # Dealt out before the signatures are made, so that these do not travel.
    own = signatures(cut.repartition("kind", "seg"), "text", "sigs").withColumn("next", F.lead(F.struct("text", "sigs")).over(order))
    met = own.join(heads, (F.col("kind") == F.col("kind_")) & (F.col("seg") == F.col("seg_")) & F.col("next").isNull(), "left")
    return met.select("doc_id", "text", "sigs", F.coalesce("next.text", "text_").alias("next_text"), F.coalesce("next.sigs", "sigs_").alias("next_sigs"))


def fingerprint(signature_set: str) -> Column:
    return F.array_join(signature_set, "")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", rows: int = ROWS) -> DataFrame:
    """Per document its fingerprint, that of its edited text (the second half replaced by the beginning of the next document), and
    the likeness of its own to that one and to the next document's."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next_text", F.lit(1), half))
    both = signatures(with_next(docs, key, text, rows).withColumn("edited", edited), "edited", "edited_sigs")
    return both.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("sigs").alias("fingerprint"), fingerprint("edited_sigs").alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
        F.size("sigs").cast("long").alias("n_signatures"))
