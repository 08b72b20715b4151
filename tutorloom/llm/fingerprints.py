"""Document fingerprints by Order MinHash, in DataFrame functions only.

A text is cut into tokens (runs of visible characters, at most ``TOKEN_CHARS`` long, so that text without spaces has tokens
too); every ``K`` consecutive tokens are a k-mer, and equal k-mers are told apart by their occurrence number. One hash of
(k-mer, occurrence) deals the pairs to ``BINS`` bins and orders them there. From each bin the ``KEPT`` minimal pairs are
selected, put back in text order, and the tuple of their k-mers is hashed: the bin's part of the fingerprint. Two texts agree
in a bin only if they share these k-mers in the same order, so the share of equal bins falls with edit distance, not just with
set difference.

The fingerprint is a string of ``BINS`` groups of four hexadecimal digits, ``----`` for a bin without pairs. Likeness is the
share of equal groups among those that aren't empty in both, and 1 for equal fingerprints.

Defined results: a null text is empty; texts without visible characters have the empty fingerprint, ``----`` throughout; a text
with fewer than ``K`` tokens has one k-mer of all its tokens; texts that differ in white space alone have equal fingerprints.
Rows with a repeated id follow one another in no defined order; a row without an id has no next document, its edited text is
its text and both likenesses are 1. Ids are integers; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tutorloom.functions.text import let
from tutorloom.llm.common import small_or_not, written

TOKEN_CHARS, K, BINS, KEPT = 16, 3, 64, 2
SPAN = 6  # documents whose ids agree but for these low bits are brought together to find the next text
EMPTY = "----"
LOW = (1 << 32) - 1


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _position(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW)).cast("int")


def _item(array: Column, i: Column) -> Column:
    return F.coalesce(F.get(array, i), F.lit(0).cast("bigint"))  # never null, so that arrays stay primitive


def _starts(array: Column, key) -> Column:
    """Indexes of a sorted array where ``key`` changes; empty for an empty array."""
    return F.filter(F.transform(array, lambda _, i: i), lambda i: (i == 0) | (key(_item(array, i)) != key(_item(array, i - 1))))


def with_fingerprint(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with column ``name``: the fingerprint of column ``text``. Steps that are read more than once are columns of their own."""
    kept = df.columns
    hashes, kmers, packed, firsts, numbered = (F.col(f"__{name}_{x}") for x in ("hashes", "kmers", "packed", "firsts", "numbered"))

    def step(df: DataFrame, column: str, value: Column) -> DataFrame:
        return df.withColumn(f"__{name}_{column}", value)

    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"\S{{1,{TOKEN_CHARS}}}"), F.lit(0))
    df = step(df, "hashes", F.transform(tokens, lambda t: F.xxhash64(t)))
    complete = F.slice(hashes, 1, F.greatest(F.size(hashes) - K + 1, F.least(F.size(hashes), F.lit(1))))
    df = step(df, "kmers", F.transform(complete, lambda h, i: F.xxhash64(h, *(F.get(hashes, i + j) for j in range(1, K)))))
    # the k-mer's hash in the high half, its position in the low half
    df = step(df, "packed", F.sort_array(F.transform(kmers, lambda h, i: F.shiftleft(h, 32).bitwiseOR(i.cast("bigint")))))
    df = step(df, "firsts", _starts(packed, _high))

    def numbering(x: Column, nth: Column) -> Column:
        return F.shiftleft(_high(F.xxhash64(_high(x), nth)), 32).bitwiseOR(x.bitwiseAND(F.lit(LOW)))

    runs = F.transform(firsts, lambda start, j: F.struct(start.alias("start"), F.coalesce(F.get(firsts, j + 1), F.size(packed)).alias("end")))
    again = F.transform(
        F.filter(runs, lambda r: r["end"] - r["start"] > 1),
        lambda r: F.transform(F.sequence(r["start"] + 1, r["end"] - 1), lambda i: numbering(_item(packed, i), i - r["start"])),
    )
    df = step(df, "numbered", F.sort_array(F.concat(F.transform(firsts, lambda i: numbering(_item(packed, i), F.lit(0))), F.flatten(again))))

    shift = 64 - (BINS.bit_length() - 1)  # a bin is the top bits of the hash, so sorting keeps it together

    def bin_of(x: Column) -> Column:
        return F.shiftrightunsigned(x, shift).cast("int")

    def group(i: Column) -> Column:
        first, second = _item(numbered, i), _item(numbered, i + 1)
        a, b = F.get(kmers, _position(first)), F.get(kmers, _position(second))
        alone = (i + 1 >= F.size(numbered)) | (bin_of(first) != bin_of(second))
        value = F.when(alone, F.xxhash64(a)).when(_position(first) < _position(second), F.xxhash64(a, b)).otherwise(F.xxhash64(b, a))
        return F.struct(bin_of(first).alias("bin"), F.lower(F.lpad(F.hex(value.bitwiseAND(F.lit(0xFFFF))), 4, "0")).alias("group"))

    found = F.map_from_entries(F.transform(_starts(numbered, bin_of), group))
    bins = let(found, lambda m: F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda b: F.coalesce(F.try_element_at(m, b), F.lit(EMPTY))))
    return df.withColumn(name, F.array_join(bins, "")).select(*kept, name)


def likeness(a: Column, b: Column) -> Column:
    """Share of equal groups among the groups that aren't empty in both fingerprints."""
    group = F.sequence(F.lit(0), F.lit(BINS - 1))

    def groups(x: Column) -> Column:
        return F.transform(group, lambda i: F.substring(x, i * 4 + 1, F.lit(4)))

    def share(x: Column) -> Column:
        filled = F.size(F.filter(x, lambda g: (g["a"] != EMPTY) | (g["b"] != EMPTY)))
        return F.size(F.filter(x, lambda g: (g["a"] != EMPTY) & (g["a"] == g["b"]))) / filled

    pairs = F.zip_with(groups(a), groups(b), lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.when(a == b, F.lit(1.0)).otherwise(let(pairs, share))


def _next_keys(keys: DataFrame) -> DataFrame:
    """(key, next_key) of distinct integer ``key`` in order; null after the last. No window holds more than 2**16 keys.

    Keys that agree but for 16 low bits are ordered together; the last of them is followed by the first key of the next
    such group, which the same step finds one level up, where a group is one row.
    """
    levels = [keys.select(F.col("key").alias("first"), F.col("key").alias("group"))]
    for _ in range(3):
        levels.append(levels[-1].groupBy(F.shiftright("group", 16).alias("group")).agg(F.min("first").alias("first")))
    follow = None  # (group, next_first) of the level above
    for level in reversed(levels):
        above = F.lit(0) if follow is None else F.shiftright("group", 16)  # the topmost level is one group of at most 2**16
        near = level.select("first", "group", F.lead("first").over(Window.partitionBy(above).orderBy("group")).alias("near"), above.alias("above"))
        if follow is not None:
            near = near.join(follow, "above", "left").withColumn("near", F.coalesce("near", "far"))
        follow = near.select(F.col("group").alias("above"), F.col("near").alias("far"))
    return follow.select(F.col("above").alias("key"), F.col("far").alias("next_key"))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with its ``fingerprint`` and the text and fingerprint of the following row by doc_id; the first row follows the last.

    Rows without an id have no next row. A text moves once, with the at most ``2 ** SPAN`` ids of its bucket.
    """
    bucket = F.shiftright(F.col("doc_id").cast("bigint"), SPAN)
    known = docs.where("doc_id IS NOT NULL")
    row = F.struct("text", "fingerprint")
    bucketed = with_fingerprint(known.withColumn("bucket", bucket), "text", "fingerprint")
    inside = bucketed.withColumn("after", F.lead(row).over(Window.partitionBy("bucket").orderBy("doc_id")))
    # the first row of a bucket follows the last row of the bucket before it
    opening = written(known.groupBy(bucket.alias("key")).agg(F.min("doc_id").alias("doc_id")), "openings")
    firsts = with_fingerprint(known.join(small_or_not(opening.select("doc_id")), "doc_id", "left_semi"), "text", "fingerprint")
    firsts = firsts.select(bucket.alias("next_key"), row.alias("opening")).dropDuplicates(["next_key"])
    lowest = opening.agg(F.min("key")).first()[0]
    following = _next_keys(opening.select("key")).select("key", F.coalesce("next_key", F.lit(lowest)).alias("next_key"))
    openings = following.join(firsts, "next_key").select("key", "opening")
    after = F.coalesce("after", "opening")
    linked = inside.join(openings, F.col("bucket") == F.col("key"), "left")
    linked = linked.select("doc_id", "text", "fingerprint", after["text"].alias("next_text"), after["fingerprint"].alias("next_fingerprint"))
    nothing = F.lit(None).cast("string")
    loose = with_fingerprint(docs.where("doc_id IS NULL"), "text", "fingerprint")
    return linked.unionByName(loose.select("doc_id", "text", "fingerprint", nothing.alias("next_text"), nothing.alias("next_fingerprint")))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, text, edited, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text is the text with the last quarter of its code points replaced by the first as many of the next
    document's, by ascending id (the first document follows the last).
    """
    given = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    sized = with_next(given).withColumn("n_chars", F.char_length("text").cast("bigint"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring("next_text", F.lit(1), quarter))
    edited = sized.select("doc_id", "text", "n_chars", "fingerprint", "next_fingerprint", F.coalesce(edited, F.col("text")).alias("edited"))
    result = with_fingerprint(edited, "edited", "edited_fingerprint")
    return result.select(
        F.col("doc_id").alias(doc_id),
        "n_chars",
        F.col("text").alias(text),
        "edited",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("next_fingerprint", "fingerprint")).alias("near_next"),
    )
