"""Order MinHash document fingerprints, in DataFrame functions only.

A text's k-mers are runs of k words, one that ends at each word; those at the text's first words are as much shorter as words are missing before them. Each carries its occurrence number (0 for the first time the k-mer comes in the text, 1 for the
next), so that a multiset of k-mers is a set of numbered ones. A hash of (k-mer, number) deals the set into `buckets` buckets by
its high bits (one permutation, hashed once, gives all signatures). In each bucket the `length` smallest hashes are chosen, put
back into text order, and hashed as a tuple: moving a passage keeps the k-mers but changes the order of the chosen ones, so
signatures follow edit distance and not just content. Likeness is the share of the buckets that either text fills in which both
signatures agree.

Defined cases: a null text counts as empty; an empty text has the empty fingerprint, which is like only another empty one (1.0) and
unlike every other (0.0); repeated words and lines get rising occurrence numbers;
order is exact for texts of any length (positions have 30 bits, and Spark's strings end at 2**31 bytes); equal texts have equal fingerprints. Columns of the input other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenframe.llm.common import block_bounds, block_of, id_key, let, partitions, words

_POS = 30
_HASH = 33
_POS_MASK, _HASH_MASK = (1 << _POS) - 1, (1 << _HASH) - 1


def _long(x: int) -> Column:
    return F.lit(x).cast("long")


def _packed(h: Column, pos: Column) -> Column:
    """33 bits of hash over 30 bits of position: sorts by hash, and carries the place in the text."""
    return F.shiftleft(h.bitwiseAND(_long(_HASH_MASK)), _POS).bitwiseOR(pos.cast("long").bitwiseAND(_long(_POS_MASK)))


def _hash(x: Column) -> Column:
    return F.shiftright(x, _POS)


def kmer_hashes(text: Column, k: int) -> Column:
    """A hash for each word with the k - 1 before it, as many as there are, in text order; none for an empty text."""

    def of(ws: Column) -> Column:
        return F.transform(ws, lambda w, i: F.xxhash64(*[F.get(ws, i - j) for j in range(k - 1, 0, -1)], w))

    return let(F.transform(words(text), lambda w: F.xxhash64(w)), of)


def _numbered(sorted_: Column) -> Column:
    """Rehashes sorted (k-mer, position) entries, of which there is one at least, together with their occurrence numbers."""

    def with_starts(s: Column) -> Column:
        n = F.size(s)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (_hash(F.get(s, j)) != _hash(F.get(s, j - 1))))

        def number(st: Column) -> Column:
            runs = F.flatten(F.transform(st, lambda at, q: F.sequence(F.lit(0), F.coalesce(F.get(st, q + 1), n) - at - 1)))
            plain = F.transform(s, lambda x: _packed(F.xxhash64(_hash(x), F.lit(0)), x))
            return F.when(F.size(st) == n, plain).otherwise(let(runs, lambda occ: F.transform(s, lambda x, j: _packed(F.xxhash64(_hash(x), F.get(occ, j)), x))))

        return let(starts, number)

    return let(sorted_, with_starts)


def signatures(text: Column, k: int = 5, buckets: int = 64, length: int = 2) -> Column:
    """array<bigint>: for each bucket with an entry, bucket << 32 | 32 bits of the hash of its ordered tuple; ascending. buckets: a power of two."""
    shift = _HASH - (buckets.bit_length() - 1)

    def bucket(x: Column) -> Column:
        return F.shiftright(x, _POS + shift)

    def choose(g: Column) -> Column:
        return F.filter(g, lambda x, j: (j < length) | (bucket(F.get(g, j - length)) != bucket(x)))

    def sign(sel: Column) -> Column:
        n = F.size(sel)
        firsts = F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (bucket(F.get(sel, j)) != bucket(F.get(sel, j - 1))))

        def each(st: Column) -> Column:
            def one(at: Column, q: Column) -> Column:
                chosen = F.slice(sel, at + 1, F.coalesce(F.get(st, q + 1), n) - at)
                in_text_order = F.sort_array(F.transform(chosen, lambda x: F.shiftleft(x.bitwiseAND(_long(_POS_MASK)), _HASH).bitwiseOR(_hash(x))))
                tuple_hash = F.xxhash64(F.transform(in_text_order, lambda y: y.bitwiseAND(_long(_HASH_MASK))))
                return F.shiftleft(bucket(F.get(sel, at)), 32).bitwiseOR(tuple_hash.bitwiseAND(_long(0xFFFFFFFF)))

            return F.transform(st, one)

        return let(firsts, each)

    def whole(h: Column) -> Column:
        entries = F.sort_array(F.transform(h, lambda x, i: _packed(x, i)))
        return F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(let(let(F.sort_array(_numbered(entries)), choose), sign))

    return let(kmer_hashes(text, k), whole)


def as_text(sig: Column) -> Column:
    """Ten hexadecimal digits a bucket: two name it, eight are its signature."""
    return F.array_join(F.transform(sig, lambda x: F.lower(F.lpad(F.hex(x), 10, "0"))), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of the buckets filled by either in which both agree; 1 where neither has any."""
    agree = F.size(F.array_intersect(a, b)).cast("double")
    filled = F.size(F.array_union(F.transform(a, lambda x: F.shiftright(x, 32)), F.transform(b, lambda x: F.shiftright(x, 32))))
    return F.when(filled == 0, F.lit(1.0)).otherwise(agree / filled)


def fingerprint(df: DataFrame, text: str = "text", out: str = "fingerprint", **params) -> DataFrame:
    """df with a column of signatures for its text column."""
    return df.withColumn(out, signatures(F.col(text), **params))


def with_next(df: DataFrame) -> DataFrame:
    """(doc_id, text) in, (doc_id, text, sig, next_text, next_sig) out: each row beside its successor by ascending doc_id (ties by text), the last beside the first.

    Rows are dealt to ranges of doc_id, one a partition, and sorted within each. A copy of each range's first row
    is added at the end of the range before, so that successors never cross a task.
    """
    spark = df.sparkSession
    p = partitions(spark)
    docs = df.select(F.col("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    key = id_key()
    bounds = block_bounds(docs, key, p)
    keyed = docs.select("doc_id", "text", key.alias("key"), block_of(key, bounds).alias("block"))
    # One row a block, and so as many as there are bounds, whatever the table's size.
    firsts = sorted((r["block"], r["key"]) for r in keyed.groupBy("block").agg(F.min("key").alias("key")).collect())
    if not firsts:
        before = keyed.limit(0).withColumn("added", F.lit(True))
    else:
        into = {firsts[i][0]: firsts[i - 1][0] for i in range(len(firsts))}
        target = F.create_map(*[F.lit(x) for pair in into.items() for x in pair])
        head = keyed.where(F.col("key").isin([k for _, k in firsts])).groupBy("block").agg(F.min_by(F.struct("doc_id", "text", "key"), F.struct("key", "text")).alias("r"))
        before = head.select("r.doc_id", "r.text", "r.key", target[F.col("block")].cast("int").alias("block"), F.lit(True).alias("added"))
    rows = keyed.withColumn("added", F.lit(False)).unionByName(before).repartitionById(p, "block")
    w = Window.partitionBy("block").orderBy("added", "key", "text")
    signed = rows.withColumn("sig", signatures(F.col("text")))
    return signed.select("doc_id", "text", "sig", "added", F.lead("text").over(w).alias("next_text"), F.lead("sig").over(w).alias("next_sig")).where(~F.col("added")).drop("added")


def half_edited(text: Column, following: Column) -> Column:
    """text with its last floor(n / 2) code points replaced by the first as many (or all) of the following text."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(following, F.lit(1), half))


def compare_with_edited(df: DataFrame) -> DataFrame:
    """The columns of query op2 for a table of doc_id and text."""
    pairs = with_next(df).withColumn("edited", half_edited(F.col("text"), F.col("next_text")))
    both = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "sig", "next_sig", signatures(F.col("edited")).alias("edited_sig"))
    return both.select(
        "doc_id", "n_chars", "edited_sha256", as_text(F.col("sig")).alias("fingerprint"), as_text(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )
