"""Homomorphic multiset hashes of documents, in DataFrame operations only.

A document is the multiset of its paragraphs (lines, cut into sentences). Each paragraph is
hashed to a wide vector and the vectors are summed lane by lane modulo a power of two, so the
fingerprint does not depend on their order and a paragraph is put in or taken out by adding
or subtracting its vector. Two parts:

* ``LANES`` dense lanes of 32 bits, to which every paragraph adds: equality of multisets.
* a count lane and ``STABLE`` lanes to which every paragraph adds a Cauchy number drawn by its
  hash. The difference of two such sums is a Cauchy number as wide as the number of paragraphs,
  copies counted, that only one of the documents has (1-stable sums), however long both are; the
  median over the lanes estimates it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillworks.config import stage_table
from tillworks.llm.ranges import buckets

LANES = 8
STABLE = 64
UNIT = 256  # steps of a stable lane to one paragraph
MOST = 1 << 20  # Cauchy numbers beyond this are cut; one in 1.6 million is
POWER = 1 << 32


def paragraphs(text: Column) -> Column:
    """The non-blank paragraphs of a text; none for null or empty text.

    Lines, cut after sentence ends, without white space around them.
    """
    cut = F.split(F.coalesce(text, F.lit("")), r"[\n\r]+|(?<=[.!?]) +")
    return F.filter(F.transform(cut, lambda p: F.trim(p)), lambda p: p != "")


def hashes(units: Column) -> Column:
    """For each paragraph of an array its hash ``a`` and a second one, ``wide``."""
    return F.transform(units, lambda u: F.struct(F.xxhash64(u).alias("a"), F.xxhash64(F.lit("lane"), u).alias("wide")))


def sums(found: Column) -> Column:
    """The fingerprint of an array of :func:`hashes`: ``LANES + 1 + STABLE`` sums modulo 2**32, all zero for none.

    Terms are under 2**32 and an array has under 2**31 of them, so the modulus is taken once.
    """
    zero = F.lit(0).cast("long")

    def total(of) -> Column:
        return F.aggregate(found, zero, lambda s, h: s + of(h), lambda s: F.pmod(s, F.lit(POWER)))

    # Each lane takes its own hash of the paragraph's two hashes.
    own = lambda h, i: F.pmod(F.xxhash64(F.lit(i), h["a"], h["wide"]), F.lit(POWER))

    def cauchy(h: Column, i: int) -> Column:
        x = F.tan((own(h, i) + 0.5) * (math.pi / POWER) - math.pi / 2)
        return F.rint(F.greatest(F.least(x, F.lit(float(MOST))), F.lit(-float(MOST))) * UNIT).cast("long")

    dense = [total(lambda h, i=i: own(h, i)) for i in range(LANES)]
    stable = [total(lambda h, i=i: cauchy(h, i)) for i in range(LANES, LANES + STABLE)]
    return F.array(*dense, total(lambda h: F.lit(1).cast("long")), *stable)


def vector(units: Column) -> Column:
    """The fingerprint of an array of paragraphs as one expression; :func:`with_vector` is the form for whole tables."""
    return sums(hashes(units))


def with_vector(df: DataFrame, text: str, name: str) -> DataFrame:
    """``df`` with the fingerprint of column ``text`` as column ``name``; null for null text.

    Paragraphs and their hashes are columns of their own, so that each is computed once and
    not once in every lane.
    """
    units, found = f"{name}_units", f"{name}_hashes"
    df = df.withColumn(units, F.when(F.col(text).isNotNull(), paragraphs(F.col(text))))
    df = df.withColumn(found, hashes(F.col(units)))
    return df.withColumn(name, F.when(F.col(text).isNotNull(), sums(F.col(found)))).drop(units, found)


def add(a: Column, b: Column) -> Column:
    """Fingerprint of the union of two multisets."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x + y, F.lit(POWER)))


def subtract(a: Column, b: Column) -> Column:
    """Fingerprint of multiset ``a`` without the paragraphs of ``b``."""
    return F.zip_with(a, b, lambda x, y: F.pmod(x - y, F.lit(POWER)))


def likeness(a: Column, b: Column) -> Column:
    """1 for equal fingerprints, else an estimate of the multiset Jaccard resemblance, under 1.

    The paragraphs that differ are estimated with a standard error of about a fifth of their
    number (``1.57 / sqrt(STABLE)``) whatever the length, and lie between the difference and the
    sum of the two counts. Good for documents that differ in up to about a million paragraphs.
    """
    half = F.lit(POWER // 2)
    gaps = F.zip_with(F.slice(a, LANES + 2, STABLE), F.slice(b, LANES + 2, STABLE), lambda x, y: F.abs(F.pmod(x - y + half, F.lit(POWER)) - half))
    gaps = F.array_sort(gaps)
    n, m = F.get(a, F.lit(LANES)), F.get(b, F.lit(LANES))
    middle = (F.get(gaps, F.lit(STABLE // 2 - 1)) + F.get(gaps, F.lit(STABLE // 2))) / (2 * UNIT)
    apart = F.greatest(F.least(middle, n + m), F.abs(n - m).cast("double"))
    # Unequal documents stay under 1.
    return F.when(a == b, F.lit(1.0)).otherwise(F.least((n + m - apart) / (n + m + apart), F.lit(0.999)))


def text_of(v: Column) -> Column:
    """Lower-case hex of all lanes."""
    return F.array_join(F.transform(v, lambda x: F.lower(F.lpad(F.hex(x), 8, "0"))), "")


def _edited(text: Column, after: Column) -> Column:
    """``text`` with its last half replaced by as many characters from the start of ``after``."""
    n = F.char_length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - half), F.substring(after, F.lit(1), half))


def _compared(df: DataFrame) -> DataFrame:
    """From (doc_id, text, vec, next_text, next_vec): the fingerprints and their likenesses."""
    df = df.withColumn("edited", _edited(F.col("text"), F.col("next_text")))
    df = with_vector(df, "edited", "edited_vec")
    return df.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        text_of(F.col("vec")).alias("fingerprint"),
        text_of(F.col("edited_vec")).alias("edited_fingerprint"),
        likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
        likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row; null text counts as empty."""
    return with_vector(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "fingerprint").select("doc_id", "fingerprint")


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and their likeness; see the query.

    The next document is the one with the next smaller doc_id; rows of equal doc_id follow each
    other by text, rows without one come last. Documents meet their neighbours within ranges of doc_id; only the last
    row of each range looks up the first row of the next.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    own = with_vector(own.withColumn("bucket", buckets(own.select("doc_id"), "doc_id")), "text", "vec")
    order = Window.partitionBy("bucket").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    rows = own.withColumns({
        "next_text": F.lead("text").over(order), "next_vec": F.lead("vec").over(order), "at": F.row_number().over(order),
    })
    inner = F.col("next_vec").isNotNull()
    # The ends of the ranges keep their texts; all other rows are done here.
    ends = F.when(~inner, F.struct("text", "vec"))
    heads = F.when(F.col("at") == 1, F.struct("text", "vec"))
    edited = rows.withColumn("tail", ends).withColumn("head", heads)
    done = edited.withColumn("edited", F.when(inner, _edited(F.col("text"), F.col("next_text"))))
    done = with_vector(done, "edited", "edited_vec")
    done = stage_table(
        done.select(
            "doc_id", "bucket", "tail", "head", F.char_length("text").cast("long").alias("n_chars"),
            F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), text_of(F.col("vec")).alias("fingerprint"),
            text_of(F.col("edited_vec")).alias("edited_fingerprint"), likeness(F.col("vec"), F.col("edited_vec")).alias("near_edited"),
            likeness(F.col("vec"), F.col("next_vec")).alias("near_next"),
        )
    )
    # Which range follows which: one small row for each range, no text.
    numbers = done.select("bucket").distinct()
    follow = Window.orderBy(F.col("bucket").desc())
    chain = numbers.select("bucket", F.coalesce(F.lead("bucket").over(follow), F.first("bucket").over(follow)).alias("next"))
    heads = done.where("head is not null").select(F.col("bucket").alias("next"), F.col("head.text").alias("next_text"), F.col("head.vec").alias("next_vec"))
    tails = done.where("tail is not null").select("doc_id", "bucket", F.col("tail.text").alias("text"), F.col("tail.vec").alias("vec"))
    last = _compared(tails.join(chain, "bucket").join(heads, "next"))
    return done.where("tail is null").select(*last.columns).union(last)
