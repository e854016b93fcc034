"""Document fingerprints by Order MinHash, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 3
CELLS = 32
BUCKETS_A_TASK = 4
PLACE_BITS = 24
PLACE = (1 << PLACE_BITS) - 1


def _bits(value: Column, shift: int) -> Column:
    return F.shiftrightunsigned(value, shift)


def _words(text: Column) -> Column:
    """Hash of each word, of the empty text one hash; of a text without white space between words, of each character."""
    parts = F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")
    many = F.rlike(text, F.lit(r"[^\x20\x09-\x0D][\x20\x09-\x0D]++[^\x20\x09-\x0D]"))
    return F.when(many | (F.length(text) == 0), F.transform(parts, lambda w: F.xxhash64(w))).otherwise(F.transform(F.split(text, ""), lambda c: F.xxhash64(c)))


def _word_runs(words: str, gram: int) -> Column:
    """Hash of each run of ``gram`` words; of all words as one run where there are fewer."""
    runs = F.transform(F.slice(words, F.lit(1), F.size(words) - (gram - 1)), lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, gram)]))
    return F.when(F.size(words) < gram, F.array(F.xxhash64(F.array_join(F.col(words).cast("array<string>"), ",")))).otherwise(runs)


def _placed(hashes: Column) -> Column:
    """Sorted numbers with 40 bits of a run's hash above 24 bits of its place.

    A place beyond 2 ** 24 wraps: such a text still has equal fingerprints for equal texts, and only the order
    and numbering of runs that far apart may mix.
    """
    packed = F.transform(hashes, lambda h, i: (h.bitwiseAND(F.lit(~PLACE & 0x7FFFFFFFFFFFFFFF))).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACE))))
    return F.sort_array(packed)


def with_fingerprint(df: DataFrame, text: str, out: str, gram: int = GRAM, cells: int = CELLS) -> DataFrame:
    """Add the fingerprint of a text column: up to ``cells`` sketches (number of the cell, hash), in hexadecimal.

    Runs of words are numbered by occurrence, hashed, and dealt by hash into ``cells`` cells. In each cell the two
    smallest are selected, put back in text order, and hashed as a tuple, so a sketch survives only if both runs
    and their order do: this follows edits, not just the set of runs. One pass of one hash serves all cells
    instead of a permutation each. An empty cell has no sketch.
    """
    df = df.withColumn("_w", _words(F.col(text)))
    df = df.withColumn("_s", _placed(_word_runs("_w", gram))).drop("_w")
    same = lambda i: _bits(F.get("_s", i), PLACE_BITS) == _bits(F.get("_s", i - 1), PLACE_BITS)
    index = F.sequence(F.lit(0), F.size("_s") - 1)
    df = df.withColumn("_h", F.filter(index, lambda i: (i == 0) | ~same(i)))
    # equal runs stand together in text order: their number is the distance to the first
    number = F.flatten(F.transform("_h", lambda h, k: F.sequence(F.lit(0), F.coalesce(F.get("_h", k + 1), F.size("_s")) - h - 1)))
    df = df.withColumn("_o", number)
    cell_bits = (cells - 1).bit_length()
    df = df.withColumn(
        "_n",
        F.sort_array(
            # zipped: the optimiser moves a column that is named once into the function that names it
            F.transform(
                F.arrays_zip("_s", "_o"),
                lambda v: F.xxhash64(_bits(v["_s"], PLACE_BITS), v["_o"])
                .bitwiseAND(F.lit(~PLACE & 0x7FFFFFFFFFFFFFFF))
                .bitwiseOR(v["_s"].bitwiseAND(F.lit(PLACE))),
            )
        ),
    )
    cell = lambda v: _bits(v, 63 - cell_bits)
    at = F.sequence(F.lit(0), F.size("_n") - 1)
    df = df.withColumn("_c", F.filter(at, lambda i: (i == 0) | (cell(F.get("_n", i)) != cell(F.get("_n", i - 1)))))

    def sketch(i):
        one, two = F.get("_n", i), F.get("_n", i + 1)
        name = lambda v: _bits(v, PLACE_BITS)
        place = lambda v: v.bitwiseAND(F.lit(PLACE))
        pair = F.when(place(one) <= place(two), F.xxhash64(name(one), name(two))).otherwise(F.xxhash64(name(two), name(one)))
        value = F.when(two.isNotNull() & (cell(two) == cell(one)), pair).otherwise(F.xxhash64(name(one)))
        return F.lower(F.concat(F.lpad(F.hex(cell(one)), 2, "0"), F.lpad(F.hex(_bits(value, 32)), 8, "0")))

    return df.withColumn(out, F.array_join(F.transform("_c", sketch), " ")).drop("_s", "_h", "_o", "_n", "_c")


def likeness(a: str, b: str) -> Column:
    """Share of equal sketches among cells that are filled in either fingerprint."""
    one, two = F.split(F.col(a), " "), F.split(F.col(b), " ")
    cells = lambda sketches: F.transform(sketches, lambda s: F.substring(s, 1, 2))
    return F.size(F.array_intersect(one, two)) / F.size(F.array_union(cells(one), cells(two)))


def cut_points(docs: DataFrame) -> list[int]:
    """Ids that cut the documents into ranges of about as many each, four ranges a shuffle partition.

    The points are approximate, and another run may find others: whoever places documents by them must use one list.
    """
    ranges = BUCKETS_A_TASK * max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    points = docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 20 * ranges)).first()[0] if ranges > 1 else None
    return sorted(set(points or []))


def _bucketed(docs: DataFrame, points: list[int]) -> DataFrame:
    """Documents with the number of their range of ids."""
    if not points:
        return docs.withColumn("range", F.lit(0))
    bounds = F.array(*[F.lit(p).cast("long") for p in points])
    # binary search for the number of points below the id
    step = [1 << k for k in reversed(range(len(points).bit_length()))]

    def search(at, size):
        return F.when((at + size <= len(points)) & (F.get(bounds, at + size - 1) < F.col("doc_id")), at + size).otherwise(at)

    found = F.aggregate(F.array(*[F.lit(s) for s in step]), F.lit(0), search)
    return docs.withColumn("range", F.when(F.col("doc_id").isNull(), F.lit(0)).otherwise(found))


def next_document(docs: DataFrame) -> DataFrame:
    """Add next_text and next_print: the text and fingerprint of the next document by id, of the first after the last.

    Documents are sorted inside ranges of ids. Of each range the first document is found by its id and sent along with the
    range before it, as a row behind its last, so no text is broadcast. Rows that share an id, also null, follow each
    other by text; nulls come first.
    """
    points = cut_points(docs)
    rows = _bucketed(docs, points)
    low = rows.groupBy("range").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).getField("doc_id").alias("doc_id"))
    ranges = low.withColumn("before", F.lag("range").over(Window.orderBy("range"))).withColumn("top", F.max("range").over(Window.partitionBy()))
    ranges = ranges.select("doc_id", F.coalesce("before", "top").alias("before"))
    heads = docs.join(F.broadcast(ranges), docs.doc_id.eqNullSafe(ranges.doc_id)).groupBy("before").agg(F.min("text").alias("text"))
    heads = heads.select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("before").alias("range"), F.lit(True).alias("sent"))
    both = with_fingerprint(rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "range", F.lit(False).alias("sent")).union(heads), "text", "fingerprint")
    order = Window.partitionBy("range").orderBy("sent", F.col("doc_id").asc_nulls_first(), "text")
    both = both.withColumn("next_text", F.lead("text").over(order)).withColumn("next_print", F.lead("fingerprint").over(order))
    return both.filter("NOT sent").select("doc_id", "text", "fingerprint", "next_text", "next_print")


def fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text whose second half (the smaller, in code points) gives way to the beginning of
    the next document. All in DataFrame functions; one shuffle of the texts, by ranges of ids. What is broadcast is one id a
    range, ranges being four a shuffle partition. Of a text without white
    space between words the characters are taken for words.

    Null text counts as empty; empty texts have equal fingerprints. A table of one row is its own next document.
    An empty table gives an empty table; further columns are ignored.
    """
    rows = next_document(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - half), F.substring("next_text", F.lit(1), half)))
    rows = with_fingerprint(rows, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness("fingerprint", "edited_fingerprint").alias("near_edited"),
        likeness("fingerprint", "next_print").alias("near_next"),
    )
