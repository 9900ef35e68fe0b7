"""Order MinHash fingerprints, in built-in functions only.

A text's elements are its k-mers of words, each numbered by its occurrence, so that the second "a b" differs from the
first.  A 64-bit hash of (k-mer, occurrence) puts all elements on a circle, in random order.  Each of ``SLOTS`` permutations
reads that circle from a start of its own, 1/SLOTS of the way round from the one before, and selects the two minimal elements
of the whole text, that is, the first two from there on; they are put back into their order in the text and hashed as a
tuple.  Two texts agree in a permutation if they share its minimal elements *in the same order*, so the share of agreeing
permutations falls with edit distance, block moves included, where plain MinHash sees a set only.  A random order stays one
wherever reading starts, so each permutation selects as an independent one would; one sort serves them all.

Words are runs of `[^\\x20\\x09-\\x0D]`, cut into pieces of ``PIECE`` code points so that scripts without spaces have
k-mers too.  Defined results: a null text counts as empty; an empty text has the empty fingerprint, and two empty
fingerprints have likeness 1; a text of fewer than ``K`` pieces is one k-mer, and one of a single k-mer has tuples of one;
equal texts have equal fingerprints; repeated rows stay repeated; extra columns are not returned.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

#: Words in a k-mer, bits of a permutation's number, permutations, code points in a piece of a word.
K, SLOT_BITS, PIECE = 2, 6, 12
SLOTS = 1 << SLOT_BITS

#: Rows and bytes of text that one range of ids may hold on average, and ranges at most (their bounds go through the driver).
RANGE_ROWS, RANGE_BYTES, MOST_RANGES = 3000, 32 << 20, 1 << 18


def pieces(text: Column) -> Column:
    """The words of a text; only where one is longer than ``PIECE`` bytes is the regular expression that cuts it run."""
    words = F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), "")
    return F.flatten(
        F.transform(words, lambda w: F.when(F.octet_length(w) <= PIECE, F.array(w)).otherwise(F.regexp_extract_all(w, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))))
    )


def signature(df: DataFrame, words: str, out: str) -> DataFrame:
    """Replace the column ``words`` (array of pieces) by ``out``: an array of longs, each a permutation (top bits) and its tuple's hash, in order."""
    keep = [c for c in df.columns if c != words]
    mask = "(shiftleft(1L, b) - 1L)"
    slot = f"shiftright({{}}, {64 - SLOT_BITS})".format
    number = f"(xxhash64(shiftright(get(s, i), b), {{}}) & ~{mask}) | (get(s, i) & {mask})".format
    grams = ", ".join(f"get(h, i + {j})" for j in range(K))
    low, high, rest = -(SLOTS // 2), SLOTS // 2 - 1, (1 << (64 - SLOT_BITS)) - 1
    steps = [
        {"h": F.transform(words, lambda w: F.xxhash64(w)), "b": F.length(F.bin(F.size(words)))},
        # k-mer hash and position share one long; sorted, equal k-mers stand together in the order of the text
        {"s": F.expr(f"CASE WHEN size(h) = 0 THEN array() ELSE sort_array(transform(sequence(0, greatest(size(h) - {K}, 0)), i -> (xxhash64({grams}) & ~{mask}) | i)) END"), "b": "b"},
        {"r": F.expr("CASE WHEN size(s) = 0 THEN array() ELSE filter(sequence(0, size(s) - 1), i -> i = 0 OR shiftright(get(s, i), b) <> shiftright(get(s, i - 1), b)) END"), "s": "s", "b": "b"},
        # each run of equal k-mers is numbered from 0, and the number hashed with it
        {"v": F.expr(f"sort_array(flatten(transform(r, (a, j) -> transform(sequence(a, coalesce(get(r, j + 1), size(s)) - 1), i -> {number('i - a')}))))"), "b": "b"},
        # no permutation reads past the second element that lies between its start and the next
        {"c": F.expr(f"filter(v, (x, j) -> j < 2 OR {slot('x')} <> {slot('get(v, j - 2)')})"), "b": "b"},
        # the tuple of each element and the one after it on the circle
        {"t": F.expr(f"""transform(c, (x, j) -> {rest}L & aggregate(array(get(c, (j + 1) % size(c))), 0L, (z, y) -> CASE WHEN size(c) = 1 THEN xxhash64(shiftright(x, b))
            WHEN (x & {mask}) < (y & {mask}) THEN xxhash64(shiftright(x, b), shiftright(y, b)) ELSE xxhash64(shiftright(y, b), shiftright(x, b)) END))"""), "c": F.expr(f"transform(c, x -> {slot('x')})")},
        # a permutation's first element is the first at or after its start; after the last it is the circle's first
        {out: F.expr(f"""CASE WHEN size(c) = 0 THEN array() ELSE concat(
            flatten(transform(t, (y, j) -> CASE WHEN j > 0 AND get(c, j) = get(c, j - 1) THEN array()
              ELSE transform(sequence(CASE WHEN j = 0 THEN {low}L ELSE get(c, j - 1) + 1 END, get(c, j)), p -> shiftleft(p, {64 - SLOT_BITS}) | y) END)),
            CASE WHEN get(c, size(c) - 1) < {high} THEN transform(sequence(get(c, size(c) - 1) + 1, {high}L), p -> shiftleft(p, {64 - SLOT_BITS}) | get(t, 0)) ELSE array() END) END""")},
    ]
    for step in steps:
        df = df.select(*keep, *(F.col(x).alias(n) if isinstance(x, str) else x.alias(n) for n, x in step.items()))
    return df


def likeness(a: str, b: str) -> Column:
    """Share of the permutations in which both have the same tuple; 1 for two empty signatures."""
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.lit(SLOTS))


def as_text(sig: str) -> Column:
    """A signature as one string: 16 hexadecimal digits a permutation."""
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, n_chars, signature (array of longs) and fingerprint (string) of every text; one narrow pass."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.char_length(text).cast("long").alias("n_chars"), pieces(text).alias("w"))
    return signature(rows, "w", "sig").select(F.col("id").alias(id_col), "n_chars", F.col("sig").alias("signature"), as_text("sig").alias("fingerprint"))


def _before(df: DataFrame, key: str, cuts: list[int], out: str, equal: bool = False) -> DataFrame:
    """Add ``out``: how many of the sorted ``cuts`` lie below the column ``key`` (or at it, with ``equal``), looked for 64 at a time."""
    below = (lambda c: c <= F.col(key)) if equal else (lambda c: c < F.col(key))
    listed = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<bigint>")
    df = df.withColumn(out, F.lit(0))
    for step in (4096, 64, 1):
        if found := cuts[step - 1 :: step]:
            df = df.withColumn(out, F.col(out) * 64 + F.size(F.filter(F.slice(listed(found), F.col(out) * 64 + 1, F.lit(64)), below)))
    return df


def with_next(docs: DataFrame, carried: dict[str, str], id_col: str = "doc_id", text_col: str = "text", prepare: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Add columns of the document that follows by descending id (after the last comes the first): ``carried`` maps the
    columns to take from it to the names they get; they follow from the text.  ``prepare`` adds columns before rows are shuffled.

    Ids are cut into ranges of bounded size, each sorted in its own task, and the first document of a range is also sent, as a
    guest, to the range before it, so that rows are shuffled once and no task sees the whole order.  An id that many rows have
    in common fills several ranges, parted by the hash of the text.  Only the bounds go through the driver: one for each
    ``RANGE_ROWS`` rows or ``RANGE_BYTES`` of text, ``MOST_RANGES`` (2 MB) at most, which 8 TB of text reach; ranges grow only
    beyond that.  A null id counts as the least; ties follow the hash of the text; rows equal in both are alike.
    """
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    ids = docs.select(key.alias("paperloom_key"), F.col(text_col).alias("body"))
    rows, size = ids.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()
    ranges = max(1, min(MOST_RANGES, max(rows // RANGE_ROWS, size // RANGE_BYTES)))
    cuts = sorted(int(c) for c in ids.approxQuantile("paperloom_key", [k / ranges for k in range(1, ranges)], 0.2 / ranges)) if ranges > 1 else []
    shared = len(set(cuts)) < len(cuts)
    mix = F.xxhash64(text_col)

    def dealt(df: DataFrame) -> DataFrame:
        df = _before(df.withColumn("paperloom_key", key), "paperloom_key", cuts, "paperloom_part")
        if not shared:
            return df
        # an id that is several cuts has the ranges between them, in order of the hash
        df = _before(df, "paperloom_key", cuts, "paperloom_upto", equal=True).withColumn("paperloom_upto", F.greatest(F.col("paperloom_upto") - F.col("paperloom_part"), F.lit(1)))
        own = F.floor((mix / F.lit(2.0**64) + 0.5) * F.col("paperloom_upto")).cast("int")
        return df.withColumn("paperloom_part", F.col("paperloom_part") + F.least(F.greatest(own, F.lit(0)), F.col("paperloom_upto") - 1)).drop("paperloom_upto")

    place = F.struct("paperloom_key", (mix if shared else F.lit(0).cast("long")).alias("mix"))
    tops = dealt(docs.select(id_col, text_col)).groupBy("paperloom_part").agg(F.max(place).alias("paperloom_top"))
    # at most as many rows as ranges, in one task
    order = Window.orderBy(F.desc("paperloom_part"))
    hosts = tops.select(F.coalesce(F.lag("paperloom_part").over(order), F.last("paperloom_part").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("paperloom_host"), "paperloom_top")
    hosts = hosts.select("paperloom_host", F.col("paperloom_top.paperloom_key").alias("paperloom_key"), F.col("paperloom_top.mix").alias("paperloom_mix"))
    first = docs.withColumn("paperloom_key", key).join(F.broadcast(hosts), "paperloom_key")
    first = first.where(F.col("paperloom_mix") == mix) if shared else first
    # only the ranges' first documents are prepared twice
    guests = prepare(first).groupBy(F.col("paperloom_host").alias("paperloom_part")).agg(F.max_by(F.struct(*carried), mix).alias("paperloom_x")).select("paperloom_part", "paperloom_x.*")
    both = prepare(dealt(docs)).withColumn("paperloom_guest", F.lit(False)).unionByName(guests.withColumn("paperloom_guest", F.lit(True)), allowMissingColumns=True)
    w = Window.partitionBy("paperloom_part").orderBy("paperloom_guest", F.desc("paperloom_key"), F.desc(mix))
    own = prepare(docs).columns
    return both.select(*own, "paperloom_guest", *(F.lead(c).over(w).alias(to) for c, to in carried.items())).where("NOT paperloom_guest").drop("paperloom_guest")


def op6_document_fingerprints(spark, sf_dir):
    """Fingerprints of every whole text, of its edited text (half replaced by the next document's start), and their likenesses."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    signed = lambda df: signature(df.withColumn("w", pieces(F.col("text"))), "w", "sig")
    pairs = with_next(docs, {"text": "next_text", "sig": "sig_next"}, prepare=signed).withColumn("n_chars", F.char_length("text"))
    half = "int(n_chars div 2)"
    edited = pairs.select(
        "doc_id", "sig", "sig_next", F.col("n_chars").cast("long").alias("n_chars"),
        F.expr(f"concat(substring(text, 1, n_chars - {half}), substring(next_text, 1, {half}))").alias("edited"),
    )
    rows = edited.select("doc_id", "sig", "sig_next", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), pieces(F.col("edited")).alias("w"))
    return signature(rows, "w", "sig_edited").select(
        "doc_id", "n_chars", "edited_sha256", as_text("sig").alias("fingerprint"), as_text("sig_edited").alias("edited_fingerprint"),
        likeness("sig", "sig_edited").alias("near_edited"), likeness("sig", "sig_next").alias("near_next"),
    )
