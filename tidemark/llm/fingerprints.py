"""I-Match document fingerprints (operator 1), with DataFrame functions only.

A document's terms are its distinct runs of letters and digits in lower case. Kept are those whose inverse
document frequency lies in a band: terms in more than COMMON of the documents say nothing, those in fewer
than RARE are too odd to last. The distinct terms that are left are sorted (by a 64-bit hash of each) and
hashed once for each of several randomised sublexicons, which hold a random share of the lexicon each:
first the whole band (of a text without a term in it: all its terms), then shares from a half downwards, so that texts which differ in many terms still
agree in some. The likeness of two fingerprints is the share of sublexicons in which they agree, of those
that keep a term of either.

The lexicon holds at most (distinct terms per document) / RARE entries, however large the corpus, so it
goes into the plan as one set and no term is ever shuffled with its document.

Null texts are empty. Texts without a term in the band have only the first hash, so they are like others
with the same terms alone; texts without any term have an empty fingerprint, and two of these are alike (1.0). Equal texts have equal fingerprints. Rows that share a doc_id are independent documents, in
the order of their texts' hashes among each other. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import runs, store

COMMON, RARE = 0.3, 0.004
#: Random sublexicons: bits that a term's hash must have unset, and how many sublexicons of that share.
SHARES = ((0, 1), (1, 1), (2, 2), (3, 4), (4, 6), (5, 8), (6, 10), (7, 8), (8, 8))
#: Documents of one run that are put in order together.
RUN = 512


def terms(text: Column) -> Column:
    """Distinct terms of a text as 64-bit hashes."""
    words = F.split(F.lower(text), r"[^\p{L}\p{N}]+")
    return F.array_distinct(F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w)))


def lexicon(docs: DataFrame, common: float = COMMON, rare: float = RARE) -> list[int]:
    """Terms of the band, from the document frequencies of all whole texts."""
    total = docs.count()
    counts = docs.select(F.explode(terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    return sorted(r.term for r in counts.where((F.col("n") >= total * rare) & (F.col("n") <= max(1.0, total * common))).select("term").collect())


def hashes(words: str, band: list[int]) -> Column:
    """One hash for each sublexicon, from a column of terms; null where the text has none of its terms."""

    def holds(at: int, bits: int):
        return lambda t: F.shiftrightunsigned(t, at).bitwiseAND(F.lit((1 << bits) - 1)) == 0

    lots = [bits for bits, many in SHARES for _ in range(many)]

    def each(kept: Column) -> Column:
        whole = F.when(F.size(kept) > 0, kept).otherwise(F.array_sort(F.col(words)))
        some = [F.filter(kept, holds(23 * i % 56, bits)) if bits else whole for i, bits in enumerate(lots)]
        return F.array(*[F.when(F.size(x) > 0, F.hash(F.lit(i), x)) for i, x in enumerate(some)])

    known = ", ".join(f"{t}L" if t > -(2**63) else f"{t + 1}L - 1L" for t in band) or "NULL"
    kept = F.array_sort(F.expr(f"filter({words}, t -> t IN ({known}))"))  # as SQL text, for a call for each term takes long
    return F.transform(F.array(kept), each)[0]  # the inner function sees the sorted terms as one value


def likeness(a: Column, b: Column) -> Column:
    """Share of sublexicons in which two fingerprints agree, of those that keep a term of either."""
    agree = F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same))
    either = F.size(F.filter(F.zip_with(a, b, lambda x, y: F.coalesce(x, y)), lambda one: one.isNotNull()))
    return F.when(either == 0, F.lit(1.0)).otherwise(agree / either)


def written(h: Column) -> Column:
    """A fingerprint as text: eight hexadecimal digits for each sublexicon, or a dash."""
    return F.array_join(F.transform(h, lambda x: F.coalesce(F.lower(F.right(F.lpad(F.hex(x), 16, "0"), F.lit(8))), F.lit("-"))), ".")


def with_next(rows: DataFrame, columns: list[str], tie: str, name: str = "next") -> DataFrame:
    """rows with a struct of the next row's columns, by descending doc_id and from the last on to the first.

    Rows are put in order inside runs, whose bounds are quantiles; a run's last row takes its neighbour from the
    table of first rows, which has one for each run, at most 16,384. Null doc_ids come last.
    """
    told, keys = rows.withColumn("_row_id", F.monotonically_increasing_id()), ["doc_id", tie, "_row_id"]
    placed, this = told.withColumn("_run", runs(told, keys, RUN)), F.struct("doc_id", *columns)
    order = Window.partitionBy("_run").orderBy(*[F.desc_nulls_last(k) for k in keys])
    firsts = placed.withColumn("_place", F.row_number().over(order)).where("_place = 1").select("_run", this.alias("_there"))
    down = Window.orderBy(F.desc("_run"))
    after = firsts.select(F.col("_run").alias("_from"), F.coalesce(F.lead("_there").over(down), F.first("_there").over(down)).alias("_there"))
    inside = placed.withColumn("_here", F.lead(this).over(order))
    return (
        inside.join(after, inside["_run"] == after["_from"], "left")
        .withColumn(name, F.coalesce("_here", "_there")).drop("_run", "_row_id", "_here", "_from", "_there")
    )


def edited(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars and edited: the last third of each text replaced by the start of the next document's."""
    clean = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("_tie", F.xxhash64("text"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    return with_next(clean, ["text"], "_tie").select(
        "doc_id", "text", n.cast("long").alias("n_chars"),
        F.concat(F.left("text", n - third), F.left("next.text", third)).alias("edited"), "_tie",
    )


def compared(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document."""
    band = lexicon(docs)
    marked = store(
        edited(docs).withColumns({"_own": terms(F.col("text")), "_changed": terms(F.col("edited"))}).select(
            "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
            hashes("_own", band).alias("own"), hashes("_changed", band).alias("changed"), "_tie",
        )
    )
    return with_next(marked, ["own"], "_tie").select(
        "doc_id", "n_chars", "edited_sha256", written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("next.own")).alias("near_next"),
    )
