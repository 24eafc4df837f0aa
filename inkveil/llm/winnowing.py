"""Document fingerprints by winnowing, in DataFrame expressions alone.

The units are words. In scripts without spaces, and in words longer than ``LONG``, they are code points. Every run of
``K`` units has a rolling polynomial hash; of every ``W`` neighbouring hashes the least is chosen, the rightmost among
equals, and kept with its position. Two texts that share a run of ``K + W - 1`` units therefore share a fingerprint.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

K, W = 3, 4
#: Code points of the longest word that is one unit, and scripts whose words have no space between them.
LONG = 24
_UNSPACED = "".join(rf"\p{{Is{x}}}" for x in ("Han", "Hiragana", "Katakana", "Thai", "Lao", "Khmer", "Myanmar", "Tibetan"))
#: A prime, and the base of the polynomial; products stay below 2**62.
_PRIME, _BASE = (1 << 31) - 1, 1_000_003
_HALF = 1 << 31
#: Rows of one run of neighbouring ids, and most runs.
_RUN, _RUNS = 256, 4096


def _shifted(values: Column, by: int) -> Column:
    return F.slice(values, F.lit(by + 1), F.greatest(F.size(values) - by, F.lit(0)))


def _units(text: Column) -> Column:
    """The words of a text, or the code points of those without a place to cut."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    pieces = F.flatten(F.transform(words, lambda x: F.regexp_extract_all(x, F.lit(f"[{_UNSPACED}]|[^{_UNSPACED}]+"), F.lit(0))))
    cut = lambda x: F.when(F.char_length(x) > LONG, F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))).otherwise(F.array(x))
    return F.when(text.rlike(rf"[{_UNSPACED}]|[^\x20\x09-\x0D]{{{LONG + 1}}}"), F.flatten(F.transform(pieces, cut))).otherwise(words)


def with_marks(df: DataFrame, text: str, out: str, k: int = K, w: int = W) -> DataFrame:
    """Adds ``out``: the chosen hashes with their positions, each as hash * 2**31 + (2**31 - 1 - position).

    Null and empty texts, and those of white space alone, have none. A text with fewer than ``k`` units is filled
    up with empty ones, one with fewer than ``w`` runs is a single window.
    """
    hashed = F.transform(_units(F.coalesce(F.col(text), F.lit(""))), lambda x: F.pmod(F.xxhash64(x), F.lit(_PRIME)))
    df = df.withColumn("__h", hashed)
    short = (F.size("__h") > 0) & (F.size("__h") < k)
    df = df.withColumn("__h", F.when(short, F.concat("__h", F.array_repeat(F.lit(0).cast("long"), F.lit(k) - F.size("__h")))).otherwise(F.col("__h")))
    rolled = F.col("__h")
    for j in range(1, k):
        rolled = F.zip_with(rolled, _shifted(F.col("__h"), j), lambda a, b: (a * _BASE + b) % _PRIME)
    # the last k - 1 places lack units
    runs = F.slice(rolled, F.lit(1), F.greatest(F.size("__h") - (k - 1), F.lit(0)))
    df = df.withColumn("__e", F.transform(runs, lambda x, i: x * _HALF + (F.lit(_HALF - 1) - i)))
    least, width = F.col("__e"), 1
    while width < w:
        step = min(width, w - width)
        df = df.withColumn("__m", least)
        least = F.zip_with(F.col("__m"), _shifted(F.col("__m"), step), lambda a, b: F.least(a, b))
        width += step
    windows = F.least(F.greatest(F.size("__e") - (w - 1), F.lit(1)), F.size("__e"))
    return df.withColumn(out, F.array_distinct(F.slice(least, F.lit(1), windows))).drop("__h", "__e", "__m")


def hashes(marks: str) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(F.col(marks), lambda x: F.shiftright(x, 31)))


def printed(marks: str) -> Column:
    """A fingerprint as text: ``hash:position`` in order, hashes in hexadecimal."""
    one = F.transform(
        F.col(marks), lambda x: F.concat(F.hex(F.shiftright(x, 31)), F.lit(":"), (F.lit(_HALF - 1) - x.bitwiseAND(_HALF - 1)).cast("string"))
    )
    return F.array_join(one, " ")


def likeness(left: str, right: str) -> Column:
    """Jaccard similarity of two sets of hashes; two empty ones are alike."""
    both = F.size(F.array_intersect(left, right))
    either = F.size(left) + F.size(right) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def _run_of(docs: DataFrame) -> Column:
    """A number that rises with doc_id, for runs of about ``_RUN`` rows; rows without id get negative ones by text."""
    n = docs.where("doc_id is not null").count()
    runs = min(_RUNS, max(1, n // _RUN))
    shares = [i / runs for i in range(1, runs)]
    found = docs.agg(F.percentile_approx("doc_id", shares, 20 * runs)).first()[0] if shares and n else []
    bounds = sorted(set(found or []))
    by_text = -1 - F.pmod(F.xxhash64("text"), F.lit(_RUNS))
    if not bounds:
        return F.when(F.col("doc_id").isNull(), by_text).otherwise(F.lit(0).cast("long"))
    below = lambda values: F.size(F.filter(values, lambda b: b < F.col("doc_id")))
    coarse = below(F.array(*map(F.lit, bounds[::64]))) - 1
    fine = below(F.slice(F.array(*map(F.lit, bounds)), F.greatest(coarse, F.lit(0)) * 64 + 1, F.lit(64)))
    run = F.when(coarse < 0, 0).otherwise(coarse * 64 + fine)
    return F.when(F.col("doc_id").isNull(), by_text).otherwise(run.cast("long"))


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, marks, and next_text, next_marks of the document that follows by descending doc_id.

    After the last comes the first; a single document follows itself. Null ids come last; among equal ids, the
    order is that of the texts, null first. Documents of a run of ids are brought together, and the first of each run is
    added to the end of the run before.
    """
    numbered = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    numbered = numbered.withColumn("run", _run_of(numbered))
    heads = numbered.groupBy("run").agg(F.max("doc_id").alias("head"))
    in_order = Window.orderBy("run")
    higher = F.lead("run").over(in_order)
    lowest = F.min("run").over(in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heads = heads.select("run", "head", F.coalesce(higher, lowest).alias("goal"))  # two runs of rows per 4,096 at most
    doubled = numbered.join(F.broadcast(heads), "run").select(
        "doc_id", "text", F.explode(F.expr(
            "if(doc_id <=> head, array(struct(run as run, false as guest), struct(goal as run, true as guest)), "
            "array(struct(run as run, false as guest)))"
        )).alias("at"),
    ).select("doc_id", "text", "at.run", "at.guest")
    order = [F.col("guest"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    sorted_rows = doubled.repartition("run").sortWithinPartitions("run", *order)
    following = Window.partitionBy("run").orderBy(*order)
    marked = with_marks(sorted_rows, "text", "marks")
    return marked.withColumns({
        "next_text": F.lead("text").over(following), "next_marks": F.lead("marks").over(following),
    }).where("not guest").drop("run", "guest")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    The edited text has its last third replaced by as much of the next document's beginning, or all of that. Null
    texts are empty. Repeated rows stay. Other columns are ignored.
    """
    rows = with_next(docs.select("doc_id", "text")).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next_text"), F.lit(1), cut)
    )
    rows = with_marks(rows.withColumn("edited", edited), "edited", "edited_marks")
    rows = rows.withColumns({"own": hashes("marks"), "changed": hashes("edited_marks"), "other": hashes("next_marks")})
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        printed("marks").alias("fingerprint"), printed("edited_marks").alias("edited_fingerprint"),
        likeness("own", "changed").alias("near_edited"), likeness("own", "other").alias("near_next"),
    )
