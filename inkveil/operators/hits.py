"""Verified hits: where the keys of a large dictionary stand in a text, found by equi-joins on whole pieces.

A text is a row of pieces: runs of word characters, and every other character by itself. A key that stands in a text
begins and ends where pieces do, so it is a run of whole folded pieces there. Places whose first pieces begin no key
are passed over by a bitmap of fixed size, and so are runs that are no key. What is left joins the keys on the hash of
the whole run and is checked against the key's own pieces and guards, so keys that share words or endings never meet.
Overlaps are settled as one scan from left to right would: the first place wins, there the longest key.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkveil.functions.patterns import WORD_CLASS
from inkveil.functions.redaction import LOOKUP_TYPE
from inkveil.operators.joins import measured_join
from inkveil.session import written

PIECE = rf"(?s){WORD_CLASS}+|."
#: Pieces that decide whether a place can begin a key.
_FIRST = 3
#: Bits per key, and bits at most. Beyond that the filter passes more, and the join decides.
_BITS = 16
_MOST_BITS = 1 << 22
_HIT = "struct<at:int,size:int,entry:" + LOOKUP_TYPE + ">"


@dataclass(frozen=True)
class KeyIndex:
    """Keys by the hash of their folded pieces, their numbers of pieces, and bitmaps of first pieces, beginnings and whole keys."""

    keys: DataFrame
    sizes: tuple[int, ...]
    firsts: str
    begins: str
    whole: str
    bits: int

    @classmethod
    def build(cls, keys: DataFrame, n_keys: int, also: tuple[str, ...] = ()) -> KeyIndex:
        """Index ``keys`` (lower, original, replacement), a table that has been written; columns in ``also`` stay."""
        cut = F.transform(cut_pieces(F.col("original")), folded)
        rows = keys.select("lower", "original", "replacement", *also, cut.alias("_pieces")).select(
            *also,
            F.xxhash64(F.array_join("_pieces", "")).alias("run"), F.array_join("_pieces", "").alias("said"),
            F.size("_pieces").alias("size"), F.xxhash64(F.get("_pieces", F.lit(0))).alias("first"),
            F.when(F.size("_pieces") > _FIRST, _run_hash(F.col("_pieces"), F.lit(0), _FIRST)).alias("begin"),
            F.col("original").rlike(r"^[\p{L}\p{N}]").alias("left"), F.col("original").rlike(r"[\p{L}\p{N}]$").alias("right"),
            "lower", F.struct("original", "replacement").cast(LOOKUP_TYPE).alias("entry"),
        )
        bits = 1 << max(10, min(_MOST_BITS, _BITS * n_keys).bit_length())
        sizes = tuple(sorted(r[0] for r in rows.select("size").distinct().collect()))  # at most the length of a key
        maps = [_bitmap(rows.where(F.col(c).isNotNull()), c, bits) for c in ("first", "begin", "run")]
        return cls(rows.drop("first", "begin"), sizes, *maps, bits)


def cut_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PIECE), F.lit(0))


def folded(piece: Column) -> Column:
    """A piece the way case-insensitive matching compares it; characters with longer upper or lower forms stay."""
    plain = F.lower(F.translate(piece, "İıſK", "iisk"))
    # a piece that is not ASCII now is a single character
    upper = F.when(F.length(F.upper(plain)) == 1, F.upper(plain)).otherwise(plain)
    lower = F.when(F.length(F.lower(upper)) == 1, F.lower(upper)).otherwise(upper)
    wide = F.when(F.octet_length(plain) == F.length(plain), plain).otherwise(lower)
    # most pieces are ASCII, and translating costs far more than the rest
    return F.when(F.octet_length(piece) == F.length(piece), F.lower(piece)).otherwise(wide)


def _run_hash(pieces: Column, at: Column, size: Column | int) -> Column:
    return F.xxhash64(F.array_join(F.slice(pieces, at + 1, F.lit(size) if isinstance(size, int) else size), ""))


def _bitmap(rows: DataFrame, column: str, bits: int) -> str:
    """The bits of the hashes in ``column``, as a constant of at most ``bits`` / 64 numbers."""
    place = F.pmod(F.col(column), F.lit(bits).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    words = rows.groupBy(F.floor(place / 64).cast("int").alias("word")).agg(F.bit_or(bit).alias("bits")).collect()
    table = [0] * (bits // 64)
    for word, found in words:
        table[word] = found
    return json.dumps(table)


def _has(bitmap: str, bits: int, hashed: Column) -> Column:
    place = F.pmod(hashed, F.lit(bits).cast("long"))
    word = F.get(F.from_json(F.lit(bitmap), "array<bigint>"), F.call_function("shiftright", place, F.lit(6)).cast("int"))
    return F.call_function("shiftright", word, F.pmod(place, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1


def candidates(df: DataFrame, index: KeyIndex, text: str, keys: list[str]) -> DataFrame:
    """Runs of pieces that may be keys: ``keys``, the text's hash, at, size, run, said, match, and whether words touch it."""
    rows = df.where(F.col(text).isNotNull()).select(*keys, F.xxhash64(text).alias("_text"), cut_pieces(F.col(text)).alias("_pieces"))
    if index.sizes == (1,):
        return _single(rows, index, keys)
    # no filters between these steps: they would be pushed down together with all that they are computed from
    rows = rows.withColumn("_folded", F.transform("_pieces", folded)).withColumn("_hashes", F.transform("_folded", lambda p: F.xxhash64(p)))
    pieces, fold, bits = F.col("_pieces"), F.col("_folded"), index.bits
    places = F.when(F.size(pieces) > 0, F.sequence(F.lit(0), F.size(pieces) - 1))
    rows = rows.withColumn("_places", F.filter(places, lambda i: _has(index.firsts, bits, F.get("_hashes", i))))

    def fits(i: Column, size: int) -> Column:
        return i + size <= F.size(pieces)

    def run(i: Column, size: Column) -> Column:
        return F.struct(i.alias("at"), size.alias("size"), F.array_join(F.slice(fold, i + 1, size), "").alias("said"))

    def short(size: int) -> Column:
        """Runs of so few pieces that they are looked up as a whole."""
        hashed = (lambda i: F.get("_hashes", i)) if size == 1 else (lambda i: _run_hash(fold, i, size))
        held = F.filter("_places", lambda i: fits(i, size) & _has(index.whole, bits, hashed(i)))
        return F.transform(held, lambda i: run(i, F.lit(size)))

    found = [short(size) for size in index.sizes if size <= _FIRST]
    longer = [s for s in index.sizes if s > _FIRST]
    if longer:
        begun = F.filter("_places", lambda i: fits(i, _FIRST) & _has(index.begins, bits, _run_hash(fold, i, _FIRST)))
        sizes = F.array(*map(F.lit, longer))
        each = F.flatten(F.transform(begun, lambda i: F.transform(F.filter(sizes, lambda s: i + s <= F.size(pieces)), lambda s: run(i, s))))
        found.append(F.filter(each, lambda c: _has(index.whole, bits, F.xxhash64(c["said"]))))
    rows = rows.withColumn("_runs", F.concat(*found))

    def is_word(i: Column) -> Column:
        return F.coalesce(F.get(pieces, i).rlike(WORD_CLASS), F.lit(False))

    full = F.transform(
        "_runs",
        lambda c: F.struct(
            c["at"].alias("at"), c["size"].alias("size"), F.xxhash64(c["said"]).alias("run"), c["said"].alias("said"),
            F.lower(F.array_join(F.slice(pieces, c["at"] + 1, c["size"]), "")).alias("match"),
            ((c["at"] > 0) & is_word(c["at"] - 1)).alias("after_word"), is_word(c["at"] + c["size"]).alias("before_word"),
        ),
    )
    # the outer form, as Spark tests the size of the array below all these steps for the other one, computing it twice
    return rows.select(*keys, "_text", F.inline_outer(full)).where("at is not null")


def _single(rows: DataFrame, index: KeyIndex, keys: list[str]) -> DataFrame:
    """The runs of :func:`candidates` for keys of one piece: each piece is a row with its neighbours.

    Folding stays a function over the array. Within the compiled loop it makes a method too long for the JVM to compile.
    """
    before, after = F.concat(F.array(F.lit("")), "_pieces"), F.concat(F.slice("_pieces", 2, F.greatest(F.size("_pieces"), F.lit(1))), F.array(F.lit("")))
    rows = rows.withColumn("_folded", F.transform("_pieces", folded))
    sides = F.arrays_zip(F.col("_pieces").alias("match"), F.col("_folded").alias("said"), before.alias("before"), after.alias("after"))
    places = rows.select(*keys, "_text", F.posexplode_outer(sides).alias("at", "_piece"))
    run = F.xxhash64("_piece.said")
    return places.where(F.col("_piece.match").isNotNull() & _has(index.whole, index.bits, run)).select(
        *keys, "_text", "at", F.lit(1).alias("size"), run.alias("run"), F.col("_piece.said").alias("said"), F.lower("_piece.match").alias("match"),
        F.col("_piece.before").rlike(WORD_CLASS).alias("after_word"), F.col("_piece.after").rlike(WORD_CLASS).alias("before_word"),
    )


def matched(runs: DataFrame, index: KeyIndex, keys: list[str], broadcast: bool) -> DataFrame:
    """The ``runs`` that a key of ``index`` equals where it may stand, with the key's columns.

    Without a broadcast, runs that many texts hold are dealt out over several tasks.
    """
    known = index.keys.drop("size").withColumnRenamed("said", "_said")
    touched = (F.col("left") & F.col("after_word")) | (F.col("right") & F.col("before_word"))
    if broadcast:
        joined = runs.join(F.broadcast(known), "run")
    else:
        # finding runs reads every text, and they are measured before they are joined
        joined = measured_join(written(runs, "runs"), known, "run", [*keys, "_text"], broadcast_bytes=0)
    return joined.where((F.col("said") == F.col("_said")) & ~touched)


def verified(runs: DataFrame, index: KeyIndex, keys: list[str], broadcast: bool) -> DataFrame:
    """``keys``, _text, at, size and entry of the ``runs`` that are keys; the entry is null for one that is alike only when folded."""
    entry = F.when(F.col("lower") == F.col("match"), F.col("entry"))
    return matched(runs, index, keys, broadcast).select(*keys, "_text", "at", "size", entry.alias("entry"))


def settled(hits: DataFrame, keys: list[str], most: int) -> DataFrame:
    """``keys``, _text and ``_hits``: the hits of each text that a scan from left to right takes, in order.

    The hits of a text are gathered where they are found, meet once and are sorted once: by place, the longest first, and known
    keys before others. No key has more than ``most`` pieces.
    """
    hit = F.struct("at", (-F.col("size")).alias("less"), F.col("entry").isNull().alias("unknown"), "size", "entry")
    sorted_hits = hits.groupBy(*keys, "_text").agg(F.sort_array(F.collect_list(hit)).alias("_all"))
    every = F.col("_all")
    longest = F.filter(every, lambda x, i: (i == 0) | (F.get(every, i - 1)["at"] != x["at"]))
    rows = sorted_hits.withColumn("_longest", F.transform(longest, lambda x: F.struct(x["at"].alias("at"), x["size"].alias("size"), x["entry"].alias("entry")).cast(_HIT)))
    found = F.col("_longest")

    def reaches(x: Column, i: Column) -> Column:
        """Whether a hit before this one ends behind its place. Places differ, so only the last few hits can."""
        first = F.greatest(i - most, F.lit(0))
        return F.exists(F.slice(found, first + 1, i - first), lambda h: h["at"] + h["size"] > x["at"])

    start = F.struct(F.lit(0).alias("end"), F.array().cast(f"array<{_HIT}>").alias("taken"))

    def take(state: Column, hit: Column) -> Column:
        free = hit["at"] >= state["end"]
        return F.struct(
            F.when(free, hit["at"] + hit["size"]).otherwise(state["end"]).alias("end"),
            F.when(free, F.concat(state["taken"], F.array(hit))).otherwise(state["taken"]).alias("taken"),
        )

    # hits that reach into each other form a knot, nearly always a small one; most texts have none
    beside = F.zip_with(found, F.slice(found, 2, F.size(found)), lambda x, y: x["at"] + x["size"] > y["at"])
    begins = F.filter(F.transform(found, lambda x, i: F.when(~reaches(x, i), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("_begins", F.when(F.exists(beside, lambda x: F.coalesce(x, F.lit(False))), begins))
    knots = F.transform(
        "_begins", lambda b, k: F.slice(found, b + 1, F.coalesce(F.get("_begins", k + 1), F.size(found)) - b)
    )
    scanned = F.flatten(F.transform(knots, lambda t: F.when(F.size(t) == 1, t).otherwise(F.aggregate(t, start, take)["taken"])))
    return rows.select(*keys, "_text", F.when(F.col("_begins").isNull(), found).otherwise(scanned).alias("_hits"))


def entries(text: Column, pieces: Column, hits: Column) -> Column:
    """The text cut at its hits, as array<struct<part, entry>>: untouched, hit, untouched, ..., untouched."""
    nothing = F.lit(None).cast(LOOKUP_TYPE)

    def part(start: Column, count: Column, entry: Column) -> Column:
        text = F.when(count == 1, F.get(pieces, start)).otherwise(F.array_join(F.slice(pieces, start + 1, count), ""))
        return F.struct(text.alias("part"), entry.alias("entry"))

    def both(hit: Column, i: Column) -> Column:
        last = F.get(hits, i - 1)
        end = F.when(i == 0, F.lit(0)).otherwise(last["at"] + last["size"])
        return F.array(part(end, hit["at"] - end, nothing), part(hit["at"], hit["size"], hit["entry"]))

    last = F.element_at(hits, -1)
    end = last["at"] + last["size"]
    tail = F.array(part(end, F.size(pieces) - end, nothing))
    whole = F.array(F.struct(text.alias("part"), nothing.alias("entry")))
    cut = F.concat(F.flatten(F.transform(hits, both)), tail)
    return F.when(text.isNull(), F.lit(None)).when(hits.isNull(), whole).otherwise(cut)
