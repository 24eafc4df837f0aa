"""Redaction with one pass per key, in rank order, for dictionaries of any size.

A replacement can be replaced again by a key of a later rank. Of all keys only those that stand in a text change it, and
those that an earlier replacement puts there. So a round finds the keys in each text by the index of
:mod:`inkveil.operators.hits` and applies them in rank order, up to the first rank at which a replacement made so far might
have put a new key. Texts that stopped there take part in the next round. Keys that can't create each other are all applied in
one round, and the number of rounds follows the longest chain of keys in a text, not the dictionary.

What a replacement may put into a text (:func:`_stops`) is judged from above, which can add rounds and never changes a result:

* A key between guards leaves its neighbours as they are, so a new match has the first or the last piece of the replacement,
  or lies inside it. A deletion between guards brings two characters together that are no word characters.
* After keys without guards on both sides, and replacements with other than ASCII characters, every later key is possible.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from inkveil.functions import redaction
from inkveil.functions.patterns import WORD_CLASS, first_letter
from inkveil.operators import hits
from inkveil.operators.dictionary import key_pattern
from inkveil.operators.joins import BROADCAST_BYTES, fits_broadcast
from inkveil.session import written

_LAST = (1 << 63) - 1
#: Up to so many keys of so many characters in all become one expression, which costs less than an index.
FEW = 64
_FEW_CHARS = 10_000


def _later(least: Column, most: Column) -> Column:
    """The first position after the key's own that a range of positions may hold; null if there is none."""
    here = F.col("position")
    return F.when(least > here, least).when(most > here, here + 1)


def _stops(ranked: DataFrame, index: hits.KeyIndex, broadcast: bool) -> DataFrame:
    """position and stop: the first later position whose key a replacement may put into a text, null if there is none."""
    cut = F.transform(hits.cut_pieces(F.col("original")), hits.folded)
    keys = ranked.select("position", cut.alias("pieces"))
    among = keys.select("position", F.explode("pieces").alias("piece")).groupBy("piece").agg(
        F.min("position").alias("least"), F.max("position").alias("most")
    )
    new = F.transform(hits.cut_pieces(F.col("replacement")), hits.folded)
    edges = ranked.where("replacement <> ''").select("position", new.alias("new"))
    edges = edges.select("position", F.explode(F.array_distinct(F.array(F.get("new", F.lit(0)), F.element_at("new", -1)))).alias("piece"))
    at_edges = edges.join(among, "piece").select("position", _later(F.col("least"), F.col("most")).alias("stop"))

    runs = hits.candidates(ranked.select("position", "replacement"), index, "replacement", ["position"])
    held = hits.matched(runs.withColumnRenamed("position", "outer"), index, ["outer"], broadcast)
    inside = held.where("position > outer").select(F.col("outer").alias("position"), F.col("position").alias("stop"))

    # keys in which two characters other than word characters stand side by side
    bare = F.transform("pieces", lambda p: ~p.rlike(WORD_CLASS))
    side_by_side = F.exists(F.zip_with(bare, F.slice(bare, F.lit(2), F.greatest(F.size(bare) - 1, F.lit(0))), lambda a, b: a & b), lambda x: x)
    least, most = keys.where(side_by_side).agg(F.min("position"), F.max("position")).first()
    guarded = F.col("original").rlike(r"^[\p{L}\p{N}]") & F.col("original").rlike(r"[\p{L}\p{N}]$")
    plain = F.octet_length("replacement") == F.length("replacement")
    joined = _later(F.lit(least), F.lit(most)) if least is not None else F.lit(None)
    any_key = F.when(~guarded | ~plain, F.col("position") + 1).when(F.col("replacement") == "", joined)
    others = ranked.select("position", any_key.cast("long").alias("stop"))
    both = at_edges.unionByName(inside).unionByName(others)
    return both.groupBy("position").agg(F.min("stop").alias("stop"))


def _one_pass(state: Column, step: Column, low: bool = False) -> Column:
    """The state after a step. With ``low`` it has a searched form of its text, and steps whose word isn't in there are passed over."""

    def rest(parts: Column) -> Column:
        turned = F.transform(parts, lambda part, at: F.when(at % 2 == 1, redaction.in_case_of(part, step["replacement"])).otherwise(part))
        found = F.floor(F.size(parts) / 2)
        done = F.struct(
            F.array_join(turned, "").alias("text"), (state["hits"] + found).cast("long").alias("hits"),
            F.least(state["bound"], F.coalesce(step["stop"], F.lit(_LAST))).alias("bound"),
        )
        return F.when(found > 0, done).otherwise(F.struct(*[state[c].alias(c) for c in ("text", "hits", "bound")]))

    # a variable of its own: the text would be scanned again at each mention of its pieces
    after = F.get(F.transform(F.array(redaction.pieces(state["text"], step["pattern"])), rest), F.lit(0))
    if not low:
        return F.when(step["position"] >= state["bound"], state).otherwise(after)
    with_low = F.get(F.transform(F.array(after), lambda x: F.struct(x["text"].alias("text"), x["hits"].alias("hits"), x["bound"].alias("bound"), _searched(x["text"]).alias("low"))), F.lit(0))
    return F.when(step["word"].isNotNull() & ~F.contains(state["low"], step["word"]), state).otherwise(with_low)


def _searched(text: Column) -> Column:
    """Lower case, with the four letters that match ASCII ones as those: an ASCII key that stands in the text is a part of this."""
    return F.lower(F.when(F.octet_length(text) == F.length(text), text).otherwise(F.translate(text, "İıſK", "iisk")))


def _few(df: DataFrame, ranked: DataFrame, text: str) -> DataFrame:
    """All passes as one expression, for a number of keys that a plan can hold."""
    rows = ranked.orderBy("position").select("position", "original", key_pattern(F.col("original")).alias("pattern"), "replacement")

    def step(r: Row) -> Column:
        key = r["original"]
        return F.struct(
            F.lit(r["position"]).cast("long").alias("position"), F.lit("(?iu)" + first_letter(key) + r["pattern"]).alias("pattern"),
            F.lit(r["replacement"]).alias("replacement"), F.lit(None).cast("long").alias("stop"),
            F.lit(key.lower() if key.isascii() else None).cast("string").alias("word"),
        )

    start = F.struct(F.col(text).alias("text"), F.lit(0).cast("long").alias("hits"), F.lit(_LAST).alias("bound"), _searched(F.col(text)).alias("low"))
    done = df.withColumn("_done", F.aggregate(F.array(*map(step, rows.collect())), start, lambda state, of: _one_pass(state, of, low=True)))
    return done.select(
        *df.columns, F.col("_done.text").alias("redacted"), F.when(F.col(text).isNull(), 0).otherwise(F.col("_done.hits")).cast("long").alias("replacements")
    )


def redact_in_passes(df: DataFrame, ranked: DataFrame, text: str = "text", broadcast_bytes: int = BROADCAST_BYTES, few: int = FEW) -> DataFrame:
    """The older way: one pass per key of ``ranked`` (position, original, replacement) in rank order, over all texts.

    Adds redacted and replacements. A replacement can be replaced again by later keys. A null text stays null.
    """
    position = F.col("position").cast("long").alias("position")
    ranked = written(ranked.select(position, "original", "replacement", F.lower("original").alias("lower")), "ranked")
    n_keys, n_chars = ranked.agg(F.count("*"), F.sum(F.length("original") + F.length("replacement"))).first()
    zero = F.lit(0).cast("long")
    if not n_keys:
        return df.withColumns({"redacted": F.col(text), "replacements": zero})
    if n_keys <= few and n_chars <= _FEW_CHARS:
        return _few(df, ranked, text)
    rows = written(df.withColumn("_row", F.monotonically_increasing_id()), "texts")
    broadcast = fits_broadcast(n_keys, n_chars, broadcast_bytes)
    index = hits.KeyIndex.build(ranked, n_keys, also=("position",))
    steps = written(ranked.join(_stops(ranked, index, broadcast), "position"), "steps").select(
        "position", F.concat(F.lit("(?iu)"), key_pattern(F.col("original"))).alias("pattern"), "replacement", "stop"
    )
    index = replace(index, keys=written(index.keys.join(steps, "position"), "keys"))

    state = rows.select("_row", F.col(text).alias("_now"), zero.alias("_hits"), F.lit(-_LAST).alias("_from"))
    done = []
    while True:
        runs = hits.candidates(state, index, "_now", ["_row", "_from"])
        found = hits.matched(runs, index, ["_row", "_from"], broadcast).where("position >= _from")
        step = F.struct("position", "pattern", "replacement", "stop")
        todo = found.groupBy("_row").agg(F.sort_array(F.collect_set(step)).alias("_steps"))
        start = F.struct(F.col("_now").alias("text"), F.col("_hits").alias("hits"), F.lit(_LAST).alias("bound"))
        after = state.join(todo, "_row").withColumn("_after", F.aggregate("_steps", start, lambda state, of: _one_pass(state, of)))
        after = written(after.select("_row", "_after.text", "_after.hits", "_after.bound"), "passes")
        done.append(after.select("_row", "text", "hits"))
        state = after.where(F.col("bound") < _LAST).select(
            "_row", F.col("text").alias("_now"), F.col("hits").alias("_hits"), F.col("bound").alias("_from")
        )
        if state.isEmpty():
            break
    last = done[0].withColumn("_round", F.lit(0))
    for i, part in enumerate(done[1:], 1):
        last = last.unionByName(part.withColumn("_round", F.lit(i)))
    last = last.groupBy("_row").agg(F.max_by(F.struct("text", "hits"), "_round").alias("_done"))
    return rows.join(last, "_row", "left").select(
        *[F.col(c) for c in df.columns], F.coalesce("_done.text", F.col(text)).alias("redacted"), F.coalesce("_done.hits", zero).alias("replacements")
    )
