"""Document fingerprints by a homomorphic multiset hash, with DataFrame operations only.

A text is the multiset of its paragraphs (the parts between line ends). Each paragraph is hashed to a wide
vector, and the fingerprint is the sum of these vectors, lane by lane, modulo a power of two:

* EXACT lanes modulo 2^32, the SHA-256 of the paragraph: equal sums mean equal multisets of paragraphs.
* ALIKE lanes modulo 2^16: every WORDS consecutive words of the paragraph (the whole one, if shorter) add +1 or
  -1 to each lane by the bits of their hash. The squared length of such a sum estimates the number of shingles,
  that of the difference of two fingerprints the number of shingles in which their texts differ.

As sums don't depend on the order, neither do fingerprints; paragraphs are inserted and deleted by adding and
subtracting their vectors (``insert``, ``delete``), without the rest of the text. A state is a struct of two arrays
(exact: bigint, alike: smallint).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import in_order
from basketry.session import materialize

EXACT, ALIKE, WORDS = 8, 128, 5
#: Two lanes of 32 bits share a sum: a text has fewer than 2^31 shingles, so that no lane runs over into the next.
_PAIR = 0x1_0000_0001


def _short(x: Column) -> Column:
    """x modulo 2^16, as a number from -2^15 to 2^15 - 1."""
    return (F.pmod(x + F.lit(1 << 15), F.lit(1 << 16)) - F.lit(1 << 15)).cast("smallint")


def sum_paragraphs(pieces: DataFrame, keys: Sequence[str], text_col: str) -> DataFrame:
    """(keys, state): the summed vectors of all paragraphs of the texts of each key; null texts hold none."""
    paragraphs = pieces.select(*keys, F.explode(F.split(text_col, "\n", -1)).alias("__p"))
    lanes = [F.conv(F.substring("__sha", 8 * i + 1, 8), 16, 10).cast("long").alias(f"__x{i}") for i in range(EXACT)]
    paragraphs = paragraphs.select(*keys, F.sha2("__p", 256).alias("__sha"), F.split("__p", " ", -1).alias("__w"))
    shingles = F.transform(F.sequence(F.lit(0), F.greatest(F.size("__w") - WORDS, F.lit(0))), lambda i: F.xxhash64(F.slice("__w", i + 1, WORDS)))
    rows = paragraphs.select(*keys, *lanes, F.posexplode(shingles).alias("__at", "__h0"))
    first = [F.when(F.col("__at") == 0, F.col(f"__x{i}")).otherwise(F.lit(0)).alias(f"__x{i}") for i in range(EXACT)]  # a paragraph counts once
    hashes = ALIKE // 64
    more = [F.xxhash64("__h0", F.lit(k)).alias(f"__h{k}") for k in range(1, hashes)]
    rows = rows.select(*keys, *first, "__h0", *more)
    sums = [F.sum(f"__x{i}").alias(f"__x{i}") for i in range(EXACT)]
    sums += [F.sum(F.shiftrightunsigned(f"__h{k}", j).bitwiseAND(F.lit(_PAIR))).alias(f"__s{k}_{j}") for k in range(hashes) for j in range(32)]
    summed = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), *sums)
    exact = F.array(*[F.pmod(F.col(f"__x{i}"), F.lit(1 << 32)) for i in range(EXACT)])
    ones = [half for k in range(hashes) for j in range(32) for half in (F.col(f"__s{k}_{j}").bitwiseAND(F.lit(0xFFFF_FFFF)), F.shiftrightunsigned(f"__s{k}_{j}", 32))]
    alike = F.array(*[_short(2 * one - F.col("__n")) for one in ones])
    return summed.select(*keys, F.struct(exact.alias("exact"), alike.alias("alike")).alias("state"))


def empty_state() -> Column:
    """The state of no paragraph at all."""
    return F.struct(F.array_repeat(F.lit(0).cast("long"), EXACT).alias("exact"), F.array_repeat(F.lit(0).cast("smallint"), ALIKE).alias("alike"))


def _combined(a: Column, b: Column, sign: int) -> Column:
    exact = F.zip_with(a["exact"], b["exact"], lambda x, y: F.pmod(x + sign * y, F.lit(1 << 32)))
    alike = F.zip_with(a["alike"], b["alike"], lambda x, y: _short(x.cast("int") + sign * y.cast("int")))
    return F.struct(exact.alias("exact"), alike.alias("alike"))


def insert(state: Column, paragraphs: Column) -> Column:
    """The state of a text with further paragraphs, whose own state is ``paragraphs``."""
    return _combined(state, paragraphs, 1)


def delete(state: Column, paragraphs: Column) -> Column:
    """The state of a text without some of its paragraphs, whose own state is ``paragraphs``."""
    return _combined(state, paragraphs, -1)


def as_text(state: Column) -> Column:
    """The fingerprint as lower-case hexadecimal digits: 8 for each exact lane, then 4 for each other."""
    exact = F.transform(state["exact"], lambda x: F.lpad(F.hex(x), 8, "0"))
    alike = F.transform(state["alike"], lambda x: F.lpad(F.hex(F.pmod(x.cast("int"), F.lit(1 << 16)).cast("long")), 4, "0"))
    return F.lower(F.concat(F.array_join(exact, ""), F.array_join(alike, "")))


def likeness(a: Column, b: Column) -> Column:
    """The estimated Jaccard similarity of the shingles of two states, 0 to 1; 1 for equal states."""
    square = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    apart = square(F.zip_with(a["alike"], b["alike"], lambda x, y: _short(x.cast("int") - y.cast("int"))))
    both = square(a["alike"]) + square(b["alike"])
    estimate = F.when(both + apart > 0, (both - apart) / (both + apart)).otherwise(0.0)
    return F.when(a == b, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), estimate)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, state) per distinct id and text of ``docs``; null texts count as empty (one empty paragraph)."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    given = docs.select(F.col(f"`{id_col}`").alias("__id"), text.alias("__text")).dropDuplicates()
    keyed = given.select("__id", F.xxhash64("__text").alias("__k1"), F.xxhash64(F.lit(1), "__text").alias("__k2"), "__text")
    return sum_paragraphs(keyed, ["__id", "__k1", "__k2"], "__text").select(F.col("__id").alias(id_col), "state")


def edited(docs: DataFrame, share: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per input row: id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, state.

    The edited text has the last ``floor(n_chars / share)`` code points replaced by the first as many (or all) of the
    next row's text, rows in ascending order of id; the first row follows the last. Its fingerprint comes from that
    of the text by deletion of the paragraphs from the cut on and insertion of the new ones. near_edited is the
    likeness to the edited text, near_next that to the next row's text.

    Null texts count as empty. Null ids come first; rows of one id are ordered by hashes of their text, and wholly
    equal rows follow one another. Very long texts are hashed whole, in the one task that holds their row. An empty
    table gives an empty result; other columns are ignored. Rows are told apart by hashes of id and text and not by
    their place in a scan, so that ``docs`` may be evaluated more than once.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    given = docs.select(F.col(f"`{id_col}`").alias("__id"), text.alias("__text"))
    null = F.col("__id").isNull()
    keyed = given.select(F.xxhash64(null, "__id", "__text").alias("k1"), F.xxhash64(F.lit(1), null, "__id", "__text").alias("k2"), "__id", "__text")
    known = keyed.groupBy("k1", "k2").agg(F.first("__id").alias("__id"), F.first(F.length("__text")).alias("n"), F.count(F.lit(1)).alias("m"))
    order = in_order(known, F.col("__id").asc_nulls_first(), F.col("k1"), F.col("k2"))
    total = max(1, order.count())
    follower = order.select(F.pmod(F.col("ord") - 1, F.lit(total)).alias("ord"), F.col("k1").alias("n1"), F.col("k2").alias("n2"))
    pairs = order.join(follower, "ord").drop("ord")
    # all but one of m equal rows are followed by their like
    own = pairs.where("m > 1").select("k1", "k2", "__id", "n", (F.col("m") - 1).alias("times"), F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.lit(False).alias("real"))
    links = materialize(pairs.select("k1", "k2", "__id", "n", F.lit(1).cast("long").alias("times"), "n1", "n2", F.lit(True).alias("real")).unionByName(own))
    texts = keyed.select("k1", "k2", "__text").dropDuplicates(["k1", "k2"])
    cut = F.floor(F.col("n") / share).cast("int")
    added = links.join(texts.select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("__text").alias("__next")), ["n1", "n2"])
    added = added.select(*links.columns, F.substring("__next", F.lit(1), cut).alias("__add"))
    both = added.join(texts, ["k1", "k2"])
    both = both.withColumn("__head", F.substring("__text", F.lit(1), F.col("n") - cut))
    both = both.withColumn("__rest", F.substring_index("__head", "\n", -1))  # the last paragraph of what stays, or a part of it
    both = both.withColumn("__kept", F.length("__head") - F.length("__rest"))
    piece = lambda which, x: F.struct(F.lit(which).alias("which"), x.alias("text"))
    pieces = F.array(
        piece(0, F.when(F.col("__kept") > 0, F.substring("__text", F.lit(1), F.col("__kept") - 1))),  # without its last line end
        piece(1, F.substring("__text", F.col("__kept") + 1, F.col("n"))),
        piece(2, F.concat("__rest", "__add")))
    keys = [*links.columns, "sha"]
    rows = both.select(*links.columns, F.sha2(F.concat("__head", "__add"), 256).alias("sha"), F.explode(pieces).alias("__piece"))
    rows = rows.select(*keys, F.col("__piece.which").alias("which"), F.col("__piece.text").alias("__piece"))
    parts = sum_paragraphs(rows, [*keys, "which"], "__piece").groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("which", "state"))).alias("__by"))
    of = lambda which: F.coalesce(F.try_element_at("__by", F.lit(which)), empty_state())
    parts = parts.select(*keys, of(1).alias("__gone"), of(2).alias("__new"), insert(of(0), of(1)).alias("state"))
    states = materialize(parts.select(*keys, "state", insert(delete(F.col("state"), F.col("__gone")), F.col("__new")).alias("__edited")))
    after = states.where("real").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("state").alias("__after"))
    out = states.join(after, ["n1", "n2"])
    out = out.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("__copy"))
    return out.select(
        F.col("__id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.col("sha").alias("edited_sha256"), as_text(F.col("state")).alias("fingerprint"),
        as_text(F.col("__edited")).alias("edited_fingerprint"), likeness(F.col("state"), F.col("__edited")).alias("near_edited"),
        likeness(F.col("state"), F.col("__after")).alias("near_next"), "state")
