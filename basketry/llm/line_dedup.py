"""Line deduplication by an exact set-similarity join, with DataFrame operations only.

A line is removed if the Jaccard similarity of its words to those of an earlier line (smaller id, or
same document and earlier line) reaches NUM / DEN; lines are judged on the input. The words of a line
are 64-bit numbers that sort by rarity (counts over the whole corpus, hashed to 2^17 cells) and then hash.

1. Lines with equal word sets are one class, named by its first line; all others of it go.
2. Most near copies share two of the three words with the least hashes among their rarest. Classes that share such a
   pair of words meet the first of its list and their neighbour in it; those that match are gone. Classes that share a rare
   word with a line matched by LEADS others meet that line too, so that large groups of near copies don't meet in full.
3. Similar sets share one of their rarest words: of the larger set one of the ``n - ceil(t n) + 1`` rarest, of the
   smaller one of the ``n - ceil(2 t / (1 + t) n) + 1`` rarest. Classes are dealt by these words and meet within a word
   those of their own bucket of sizes (steps of 1 / t) and of the next lower one. Pairs whose later line is not yet
   gone pass a length filter, a positional filter (the words behind the shared one must suffice) and a parity sketch of
   64 bits, between sets of more than WIDE words 128, whose distance bounds that of the sets from below.
4. Pairs that pass are verified on all words of both lines; a line tries the LONG earliest of its pairs first,
   and the others only if none of these matches.

A list that a sample tells to be very long is dealt over SALTS tasks.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from basketry.llm.common import broadcast_if_small, dense_order, stable
from basketry.session import materialize, release, subset_keys

NUM, DEN = 80, 100
CELLS = 1 << 17
LONG = 8
#: Lists that are estimated to have more members than this are split.
HOT, SAMPLE_RATE = 200_000, 0.01
SALTS = 16
WIDE = 80
LEADS = 16


def _words(line: Column) -> Column:
    words = F.split(F.lower(line), " ")
    blanks = F.contains(line, F.lit("  ")) | F.startswith(line, F.lit(" ")) | F.endswith(line, F.lit(" ")) | (line == "")
    return F.when(blanks, F.array_remove(words, "")).otherwise(words)


def _rarity(text: Column, of: DataFrame) -> Column:
    """An array that holds, for each cell of hashed words, a number below 2^7 that grows with how often its words occur."""
    words = F.split(F.lower(F.replace(text, F.lit("\n"), F.lit(" "))), " ")
    cell = F.xxhash64("w").bitwiseAND(F.lit(CELLS - 1)).cast("int")
    counts = of.select(F.explode(words).alias("w")).groupBy(cell.alias("cell")).count()
    rank = F.least(F.lit(127), F.round(F.log2(F.col("count") + 1) * 4)).cast("int")
    ranks = [0] * CELLS
    for c, r in counts.select("cell", rank).collect():  # at most CELLS rows
        ranks[c] = r
    return F.split(F.lit(",".join(map(str, ranks))), ",").cast("array<tinyint>")  # folded to one constant


def _numbers(line: Column, table: Column) -> Column:
    """The distinct words of a line as numbers, rarest first."""
    hashes = F.transform(_words(line), lambda w: F.xxhash64(w))

    def one(h: Column) -> Column:
        rank = F.coalesce(F.get(table, h.bitwiseAND(F.lit(CELLS - 1)).cast("int")).cast("long"), F.lit(0).cast("long"))
        return F.shiftleft(rank, 56).bitwiseOR(F.shiftrightunsigned(h, 8))

    return F.sort_array(F.array_distinct(F.transform(hashes, one)))


def _close(a: str, b: str, num: int, den: int) -> Column:
    """The length and sketch filters for two sets, by the prefixes of their columns."""
    na, nb = F.col(f"{a}n"), F.col(f"{b}n")
    apart = F.col(f"{a}sketch").bitwiseXOR(F.col(f"{b}sketch"))
    more = F.col(f"{a}more").bitwiseXOR(F.col(f"{b}more"))
    bits = F.when((na > WIDE) & (nb > WIDE), F.bit_count(apart.bitwiseXOR(more)) + F.bit_count(more)).otherwise(F.bit_count(apart))
    return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (bits * (num + den) <= (na + nb) * (den - num))


def _copies(classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of each class with the first and the last earlier one that share two of three of its rarest words."""
    classes = classes.withColumn("prefix", F.sort_array("prefix"))  # by hash: a copy's own rare words may be among them or not
    two = [F.when(F.size("prefix") > j, F.xxhash64(F.get("prefix", F.lit(i)), F.get("prefix", F.lit(j)))) for i, j in ((0, 1), (0, 2), (1, 2))]
    lists = classes.where("size(prefix) > 1").select(F.explode(F.array_compact(F.array(*two))).alias("key"), "line_id", "n", "sketch", "more")
    within = Window.partitionBy("key").orderBy("line_id")
    member = F.struct("line_id", "n", "sketch", "more")
    met = lists.withColumn("e", F.first(member).over(within)).withColumn("f", F.lag(member).over(within)).where("f IS NOT NULL")
    met = met.select(F.col("line_id").alias("a"), "n", "sketch", "more", F.explode(F.array("e", "f")).alias("b"))
    met = met.where(_close("", "b.", num, den))
    return met.select("a", F.col("b.line_id").alias("b")).distinct()


def _led(posted: DataFrame, leads: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) of an open line and a line of ``leads`` that share a rare word and pass the filters."""
    posted = posted.withColumn("n", F.shiftright("np", 32))
    heads = posted.join(F.broadcast(leads), "line_id", "left_semi")
    heads = materialize(heads.select("word", F.struct("line_id", "n", "sketch", "more").alias("e")))
    met = posted.where("(np & 1) = 1").join(F.broadcast(heads), "word")
    return met.where((F.col("e.line_id") < F.col("line_id")) & _close("", "e.", num, den)).select(F.col("line_id").alias("a"), F.col("e.line_id").alias("b")).distinct()


def _candidates(posted: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b), a the later line and open, of members of one list that pass the filters.

    ``np`` holds the size of the set, the place of the word and in its last bit whether the line is open. Members of split lists
    have a ``salt`` too, and take the part of the smaller set only where they are at ``home``.
    """
    keys = [c for c in ("word", "salt") if c in posted.columns]
    dealt = posted.repartition(*keys)  # read by both sides of the join

    def side(name: str, bucket: Column) -> DataFrame:
        n, pos = F.shiftright("np", 32), F.shiftright(F.col("np").bitwiseAND(F.lit((1 << 32) - 1)), 1)
        own = {"line_id": "id", "sketch": "sketch", "more": "more"} | ({"home": "home"} if "home" in posted.columns else {})
        found = dealt.select(*keys, n.alias(f"{name}_n"), pos.alias(f"{name}_pos"), F.col("np").bitwiseAND(F.lit(1)).alias(f"{name}_open"),
                             *[F.col(c).alias(f"{name}_{to}") for c, to in own.items()])
        return found.select("*", F.explode_outer(bucket).alias("bucket")).drop(f"{name}_home")

    def bucket(n: Column) -> Column:  # sizes a factor of den / num apart are at most one bucket apart
        return F.floor(F.log(n) / F.lit(math.log(den / num) * (1 + 1e-6))).cast("int")

    own = bucket(F.col("l_n"))
    lowest = bucket(F.ceil(F.col("l_n") * F.lit(num) / F.lit(den)))
    larger = side("l", F.array(own, F.when(lowest < own, own - 1)))
    few = F.col("s_n") - F.ceil(F.col("s_n") * F.lit(2 * num) / F.lit(num + den)) >= F.col("s_pos")
    if "home" in posted.columns:
        few &= F.col("s_home")
    smaller = side("s", F.when(few, F.array(bucket(F.col("s_n")))))
    nl, ns = F.col("l_n"), F.col("s_n")
    later = F.col("l_id") > F.col("s_id")
    ok = (ns < nl) | ((ns == nl) & later)
    ok &= F.when(later, F.col("l_open")).otherwise(F.col("s_open")) == 1
    ok &= F.least(nl - F.col("l_pos"), ns - F.col("s_pos")) * (num + den) >= (nl + ns) * num
    pairs = larger.join(smaller.hint("shuffle_hash"), [*keys, "bucket"]).where(ok & _close("l_", "s_", num, den))
    return pairs.select(F.greatest("l_id", "s_id").alias("a"), F.least("l_id", "s_id").alias("b"))


def _verify(pairs: DataFrame, words: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs whose line ``a`` matches the earlier line ``b``."""
    left = pairs.join(words.select(F.col("line_id").alias("a"), F.col("numbers").alias("of_a")), "a")
    both = left.join(words.select(F.col("line_id").alias("b"), F.col("numbers").alias("of_b")), "b")
    common = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(common * den >= (F.size("of_a") + F.size("of_b") - common) * num).select("a", "b")


def find_repeats(docs: DataFrame, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text", long: int = LONG, hot: int = HOT) -> DataFrame:
    """Per input row: __row, id, n_lines, n_removed, removed (the numbers of removed lines, from 0, ascending).

    Lines end at "\\n"; their words are separated by spaces and compared in lower case. Lines without words are never
    removed. Null texts count as empty (one line without words). Rows with equal ids are ordered as in the scan, and
    rows with null ids come first. An empty table gives an empty result; other columns are ignored. Very long texts
    are split in the one task that holds their row. An input that is not a plain scan of files is written once.
    """
    docs = stable(docs)
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    given = docs.select(F.monotonically_increasing_id().alias("__row"), F.col(f"`{id_col}`").alias("__id"), text.alias("__text"))
    split = F.split("__text", "\n")
    full = F.filter(F.transform(split, lambda x, i: F.when(F.trim(x) != "", i)), lambda i: i.isNotNull())
    rows = materialize(given.select("__row", "__id", F.size(split).alias("n_lines"), full.alias("full")))
    # line_id orders lines: the rank of the row and the number of the line; ids that fit serve as rank themselves
    stats = rows.agg(F.min("__id"), F.max("__id"), F.count("__id"), F.count(F.lit(1)), F.max("n_lines")).first()
    bits = max(1, int(stats[4] or 1).bit_length())
    plain = isinstance(stats[0], int) and stats[0] >= 0 and stats[1] < 1 << (62 - bits) and stats[2] == stats[3]
    if plain and not rows.groupBy("__id").count().where(F.col("count") > 1).take(1):
        rows, ranked = rows.withColumn("ord", F.col("__id").cast("long")), given.withColumn("ord", F.col("__id").cast("long"))
    else:
        order = dense_order(rows.select("__row", "__id"))
        rows, ranked = rows.join(order, "__row"), given.join(order, "__row")
    lines = ranked.select("ord", F.posexplode(F.split("__text", "\n")).alias("number", "line"))
    lines = lines.select(F.shiftleft("ord", bits).bitwiseOR(F.col("number").cast("long")).alias("line_id"), "line").where(F.trim("line") != "")

    table = _rarity(F.col("__text"), given)
    numbered = lines.select("line_id", _numbers(F.col("line"), table).alias("numbers"))
    n = F.size("numbers")

    def parity(bit: Callable[[Column], Column]) -> Column:
        return F.aggregate("numbers", F.lit(0).cast("long"), lambda a, k: a.bitwiseXOR(F.call_function("shiftleft", bit(k), k.bitwiseAND(F.lit(63)).cast("int"))))

    sketch = parity(lambda k: F.lit(1).cast("long"))
    more = F.when(n > WIDE, parity(lambda k: F.shiftright(k, 6).bitwiseAND(F.lit(1)))).otherwise(F.lit(0)).cast("long")
    prefix = F.slice("numbers", 1, n - F.ceil(n * F.lit(num) / F.lit(den)).cast("int") + 1)
    # a part of the hash names a word in the lists; sets so small that only equal ones are similar have none
    prefix = F.when(n * (den - num) >= num, F.transform(prefix, lambda k: k.bitwiseAND(F.lit((1 << 31) - 1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    sets = numbered.select("line_id", F.xxhash64("numbers").alias("d0"), F.xxhash64(F.lit(1), "numbers").alias("d1"), n.alias("n"), sketch.alias("sketch"), more.alias("more"), prefix.alias("prefix"))
    classes = sets.groupBy("d0", "d1").agg(F.min("line_id").alias("line_id"), F.first(F.struct("n", "sketch", "more", "prefix")).alias("s"))
    classes = materialize(classes.select("line_id", "s.*"))

    def verified(pairs: DataFrame) -> DataFrame:
        touched = pairs.select(F.explode(F.array("a", "b")).alias("line_id")).distinct()
        touched = broadcast_if_small(materialize(touched))
        words = materialize(lines.join(touched, "line_id").select("line_id", _numbers(F.col("line"), table).alias("numbers")))
        out = materialize(_verify(pairs, words, num, den))
        release(words)
        return out

    def earliest(pairs: DataFrame) -> DataFrame:
        """``first`` tells the pairs that a line tries first."""
        return materialize(pairs.withColumn("first", F.row_number().over(Window.partitionBy("a").orderBy("b")) <= long))

    often = classes.sample(SAMPLE_RATE, seed=1).select(F.explode("prefix").alias("word")).groupBy("word").count()
    very_long = materialize(often.where(F.col("count") > hot * SAMPLE_RATE).select("word"))

    def postings() -> DataFrame:
        marked = classes.join(broadcast_if_small(gone).withColumn("gone", F.lit(1)), "line_id", "left")
        np = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 1)).bitwiseOR(F.when(F.col("gone").isNull(), F.lit(1)).otherwise(F.lit(0)).cast("long"))
        return marked.select(F.posexplode("prefix").alias("pos", "word"), "line_id", "n", "sketch", "more", "gone").select("word", "line_id", np.alias("np"), "sketch", "more")

    matched = verified(materialize(_copies(classes, num, den)))
    gone = materialize(matched.select(F.col("a").alias("line_id")).distinct())
    leads = materialize(matched.groupBy(F.col("b").alias("line_id")).count().where(F.col("count") >= LEADS).orderBy(F.desc("count")).limit(1000).select("line_id"))
    if leads.take(1):
        matched = verified(earliest(_led(postings(), leads, num, den)).where("first").drop("first"))
        gone = materialize(gone.unionByName(matched.select(F.col("a").alias("line_id"))).distinct())
    posted = postings()
    if very_long.take(1):
        hot_word = F.broadcast(very_long.withColumn("hot", F.lit(True)))
        own = F.pmod(F.xxhash64("line_id"), F.lit(SALTS)).cast("int")
        salts = F.sequence(F.lit(0), F.lit(SALTS - 1))
        posted = posted.join(hot_word, "word", "left").select("*", F.explode(F.when(F.col("hot"), salts).otherwise(F.array(F.lit(0)))).alias("salt"))
        posted = posted.withColumn("home", F.col("hot").isNull() | (F.col("salt") == own)).drop("hot")
    with subset_keys(docs.sparkSession):
        pairs = materialize(_candidates(posted, num, den).distinct())
    pairs = earliest(pairs)
    gone = gone.unionByName(verified(pairs.where("first").drop("first")).select(F.col("a").alias("line_id")))
    rest = materialize(pairs.where("NOT first").drop("first").join(gone.select(F.col("line_id").alias("a")), "a", "left_anti"))
    if rest.take(1):
        gone = gone.unionByName(verified(rest).select(F.col("a").alias("line_id")))
    kept = classes.select("line_id").join(gone, "line_id", "left_anti")
    number = F.col("line_id").bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
    kept = kept.groupBy(F.shiftright("line_id", bits).alias("ord")).agg(F.collect_list(number).alias("kept"))
    removed = F.array_except("full", F.coalesce("kept", F.array().cast("array<int>")))
    return rows.join(kept, "ord", "left").select("__row", F.col("__id").alias(id_col), "n_lines", F.size(removed).alias("n_removed"), removed.alias("removed"))


def remove_repeats(docs: DataFrame, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the removed lines taken out of the text; a text that loses no line stays as it is, a null text too.

    An input that is not a plain scan of files is written once; an empty table gives an empty result.
    """
    docs = stable(docs)
    found = find_repeats(docs, num, den, id_col, text_col).where("n_removed > 0").select("__row", F.col("removed").alias("__removed"))
    joined = docs.withColumn("__row", F.monotonically_increasing_id()).join(materialize(found), "__row", "left")
    left = F.filter(F.split(F.col(f"`{text_col}`"), "\n"), lambda x, i: ~F.array_contains("__removed", i))
    return joined.withColumn(text_col, F.when(F.col("__removed").isNull(), F.col(f"`{text_col}`")).otherwise(F.array_join(left, "\n"))).drop("__row", "__removed")
