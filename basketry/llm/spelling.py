"""Spelling variants: words one edit apart, found with an index of variable-length grams.

1. Dictionary. Grams of Q_MIN to Q_MAX characters of all words (between two end marks) are counted. A longer gram
   belongs to the dictionary only if it is frequent itself and the gram without its last character is too frequent
   to stay alone; rare ones are pruned. At most DICTIONARY grams of each length pass, as each needs that share of all
   places, so the dictionary has a proven bound and may be sent to every task.
2. Decomposition. At each place a word has one gram: the longest of the dictionary that starts there, or the one of
   Q_MIN characters. Which one depends on the characters up to its reach only: those of the gram itself and the
   next one, if a longer gram of the dictionary goes on.
3. Bounds. An edit affects only the grams whose place and reach it lies between; the most that any edit affects is
   the word's own bound b. Two words one edit apart therefore share all but b of either's grams, at the same place
   from one end, and in the order of frequency they share one of the first b + 1 of both.
4. List merging. Each word enters the lists of its b + 1 rarest grams. As a shared gram isn't affected, the one edit
   lies on one side of it, and the other side is equal; on the edit's side, one half is. A list is therefore dealt by
   the equal side and half, which keeps every list short and no group whole, also that of a very frequent gram.
   Longer words enter the lists of words with one character less, too.
5. Verification. Pairs of a list are compared by edit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketry.llm.common import Tables

Q_MIN, Q_MAX = 2, 4
#: Of each length of grams, those that take at least this part of all places may enter the dictionary.
DICTIONARY = 100_000
#: A gram more frequent than so many times the least frequency gets longer ones beside it.
EXTEND = 4
MIN_LENGTH, MIN_COUNT, FACTOR = 7, 2, 10
# The letters of a word, and which of them are put in lower case.
LETTERS = "[A-Za-z\\u00C0-\\u00FF]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"


def count_words(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, damage: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): words of at least ``min_length`` letters that occur at least ``min_count`` times, A-Z in lower case.

    ``damage`` plants variants: with h the CRC-32 of ``<id>:<run>``, runs of letters with h divisible by it lose the
    letter h modulo their length (0: no damage). Null ids count as empty. Shorter runs can't become words and
    are left out at once.
    """
    text = F.translate(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), UPPER, LOWER)
    ident = F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))
    runs = docs.select(ident.alias("__id"), F.explode(F.regexp_extract_all(text, F.lit(f"({LETTERS}{{{min_length},}})"), F.lit(1))).alias("__run"))
    word = F.col("__run")
    if damage:
        runs = runs.withColumn("__h", F.crc32(F.concat("__id", F.lit(":"), "__run").cast("binary")))
        at = (F.col("__h") % F.length("__run")).cast("int")
        cut = F.concat(F.substring("__run", F.lit(1), at), F.substring("__run", at + 2, F.length("__run")))
        word = F.when(F.col("__h") % damage == 0, cut).otherwise(F.col("__run"))
    words = runs.select(word.alias("word")).where(F.length("word") >= min_length)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def gram_dictionary(words: DataFrame, places: int = DICTIONARY) -> tuple[dict[str, int], int]:
    """The counts of frequent grams, and the least count from which a gram gets longer ones beside it."""
    marked = F.concat(F.lit(START), "word", F.lit(END))
    total = words.agg(F.sum(F.length("word") + 1)).first()[0] or 0
    least = max(1, -(-int(total) // places))
    grams = words.select(marked.alias("s")).select("s", F.explode(F.sequence(F.lit(1), F.length("s") - 1)).alias("p"))
    grams = grams.select(F.explode(F.array(*[F.when(F.col("p") + q - 1 <= F.length("s"), F.substring("s", F.col("p"), F.lit(q))) for q in range(Q_MIN, Q_MAX + 1)])).alias("g"))
    often = grams.where("g IS NOT NULL").groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= least)
    counts = {r[0]: r[1] for r in often.collect()}  # at most `places` rows for each length
    kept = {g for g in counts if len(g) == Q_MIN}
    for q in range(Q_MIN + 1, Q_MAX + 1):
        kept |= {g for g in counts if len(g) == q and g[:-1] in kept and counts[g[:-1]] > EXTEND * least}
    return {g: counts[g] for g in kept}, least


def decompose(word: str, counts: dict[str, int], inner: set[str]) -> list[tuple[int, str, int, int]]:
    """(count, gram, place, reach) of each place of a word between its end marks."""
    s = START + word + END
    out = []
    for p in range(len(s) - Q_MIN + 1):
        gram = s[p:p + Q_MIN]
        while p + len(gram) < len(s) and (longer := s[p:p + len(gram) + 1]) in counts:
            gram = longer
        out.append((counts.get(gram, 0), gram, p, p + len(gram) - (gram not in inner)))
    return out


def rarest(word: str, counts: dict[str, int], inner: set[str]) -> list[tuple[int, int]]:
    """(start, end) of the grams whose lists a word enters: one more than an edit can affect, the rarest."""
    grams = decompose(word, counts, inner)
    n = len(word) + 2
    change = [0] * (n + 2)
    for _, _, p, reach in grams:
        change[max(1, p)] += 1
        change[min(reach, n - 1) + 1] -= 1
    most = hit = 0
    for i in range(1, n):
        hit += change[i]
        most = max(most, hit)
    return [(p, p + len(gram)) for _, gram, p, _ in sorted(grams)[:most + 1]]


def list_keys(word: str, spans: list[tuple[int, int]], n: int) -> set[str]:
    """The lists that a word enters among words of n characters (with end marks): its own length or one less."""
    s = START + word + END
    more = len(s) - n
    keys = set()
    for p, e in spans:
        # the edit behind the gram: the text up to e is equal, and of the r characters of the shorter word behind it the first h or the others
        r = n - e
        if r > 0:
            h = r // 2
            if r - 2 >= h:
                keys.add(f"{n} > {s[:e + h]}")
            keys.add(f"{n} < {s[:e]} {s[len(s) - (r - h):]}")
        # the edit before the gram: the text from p on is equal, and the last h of the r characters before it or the others
        r = p - more
        if r > 0:
            h = r // 2
            if r - h >= 2:
                keys.add(f"{n} ) {s[p - h:]}")
            keys.add(f"{n} ( {s[:r - h]} {s[p:]}")
    return keys


def near_pairs(words: DataFrame, places: int = DICTIONARY, tables: Tables | None = None) -> DataFrame:
    """(a, na, b, nb): each pair of distinct words of (word, n) that differ by one inserted, deleted or replaced character, once.

    Words have at least Q_MAX characters, so that an edit never affects all grams of one. The result reads a written
    table of the lists of each word, which is held in ``tables``.
    """
    tables = tables or Tables()
    counts, _ = gram_dictionary(words, places)
    inner = {g[:-1] for g in counts if len(g) > Q_MIN}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                names = some.column(0).to_pylist()
                own, guest = [], []
                for word in names:
                    spans = rarest(word, counts, inner)
                    own.append(list(list_keys(word, spans, len(word) + 2)))
                    guest.append(list(list_keys(word, spans, len(word) + 1)))
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(own, pa.list_(pa.string())), pa.array(guest, pa.list_(pa.string()))], names=["w", "n", "own", "guest"])

    lists = tables.write(words.select("word", "n").mapInArrow(run, "w string, n long, own array<string>, guest array<string>"))
    entries = lambda c, role: F.transform(c, lambda k: F.struct(F.xxhash64(k).alias("key"), F.lit(role).alias("guest")))
    member = F.concat(entries("own", 0), entries("guest", 1))
    members = lists.select("w", "n", F.explode(member).alias("m")).select(F.col("m.key").alias("key"), F.col("m.guest").alias("guest"), "w", "n")
    # both sides are the same rows with the same columns, so that they are shuffled once: conditions that name both sides
    # aren't moved below the exchange
    x, y = members.alias("x"), members.alias("y")
    role = (F.col("x.guest") < F.col("y.guest")) | ((F.col("x.guest") + F.col("y.guest") == 0) & (F.col("x.w") < F.col("y.w")))
    length = F.length("y.w") - F.length("x.w") == F.col("y.guest") - F.col("x.guest")
    pairs = x.join(y, F.col("x.key") == F.col("y.key")).where(role & length & (F.levenshtein("x.w", "y.w", 1) == 1))
    return pairs.select(F.col("x.w").alias("a"), F.col("x.n").alias("na"), F.col("y.w").alias("b"), F.col("y.n").alias("nb")).distinct()


def variants(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, factor: int = FACTOR, damage: int = 31,
             places: int = DICTIONARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per word: word, form, root, n, n_near, form_n.

    n_near counts the words one edit away. ``form`` is the most frequent of them (ties: the smallest in order of code
    points) if it is at least ``factor`` times as frequent as the word, else null; ``root`` follows forms to
    the last one. Forms grow by the factor at each step, so there are no circles and few steps.

    Null texts and texts without words add nothing; repeated rows count again; an empty table gives an empty result;
    other columns are ignored. Very long texts are read whole, in the one task that holds their row. A word has a
    bounded number of words one edit away, so no group of a word grows with the table.
    """
    if min_length < Q_MAX:
        raise ValueError(f"words of fewer than {Q_MAX} letters may share no gram")
    tables = Tables()
    words = tables.write(count_words(docs, min_length, min_count, damage, id_col, text_col))
    pairs = tables.write(near_pairs(words, places, tables))
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("nb")).alias("neg"), F.col("b").alias("form")).alias("o")).unionByName(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("na")).alias("neg"), F.col("a").alias("form")).alias("o")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("o").alias("o"))
    told = words.join(near, "word", "left")
    high = -F.col("o.neg") >= factor * F.col("n")
    told = tables.write(told.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(high, F.col("o.form")).alias("form"), F.when(high, -F.col("o.neg")).alias("form_n")))
    tables.drop(told)
    steps = told.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps taken
        on = steps.select(F.col("word").alias("root"), F.col("root").alias("__on"))
        steps = tables.write(steps.join(on, "root", "left").select("word", F.coalesce("__on", "root").alias("root"), F.col("__on").isNotNull().alias("__moved")))
        moved = bool(steps.where("__moved").take(1))
        steps = steps.drop("__moved")
        if not moved:
            break
    return told.join(steps, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
