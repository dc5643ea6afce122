"""Spelling variants by anagram hashing.

A word's key is the sum of the fourth powers of its code points, an integer that does not know the order of letters
(a power of four keeps every Spark string below 2^63 for letters up to U+00FF). Two words that differ by one added,
removed or exchanged letter have keys that differ by p(x) or by p(x) - p(y). Each key is therefore joined with what
is left of it when one of its letters' values is taken away: a key that equals such a rest is one addition away, two
keys with a common rest are one exchange away. Only letters whose rest is met by a second key are followed further:
there the order of letters is verified by the words themselves, written without the letter. (Rests of LONG letters or
more are written as 122-bit fingerprints, so that a word's rows grow with its length and not with its square.)

No pairs are emitted within a class of anagrams: words meet on (rest in order, place), where at most one word for each
letter of the alphabet can stand, and on (rest in order), where each word has as many rows as letters. Counting
and the best neighbour are aggregates, combined before each shuffle.

Defined results: null and empty texts have no words; a null document id is written as the empty string before the
colon; runs of any length count whole; repeated rows count each; an empty table gives no rows; words are told apart by
code points, ties go to the smaller word in that order; extra columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.llm.common import discard, ship, stash

MIN_LENGTH, MIN_COUNT, DAMAGE = 5, 3, 97
LONG, MODULUS, PLACES = 256, (1 << 61) - 1, (1_000_003, 998_244_353)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def runs(df: DataFrame, id_col: str, text: str, min_length: int) -> DataFrame:
    """(id, run) of each maximal run of letters of min_length code points or more."""
    lowered = F.translate(F.col(text), UPPER, LOWER)
    found = F.regexp_extract_all(lowered, F.lit(f"([a-zÀ-ÿ]{{{min_length},}})"), F.lit(1))
    return df.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(found).alias("run"))


def damaged(run: Column, doc: Column, every: int) -> Column:
    """The run, without one code point where `every` divides the checksum of '<doc>:<run>'."""
    h = F.crc32(F.concat(doc, F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run)).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(run)


def vocabulary(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = DAMAGE) -> DataFrame:
    """(word, n) of the words of whole texts; runs of fewer than min_length letters cannot become words."""
    words = runs(df, id_col, text, min_length).select(damaged(F.col("run"), F.col("id"), every).alias("word"))
    return words.where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def power(letter: Column) -> Column:
    code = F.ascii(letter).cast("long")
    return code * code * code * code


def letters(word: Column) -> Column:
    return F.split(word, "")


def key_of(word: Column) -> Column:
    return F.aggregate(letters(word), F.lit(0).cast("long"), lambda s, c: s + power(c))


def live_removals(words: DataFrame) -> DataFrame:
    """(key, letters, alone): of each key the letters whose rest another key meets, and whether the key itself is such a rest."""
    removed = words.select("key", F.explode(F.array_distinct(letters(F.col("word")))).alias("letter")).distinct().withColumn("rest", F.col("key") - power(F.col("letter")))
    whole = words.select("key").distinct().select("key", F.lit(None).cast("string").alias("letter"), F.col("key").alias("rest"))
    rows = removed.unionByName(whole)
    met = rows.groupBy("rest").agg(F.min("key").alias("a"), F.max("key").alias("b")).where("a <> b").select("rest")
    live = rows.join(met, "rest")
    return live.groupBy("key").agg(F.collect_set("letter").alias("letters"), F.max(F.col("letter").isNull()).alias("alone"))


def fingerprint(length: int, hashes) -> str:
    """A long rest in few letters: its length and its values as a polynomial modulo 2^61 - 1 at two places."""
    return f"{length}:{':'.join(f'{h:x}' for h in hashes)}"


def long_rests(word: str, wanted) -> list[tuple[int, str, bool]]:
    """(at, fingerprint of the word without its letter there, whether the letter before is another) for wanted letters."""
    codes, n = [ord(c) for c in word], len(word)
    sides = []
    for base in PLACES:
        power, after, before = [1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        for i in range(n):
            power[i + 1] = power[i] * base % MODULUS
            before[i + 1] = (before[i] * base + codes[i]) % MODULUS
        for i in range(n - 1, -1, -1):
            after[i] = (codes[i] * power[n - 1 - i] + after[i + 1]) % MODULUS
        sides.append((power, before, after))
    wanted, out = set(wanted), []
    for i, c in enumerate(word):
        if c in wanted:
            out.append((i, fingerprint(n - 1, ((before[i] * power[n - 1 - i] + after[i + 1]) % MODULUS for power, before, after in sides)), i == 0 or word[i - 1] != c))
    return out


def whole_fingerprint(word: str) -> str:
    hashes = []
    for base in PLACES:
        h = 0
        for c in word:
            h = (h * base + ord(c)) % MODULUS
        hashes.append(h)
    return fingerprint(len(word), hashes)


def rests_of_long(held: DataFrame) -> DataFrame:
    """(me, at, rest, first) of words above LONG letters; a row is small however long the word is."""
    rows = held.where(F.length("word") > LONG).select("word", "letters", "me.m", "me.head", "me.rk")

    def run(batches):
        for batch in batches:
            for word, wanted, m, head, rk in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = long_rests(word, wanted)
                for i in range(0, len(found), 4096):
                    at, rest, first = zip(*found[i : i + 4096], strict=True)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([m] * n, pa.int64()), pa.array([head] * n, pa.string()), pa.array([rk] * n, pa.int64()), pa.array(at, pa.int32()), pa.array(rest, pa.string()), pa.array(first)], names=["m", "head", "rk", "at", "rest", "first"])

    return rows.mapInArrow(run, "m long, head string, rk long, at int, rest string, first boolean").select(F.struct("m", "head", "rk").alias("me"), "at", "rest", "first")


def rests_as_words(held: DataFrame) -> DataFrame:
    """(rest, short) of the words that are themselves rests."""
    alone = held.where("alone")

    def run(batches):
        for batch in batches:
            word, *others = batch.columns
            yield pa.RecordBatch.from_arrays([pa.array([whole_fingerprint(w) for w in word.to_pylist()], pa.string()), *others], names=["rest", "m", "head", "rk"])

    long = alone.where(F.length("word") >= LONG).select("word", "me.m", "me.head", "me.rk").mapInArrow(run, "rest string, m long, head string, rk long")
    return alone.where(F.length("word") < LONG).select(F.col("word").alias("rest"), F.col("me").alias("short")).unionByName(long.select("rest", F.struct("m", "head", "rk").alias("short")))


def keyed(words: DataFrame) -> DataFrame:
    """words with key and me, a struct (-n, head, rk) that orders words by count and then code points.

    A word above LONG letters is told apart by its head and its rank among those words, so that what travels for each of its
    letters does not hold the word."""
    ship(words.sparkSession)
    long = words.where(F.length("word") > LONG).orderBy("word").withColumn("rk", F.monotonically_increasing_id())
    rows = words.where(F.length("word") <= LONG).withColumn("rk", F.lit(-1).cast("long")).unionByName(long)
    return rows.select("word", "n", key_of(F.col("word")).alias("key"), F.struct((-F.col("n")).alias("m"), F.substring("word", 1, LONG).alias("head"), "rk").alias("me"))


def nearness(words: DataFrame) -> DataFrame:
    """(me, n_near, best) for the words of keyed() that have a near word; best is the me of the one with the largest n."""
    held = stash(words.join(live_removals(words), "key"))
    spelt = held.where(F.length("word") <= LONG).select("word", "me", "letters", F.posexplode(letters(F.col("word"))).alias("at", "letter"))
    spelt = spelt.where(F.array_contains("letters", F.col("letter")))
    rest = F.concat(F.substring("word", F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 2, F.length("word")))
    before = F.substring(F.col("word"), F.col("at"), F.lit(1))
    short = spelt.select("me", "at", rest.alias("rest"), ((F.col("at") == 0) | (before != F.col("letter"))).alias("first"))
    cut = stash(short.unionByName(rests_of_long(held)))
    # exchange: equal rests at the same place; one word a letter of the alphabet at most
    met = cut.groupBy("rest", "at").agg(F.array_sort(F.collect_list("me")).alias("all")).where(F.size("all") > 1)
    swapped = met.select(F.explode("all").alias("me"), "all")
    other = F.when(F.col("me") == F.col("all")[0], F.col("all")[1]).otherwise(F.col("all")[0])
    swaps = swapped.select("me", (F.size("all") - 1).cast("long").alias("n_near"), other.alias("best"))
    # addition and removal: the rest is a word; of equal letters side by side only the first is taken out
    grown = cut.where("first").select("rest", "me").join(rests_as_words(held), "rest")
    longer = grown.select("me", F.lit(1).cast("long").alias("n_near"), F.col("short").alias("best"))
    shorter = grown.select(F.col("short").alias("me"), F.lit(1).cast("long").alias("n_near"), F.col("me").alias("best"))
    near = stash(swaps.unionByName(longer).unionByName(shorter).groupBy("me").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best")))
    discard(held, cut)
    return near


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms (word, form): chains end, as counts at least double along them, and halve with each round."""
    held = stash(forms.select("word", F.col("form").alias("root")))
    while True:
        up = held.select(F.col("word").alias("root"), F.col("root").alias("to"))
        step = held.join(up, "root", "left").select("word", F.coalesce("to", "root").alias("root"), F.col("to").isNotNull().alias("moved"))
        before, held = held, stash(step)
        discard(before)
        if held.where("moved").isEmpty():
            return held.drop("moved")
        held = held.drop("moved")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text: str = "text", min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT, every: int = DAMAGE) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of df's texts and the more frequent word that it is a variant of."""
    words = stash(keyed(stash(vocabulary(df, id_col, text, min_length, min_count, every))))
    joined = words.join(nearness(words), "me", "left")
    taken = (-F.col("best.m")) >= 2 * F.col("n")
    rows = stash(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("best")).alias("best")))
    named = rows.where("best is null or best.rk < 0").withColumn("form", F.col("best.head"))
    long = words.where("me.rk >= 0").select(F.col("me.rk").alias("rk"), F.col("word").alias("form"))
    rows = stash(named.unionByName(rows.where("best.rk >= 0").withColumn("rk", F.col("best.rk")).join(long, "rk").drop("rk")))
    tops = roots(rows.where("form is not null"))
    return rows.join(tops, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", (-F.col("best.m")).alias("form_n"))


def op12(spark, sf_dir: str) -> DataFrame:
    from skein.llm.common import table

    return spelling_variants(table(spark, sf_dir, "documents"))
