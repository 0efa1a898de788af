r"""Benchmark decontamination by a positional inverted index, in DataFrame operations only.

1. The words of all benchmark items are the vocabulary.  One pass over the documents writes the index: a posting (key,
   hash of the text, term, position) for each of these words, and one at the end of each document that has its number of
   words.  Each file of the index is sorted by term, so the postings of a term are found without reading the others.
2. Each window of test words is looked up from its two rarest terms.  Their posting lists are intersected where the
   positions are at most ``distance`` apart; neighbouring windows mostly share these terms and are looked up together.
3. Around each place found the postings of the windows' other terms are intersected, adjusted by their offsets: a window
   whose terms all stand at their offsets is an exact phrase match, one whose terms all stand within ``distance`` words
   is a proximity match.

The number of passes over documents and index does not depend on the number of windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkedframe.llm.common import stored

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Terms, or terms of places to look up, whose table is broadcast (a row of about 100 bytes each); larger tables are joined
#: by shuffles, where Spark splits the postings of a frequent term.
BROADCAST = 500_000
#: Words that the terms of a proximity match may be away from the rarest one.
DISTANCE = 24
#: What ends a document in the index; no word can be this.
END, END_TERM = "\0", -1


def words_of(text: str | Column) -> Column:
    """Words by position, case kept.  The first and the last may be empty, where a text starts or ends otherwise."""
    return F.split(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SEPARATORS, -1)


def plain_words(text: str) -> Column:
    """The lower-case (A-Z) words of a short text."""
    return F.filter(words_of(F.translate(text, UPPER, LOWER)), lambda w: w != "")


def _sized(table: DataFrame) -> DataFrame:
    """A stored table, broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST else table


def phrases_of(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """(item, words) of each item with an id and words, each once."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), plain_words(text).alias("words"))
    return words.where("item IS NOT NULL AND size(words) > 0").distinct()


def vocabulary_of(phrases: DataFrame) -> DataFrame:
    """(term, word) of each word of the phrases; ``term`` is its number."""
    words = phrases.select(F.explode("words").alias("word")).distinct()
    return stored(words.select(F.monotonically_increasing_id().alias("term"), "word"))


def postings(docs: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index (key, hash, term, pos) of the vocabulary's words; term -1 has a document's number of words as ``pos``.

    Positions ascend by one a word; whether they start at 0 or 1 depends on how the text starts.
    """
    spark = docs.sparkSession
    known = vocabulary.select("term", F.col("word").alias("exact"), F.lower("word").alias("folded")).withColumn("plain", F.expr("exact = folded"))
    end = spark.range(1).select(F.lit(END_TERM).cast("long").alias("term"), F.lit(END).alias("exact"), F.lit(END).alias("folded"), F.lit(True).alias("plain"))
    known = F.broadcast(known.union(end)) if vocabulary.count() <= BROADCAST else known.union(end)
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), words_of(text).alias("words"))
    n_words = "greatest(0, size(words) - int(words[0] = '') - int(words[size(words) - 1] = ''))"
    ended = rows.select("key", "hash", F.expr(n_words).alias("n_words"), F.concat("words", F.array(F.lit(END))).alias("words"))
    placed = ended.select("key", "hash", "n_words", F.posexplode_outer("words").alias("pos", "word"))
    # lower() is fast and never parts words that differ in A-Z only; where it may do more, the word is compared exactly
    exact = F.expr(f"if(octet_length(word) = length(word), plain, translate(word, '{UPPER}', '{LOWER}') = exact)")
    found = placed.join(known, (F.lower("word") == F.col("folded")) & exact)
    return stored(found.select("key", "hash", "term", F.when(F.col("term") == END_TERM, F.col("n_words")).otherwise(F.col("pos")).alias("pos")).sortWithinPartitions("term"))


def lookups(index: DataFrame, vocabulary: DataFrame, phrases: DataFrame, window: int | None, distance: int) -> DataFrame:
    """The stored places to look up: (pair, item, n, q1, q2, low, terms, reach), each for some windows of one phrase.

    ``q1`` and ``q2`` are where the two rarest terms of these windows stand in the phrase, ``terms`` what stands there
    from ``low`` on as far as the windows go, ``n`` the length of a window, ``reach`` how far from ``q1`` to search.
    Windows with a term that has no posting are left out.  A window's row has its own terms only, so a phrase costs its
    length times that of a window, however long it is.
    """
    counts = index.where(F.col("term") >= 0).groupBy("term").agg(F.count("*").alias("postings"))
    numbered = stored(vocabulary.join(counts, "term", "left").na.fill(0, ["postings"]))
    # the hash before the words part, or it would be made for each of them
    named = phrases.select("item", "words", F.xxhash64("item", "words").alias("phrase")).select("item", "phrase", F.posexplode("words").alias("q", "word"))
    at = named.join(_sized(numbered), "word")
    whole = stored(at.groupBy("phrase", "item").agg(F.array_sort(F.collect_list(F.struct("q", "postings", "term"))).alias("at")))
    n = F.size("at") if window is None else F.least(F.lit(window), F.size("at"))
    # by place, since slice() goes through the whole of an array
    own = """transform(sequence(0, size(at) - n), i -> named_struct('i', i, 'terms', transform(sequence(i, i + n - 1), j -> at[j].term),
        'rare', slice(array_sort(transform(sequence(i, i + n - 1), j -> named_struct('postings', at[j].postings, 'q', j))), 1, 2)))"""
    windows = whole.withColumn("n", n).select("phrase", "item", "n", F.explode(F.filter(F.expr(own), lambda w: w["rare"][0]["postings"] > 0)).alias("w")).select("phrase", "item", "n", "w.*")
    # the windows of a pair follow each other, and the last one begins before the first one ends
    pairs = windows.groupBy("phrase", "item", "n", F.expr("rare[0].q").alias("q1"), F.expr("rare[size(rare) - 1].q").alias("q2")).agg(
        F.min("i").alias("low"), F.max("i").alias("high"), F.min_by("terms", "i").alias("first"), F.max_by("terms", "i").alias("last")
    )
    terms = F.expr("concat(first, slice(last, n - (high - low) + 1, high - low))")
    reach = F.greatest(F.lit(distance), F.col("n") - 1)
    return stored(pairs.select(F.monotonically_increasing_id().alias("pair"), "item", "n", "q1", "q2", "low", terms.alias("terms"), reach.alias("reach")))


def matches(index: DataFrame, vocabulary: DataFrame, phrases: DataFrame, window: int | None = None, distance: int = DISTANCE) -> DataFrame:
    """(item, key, hash, n, starts, near): where windows of the phrases (of (item, words)) are in the index.

    ``starts`` are the positions where a window of ``n`` words stands word for word, ``near`` those of a rarest term
    with all other terms of its window within ``distance`` words (or the window's length, if that is more), in any
    order.  Without ``window`` each phrase is one window.  A row has at least one of both.
    """
    pairs = lookups(index, vocabulary, phrases, window, distance)
    # lists of the two rarest terms, met in stretches as long as the reach: in each, the places of the rarest one have
    # those of the other at hand, and no stretch holds more than a few times its length
    roles = F.array(F.struct(F.expr("terms[q1 - low]").alias("term"), F.lit(1).alias("role")), F.struct(F.expr("terms[q2 - low]").alias("term"), F.lit(2).alias("role")))
    anchors = stored(pairs.select("pair", "reach", F.explode(roles).alias("r")).select("pair", "reach", "r.*"))
    lists = index.join(_sized(anchors), "term").select("pair", "reach", "role", "key", "hash", "pos")
    stretch = F.floor(F.col("pos") / F.col("reach"))
    stretches = F.when(F.col("role") == 1, F.array(stretch - 1, stretch, stretch + 1)).otherwise(F.array(stretch))
    met = (
        lists.select("pair", "reach", "key", "hash", F.explode(stretches).alias("stretch"), F.when(F.col("role") == 1, F.col("pos")).alias("p1"), F.when(F.col("role") == 2, F.col("pos")).alias("p2"))
        .groupBy("pair", "reach", "key", "hash", "stretch")
        .agg(F.collect_set("p1").alias("p1"), F.collect_set("p2").alias("p2"))
        .where("size(p1) > 0 AND size(p2) > 0")
    )
    near = F.expr("filter(p1, a -> exists(p2, b -> abs(b - a) <= reach))")
    places = stored(met.select("pair", "key", "hash", F.explode(near).alias("at")).distinct())

    # lists of all terms of the windows, in the documents of these places only, met in stretches like those above
    documents = stored(places.select(F.col("key").alias("k"), F.col("hash").alias("h")).distinct())
    width = pairs.agg(F.max("reach")).first()[0] or 1
    rest = index.join(documents, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left_semi").withColumn("stretch", F.expr(f"pos div {width}"))
    wanted = (
        places.join(pairs, "pair")
        .select("pair", F.col("key").alias("k"), F.col("hash").alias("h"), "at", "reach", F.explode(F.array_distinct("terms")).alias("t"))
        .select("*", F.explode(F.expr(f"sequence(greatest(0, at - reach) div {width}, (at + reach) div {width})")).alias("near_stretch"))
    )
    there = F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")) & (F.col("term") == F.col("t")) & (F.col("stretch") == F.col("near_stretch"))
    here = there & (F.abs(F.col("pos") - F.col("at")) <= F.col("reach"))
    around = rest.join(wanted, here).groupBy("pair", "key", "hash", "at").agg(F.collect_set(F.struct((F.col("pos") - F.col("at")).alias("off"), "term")).alias("found"))
    exact = """transform(filter(sequence(0, size(terms) - n),
        i -> forall(sequence(i, i + n - 1), j -> array_contains(found, named_struct('off', j + low - q1, 'term', terms[j])))), i -> at - q1 + low + i)"""
    close = "exists(sequence(0, size(terms) - n), i -> forall(slice(terms, i + 1, n), t -> exists(found, f -> f.term = t)))"
    return (
        around.join(pairs, "pair")
        .select("item", "key", "hash", "n", F.expr(exact).alias("starts"), F.expr(f"if({close}, at, null)").alias("near"))
        .where("size(starts) > 0 OR near IS NOT NULL")
    )


def phrase_matches(found: DataFrame) -> DataFrame:
    """(item, key, hash, start, end): each exact occurrence of a window, of the result of :func:`matches`."""
    starts = found.select("item", "key", "hash", F.explode("starts").alias("start"), "n").distinct()
    return starts.select("item", "key", "hash", "start", (F.col("start") + F.col("n") - 1).alias("end"))


def proximity_matches(found: DataFrame) -> DataFrame:
    """(item, key, hash, pos): each posting of a rarest term with all other terms of its window near it."""
    return found.where("near IS NOT NULL").select("item", "key", "hash", F.col("near").alias("pos")).distinct()


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, window: int = 13, key: str = "doc_id", text: str = "text", item: str = "item_id", distance: int = DISTANCE
) -> DataFrame:
    """One row a document: (key, text_hash, n_words, n_hit, items, n_near, contaminated).

    A word inside any occurrence of a window of ``window`` item words is hit; ``items`` are the items, as sorted strings,
    with such windows; ``n_near`` is the number of items with a proximity match; a document is contaminated if at least
    one word in twenty is hit.  Null and empty texts have no words and no hits; null items count as texts without
    windows, and an item given more than once is one item.  A row repeated n times gives n rows.  Documents that share a
    key but not a text are told apart.  Empty tables give an empty result or one without hits.  Other columns are left
    out.  ``text_hash`` is the text's xxhash64.
    """
    phrases = stored(phrases_of(benchmark, item, text))
    vocabulary = vocabulary_of(phrases)
    index = postings(docs, vocabulary, key, text)
    found = stored(matches(index, vocabulary, phrases, window, distance))
    covered = F.expr("array_distinct(flatten(transform(starts, s -> sequence(s, s + n - 1))))")
    words = found.select("item", "key", "hash", F.explode(covered).alias("pos")).groupBy("key", "hash", "pos").agg(F.collect_set("item").alias("items"))
    hit = words.groupBy("key", "hash").agg(F.count("*").alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    near = found.where("near IS NOT NULL").select("key", "hash", "item").distinct().groupBy("key", "hash").agg(F.count("*").alias("n_near"))
    both = hit.unionByName(near, allowMissingColumns=True).groupBy("key", "hash").agg(F.max("n_hit").alias("n_hit"), F.max("items").alias("items"), F.max("n_near").alias("n_near"))
    hits = stored(both.select(F.col("key").alias("k"), F.col("hash").alias("h"), "n_hit", "items", "n_near"))
    ends = index.where(F.col("term") == END_TERM).select("key", "hash", F.col("pos").cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    return (
        ends.join(hits, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left")
        .na.fill(0, ["n_hit", "n_near"])
        .select(F.col("key").alias(key), F.col("hash").alias("text_hash"), "n_words", "n_hit", F.coalesce("items", none).alias("items"), "n_near")
        .withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words"))
    )
