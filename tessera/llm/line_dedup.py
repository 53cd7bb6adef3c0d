"""Line dedup by an exact set-similarity join, in DataFrame functions alone.

A line's set is its different words as written (split at ASCII white space). Two
lines match if the Jaccard similarity of their sets is at least ``threshold``; a
line goes if a line before it (by doc_id and place) matches it, whether or not
that one stays itself. Lines without words match nothing and stay.

1. Equal lines become one class, which counts from its first place. Lines are
   compared as texts, combined before the shuffle, so a line that stands
   everywhere is one row.
2. Words are counted in ``COUNTERS`` counters by hash; a word's rank is the
   logarithm of its counter, so rarer words come first. A wrong guess of rarity
   costs time, not matches: any fixed order finds every pair.
3. Prefix filter: of n words in order, the first n - ceil(t n) + 1 are entries; two
   matching lines share one. Sets of three words or less match only equal sets,
   and have one entry for the whole set. Length filter, positional filter (what is
   left after a shared word must suffice) and a parity signature of 64 bits, 128 for
   larger sets (matching sets differ in at most as many bits as words), are part of the
   join on words.
4. Large groups of near copies are not paired: lines that share bands (hashes of three
   of their rarer words) form families, and pairs that a family's middle proves to match
   are counted by the distances from it. Any grouping gives the same results.
5. Remaining pairs are verified on the words themselves.

The counters (a fixed number of bytes) are a literal of one plan, that of the written
sets; the only broadcast tables asked for are, if there are at most ``SMALL`` of them, the
ids of classes to verify, and half as many bands of families; more take a sorted join.

Defined cases: a null text has no lines, an empty one has one line without words;
null doc_ids come first; lines of rows that share a doc_id share places, and of equal
ones in the same place all stay if the first place is theirs; extra columns are
ignored by ``lines`` and kept by ``dedup``; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import dropped, written

THRESHOLD = 0.8
COUNTERS = 1 << 20
#: Ids that may be broadcast (8 bytes each).
SMALL = 2_000_000
#: Pairs are verified in so many passes: a pair carries a line through a shuffle, and
#: only one pass's shuffle files are on the disks at a time.
PASSES = 4
#: Words in a band, and the classes in the smallest group that is a family. Both change
#: the time alone: whatever is no family is paired.
BAND, FAMILY = 3, 8
#: Sets of more words have 128 bits of parity, others 64: enough to tell them apart.
ONE_SIGN = 80


def _split(line: Column) -> Column:
    """The words between white space, with repeats and empty ones. Most lines have
    no white space but spaces, which are split without a pattern."""
    other = F.contains(line, F.lit("\t")) | F.contains(line, F.lit("\r")) | F.contains(line, F.lit("\x0b")) | F.contains(line, F.lit("\f"))
    return F.when(other, F.split(line, r"\s+")).otherwise(F.split(line, " "))


def words(line: Column) -> Column:
    return F.array_remove(F.array_distinct(_split(line)), "")


def _bound(**columns: Column) -> Column:
    """Columns behind a generator: worked out once and not again in every use."""
    return F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()])))


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    return rows.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def _digest(line: Column) -> list[Column]:
    """128 bits that name a class in joins."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, line, n_lines, first): a row for each different line."""
    lines = _occurrences(docs, id_col, text_col).groupBy("line")
    found = lines.agg(F.count(F.lit(1)).alias("n_lines"), F.min(F.struct("doc_id", "line_no")).alias("first"))
    return written(found.withColumn("id", F.monotonically_increasing_id()), "lines")


def _ranks(found: DataFrame) -> Column:
    """The counters' ranks (0: one word in one class, then 1 to 63) as one binary
    literal, a byte for each. The driver gets ``COUNTERS`` bytes, whatever the input;
    as a literal they are not copied from row to row, as a joined array would be."""
    slot = F.xxhash64("word").bitwiseAND(F.lit(COUNTERS - 1)).cast("int")
    # repeats in a line count too: their removal costs more than all the counting
    counts = found.select(F.explode(_split(F.col("line"))).alias("word")).where("word != ''").groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    ranks = counts.select("slot", F.when(F.col("n") == 1, 0).otherwise(F.least(F.lit(63), F.floor(F.log2("n") * 2))).cast("int").alias("rank"))
    every = found.sparkSession.range(COUNTERS).select(F.col("id").cast("int").alias("slot"))
    named = every.join(ranks, "slot", "left").select("slot", F.expr("chr(coalesce(rank, 0) + 48)").alias("c"))
    joined = named.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "c"))), lambda x: x["c"]), "").alias("all"))
    return F.lit(bytes(ord(c) - 48 for c in joined.collect()[0]["all"]))


def _sets(found: DataFrame, threshold: float) -> DataFrame:
    """(id, n, sign, sign2, start, prefix, bands) of each class with words, written, so that
    the plans of joins do not hold the counters. A word's key is its rank and 57 bits of its
    hash; ``start`` words in one class only come before the prefix; bands are hashes of the
    least and largest three of its rarer shared words in two orders, of which near copies
    share some. Lambdas are evaluated node by node and keep what they are given from being
    compiled, so they are few, short and in steps of their own."""
    ranks, low, shared = _ranks(found), F.lit((1 << 57) - 1), F.lit(1 << 57)  # the least key of rank 1

    def key(h: Column) -> Column:
        rank = F.ascii(F.substring(ranks, h.bitwiseAND(F.lit(COUNTERS - 1)).cast("int") + 1, F.lit(1)).cast("string"))
        return F.shiftleft(rank.cast("long"), 57).bitwiseOR(h.bitwiseAND(low))

    rows = found.select("id", F.transform(_split(F.col("line")), lambda w: F.xxhash64(w)).alias("hashes"))
    rows = rows.select("id", _bound(hashes=F.array_distinct(F.array_remove("hashes", F.xxhash64(F.lit(""))))))
    rows = rows.select("id", F.transform("hashes", key).alias("keys"))
    # one more key stands between the words of one class and the others; parities have it in all sets
    rows = rows.select("id", _bound(keys=F.sort_array(F.array_append("keys", shared)))).where("size(keys) > 1")
    rows = rows.select("id", "keys", _bound(n=F.size("keys") - 1, start=(F.array_position("keys", shared) - 1).cast("int")))
    # a whole small set is one key, below all keys of words
    small = F.array(-F.abs(F.xxhash64("keys") / 2).cast("long") - 1)
    whole = 1 / (1 - threshold) - 1 - 1e-9  # below this size one word more or less is too much
    prefix = F.expr(f"slice(keys, start + 2, greatest(0, n - cast(ceil({threshold}D * n - 1e-9D) as int) + 1 - start))")
    rare = F.expr(f"slice(keys, start + 2, greatest({BAND}, cast(ceil((n - start) / 2) as int)))")
    is_whole = F.col("n") < whole
    rows = rows.select("id", "keys", "n", _bound(start=F.when(is_whole, 0).otherwise(F.col("start")), prefix=F.when(is_whole, small).otherwise(prefix), rare=rare))
    # the parity signature of all words and, of larger sets, that of those with a certain bit
    parity = lambda bit: F.expr(f"aggregate(keys, 0L, (a, k) -> a ^ shiftleft({bit}, cast(k & 63L as int)))")
    orders = [F.transform("rare", by) for by in (lambda k: F.shiftleft(k, 7), lambda k: F.shiftleft(k, 35))]
    rows = rows.select("id", "n", parity("1L").alias("sign"), F.when(F.col("n") > ONE_SIGN, parity("shiftright(k, 6) & 1L")).alias("sign2"), "start", "prefix", orders[0].alias("o0"), orders[1].alias("o1"))
    rows = rows.select("id", "n", "sign", "sign2", "start", "prefix", _bound(o0=F.sort_array("o0"), o1=F.sort_array("o1")))
    ends = [F.slice(o, first, F.lit(BAND)) for o in ("o0", "o1") for first in (F.lit(1), F.greatest(F.lit(1), F.size(o) - (BAND - 1)))]
    bands = F.array(*[F.xxhash64(F.lit(i), e) for i, e in enumerate(ends)])
    rows = rows.select("id", "n", "sign", "sign2", "start", "prefix", F.when(F.size("o0") > 0, bands).alias("bands"))
    return written(rows, "sets")


def _middles(members: DataFrame) -> DataFrame:
    """(fam, middle): the words that most lines of a group have, if there are any."""
    of = members.groupBy("fam").agg(F.count(F.lit(1)).alias("of"))
    most = members.select("fam", F.explode("words").alias("word")).groupBy("fam", "word").agg(F.count(F.lit(1)).alias("n"))
    return most.join(of, "fam").where(F.col("n") * 2 > F.col("of")).groupBy("fam").agg(F.collect_list("word").alias("middle"))


def _united(middles: DataFrame) -> DataFrame:
    """(fam, to): groups whose middles share bands of their own become one."""
    rows = middles.select("fam", _bound(o=F.sort_array(F.transform("middle", lambda w: F.xxhash64(w)))))
    rows = rows.select("fam", "o", _bound(p=F.sort_array(F.transform("o", lambda h: F.shiftleft(h, 29)))))
    ends = [F.slice(o, first, F.lit(BAND)) for o in ("o", "p") for first in (F.lit(1), F.greatest(F.lit(1), F.size(o) - (BAND - 1)))]
    bands = rows.select("fam", F.explode(F.array(*[F.xxhash64(F.lit(i), e) for i, e in enumerate(ends)])).alias("band"))
    least = bands.groupBy("band").agg(F.min("fam").alias("to"))
    first = written(bands.join(least, "band").groupBy("fam").agg(F.min("to").alias("to")), "united")
    # a group goes where its first group has gone
    return first.join(first.select(F.col("fam").alias("to"), F.col("to").alias("last")), "to").select("fam", F.col("last").alias("to"))


def _families(found: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(id, fam, slack, first, own) of classes in groups of ``FAMILY`` or more that share
    bands. A group's middle is the set of the words that most of its lines have; ``own``
    holds the words (hashes) in which a line differs from it. A line's slack is c n less
    the number of these, c being (1 - t) / (1 + t): two sets match if they differ in at
    most c (n + m) words, so two lines of one group match if and only if their slacks and
    twice the number of words that both ``own`` sum up to 0 or more. If the slacks alone
    do, the lines need not be paired."""
    bands = sets.select("id", F.explode("bands").alias("band"))
    wide = bands.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("fam")).where(F.col("n") >= FAMILY)
    wide = written(wide.select("band", "fam"), "wide")
    few = wide.limit(SMALL // 2 + 1).count() <= SMALL // 2
    first = written(bands.join(F.broadcast(wide) if few else wide, "band").groupBy("id").agg(F.min("fam").alias("fam")), "led")
    dropped(wide)
    # a line goes to the family that its first line has gone to
    led = written(first.join(first.select(F.col("id").alias("fam"), F.col("fam").alias("to")), "fam").select("id", F.col("to").alias("fam")), "led")
    dropped(first)
    large = led.groupBy("fam").agg(F.count(F.lit(1)).alias("of")).where(F.col("of") >= FAMILY)
    members = found.join(led.join(large, "fam"), "id").select("id", "fam", "first", words(F.col("line")).alias("words"))
    members = written(members, "members")
    dropped(led)
    middles = written(_middles(members), "middles")
    united = written(_united(middles), "united")
    joined = members.join(united, "fam").select("id", F.col("to").alias("fam"), "first", "words")  # a group without a middle has no family
    joined = written(joined, "joined")
    dropped(members, middles, united)
    near = joined.join(_middles(joined), "fam")
    own = F.transform(F.concat(F.array_except("words", "middle"), F.array_except("middle", "words")), lambda w: F.xxhash64(w))
    near = near.select("id", "fam", "first", F.size("words").alias("n"), _bound(own=own))
    slack = F.lit((1 - threshold) / (1 + threshold)) * F.col("n") - F.size("own")
    out = written(near.select("id", "fam", slack.alias("slack"), "first", "own"), "families")
    dropped(joined)
    return out


def _counted(families: DataFrame) -> DataFrame:
    """(id, links, late) from the pairs that slacks decide, counted by slack: a family
    has as few slacks as its lines have numbers of words."""
    by = families.groupBy("fam", "slack").agg(F.count(F.lit(1)).alias("n"), F.min("first").alias("least"))
    both = by.select("fam", "slack").join(by.select("fam", F.col("slack").alias("other"), "n", "least"), "fam").where(F.col("slack") + F.col("other") >= -1e-9)
    sums = both.groupBy("fam", "slack").agg(F.sum("n").alias("n"), F.min("least").alias("least"))
    itself = (F.col("slack") + F.col("slack") >= -1e-9).cast("long")
    found = families.join(sums, ["fam", "slack"])
    return found.select("id", (F.col("n") - itself).alias("links"), (F.col("least") < F.col("first")).alias("late"))


def _entries(sets: DataFrame, families: DataFrame) -> DataFrame:
    """(key, id, size, sign, sign2, fam, slack, own): the prefix of each class without words
    that no other class has; ``size`` holds the number of words and the entry's place."""
    rows = sets.drop("bands").where("size(prefix) > 0").join(families.select("id", "fam", "slack", "own"), "id", "left")
    rows = rows.select("id", "n", "sign", "sign2", "start", "fam", "slack", "own", F.posexplode("prefix").alias("place", "key"))
    rows = rows.select("key", "id", F.expr("shiftleft(cast(n as bigint), 32) | (start + place)").alias("size"), "sign", "sign2", "fam", "slack", "own")
    return written(rows, "entries")


def _candidates(entries: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs that pass all filters and that slacks do not decide, a the one with
    fewer words (then the smaller id). The smaller set of a matching pair shares a word with the other
    within its first n - ceil(2t/(1+t) n) + 1 words, so its later entries need no
    partner."""
    n = lambda x: f"shiftright({x}.size, 32)"
    place = lambda x: f"({x}.size & 4294967295L)"
    need = f"ceil({threshold / (1 + threshold)}D * ({n('l')} + {n('r')}) - 1e-9D)"
    fewer = f"least({n('l')}, {n('r')})"  # of both sides, so that both read one shuffle
    passes = f"""l.key = r.key and l.id != r.id and ({n('l')} < {n('r')} or {n('l')} = {n('r')} and l.id < r.id)
        and {n('l')} >= {threshold}D * {n('r')} - 1e-9D
        and bit_count(l.sign ^ r.sign) <= {n('l')} + {n('r')} - 2 * {need}
        and coalesce(bit_count(l.sign2 ^ r.sign2) + bit_count(l.sign ^ r.sign ^ l.sign2 ^ r.sign2), 0) <= {n('l')} + {n('r')} - 2 * {need}
        and (l.key < 0 or {place('l')} <= {fewer} - ceil({2 * threshold / (1 + threshold)}D * {fewer} - 1e-9D)
             and 1 + least({n('l')} - {place('l')} - 1, {n('r')} - {place('r')} - 1) >= {need})
        and case when l.fam = r.fam then l.slack + r.slack < -1e-9D and l.slack + r.slack + 2 * size(array_intersect(l.own, r.own)) >= -1e-9D else true end"""
    return entries.alias("l").join(entries.alias("r"), F.expr(passes)).select(F.col("l.id").alias("a"), F.col("r.id").alias("b")).distinct()


def _matches(found: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard): the ids of the matching pairs of different classes that slacks do
    not decide."""
    pairs = written(_candidates(entries, threshold), "pairs")
    ids = written(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    few = ids.limit(SMALL + 1).count() <= SMALL
    texts = found.join(F.broadcast(ids) if few else ids.hint("merge"), "id", "left_semi").select("id", "line")
    texts = written(texts, "texts")
    verified = []
    for i in range(PASSES):
        # lines are shorter than their arrays of words in a shuffle; words are cut after it
        some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(PASSES)) == i)
        both = some.join(texts.select(F.col("id").alias("a"), F.col("line").alias("x")), "a").join(texts.select(F.col("id").alias("b"), F.col("line").alias("y")), "b")
        both = both.select("a", "b", _bound(x=words(F.col("x")), y=words(F.col("y"))))
        both = both.select("a", "b", (F.size("x") + F.size("y")).alias("n"), _bound(common=F.size(F.array_intersect("x", "y"))))
        both = both.withColumn("jaccard", F.col("common") / (F.col("n") - F.col("common")))
        verified.append(written(both.where(F.col("jaccard") >= threshold - 1e-9).select("a", "b", "jaccard"), f"matches{i}"))
    dropped(pairs, ids, texts)
    return reduce(DataFrame.unionByName, verified)


def lines(docs: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, line_no, class_doc, class_line, links, kept): a row for each line of
    ``docs``; the class is named by its first place, links counts the classes that
    match it, and lines that have a match before them are not kept."""
    found = classes(docs, id_col, text_col)
    sets = _sets(found, threshold)
    families = _families(found, sets, threshold)
    entries = _entries(sets, families)
    dropped(sets)
    pairs = _matches(found, entries, threshold)
    dropped(entries)
    at = found.select("id", "first")
    placed = pairs.join(at.select(F.col("id").alias("a"), F.col("first").alias("fa")), "a").join(at.select(F.col("id").alias("b"), F.col("first").alias("fb")), "b")
    ends = placed.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.lit(1).cast("long").alias("links"), (F.col("fb") < F.col("fa")).alias("late")), F.struct(F.col("b").alias("id"), F.lit(1).cast("long").alias("links"), (F.col("fa") < F.col("fb")).alias("late")))).alias("e")).select("e.*")
    state = ends.unionByName(_counted(families)).groupBy("id").agg(F.sum("links").alias("links"), F.max("late").alias("late"))
    has_words = F.trim("line", F.lit(" \t\r\x0b\f")) != ""
    named = found.select("id", *_digest(F.col("line")), "first", has_words.alias("has")).join(state, "id", "left")
    rows = _occurrences(docs, id_col, text_col).select("doc_id", "line_no", *_digest(F.col("line")))
    rows = rows.join(named.hint("merge"), ["h1", "h2"])
    first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("line_no") == F.col("first.line_no"))
    kept = ~F.col("has") | (first & ~F.coalesce("late", F.lit(False)))
    return rows.select("doc_id", "line_no", F.col("first.doc_id").alias("class_doc"), F.col("first.line_no").alias("class_line"), F.coalesce("links", F.lit(0).cast("long")).alias("links"), kept.alias("kept"))


def dedup(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` (with one row for each doc_id) whose texts have lost their later matches."""
    gone = lines(docs, threshold).where("not kept").groupBy("doc_id").agg(F.collect_set("line_no").alias("_gone")).withColumnRenamed("doc_id", "_id")
    both = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_id")), "left")
    text = F.expr("array_join(filter(split(text, '\\n'), (x, i) -> _gone is null or not array_contains(_gone, i)), '\\n')")
    return both.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns])
