"""Fuzzy line dedup: keys of word pairs, SimHash order, edit similarity and connected groups, in DataFrame functions alone.

A line is normalised to its words (lower case, runs of letters and digits) and compared whole, as one unit. Equal
units are one. Two units link when their edit similarity over words is at least SIMILAR. No link is lost:

Each word begins a pair with the next one. The edits between two linked units change at most broken(n) pairs of a unit of n
words, so in an order of all pairs (rare words first) their first broken(n) + 1 pairs have one in common: a unit's keys. Of
their first broken(n) + t pairs they share t, which parts the groups under keys that many units bear.

Under a key each unit meets the next shorter one, and what links is one component. Where a key's components are still large and many,
each unit meets the next one by SimHash (the bitwise majority of a line's distinct words' hashes; those of near lines are mostly
near), so that families become few components. Then all units of different components under a key meet: those beside its largest
component meet all. Large groups (_large) are parted first by a second shared pair, and a third. What is still large meets as it is: it
costs time, and nothing is cut. A pair whose
lengths or word parities are too far apart for the edits allowed is left out before its words are read. Candidates
are verified by edit similarity over words, and of each connected group the first occurrence stays.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

LANE_WORDS = 127
SIMILAR = 0.8
#: Units under one key that all meet each other; a larger group is parted by further pairs first. To compare two units takes some
#: 30 ns, a row for a further pair some 2 us, and each unit has about 20 of them, so that parting pays from here on.
GROUP = 1024
#: Further pairs by which a group is parted: as many as the shortest line that can link has.
FURTHER = 2
LAST = 2**63 - 1
_BYTES = 0x0101010101010101
#: Bits of a key as it is shuffled. Keys that are one by chance only bring units together that do not link.
KEY_BITS = 40
#: Slots of words by the low bits of their codes; a slot's class is how often its words occur, the same for all lines of a run.
SLOTS = 1 << 16
#: One unit of so many is counted for the classes. They order pairs and bear on the time alone: every order finds the same links.
COUNTED = 16
#: The longest length that a unit's number shows, and the bit from which on it does.
LENGTH = 4095
#: Units of more words have 256 bits of parities instead of 128, and 512.
WIDE = 64, 128
_LENGTH_BIT = 51
_CLASS_BIT = 57
_CLASSES = 32
_WORDED = r"[\p{L}\p{N}]"


def words_of(line: Column) -> Column:
    """Words of a normalised line: lower case, runs of letters and digits."""
    return F.array_remove(F.split(F.lower(line), r"[^\p{L}\p{N}]+", -1), "")


def simhashed(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """The keys with simhash of each row's words; rows that agree in all keys are told apart, so no counter sums over several.

    Bit 8 b + i is byte b of lane i. A byte c exceeds half of n words where c + 127 - n / 2 reaches 128, for
    seven bytes at once; the eighth is compared by itself, as a signed sum must not overflow.
    """
    own = rows.select(F.monotonically_increasing_id().alias("row"), *keys, F.array_distinct("words").alias("own"))
    each = own.select("row", *keys, F.size("own").alias("size"), F.posexplode("own").alias("at", "word"))
    each = each.select("row", *keys, "size", F.floor(F.col("at") / LANE_WORDS).alias("part"), F.xxhash64("word").alias("w"))
    lanes = [F.sum(F.shiftright("w", i).bitwiseAND(F.lit(_BYTES))).alias(f"l{i}") for i in range(8)]
    sums = common.stored(each.groupBy("row", *keys, "size", "part").agg(*lanes), "lanes")
    half = F.floor(F.col("size") / 2)
    low, ones = F.lit((1 << 56) - 1), F.lit(_BYTES & (1 << 56) - 1)

    def lane(i: int) -> Column:
        seven = F.shiftrightunsigned(F.col(f"l{i}").bitwiseAND(low) + (F.lit(127) - half) * ones, 7).bitwiseAND(ones)
        top = F.when(F.shiftrightunsigned(f"l{i}", 56) > half, F.lit(1 << 56)).otherwise(F.lit(0))
        return F.shiftleft(seven.bitwiseOR(top), i)

    def bit(i: int, b: int) -> Column:
        return F.shiftleft(F.when(F.col(f"c{i}_{b}") > half, F.lit(1)).otherwise(F.lit(0)).cast("long"), 8 * b + i)

    any_of = lambda parts: reduce(lambda x, y: x.bitwiseOR(y), parts).alias("simhash")
    short = sums.where(F.col("size") <= LANE_WORDS).select(*keys, any_of(map(lane, range(8))))
    places = [(i, b) for i in range(8) for b in range(8)]
    counts = [F.sum(F.shiftrightunsigned(f"l{i}", 8 * b).bitwiseAND(F.lit(255))).alias(f"c{i}_{b}") for i, b in places]
    long = sums.where(F.col("size") > LANE_WORDS).groupBy("row", *keys, "size").agg(*counts)
    out = common.stored(short.union(long.select(*keys, any_of([bit(i, b) for i, b in places]))), "units")
    common.dropped(sums)
    return out


def _most(long: Column) -> Column:
    """Edits allowed where the longer line has so many words."""
    return F.floor(F.lit(1 - SIMILAR) * long + 1e-9).cast("int")


def broken(n: Column) -> Column:
    """Most pairs of a line of n words that the edits to a line it links with change: two for each edit, one where a longer line has a word more.

    A line that is longer by d has d insertions at least, each of which changes one pair, so 2 edits - d pairs in all;
    beyond d = 1 that is no more than without.
    """
    return F.greatest(2 * _most(n), 2 * _most(n + 1) - 1)


def coded(words: Column) -> Column:
    """Words as 32-bit codes."""
    return F.transform(words, lambda w: F.hash(w))


def classes_of(counts: dict[int, int]) -> Column:
    """The class of each slot, from rare to frequent words, as one array literal of small numbers: every plan that has it is kept as text in the driver."""
    often = np.fromiter((counts.get(i, 0) for i in range(SLOTS)), dtype=np.float64, count=SLOTS)
    classes = np.minimum(_CLASSES - 1, np.floor(2 * np.log2(often + 1))).astype(int)
    return F.split(F.lit(",".join(map(str, classes.tolist()))), ",").cast("array<tinyint>")


def rarity(units: DataFrame) -> Column:
    """Classes of slots by how often their words occur in a sixteenth of the units: at most SLOTS counts come to the driver."""
    words = units.where(F.col("u") % COUNTED == 0).select(F.explode("words").alias("w"))
    counts = words.groupBy(F.col("w").bitwiseAND(F.lit(SLOTS - 1)).alias("slot")).count().collect()
    return classes_of({r["slot"]: r["count"] for r in counts})


def keys_of(codes: Column, further: int = 0, weights: Column | None = None) -> Column:
    """Keys of a line: the first of its pairs of neighbouring words, rare words first; none where no other line can be within the edits.

    A word weighs its class above a hash; a pair is the sum of both, so that it sorts by both classes; the last word pairs with the end. With further
    keys a pair that occurs again is told from its first occurrence, so that pairs count as often as they occur; one key that is shared
    is told by the first.
    """
    many = broken(F.size(codes))
    weights = classes_of({}) if weights is None else weights
    end = F.lit((_CLASSES - 1 << _CLASS_BIT) + (1 << 48) + 12345678901)
    weighed = F.transform(codes, lambda w: F.shiftleft(F.get(weights, w.bitwiseAND(F.lit(SLOTS - 1))).cast("long"), _CLASS_BIT) + F.shiftrightunsigned(F.xxhash64(w), 14))

    def told(pairs: Column) -> Column:
        again = lambda g, i, k: (i >= k) & F.get(pairs, F.greatest(i - k, F.lit(0))).eqNullSafe(g)
        return F.transform(pairs, lambda g, i: F.when(again(g, i, 2), F.xxhash64(g, F.lit(3))).when(again(g, i, 1), F.xxhash64(g, F.lit(2))).otherwise(g))

    pairs = _let(weighed, lambda c: F.zip_with(c, F.concat(F.slice(c, 2, F.size(c)), F.array(end)), lambda p, q: F.coalesce(p + q, F.lit(0).cast("long"))))
    first = F.slice(F.sort_array(pairs), 1, many + 1 + further)
    cut = lambda pairs: F.transform(pairs, lambda g: g.bitwiseAND(F.lit((1 << KEY_BITS) - 1)))
    return F.when(many > 0, F.array_distinct(cut(_let(first, told) if further else first))).otherwise(F.array().cast("array<long>"))


def marked(units: DataFrame) -> DataFrame:
    """(u, n, even, odd, more) of all units: parities of where a unit's words fall among 128 bits, for longer units among 256 or 512.

    An edit changes two of all bits at most, so that units that link differ in few. Of two lines that have nothing in common half the
    bits differ, which must be more than the edits allow: long lines need more bits. The 128 are the 512 folded twice; more has the halves
    that the folding takes away: those of 256 bits for units of over WIDE[0] words, then those of 512 for over WIDE[1].
    """
    each = units.select("u", "n", F.explode("words").alias("w"))
    each = each.select("u", "n", F.shiftrightunsigned("w", 6).bitwiseAND(F.lit(7)).alias("slot"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("w").bitwiseAND(F.lit(63))).alias("bit"))
    found = each.groupBy("u", "n").agg(*[F.bit_xor(F.when(F.col("slot") == i, F.col("bit")).otherwise(F.lit(0).cast("long"))).alias(f"q{i}") for i in range(8)])
    of = lambda *slots: reduce(Column.bitwiseXOR, (F.col(f"q{i}") for i in slots))
    wide, widest = (of(2, 6), of(3, 7)), [of(i) for i in range(4, 8)]
    more = F.when(F.col("n") > WIDE[1], F.array(*wide, *widest)).when(F.col("n") > WIDE[0], F.array(*wide))
    return found.select("u", "n", of(0, 2, 4, 6).alias("even"), of(1, 3, 5, 7).alias("odd"), more.alias("more"))


def _let(value: Column, body) -> Column:
    """body of a value that is computed once: inside a lambda it is a variable, not a copy of its expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def line_table(docs: DataFrame) -> DataFrame:
    """Rows (doc, h, pos, line) of the lines with words; doc is doc_id, null last, and h the hash of doc_id and text."""
    rows = docs.select(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), F.xxhash64("doc_id", "text").alias("h"), "text")
    return rows.select("doc", "h", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).where(F.col("line").rlike(_WORDED))


def distinct_units(docs: DataFrame) -> DataFrame:
    """(u, words, n, first): each distinct line by the hash of its words, with their codes and number and the place where it occurs first.

    u numbers them, to be stored with them: numbers of one task's rows differ in few bytes, so that their many keys take less room than with hashes.
    Above the number (of fewer than 2^18 tasks) stands n, up to LENGTH, so that units sort by length and a key's row shows it.
    """
    cut = line_table(docs).select("doc", "h", "pos", words_of(F.col("line")).alias("words"))
    cut = cut.select(F.xxhash64("words").alias("u"), coded(F.col("words")).alias("words"), F.struct("doc", "h", "pos").alias("place"))
    each = cut.groupBy("u").agg(F.any_value("words").alias("words"), F.min("place").alias("first"))
    return each.select((F.shiftleft(F.least(F.size("words"), F.lit(LENGTH)).cast("long"), _LENGTH_BIT) + F.monotonically_increasing_id()).alias("u"), "words", F.size("words").alias("n"), "first")


def shown(u: Column) -> Column:
    """The length that a unit's number shows."""
    return F.shiftright(u, _LENGTH_BIT)


def _near(short: Column, long: Column) -> Column:
    """Whether the edits allowed can make up for two lengths; lengths cut at LENGTH pass where the whole ones do."""
    return long - short <= _most(long)


def shared_keys(spots: DataFrame) -> DataFrame:
    """(g, u, before) of the units under keys that another unit of a length near enough bears; before is the next shorter such unit or null.

    Sorted by key and length once, with no group in memory: where the neighbours by length are too far, all are.
    """
    own = Window.partitionBy("g").orderBy("u")
    told = spots.select("g", "u", F.lag("u").over(own).alias("before"), F.lead("u").over(own).alias("after")).where("before is not null or after is not null")
    n = shown(F.col("u"))
    told = told.withColumn("before", F.when(_near(shown(F.col("before")), n), F.col("before")))
    return told.where(F.col("before").isNotNull() | _near(n, shown(F.col("after")))).drop("after")


def _mixed(rows: DataFrame, least: int = 3) -> DataFrame:
    """Rows under the keys that units of several components bear, with many, how many units, main, whether the unit is of the key's largest component, and others, how many are not.

    Where there are but two, they have met as neighbours by length, unless the groups were parted since (least = 2).
    """
    own = Window.partitionBy("g")
    told = rows.repartition("g").withColumn("_same", F.count("*").over(Window.partitionBy("g", "root")))
    told = told.withColumns({"_largest": F.max(F.struct("_same", "root")).over(own), "many": F.count("*").over(own)})
    told = told.withColumns({"main": F.col("root") == F.col("_largest.root"), "others": F.col("many") - F.col("_largest._same")})
    return common.stored(told.where(f"others > 0 and many >= {least}").drop("_same", "_largest"), "under")


def _large() -> Column:
    """Whether a group has more units to compare than GROUP units of as many components."""
    return F.col("many") * F.col("others") > GROUP * GROUP


def _within(a: str, b: str, more: bool = True) -> Column:
    """Whether the edits allowed can make up for the lengths and parities (n, even, odd and more) of two units: true for all that link."""
    most = _most(F.greatest(f"n_{a}", f"n_{b}"))
    apart = lambda c, at=None: (F.col(f"{c}_{a}") if at is None else F.get(f"{c}_{a}", F.lit(at))).bitwiseXOR(F.col(f"{c}_{b}") if at is None else F.get(f"{c}_{b}", F.lit(at)))
    few = lambda *bits: reduce(Column.__add__, map(F.bit_count, bits)) <= 2 * most
    split = lambda whole, halves: [x.bitwiseXOR(h) for x, h in zip(whole, halves, strict=True)] + halves
    close = (F.abs(F.col(f"n_{a}") - F.col(f"n_{b}")) <= most) & few(*(narrow := [apart("even"), apart("odd")]))
    if not more:
        return close
    wide = split(narrow, [apart("more", i) for i in (0, 1)])
    widest = split(wide, [apart("more", i) for i in (2, 3, 4, 5)])
    least = F.least(f"n_{a}", f"n_{b}")
    return close & ((least <= WIDE[0]) | few(*wide)) & ((least <= WIDE[1]) | few(*widest))


def _side(rows: DataFrame, x: str, *also: str) -> DataFrame:
    return rows.select(*also, F.col("u").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "even", "odd", "more", "root", "main") if c in rows.columns])


def likely(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that lengths and parities allow to link."""
    return pairs.join(_side(marks, "a").hint("shuffle_hash"), "a").join(_side(marks, "b").hint("shuffle_hash"), "b").where(_within("a", "b")).select("a", "b")


def _meetings(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of all units that are in one group and in different components and can link: those beside the largest component meet all."""
    both = _side(rows.where("not main"), "a", "g").join(_side(rows, "b", "g").hint("merge"), "g")
    both = both.where((F.col("main_b") | (F.col("a") < F.col("b"))) & (F.col("root_a") != F.col("root_b")) & _within("a", "b", "more" in rows.columns))
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def neighbours(rows: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (a, b) of units that follow each other by SimHash under a key, in different components: one for each row at most."""
    hashes = simhashed(_of_units(units, rows), ("u",))
    told = rows.join(hashes, "u").select("g", "simhash", F.struct("u", "root", "n", "even", "odd", "more").alias("a"))
    told = told.withColumn("b", F.lag("a").over(Window.partitionBy("g").orderBy("simhash", "a.u")))
    told = told.select(*[F.col(f"{x}.{c}").alias(f"{c}_{x}") for x in "ab" for c in ("u", "root", "n", "even", "odd", "more")])
    told = told.where((F.col("root_a") != F.col("root_b")) & _within("a", "b"))
    out = common.stored(told.select(F.least("u_a", "u_b").alias("a"), F.greatest("u_a", "u_b").alias("b")).distinct(), "pairs")
    common.dropped(hashes)
    return out


def _of_units(units: DataFrame, rows: DataFrame) -> DataFrame:
    """(u, words) of the units in the rows. The few numbers are hashed, so that all words are not sorted."""
    return units.select("u", "words").join(rows.select("u").distinct().hint("shuffle_hash"), "u", "left_semi")


def fruitless(large: DataFrame, finer: DataFrame) -> DataFrame:
    """(g) of the large groups whose parts (g, parent, others) have as much to compare as they have themselves.

    Where units share a long passage, every further pair of it brings all of them together again.
    """
    work = finer.groupBy(F.col("parent").alias("g")).agg(F.sum("others").alias("work"))
    own = large.groupBy("g").agg(F.max(F.col("many") * F.col("others")).alias("own"))
    return common.stored(own.join(work, "g").where("work >= own").select("g"), "groups")


def close_pairs(rows: DataFrame, units: DataFrame, marks: DataFrame, weights: Column) -> DataFrame:
    """All pairs (a, b) that can link of units under one key (g, u, root, n, even, odd, more, many, main, others) and in different components.
    units need only be those of large groups: the words of all others are not read.

    In a large group those meet that share another pair too, then a third one, each a later key of theirs: the first key that two units
    share is among the keys of both, and so are the next ones they share where there are further keys. A group that is not less to
    compare in parts meets as a whole, and so does one that even three pairs leave large.
    """
    rows, made = rows.withColumn("last", F.col("g")), []
    meet = lambda rows: made.append(common.stored(_meetings(rows).distinct(), "pairs"))
    for further in range(1, FURTHER + 1):
        meet(rows.where(~_large()))
        large = rows.where(_large())
        if large.isEmpty():
            return reduce(DataFrame.union, made).distinct()
        keys = common.stored(_of_units(units, large).select("u", keys_of(F.col("words"), further, weights).alias("keys")), "words")
        later = F.slice("keys", F.array_position("keys", F.col("last")).cast("int") + 1, F.size("keys"))
        finer = large.select(F.col("g").alias("parent"), "u", "root", "last").join(keys, "u").select("parent", "u", "root", F.explode(later).alias("last"))
        finer = _mixed(finer.withColumn("g", F.xxhash64("parent", "last")), 2)
        whole = fruitless(large, finer)
        meet(large.join(whole, "g", "left_semi"))
        parted = finer.join(whole.withColumnRenamed("g", "parent"), "parent", "left_anti").drop("parent")
        rows = common.stored(parted.join(marks.hint("shuffle_hash"), "u"), "under")
        common.dropped(keys, finer)
    meet(rows)
    return reduce(DataFrame.union, made).distinct()


def _same(x: Column, y: Column) -> Column:
    """How many words both begin with."""
    return F.array_position(F.concat(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.array(F.lit(False))), False).cast("int") - 1


def _middles(x: Column, y: Column) -> Column:
    """What is left of both beside what both begin and end with, as one array: it takes as many edits as the whole."""
    heads, tails = _same(x, y), _same(F.reverse(x), F.reverse(y))
    cut = lambda words, head, tail: F.slice(words, head + 1, F.size(words) - head - tail)
    both = lambda head, tail: F.array(cut(x, head, tail), cut(y, head, tail))
    return _let(heads, lambda head: _let(F.least(tails, F.least(F.size(x), F.size(y)) - head), lambda tail: both(head, tail)))


def _edit_bound(x: Column, y: Column) -> Column:
    """A bound of the edits of two middles from above: replace what differs place by place, or all."""
    apart = F.size(F.filter(F.zip_with(x, y, lambda p, q: p == q), lambda e: ~e))
    return F.least(F.greatest(F.size(x), F.size(y)), F.when(F.size(x) == F.size(y), apart))


def _edits(x: Column, y: Column, most: Column) -> Column:
    """Edits between two lists of words, -1 beyond most: each word becomes one letter, numbered by its place in both lists together."""
    letter = lambda p: F.hex(p + F.when(p < 0xD800 - 0x3400, 0x3400).otherwise(0x3C00))
    spelled = lambda words, known: F.decode(F.unhex(F.array_join(F.transform(words, lambda w: F.lpad(letter(F.array_position(known, w)), 8, "0")), "")), "UTF-32")
    return _let(F.array_union(x, y), lambda known: F.call_function("levenshtein", spelled(x, known), spelled(y, known), most))


def verified(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (a, b) whose edit similarity over words is at least SIMILAR: 1 - edits / words of the longer one.

    Lengths and common words rule most false pairs out (each edit takes away one distinct word at most), a bound from
    above lets most true ones pass; only the others need the edits themselves, of what both don't begin or end with.
    """
    needed = common.stored(_of_units(units, pairs.select(F.explode(F.array("a", "b")).alias("u"))), "words")
    for side in "ab":
        pairs = pairs.join(needed.select(F.col("u").alias(side), F.col("words").alias(f"w{side}")).hint("merge"), side)
    x, y = F.col("wa"), F.col("wb")
    most = _most(F.greatest(F.size(x), F.size(y)))
    alike = (F.abs(F.size(x) - F.size(y)) <= most) & (F.size(F.array_intersect(x, y)) >= F.size(F.array_distinct(F.when(F.size(x) >= F.size(y), x).otherwise(y))) - most)
    within = lambda p, q: (_edit_bound(p, q) <= most) | (_edits(p, q, most) >= 0)
    close = _let(_middles(x, y), lambda left: within(F.get(left, F.lit(0)), F.get(left, F.lit(1))))
    out = common.stored(pairs.where(alike & close).select("a", "b"), "links")
    common.dropped(needed)
    return out


def linked_units(units: DataFrame) -> DataFrame:
    """(node, root) of units that link with others."""
    weights = rarity(units)
    shared = common.stored(shared_keys(units.select("u", F.explode(keys_of(F.col("words"), weights=weights)).alias("g"))), "keys")
    marks = common.stored(marked(units), "marks")
    beside = shared.where("before is not null").select(F.col("before").alias("a"), F.col("u").alias("b")).distinct()
    pairs = common.stored(likely(beside, marks), "pairs")
    roots = common.components(verified(pairs, units))

    def told(rows: DataFrame) -> DataFrame:
        own = roots.withColumnRenamed("node", "u")
        mixed = _mixed(rows.join(own, "u", "left").withColumn("root", F.coalesce("root", "u")))
        out = common.stored(mixed.join(marks.hint("shuffle_hash"), "u"), "under")
        common.dropped(mixed)
        return out

    rows = told(shared.drop("before"))
    common.dropped(shared)
    if not rows.isEmpty():
        large, crowded = rows.where(_large()), units
        if not large.isEmpty():
            crowded = common.stored(_of_units(units, large), "words")
            roots = common.joined(roots, verified(neighbours(large, crowded), crowded))
            rows = rows.where(~_large()).unionByName(told(large.select("g", "u")))
        left = close_pairs(rows, crowded, marks, weights).join(pairs, ["a", "b"], "left_anti")
        roots = common.joined(roots, verified(common.stored(left, "pairs"), units))
    common.dropped(marks)
    return roots


def staying_lines(docs: DataFrame) -> DataFrame:
    """Rows (h, stay): numbers of the lines with words that no earlier line equals or links with, by (doc_id, h, line number)."""
    each = common.stored(distinct_units(docs), "units")
    roots = linked_units(each).select(F.col("node").alias("u"), "root")
    grouped = each.select("u", "first").join(roots, "u", "left").select(F.coalesce("root", "u").alias("root"), "first")
    stays = grouped.groupBy("root").agg(F.min("first").alias("first")).select("first.h", "first.pos")
    out = common.stored(stays.groupBy("h").agg(F.collect_list("pos").alias("stay")), "stay")
    common.dropped(each)
    return out


def dedup_lines(docs: DataFrame) -> DataFrame:
    """The documents' columns with n_lines, n_removed, emptied and kept_text (lines that stay, joined by line ends).

    Lines without a letter or digit are never compared and stay. A null text has no lines and stays null. Of rows that
    repeat doc_id and text only one keeps its lines. emptied: the text had lines with words and all went. Documents
    are ordered by doc_id, null last. An empty table gives an empty result.
    """
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), F.struct(*[F.col(c) for c in docs.columns]).alias("row"))
    rows = rows.join(staying_lines(docs).hint("merge"), "h", "left").withColumn("k", F.row_number().over(Window.partitionBy("h").orderBy("h")))
    none = F.array().cast("array<int>")
    rows = rows.withColumn("lines", F.split("row.text", "\n", -1))
    worded = F.filter(F.transform("lines", lambda x, i: F.when(x.rlike(_WORDED), i)), lambda i: i.isNotNull())
    rows = rows.withColumn("gone", F.coalesce(F.array_except(worded, F.when(F.col("k") > 1, none).otherwise(F.coalesce("stay", none))), none))
    left = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    rows = rows.withColumn("kept", F.when(F.size("gone") == 0, F.col("lines")).otherwise(F.transform(left, lambda i: F.get("lines", i))))
    text = F.array_join("kept", "\n")
    counts = [F.coalesce(F.when(F.col("lines").isNotNull(), F.size("lines")), F.lit(0)).cast("long").alias("n_lines"), F.size("gone").cast("long").alias("n_removed")]
    return rows.select("row", *counts, ((F.size("gone") > 0) & ~text.rlike(_WORDED)).alias("emptied"), F.when(F.col("lines").isNotNull(), text).alias("kept_text"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with the lines that stay as text; those that lost all lines with words go."""
    rows = dedup_lines(docs).where("not emptied")
    return rows.select(*[F.col("kept_text").alias(c) if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def op7_simhash_lines(spark, sf_dir: str) -> DataFrame:
    """Lines of all documents: how many, how many repeat, and a digest of what stays."""
    rows = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return rows.select("row.doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
