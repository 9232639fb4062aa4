"""Operators over whole corpora against brute force, with copies, ties, nulls, empty and long texts."""

import hashlib
import math
import pathlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

from tracequarry.llm import common, jaccard, lines, mixing, packing, substrings, urls

WORDS = ["alpha", "beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "iota", "kappa"]


def corpus(seed=0, n=90):
    """Families of near and exact copies, shared passages, short, empty and null texts, repeated rows, a repeated id."""
    rng = random.Random(seed)
    fresh = lambda k: [f"{rng.choice(WORDS)}{rng.randrange(4000)}" for _ in range(k)]
    passage, rows = fresh(70), []
    for i in range(n):
        words = fresh(rng.choice((0, 2, 3, 30, 90, 200)))
        if i % 4 == 0 and words:
            at = rng.randrange(len(words))
            words[at:at] = passage[rng.randrange(10) :]
        if i > 20 and i % 3 == 0:
            words = (rows[rng.randrange(i // 2)][1] or "").split()
            for _ in range(rng.choice((0, 0, 1, 2, 4))):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(fresh(1))
        text = "".join(w + rng.choice((" ", " ", " ", "\n", "\t ")) for w in words)
        rows.append((i * 3 % n, text, f"s{i % 5}"))
    rows += [(None, rows[3][1], None), (500, None, "s1"), (501, "", None), (502, " \n", "s2"), rows[8], rows[8], (rows[9][0], rows[10][1] + " more", "s0"), (503, rows[30][1].upper(), "s9")]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)


def union_find(n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a, b):
        parent[max(find(a), find(b))] = min(find(a), find(b))

    return find, join


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)] + [(2000, 2000 + i) for i in range(60)]
    find, join = union_find(3000)
    for a, b in edges:
        join(a, b)
    got = {r["node"]: r["root"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e} and not common.components(spark.createDataFrame([], "a long, b long")).count()


def shingle_set(text, n):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


@pytest.mark.parametrize(("n", "percent", "seed"), [(4, 85, 0), (5, 80, 1), (2, 50, 2)])
def test_similar_groups(spark, n, percent, seed):
    rows = corpus(seed)
    sets = [shingle_set(t, n) for _, t, _ in rows]
    find, join = union_find(len(rows))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                join(i, j)
    low = {}
    for i, (d, _, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    expected = Counter((d, len(sets[i]), low.get(find(i)) if sets[i] else d) for i, (d, _, _) in enumerate(rows))
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.similar_groups(frame(spark, rows), n, percent).collect()) == expected
    kept = jaccard.one_of_each_group(frame(spark, rows), n, percent)
    groups = {find(i) for i in range(len(rows)) if sets[i]}
    assert kept.columns == ["doc_id", "text", "source"] and kept.count() == len(groups) + sum(not s for s in sets)


def test_family_of_near_copies(spark):
    """Many variants of one text, few of which link with the smallest one: no link is lost."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(120)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words), "s"))
    sets = [shingle_set(t, 4) for _, t, _ in rows]
    find, join = union_find(len(rows))
    for i in range(len(rows)):
        for j in range(i):
            if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                join(i, j)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.similar_groups(frame(spark, rows), 4, 85).collect()}
    assert got == {i: find(i) for i in range(len(rows))}


@pytest.mark.parametrize("seed", [0, 4])
def test_substrings(spark, seed):
    rows = corpus(seed) + [(600, " ".join(f"long{i % 5000}" for i in range(20_000)), "s"), (601, "p " + " ".join(f"long{i}" for i in range(100, 400)) + " q", "s")]
    split = lambda t: [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
    key = lambda d: math.inf if d is None else d
    low = {}
    for d, t, _ in rows:
        w = split(t)
        for i in range(len(w) - 49):
            s = tuple(w[i : i + 50])
            low[s] = min(key(d), low.get(s, math.inf))
    expected = Counter()
    for d, t, _ in rows:
        w = split(t)
        gone = {k for i in range(len(w) - 49) if low[tuple(w[i : i + 50])] < key(d) for k in range(i, i + 50)}
        expected[d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    got = substrings.remove_repeats(frame(spark, rows)).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept_text"]) for r in got) == expected and sum(x[2] for x in expected) > 500


def plain_simhash(words):
    own = set(words)
    counts = [sum(xxhash.xxh64_intdigest(w.encode(), seed=42) >> b & 1 for w in own) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(own))


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark):
    rng = random.Random(2)
    shared = [" ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(rng.choice((1, 6, 40, 200)))) for _ in range(25)]

    def variant(line):
        words = line.split()
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            words[rng.randrange(len(words))] += rng.choice(("x", ",", "!"))
        return rng.choice((" ", "", "> ")) + " ".join(words).title()

    rows = [(i, "\n".join(variant(rng.choice(shared)) if rng.random() < 0.7 else rng.choice(("", "--", f"own line {i} {rng.random()}")) for _ in range(rng.randrange(1, 7))), "s") for i in range(60)]
    rows += [(None, rows[0][1], "s"), (70, None, "s"), (71, "", "s"), (72, "\n\n", "s"), rows[5], (5, rows[6][1], "s")]
    h = lambda r: spark_hash[r[0], r[1]]
    spark_hash = {(r["doc_id"], r["text"]): r["h"] for r in frame(spark, rows).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()}
    where, found = {}, []
    for r in dict.fromkeys(rows):
        for p, line in enumerate((r[1] or "").split("\n") if r[1] is not None else []):
            words = regex.findall(r"[\p{L}\p{N}]+", line.lower())
            if words:
                found.append(((lines.LAST if r[0] is None else r[0], h(r), p), where.setdefault(tuple(words), len(where))))
    us = list(where)
    find, join = union_find(len(us))
    for i in range(len(us)):
        for j in range(i):
            a, b = us[i], us[j]
            if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and edit_distance(a, b) <= math.floor((1 - lines.SIMILAR) * max(len(a), len(b)) + 1e-9):
                join(i, j)
    first = {}
    for place, u in found:
        first[find(u)] = min(place, first.get(find(u), place))
    repeats = defaultdict(lambda: True)
    for (d, x, p), u in found:
        repeats[x, p] &= first[find(u)] != (d, x, p)
    expected, seen = Counter(), Counter()
    for r in rows:
        seen[r] += 1
        own = (r[1] or "").split("\n") if r[1] is not None else []
        worded = lambda t: regex.search(r"[\p{L}\p{N}]", t) is not None
        stay = [t for p, t in enumerate(own) if not worded(t) or seen[r] == 1 and not repeats[h(r), p]]
        gone = len(own) - len(stay)
        expected[r[0], len(own), gone, "\n".join(stay) if r[1] is not None else None, gone > 0 and not any(map(worded, stay))] += 1
    got = lines.dedup_lines(frame(spark, rows)).select("row.doc_id", "n_lines", "n_removed", "kept_text", "emptied").collect()
    assert Counter(map(tuple, got)) == expected
    assert any(find(u) != u for u in range(len(us)))
    left = lines.deduplicated(frame(spark, rows))
    assert left.columns == ["doc_id", "text", "source"] and left.count() == sum(n for k, n in expected.items() if not k[4])


def removed(spark, rows):
    return {r["doc_id"]: r["n_removed"] for r in lines.dedup_lines(frame(spark, rows)).select("row.doc_id", "n_removed").collect()}


def test_long_lines_in_repeated_rows(spark):
    words = [f"w{i}" for i in range(127)]
    near = [*words[:50], "other", *words[51:]]
    rows = [(1, " ".join(words), "s")] * 5 + [(None, " ".join(words), "s")] * 3
    cut = spark.createDataFrame([(1, words)] * 5 + [(2, near)], "k long, words array<string>").repartition(1)
    assert {(r["k"], r["simhash"] % 2**64) for r in lines.simhashed(cut, ("k",)).collect()} == {(1, plain_simhash(words)), (2, plain_simhash(near))}
    got = lines.dedup_lines(frame(spark, rows)).select("n_removed").collect()
    assert sorted(r[0] for r in got) == [0] + [1] * 7


def test_near_copies_of_a_long_line(spark):
    rng = random.Random(5)
    words = [f"w{rng.randrange(10**6)}" for _ in range(1300)]
    shifted, dropped = [words[0], "put", *words[1:]], words[:3] + words[4:]
    edited = [f"x{i}" if i % 130 == 64 else w for i, w in enumerate(words)]
    other = [f"v{rng.randrange(10**6)}" for _ in range(1300)]
    rows = [(i, " ".join(w), "s") for i, w in enumerate((words, shifted, dropped, edited, other))]
    cut = spark.createDataFrame([(i, r[1].split()) for i, r in enumerate(rows)], "k long, words array<string>")
    assert all(r["simhash"] % 2**64 == plain_simhash(rows[r["k"]][1].split()) for r in lines.simhashed(cut, ("k",)).collect())
    assert removed(spark, rows) == {0: 0, 1: 1, 2: 1, 3: 1, 4: 0}


def test_families_of_near_copies(spark):
    """Of variants of one line, those that brute force links with an earlier one go, nearly all; no other line goes."""
    rng = random.Random(9)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 10))) for _ in range(2000)]
    for n, many in ((10, 150), (20, 150), (40, 120)):
        base = rng.choices(vocabulary, k=n)
        family = []
        for _ in range(many):
            line = list(base)
            for p in rng.sample(range(n), rng.randrange(1, n // 5 + 2)):
                line[p] = rng.choice(vocabulary)
            family.append(line)
        find, join = union_find(many)
        for i in range(many):
            for j in range(i):
                if edit_distance(family[i], family[j]) <= n // 5:
                    join(i, j)
        should = many - len({find(i) for i in range(many)})
        went = sum(removed(spark, [(i, " ".join(w), "s") for i, w in enumerate(family)]).values())
        assert 0.95 * should <= went <= should, (n, went, should)


def test_pairs_among_many_lines(spark):
    """Planted pairs of 20 words out of 2,000 beside 200,000 lines of the same words, up to the least similarity."""
    rng = random.Random(10)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 10))) for _ in range(2000)]
    rows, planted = [(i, " ".join(rng.choices(vocabulary, k=20)), "s") for i in range(200_000)], defaultdict(list)
    for edits in (1, 2, 4):
        for _ in range(200):
            line = rng.choices(vocabulary, k=20)
            near = list(line)
            for p in rng.sample(range(20), edits):
                near[p] = rng.choice(vocabulary)
            planted[edits].append(len(rows) + 1)
            rows += [(len(rows), " ".join(line), "s"), (len(rows) + 1, " ".join(near), "s")]
    rng.shuffle(rows)
    gone = {d for d, n in removed(spark, rows).items() if n}
    shares = {edits: sum(d in gone for d in ids) / len(ids) for edits, ids in planted.items()}
    assert min(shares.values()) >= 0.95, shares
    assert len(gone) <= 600


def test_large_groups_are_parted(spark, monkeypatch):
    """The steps for groups of more than GROUP units, with a small GROUP: planted pairs beside many lines with the same long pair of words."""
    monkeypatch.setattr(lines, "GROUP", 8)
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 10))) for _ in range(300)]

    def own():
        line = rng.choices(vocabulary, k=20)
        at = rng.randrange(18)
        line[at : at + 2] = "internationalisation", "responsibilities"
        return line

    rows, planted = [(i, " ".join(own()), "s") for i in range(3000)], []
    for _ in range(200):
        line = own()
        near = list(line)
        for p in rng.sample([p for p in range(20) if len(line[p]) < 12], rng.randrange(1, 4)):
            near[p] = rng.choice(vocabulary)
        planted.append(len(rows) + 1)
        rows += [(len(rows), " ".join(line), "s"), (len(rows) + 1, " ".join(near), "s")]
    gone = {d for d, n in removed(spark, rows).items() if n}
    print(sum(d in gone for d in planted))
    assert gone <= set(planted) and sum(d in gone for d in planted) >= 0.95 * len(planted)


def test_stored_tables_leave_no_shuffle_files(spark):
    """What a stage shuffled is gone when its table is written, and the session's setting is as before."""
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {f.name for d in manager.localDirsString() for f in pathlib.Path(d).rglob("shuffle_*")}
    before, setting = files(), spark.conf.get(common.CLEANED, None)
    rows = common.stored(spark.range(20_000).repartition(3).groupBy((F.col("id") % 7000).alias("k")).count(), "counts")
    deadline = time.time() + 20
    while files() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not files() - before and spark.conf.get(common.CLEANED, None) == setting
    assert rows.count() == 7000 and rows.where("count > 2").count() == 6000


def test_keys_of_a_line_take_few_bytes(spark):
    """Keys stay within KEY_BITS and units are numbered from small numbers, task by task."""
    units = common.stored(lines.distinct_units(frame(spark, [(i, f"some words of line number {i} and others beside it {i * 7}", "s") for i in range(50)])), "units")
    keys = units.select("u", F.explode(lines.keys_of(F.col("words"))).alias("g"))
    most = keys.agg(F.max("g"), F.min("g"), F.max(F.col("u").bitwiseAND(F.lit((1 << 33) - 1))), F.countDistinct("u")).first()
    assert 0 <= most[1] and most[0] < 1 << lines.KEY_BITS and most[2] < 50 and most[3] == 50


def test_rare_pairs_come_first(spark):
    """Lines that share long but frequent words alone meet under no key: pairs are ordered by how rare their words are."""
    rows = [(i, " ".join(["transcontinental", "counterrevolutionary", "incomprehensibilities"] + [f"w{i}x{k}" for k in range(17)]), "s") for i in range(320)]
    units = common.stored(lines.distinct_units(frame(spark, rows)), "units")
    keys = lines.keys_of(F.col("words"), weights=lines.rarity(units))
    assert not lines.shared_keys(units.select("u", F.explode(keys).alias("g"))).count()


def test_lengths_too_far_apart_do_not_meet(spark):
    """Of the units under a key those stay that have another one near enough in length, and every such pair stays."""
    rng = random.Random(8)
    spots = {(g, (rng.choice((rng.randrange(4, 40), rng.randrange(4, 4000))) << 51) + i) for i, g in enumerate(rng.choices(range(60), k=260))}
    near = lambda a, b: abs(a - b) <= max(a, b) // 5
    want = {(g, u) for g, u in spots if any(g == h and u != v and near(u >> 51, v >> 51) for h, v in spots)}
    got = lines.shared_keys(spark.createDataFrame(sorted(spots), "g long, u long")).collect()
    assert {(r["g"], r["u"]) for r in got} == want and 20 < len(want) < len(spots) - 20
    assert all(near(r["before"] >> 51, r["u"] >> 51) and (r["g"], r["before"]) in want for r in got if r["before"] is not None)


def test_largest_component_of_a_key_does_not_meet_itself(spark):
    """A family under a key with a few others: only the others count as left to compare, and each pair of components meets once."""
    roots = [1] * 30 + [40, 40, 50]
    under = spark.createDataFrame([(7, u, r, 9, 0, 0) for u, r in enumerate(roots)], "g long, u long, root long, n int, even long, odd long")
    rows = lines._mixed(under)
    assert {(r["many"], r["others"]) for r in rows.collect()} == {(33, 3)} and rows.where("main").count() == 30
    got = [(r["a"], r["b"]) for r in lines._meetings(rows).collect()]
    assert sorted(got) == [(a, b) for a in range(33) for b in range(a + 1, 33) if roots[a] != roots[b]]


def test_long_lines_that_share_a_pair_alone_are_not_compared(spark, monkeypatch):
    """Long lines under one key whose words differ are left out by their parities before their words are read; near ones are not."""
    rng, compared, verified = random.Random(31), [], lines.verified
    monkeypatch.setattr(lines, "verified", lambda pairs, units: compared.append(pairs.count()) or verified(pairs, units))
    own = lambda n: ["rarest", "couple"] + [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = [own(n) for n in (90, 150, 240, 300) for _ in range(16)]
    rows += [[w if i % 6 or i < 2 else f"edit{i}" for i, w in enumerate(line)] for line in rows[::16]]
    assert removed(spark, [(i, " ".join(w), "s") for i, w in enumerate(rows)]) == {i: int(i >= 64) for i in range(68)}
    assert 4 <= sum(compared) < 20


def test_lines_that_share_a_passage_meet_no_more_often_in_parts(spark, monkeypatch):
    """A large group is not parted where every further pair brings all of it together again."""
    monkeypatch.setattr(lines, "GROUP", 8)
    rng, work, meetings = random.Random(32), [], lines._meetings
    monkeypatch.setattr(lines, "_meetings", lambda rows: work.append(rows.agg(F.coalesce(F.sum("others"), F.lit(0))).first()[0]) or meetings(rows))
    common_words, passage = [f"c{i}" for i in range(30)], [f"passage{i}" for i in range(14)]
    rows = [rng.choices(common_words, k=3) for _ in range(300)] + [passage + rng.choices(common_words, k=16) for _ in range(30)]
    texts = list(dict.fromkeys(" ".join(w) for w in rows))
    assert not any(removed(spark, [(i, t, "s") for i, t in enumerate(texts)]).values())
    assert 30 * 29 <= sum(work) <= 14 * 30 * 29


def test_classes_of_words_are_short_in_plans(spark):
    """A plan with the classes of words, of which the driver keeps the text, is not long."""
    units = common.stored(lines.distinct_units(frame(spark, [(0, "one line of a few words", "s")])), "units")
    plan = units.select(lines.keys_of(F.col("words"), weights=lines.rarity(units)))._jdf.queryExecution().executedPlan().toString()
    assert len(plan) < 400_000


def test_components_of_more_edges(spark):
    """What more edges join is the same as the components of all edges, new nodes and none at all included."""
    rng = random.Random(33)
    edges = lambda n, most: spark.createDataFrame([(rng.randrange(most), rng.randrange(most)) for _ in range(n)], "a long, b long")
    first, more, none = edges(60, 150), edges(40, 300), edges(0, 1)
    rows = lambda df: {tuple(r) for r in df.select("node", "root").collect()}
    for a, b in ((first, more), (first, none), (none, more)):
        assert rows(common.joined(common.components(a), b)) == rows(common.components(a.union(b)))


@pytest.mark.parametrize("group", [lines.GROUP, 4])
def test_no_link_is_lost(spark, monkeypatch, group):
    """Exactly what brute force links: edits scattered so that few pairs of words stay, insertions, few words that recur, large groups."""
    monkeypatch.setattr(lines, "GROUP", group)
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randrange(3, 10))) for _ in range(60)]
    families = []
    for n in (4, 5, 6, 8, 9, 10, 14, 20, 24, 41):
        base = rng.choices(vocabulary[: rng.choice((2, 60))], k=n)
        for _ in range(24):
            line, edits = list(base), rng.randrange(1, n // 5 + 2)
            for p in sorted((i * n // edits for i in range(edits)), reverse=True):
                line[p : p + rng.choice((1, 1, 1, 0))] = [rng.choice(vocabulary) for _ in range(rng.choice((1, 1, 1, 0, 2)))]
            families.append(line)
    families = [list(w) for w in dict.fromkeys(map(tuple, families)) if w]
    find, join = union_find(len(families))
    for i, a in enumerate(families):
        for j, b in enumerate(families[:i]):
            if abs(len(a) - len(b)) <= max(len(a), len(b)) // 5 and edit_distance(a, b) <= max(len(a), len(b)) // 5:
                join(i, j)
    first = {}
    for i in range(len(families)):
        first.setdefault(find(i), i)
    gone = {d for d, n in removed(spark, [(i, " ".join(w), "s") for i, w in enumerate(families)]).items() if n}
    assert gone == set(range(len(families))) - set(first.values()) and len(gone) > 50


def test_planted_edits_are_found(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)]
    rows, planted, most, d = [], {}, {}, 0
    for n in (5, 10, 20, 40, 127, 200):
        for edits in {1, n // 5}:
            for _ in range(60):
                words = fresh(n)
                near = list(words)
                for at in rng.sample(range(n), edits):
                    near[at] = fresh(1)[0]
                rows += [(d, " ".join(words), "s"), (d + 1, " ".join(near), "s")]
                planted[d + 1] = n, edits
                d += 2
    got = removed(spark, rows)
    assert not any(n for k, n in got.items() if k not in planted)
    found = {p: sum(got[k] for k, q in planted.items() if q == p) / 60 for p in set(planted.values())}
    print(sorted(found.items()))
    assert all(share >= (1 if edits == 1 and n >= 10 else 0.9) for (n, edits), share in found.items()), found


def water(sizes, weights, total, most):
    """Targets by repeated resharing, as the contract words it."""
    target, capped = {}, set()
    while True:
        rest = total - sum(most * sizes[s] for s in capped)
        free = [s for s in sizes if s not in capped]
        weight = sum(weights[s] for s in free)
        target = {s: most * sizes[s] if s in capped else rest * weights[s] / weight for s in sizes}
        over = {s for s in free if target[s] > most * sizes[s] + 1e-9}
        if not over:
            return target
        capped |= over


@pytest.mark.parametrize("seed", [0, 7])
def test_mix(spark, seed):
    rng = random.Random(seed)
    rows = corpus(seed) + [(700 + i, "w " * rng.randrange(1, 900), f"big{i % 4}") for i in range(60)] + [(900, "x " * 30_000, "hot")]
    docs = frame(spark, rows)
    out, parts = mixing.mix(docs)
    taken = parts.groupBy("h", "k").agg(F.sum("length").alias("taken"))
    got = out.join(taken, ["h", "k"], "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")).collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += size(t)
    names = sorted((s for s in sizes if s is not None)) + [None]
    target = water(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, 1.5 * sum(sizes.values()), 2)
    assert Counter((r["doc_id"], r["source"], r["size"], r["source_size"]) for r in got) == Counter((d, s, size(t), sizes[s]) for d, t, s in rows)
    sums = Counter()
    for r in got:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 * max(1, target[r["source"]]) and r["taken"] <= 2 * r["size"]
        sums[r["source"]] += r["taken"]
    for s in sizes:
        assert abs(sums[s] - target[s]) <= (mixing.BLOCK if sizes[s] > mixing.BLOCK else 0.5), (s, sums[s], target[s])
    again, more = mixing.mix(docs.repartition(3))
    assert Counter(map(tuple, more.collect())) == Counter(map(tuple, parts.collect()))
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and sum(size(r["text"]) for r in mixed.collect()) == sum(sums.values())


@pytest.mark.parametrize(("quota", "shards"), [(1000, 9), (1, 4), (37, 1), (10**13, 6)])
def test_slots_are_spread_by_the_quota(quota, shards):
    whole = mixing.spread(0, quota, quota, shards, [5, 1])
    assert [a for _, a, _ in whole] == [0, *(b for _, _, b in whole[:-1])] and whole[-1][2] == quota and [k for k, _, _ in whole] == sorted({k for k, _, _ in whole})
    step = -(-quota // 7)
    parts = [x for a in range(0, quota, step) for x in mixing.spread(a, min(a + step, quota), quota, shards, [5, 1])]
    sizes = Counter()
    for k, a, b in parts:
        sizes[k] += b - a
    assert sizes == {k: b - a for k, a, b in whole}
    assert all(abs(n - quota / shards) < 5 * (quota / shards) ** 0.5 + 5 for n in sizes.values())


def test_slots_go_through_permutations():
    for n in (1, 2, 5, 64, 1000):
        assert sorted(mixing.permuted(np.arange(n), n, 3).tolist()) == list(range(n))
    assert (mixing.permuted(np.arange(1000), 1000, 3) != mixing.permuted(np.arange(1000), 1000, 4)).any()


def plain_model(counts, order=urls.ORDER):
    """Witten-Bell by its definition, for one class: probability of a gram's last character."""
    tables = [Counter() for _ in range(order + 1)]
    for gram, n in counts.items():
        for k in range(1, order + 1):
            tables[k][gram[-k:]] += n
    after = [defaultdict(Counter) for _ in range(order + 1)]
    for k in range(1, order + 1):
        for g, n in tables[k].items():
            if n:
                after[k][g[:-1]][g[-1]] += n

    def p(gram):
        q = 1 / urls.SYMBOLS
        for k in range(1, order + 1):
            own = after[k][gram[-k:-1]] if k > 1 else after[k][""]
            c, t = sum(own.values()), len(own)
            if c:
                q = (own[gram[-1]] + t * q) / (c + t)
        return q

    return p


def test_urls(spark):
    rng = random.Random(1)
    hosts = ["a.org", "b.Example.ORG", "shop.com", "x.net", "news.net", "example.org"]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(('en', 'fr', 'de', 'es'))}/{rng.randrange(300)}{rng.choice(('', '?q=/', '#x', '/'))}") for i in range(250)]
    rows += [(None, None), (1, "no scheme"), (2, "http://"), (3, "://org"), (3, "x://org/"), (4, "a://b://c/d"), (5, "HTTP://EXAMPLE.ORG/en/1?"), (5, "HTTP://EXAMPLE.ORG/en/1?"), (6, "z://notexample.org/es/1"), (7, "z://org/\n?")]
    got = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string").withColumn("verdict", F.lit("old"))).collect()

    def parts(u):
        if u is None or "://" not in u:
            return "", ""
        rest = u.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        return "".join(c.lower() if c.isascii() else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]

    def rule(host, path):
        fits = [(h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return max(fits, key=lambda x: len(x[0]), default=(None, None))

    seen = [(i, *parts(u), *rule(*parts(u))) for i, u in rows]
    places = spark.createDataFrame(sorted({(h, p) for _, h, p, _, _ in seen}), "host string, path string")
    unseen = {(r["host"], r["path"]) for r in places.where(F.pmod(F.xxhash64("host", "path"), F.lit(5)) == 0).collect()}
    assert 0 < len(unseen) < places.count()
    counts = {v: Counter() for v in ("allow", "block")}
    for _, h, p, _, v in seen:
        s = "\2" * (urls.ORDER - 1) + h + p + "\3"
        if v and (h, p) not in unseen:
            counts[v].update(s[i : i + urls.ORDER] for i in range(len(s) - urls.ORDER + 1))
    a, b = plain_model(counts["allow"]), plain_model(counts["block"])

    def score(h, p):
        s = "\2" * (urls.ORDER - 1) + h + p + "\3"
        grams = [s[i : i + urls.ORDER] for i in range(len(s) - urls.ORDER + 1)]
        return sum(math.log(a(g)) - math.log(b(g)) for g in grams) / len(grams)

    cut = got[0]["threshold"]
    expected = Counter((i, h, p, r, v or ("allow" if score(h, p) >= cut else "block"), None if v else round(score(h, p), 9)) for i, h, p, r, v in seen)
    assert Counter((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"], None if r["score"] is None else round(r["score"], 9)) for r in got) == expected
    low, high = ([score(h, p) for h, p in {(h, p) for _, h, p, _, v in seen if v == kind} & unseen] for kind in ("allow", "block"))
    assert abs(np.mean(np.array(low) < cut) - np.mean(np.array(high) >= cut)) < 1 / len(low) + 1 / len(high)


def test_empty_tables(spark):
    docs = frame(spark, []).withColumn("kept", F.lit(1))
    assert not mixing.mixed_documents(docs).count() and not jaccard.one_of_each_group(docs).count() and not lines.deduplicated(docs).count() and not substrings.remove_repeats(docs).count() and not packing.pack_documents(docs).count()
    assert not urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).count()


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    fresh = lambda n: " ".join(f"{rng.choice(WORDS)}{rng.randrange(9000)}" for _ in range(n))
    clean = [(i, "\n".join(fresh(40) for _ in range(4)), f"s{i % 3}") for i in range(30)]
    junk = [(100 + i, " ".join(["spam###"] * 200), "s0") for i in range(5)] + [(110, fresh(10), "s1"), (111, None, "s1")]
    near = [(200 + i, clean[i][1].replace(clean[i][1].split()[7], "changed"), "s2") for i in range(5)] + [(300, clean[0][1], "s1")]
    frame(spark, clean + junk + near).withColumn("extra", F.lit("e")).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 1) for d, _, _ in clean] + [(d, 0) for d, _, _ in junk], "doc_id long, quality int").withColumn("toxic", F.lit(0)).write.parquet(str(tmp_path / "labels.parquet"))
    docs, left = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / f"stage{k}"))
        if k < 4:
            assert out.columns == docs.columns, name
            left[k] = [r["doc_id"] for r in out.collect()]
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    assert set(left[0]) == {d for d, _, _ in clean + near} and {d for d, _, _ in clean} <= set(left[1]) and 300 not in left[1]
    assert {d for d, _, _ in clean} <= set(left[2]) and docs.columns[:4] == ["doc_id", "piece", "start", "length"] and docs.agg(F.max("length")).first()[0] <= 4096
    whole = corpus_pipeline.run(spark, str(tmp_path))
    pick = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in df.collect())
    assert pick(whole) == pick(docs)


def test_registered(spark):
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10 and "pipeline" in names
    digest = packing.op2_best_two_fit(spark, "/root/testdata/sf0.001").collect()
    assert len({r["sequence_id"] for r in digest}) <= -(-sum(r["length"] for r in digest) // 4096) + 2
    rows = substrings.op6_difference_cover(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 200 and all(len(r["kept_sha256"]) == 64 for r in rows) and any(r["n_removed"] for r in rows)
    assert hashlib.sha256(b"").hexdigest() not in {r["kept_sha256"] for r in rows if r["n_removed"] < r["n_words"]}
