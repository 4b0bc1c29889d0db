"""Operators on all rows together: near-duplicates, substrings, decontamination, mixing, and the pipeline."""

import collections
import hashlib
import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scoreweave.llm import decontam, graph, mixing, neardup, substrings
from scoreweave.session import shared_dir

WORD = r"[^\x20\x09-\x0D]+"
lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def corpus(prose, rng, n=120):
    """Texts with exact and near copies, shared passages and short ones."""
    texts = []
    passage = prose(999, 70)
    for i in range(n):
        words = prose(i, rng.randint(1, 160)).split(" ")
        kind = rng.random()
        if texts and kind < 0.2:
            words = (rng.choice(texts) or "").split(" ")
        elif texts and kind < 0.5:
            words = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randint(1, 1 + len(words) // 25)):
                words[rng.randrange(len(words))] = rng.choice(["new", "words", "here"])
        elif kind < 0.6:
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage.split(" ")
        texts.append(" ".join(words))
    return texts


# Components


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 2000 + i) for i in range(50)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in links:
        a, b = find(u), find(v)
        parent[max(a, b)] = min(a, b)
    want = {x: find(x) for u, v in links if u != v for x in (u, v)}
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == want
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_components_stop_at_stars(spark, monkeypatch):
    """Stars take no round, and a round without a change isn't made to see the end: each costs several shuffles, however few its links."""
    made, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name: made.append(name) or settle(df, name))
    for links, want, tables in (
        ([(9, 1), (1, 5), (7, 2), (2, 2)], {1: 1, 5: 1, 9: 1, 2: 2, 7: 2}, 2),
        ([(5, 4), (4, 3), (3, 5), (8, 6)], {3: 3, 4: 3, 5: 3, 6: 6, 8: 6}, 6),
        ([(2, 1), (3, 2)], {1: 1, 2: 1, 3: 1}, 6),
    ):
        made.clear()
        assert {r.node: r.component for r in graph.components(spark.createDataFrame(links, "u long, v long")).collect()} == want
        assert len(made) == tables, made


@pytest.mark.parametrize("few", [graph.FEW, 3])
def test_components_of_a_table(spark, few):
    """Few links are joined in one task, more by rounds, with the same results."""
    rng = random.Random(2)
    links = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(i + 1, i) for i in range(1000, 1040)] + [(9000, 2000 + i) for i in range(30)] + [(7, 7)]
    table = spark.createDataFrame(links, "u long, v long")
    want = {r.node: r.component for r in graph.components(table).collect()}
    assert {r.node: r.component for r in graph.components_of_table(table, few).collect()} == want
    assert graph.components_of_table(spark.createDataFrame([], "u long, v long"), few).count() == 0


def test_few_links_take_no_rounds(spark, frame, prose, monkeypatch):
    """A chain of near copies took three tables a round, each of as many files as there are shuffle partitions."""
    made, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df, name: made.append(name) or settle(df, name))
    words, texts = prose(3, 100).split(" "), []
    for i in range(30):
        words[i * 3 % 100] = f"new{i}"
        texts.append(" ".join(words))
    got = neardup.near_duplicates(frame(texts), size=2).collect()
    assert {r.component_id for r in got} == {0}
    assert len(made) <= 3, made


# Near-duplicates


@pytest.mark.parametrize("at_once", [1, 500, 1 << 18])
@pytest.mark.parametrize("sided", [False, True])
def test_similar_joins_what_pairs_join(monkeypatch, at_once, sided):
    monkeypatch.setattr(neardup, "AT_ONCE", at_once)
    rng = random.Random(4)
    base = [sorted(rng.sample(range(1000), 40)) for _ in range(6)]
    sets = []
    for i in range(90):
        held = set(base[i % 6])
        for _ in range(rng.randint(0, 8)):
            held ^= {rng.randrange(1000) if rng.random() < 0.5 else rng.choice(base[i % 6])}
        sets.append(held | {1001 + i % 2})
    arrays = [np.array(sorted(x), np.uint64) for x in sets]
    group, side = np.array([i if i % 5 else 1000 for i in range(90)]), np.array([i // 6 % 2 for i in range(90)])
    found = neardup.similar(arrays, group, side if sided else None, 80)
    every = [(i, j) for j in range(90) for i in range(j) if group[i] != group[j] and (not sided or side[i] != side[j]) and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert set(found) <= set(every) and len(every) > len(found) > 0
    joins = lambda pairs: set(zip(*(x.tolist() for x in graph.joined(*np.array([(group[i], group[j]) for i, j in pairs]).T)), strict=True))
    assert joins(found) == joins(every)


def test_alike_sets_are_compared_at_once(monkeypatch):
    """Sets that are alike but not similar are candidates of each other; each pair made and sorted its union."""
    sets = [np.array([*range(70), *range(1000 + 30 * i, 1030 + 30 * i)], np.uint64) for i in range(120)]
    calls, unique = [], np.unique
    monkeypatch.setattr(neardup.np, "unique", lambda *a, **k: calls.append(1) or unique(*a, **k))
    assert neardup.similar(sets, np.arange(120), None, 60) == []
    assert len(calls) <= 3 * 120, len(calls)


def brute_components(rows, size, percent=80):
    sets = {}
    for d, t in rows:
        w = re.findall(WORD, lower(t))
        s = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} or ({tuple(w)} if w else set())
        sets.setdefault(d, []).append(s)
    parent = {d: d for d in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in ids}


@pytest.mark.parametrize(("size", "seed"), [(4, 1), (5, 2)])
def test_near_duplicates_match_brute_force(frame, prose, odd, size, seed):
    texts = corpus(prose, random.Random(seed))
    base = prose(50, 120).split(" ")
    for i in range(40):  # a group whose copies are like the first, and not all like each other
        copy = list(base)
        for k in range(3):
            copy[(7 * i + 13 * k) % len(copy)] = f"edit{i}{k}"
        texts.append(" ".join(copy))
    rows = frame([*((1000 - i, t) for i, t in enumerate(texts)), *((t if isinstance(t, tuple) else (2000 + i, t)) for i, t in enumerate(odd))])
    held = [(r.doc_id, r.text) for r in rows.collect()]
    want = brute_components(held, size)
    got = neardup.near_duplicates(rows.withColumn("component_id", F.lit("clash")), size=size, block=16).collect()
    assert len(got) == len(held)
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in got)
    kept = neardup.keep_one(rows, size=size).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({*want.values()})
    assert neardup.keep_one(rows, size=size).columns == rows.columns


def test_near_duplicates_of_nothing(frame):
    assert neardup.near_duplicates(frame([])).count() == 0
    assert neardup.keep_one(frame([])).count() == 0


# Substrings


def brute_removed(rows, window):
    first = {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        w = re.findall(WORD, t or "")
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), d)
    out = collections.Counter()
    for d, t in rows:
        w = re.findall(WORD, t or "")
        off = {j for i in range(len(w) - window + 1) if d is not None and first[tuple(w[i : i + window])] < d for j in range(i, i + window)}
        left = " ".join(x for i, x in enumerate(w) if i not in off)
        out[(d, len(w), len(off), hashlib.sha256(left.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize(("window", "kmer", "seed"), [(50, 12, 1), (8, 3, 2), (5, 4, 3)])
def test_substrings_match_brute_force(frame, prose, odd, window, kmer, seed):
    texts = corpus(prose, random.Random(seed))
    rows = frame([*((1000 - i, t) for i, t in enumerate(texts)), *((t if isinstance(t, tuple) else (2000 + i, t)) for i, t in enumerate(odd)), (3000, "a b " * 60), (3001, "b a " * 60), (3002, "a b " * 60)])
    held = [(r.doc_id, r.text) for r in rows.collect()]
    got = substrings.repeat_counts(rows.withColumn("key", F.lit("clash")), window=window, kmer=kmer)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_removed(held, window)


def test_tables_of_substrings_go_when_they_are_done_with(spark, frame, prose, monkeypatch):
    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    left = lambda: sorted(x.rsplit("-", 1)[0] for x in set(os.listdir(folder)) - before)
    at, windows = [], substrings._windows
    monkeypatch.setattr(substrings, "_windows", lambda *a: at.append(left()) or windows(*a))
    texts = corpus(prose, random.Random(4), 40)
    rows = frame(texts)
    gone = substrings.repeats(rows, window=8, kmer=3)
    assert at == [["substring-ranges"]]  # edges are gone before windows are written
    assert left() == ["substring-gone"]
    got = substrings._kept(substrings._numbered(rows), gone, 8).select("doc_id", "n_words", "n_removed", "digest")
    assert collections.Counter(map(tuple, got.collect())) == brute_removed(list(enumerate(texts)), 8)


def test_dropping_repeats(frame, prose):
    passage = prose(5, 60)
    rows = frame(["one " + passage + " two\nthree", "four\tfive " + passage, passage, "clean  text\n stays", None]).withColumn("kept", F.lit(1)).withColumn("spot", F.lit(2))
    out = {r.doc_id: r for r in substrings.drop_repeats(rows).collect()}
    assert sorted(out) == [0, 1, 3, 4]
    assert (out[1].text, out[1].n_chars) == ("four five", 9)
    assert out[3].text == "clean  text\n stays" and out[0].text.endswith("two\nthree")
    assert substrings.drop_repeats(rows).columns == rows.columns
    assert substrings.drop_repeats(frame([])).count() == 0


# Decontamination

ITEMS = [(1, "A train leaves Boston at 9 and travels 120 km toward Denver while Anna waits 3 hours for it to arrive there."), (2, "What colour is the sky?"), (3, "too short"), (4, None), (5, "")]


def contaminated(frame, spark, texts):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    return {(r.doc_id, r.item_id) for r in decontam.matches(frame(texts), items).collect()}


def test_benchmark_passages_are_found(spark, frame, prose):
    plain, question = ITEMS[0][1], ITEMS[1][1]
    texts = [
        prose(1, 60) + " " + plain + " " + prose(2, 60),  # as it is
        prose(3, 30) + " a TRAIN leaves, Boston at 9 and travels 120 km toward Denver; while Anna waits 3 hours for it to arrive there! " + prose(4, 10),  # case and marks
        prose(5, 30) + " A train leaves Paris at 7 and travels 450 miles toward Berlin while Maria waits 5 days for it to arrive there. " + prose(6, 9),  # other names, numbers, units
        prose(7, 30) + " " + question + " " + prose(8, 9),
        prose(9, 200),
        plain[:40] + " " + prose(10, 50),  # a few words only
        None,
        "",
    ]
    assert contaminated(frame, spark, texts) == {(0, 1), (1, 1), (2, 1), (3, 2)}


def test_slots_must_be_consistent(spark, frame):
    item = "Tom has 5 apples and gives 5 apples to Ann so how many of the 5 apples does he keep for the evening"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item.replace("5", "7"), item.replace("5", "7", 1).replace("gives 5", "gives 9")]
    assert {r.doc_id for r in decontam.matches(frame(texts), items).collect()} == {0}


def test_slots_are_held_against_each_other_within_a_run(spark, frame):
    item = "Tom has 5 apples and gives some of them to his sister who lives by the old mill and then eats 5 apples on the way back home"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    apart = item.replace("by the old mill", "in a new house").replace("eats 5", "eats 8")  # 14 words as they are, then another number
    torn = item.replace("gives some of them", "sold any but one").replace("by the old mill", "in a new house")
    assert {r.doc_id: r.run_words for r in decontam.matches(frame([apart, torn, item]), items).collect()} == {0: 14, 2: 28}


def test_slots_are_held_against_each_other_both_ways(spark, frame):
    item = "yesterday afternoon Tom gave 5 apples to Ann and Mary who then walked all the way home along the quiet river"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    texts = [item.replace("Ann", "Eve").replace("Mary", "Sue"), item.replace("Ann", "Eve").replace("Mary", "Eve")]
    assert {r.doc_id for r in decontam.matches(frame(texts), items).collect()} == {0}


def test_quotations_count_whatever_follows(spark, frame):
    item = "a box of 5 pens costs as much as two books and the shop gives one more book for free to all who buy 5 pens before the end of this month"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    first, last = item.rsplit("5 pens", 1)
    texts = [first + "9 pens" + last, first + "5 pens" + last, item.replace("5 pens costs", "6 pens costs"), item.replace("5 pens", "8 pens")]
    assert {r.doc_id: r.run_words for r in decontam.matches(frame(texts), items).collect()} == {0: 24, 1: 32, 2: 28, 3: 32}


def brute_matches(docs, items, least=13, verbatim=20):
    """Every document against every item at every shift, word by word."""

    def read(text):
        out, before = [], None
        for i, w in enumerate(re.findall(WORD, text or "")):
            bare = re.sub(r"^[^\w%€$£]+|[^\w%€$£]+$", "", w)
            if not bare:
                continue
            kind = "number" if re.fullmatch(r"[0-9]+", bare) else "unit" if bare in decontam.UNITS and before == "number" else "name" if re.fullmatch(r"[A-Z][a-z]+", bare) and i and not stopped else None
            stopped = w[-1] in ".!?:;"
            before = kind
            out.append((kind or bare.lower(), bare.lower(), kind is not None))
        return out

    found = {}
    for d, text in docs:
        doc = read(text)
        for k, told in items:
            item = read(told)
            n = len(item)
            for shift in range(-n, len(doc)):
                hits = {}
                for at in range(n - 7):
                    if at + shift < 0 or at + shift + 8 > len(doc):
                        continue
                    a, b = item[at : at + 8], doc[at + shift : at + shift + 8]
                    pairs = None
                    if [x[0] for x in a] == [x[0] for x in b] and sum(x[2] for x in a) <= 4:
                        pairs = {(x[1], y[1]) for x, y in zip(a, b, strict=True) if x[2]}
                    if [x[1] for x in a] == [x[1] for x in b]:
                        pairs = (pairs or set()) | {(x[1], x[1]) for x in a if x[2]}
                    if pairs is not None:
                        hits[at] = (pairs, all(x == y for x, y in pairs))
                for only in (False, True):
                    run, pairs, before = 0, set(), None
                    for at in [*sorted(hits), None]:
                        if at is not None and only and not hits[at][1]:
                            continue
                        if at is not None and before is not None and at == before + 1:
                            run, pairs, before = run + 1, pairs | hits[at][0], at
                            continue
                        if before is not None:
                            words = run + 8
                            steady = len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
                            if words >= verbatim if only else steady and words >= min(least, max(8, n - 2)):
                                found[d, k] = max(words, found.get((d, k), 0))
                        if at is not None:
                            run, pairs, before = 0, set(hits[at][0]), at
    return found


def test_matches_are_those_of_brute_force(spark, frame):
    rng = random.Random(12)
    plain = ["box", "pens", "costs", "much", "shop", "gives", "river", "walk", "home", "green", "slow", "train", "leaves", "toward", "waits"]
    names, units = ["Ann", "Tom", "Eve", "Sue"], ["km", "hours", "miles"]

    def words(n):
        out = ["so"]
        while len(out) < n:
            kind = rng.random()
            out += [str(rng.randint(2, 5)), rng.choice(units)] if kind < 0.12 else [str(rng.randint(2, 9))] if kind < 0.2 else [rng.choice(names)] if kind < 0.3 else [rng.choice(plain)]
        return out[:n]

    items = [(i, " ".join(words(rng.randint(10, 40)))) for i in range(12)]
    docs = []
    for i in range(150):
        item = rng.choice(items)[1].split()
        a = rng.randrange(0, max(1, len(item) - 10))
        part = item[a : a + rng.randint(10, 40)]
        if rng.random() < 0.6:  # other values, the same throughout or not
            swap = {x: rng.choice(names if x in names else units if x in units else "23456789") for x in {*names, *units, *"23456789"}}
            part = [swap.get(w, w) if rng.random() < 0.9 else w for w in part]
        docs.append((i, " ".join([*words(rng.randint(1, 12)), *part, *words(rng.randint(0, 12))])))
    docs += [(200, docs[0][1]), (200, docs[0][1]), (201, items[0][1] + " then " + items[1][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.run_words for r in decontam.matches(frame(docs), bench).collect()}
    want = brute_matches(docs, items)
    assert got == want and 30 < len(want) < 200


def test_verbatim_copies_full_of_numbers_are_found(spark, frame, prose):
    heavy, short = "Given the list 3 7 9 12 15 21 what is the median of the list", "Add 3 4 5 6"
    items = spark.createDataFrame([(1, heavy), (2, short)], "item_id long, text string")
    texts = [prose(1, 30) + " " + heavy + " " + prose(2, 30), prose(3, 30) + " so add 3 4 5 6 " + prose(4, 30), heavy.replace("9", "8"), "add 3 4 5 7", heavy.lower()]
    assert {(r.doc_id, r.item_id) for r in decontam.matches(frame(texts), items).collect()} == {(0, 1), (1, 2), (4, 1)}


def test_clean_documents_stay(spark, frame, prose, odd):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = [*odd, *(prose(i, 100) for i in range(20)), (None, ITEMS[0][1])]
    rows = frame(texts).withColumn("key", F.lit("clash"))
    out = decontam.decontaminate(rows, items)
    assert out.columns == rows.columns
    assert out.count() == len(texts) - 1
    assert decontam.decontaminate(rows, items.where("false")).count() == len(texts)
    assert decontam.decontaminate(rows.where("false"), items).count() == 0


# Mixing


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in order if s not in held]
        left = total - sum(held.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free} if free else {}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return {**{s: float(v) for s, v in held.items()}, **share}
        held.update({s: most * sizes[s] for s in over})


def test_mixing_reaches_targets(spark):
    rng = random.Random(4)
    rows = []
    for i in range(3000):
        source = rng.choice(["big"] * 6 + ["mid", "Mid", "é", None, "tiny"] if i % 50 else ["rare"])
        rows.append((i if i % 40 else None, " ".join(["w"] * rng.randint(0, 60)), source))
    rows += [(5000, None, "void"), (5001, "", "void"), rows[1], rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("clash")).withColumn("k", F.lit(0))
    got = mixing.mix_sizes(docs.repartition(7), cell_rows=16).collect()
    assert len(got) == len(rows)
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    want = brute_targets(dict(sizes))
    taken, targets = collections.Counter(), {}
    by_size = {v: k for k, v in sizes.items()}
    for r in got:
        source = by_size[r.source_size]
        taken[source] += r.taken
        targets[source] = r.target
        assert 0 <= r.taken <= 3 * r.size
    assert targets == pytest.approx(want)
    assert all(abs(taken[s] - want[s]) <= max(60, 0.02 * want[s]) for s in want)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.size, r.taken)
    again = mixing.mix_sizes(docs.repartition(3), cell_rows=16).collect()
    assert sorted(map(key, got)) == sorted(map(key, again))
    mixed = mixing.mix_documents(docs, cell_rows=16)
    assert mixed.columns == docs.columns
    assert mixed.count() == sum(r.n_copies for r in got)


def test_mixing_nothing(spark, frame):
    assert mixing.mix_sizes(frame([])).count() == 0
    assert [r.taken for r in mixing.mix_sizes(frame([None, "", " "])).collect()] == [0, 0, 0]


# Pipeline


def test_long_texts_are_compared_whole(spark, frame, prose):
    from scoreweave.llm.shared import STEP_BYTES

    long = " ".join(prose(i, 150) for i in range(300, 300 + int(1.2 * STEP_BYTES / 800)))
    assert len(long) > STEP_BYTES
    tail = " ".join(long.split()[-60:])
    rows = frame([long, "short words " + tail, long + " and more", ITEMS[0][1], long + " " + ITEMS[0][1]])
    held = [(r.doc_id, r.text) for r in rows.collect()]
    got = substrings.repeat_counts(rows)
    assert collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got.collect()) == brute_removed(held, 50)
    assert {r.doc_id: r.component_id for r in neardup.near_duplicates(rows).collect()} == {0: 0, 1: 1, 2: 0, 3: 3, 4: 0}
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontam.matches(rows, items).collect()} == {(3, 1), (4, 1)}


def test_pipeline_keeps_odd_rows_and_columns(spark, frame, prose, tmp_path):
    """Nulls, repeated rows and columns with names that the stages use; and no rows at all."""
    texts = [(None, prose(1, 60)), (None, prose(2, 60)), (3, prose(3, 60)), (3, prose(3, 60)), (3, prose(4, 60)), (5, None), (6, ""), (7, prose(7, 60)), (8, "so " + prose(7, 60))]
    docs = frame(texts)
    for name in ("kept", "key", "spot", "size", "k", "whole", "n", "gone", "figures", "wanted", "mark", "component_id"):
        docs = docs.withColumn(name, F.lit(name))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = stage(spark, rows, str(tmp_path))
        assert rows.columns == docs.columns
    left = sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in rows.collect())
    assert left == [(False, 3, "kept"), (False, 7, "kept"), (True, 0, "kept"), (True, 0, "kept")]
    assert {r.text for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} <= {r.text for r in rows.collect()}
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, str(tmp_path))
        assert empty.count() == 0


def test_pipeline_matches_brute_force(spark, frame, prose, tmp_path):
    """Each stage against its plain version, on the rows that the stage before kept."""
    rng = random.Random(8)
    texts = [t for t in corpus(prose, rng, 150)]
    texts[3:3] = [prose(70, 40) + " " + ITEMS[0][1] + " " + prose(71, 40), "junk*** words### " * 30, None]
    docs = frame(texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5
    (q, n, s, d, m) = (f for _, f in corpus_pipeline.STAGES)
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    good = q(spark, docs, str(tmp_path))
    assert good.columns == docs.columns and 5 not in rows(good) and 4 not in rows(good)
    one = n(spark, good, str(tmp_path))
    kept = rows(good)
    assert set(rows(one)) == set(brute_components(list(kept.items()), 5).values())
    cut = s(spark, one, str(tmp_path))
    want = {k[0]: k[1:] for k in brute_removed(list(rows(one).items()), 50)}
    for i, text in rows(cut).items():
        assert hashlib.sha256(" ".join(re.findall(WORD, text)).encode()).hexdigest() == want[i][2]
    assert set(rows(cut)) == {i for i, w in want.items() if w[1] < w[0] or not w[0]}
    clean = d(spark, cut, str(tmp_path))
    assert set(rows(cut)) - set(rows(clean)) == {3}
    mixed = m(spark, clean, str(tmp_path))
    assert set(rows(mixed)) <= set(rows(clean))
    out = corpus_pipeline.run(spark, str(tmp_path))
    key = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    assert key(out) == key(mixed)
