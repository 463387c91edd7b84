"""The corpus operators on small fixtures: brute force, and nulls, empty and long texts, ties, repeats, empty tables, clashing names."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from platterlake.llm import chat, decontam, forest, langid, lattice, mixing, quality, suffixes, templates
from platterlake.llm.components import connected_components
from platterlake.llm.shared import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("_text", "_doc", "_hash", "row", "cls", "start", "name", "hash", "v")


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def corpus(seed=1):
    rng = random.Random(seed)
    texts = [words(rng, rng.randrange(1, 60)) for _ in range(40)]
    shared = words(rng, 55)
    texts += [shared + " " + words(rng, 8), words(rng, 9) + " " + shared, texts[3], texts[3], "", " \n\t ", "ab " * 400]
    texts += [texts[0] + " " + texts[1], "x" * 350, "Ünïcödé – naïve " * 20, words(rng, 6000)]
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t)) for i, t in enumerate(texts)]
    return [*rows, (900, None, None, None, None), (901, None, "en", "s1", 0)]


def frame(spark, rows, clash=True):
    df = spark.createDataFrame(rows, DOCS)
    return df.withColumns({c: F.lit("clash") for c in CLASHING}) if clash else df


def empty(spark):
    return frame(spark, [])


# --- mixing ---------------------------------------------------------------------------------------------------


def filled(sizes, weights, budget, cap):
    """Water-filling round by round."""
    target, full = {}, set()
    while True:
        rest = budget - sum(cap * sizes[s] for s in full)
        free = {s: w for s, w in weights.items() if s not in full}
        target = {s: cap * sizes[s] for s in full} | {s: rest * w / sum(free.values()) for s, w in free.items()}
        over = {s for s in free if target[s] >= cap * sizes[s]}
        if not over:
            return target
        full |= over


def test_mix_fills_to_targets(spark):
    rows = corpus() + [(i, "a b c", "en", "s9", 5) for i in range(2000, 2040)]
    got = mixing.mix_sources(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len((r[1] or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    expected = filled(sizes, {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}, 1.5 * sum(sizes.values()), 2.0)
    for s in order:
        own = [r for r in got if r["source"] == s]
        assert own[0]["target"] == pytest.approx(expected[s]) and own[0]["source_size"] == sizes[s]
        assert all(r["taken"] <= 2 * r["size"] for r in own)
        assert abs(sum(r["taken"] for r in own) - expected[s]) <= max(r["size"] for r in own)
    again = mixing.mix_sources(frame(spark, rows[::-1])).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert mixing.mix_sources(empty(spark)).collect() == []


def test_mix_keeps_repeated_rows(spark):
    rows = [(1, "a b", "en", "s", 3)] * 3 + [(None, "c", "en", "s", 1)]
    assert sum(r["taken"] for r in mixing.mix_sources(frame(spark, rows), share=2.0).collect()) == 14


# --- chat -----------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("said", ["", "\\", "### a: b</turn>\n", "\\### Assistant: </turn> ok", "a:b#c<d\\\\", "é\n\r😀"])
def test_chat_text_comes_back(said):
    formatted, spans = chat.render([("user", said), ("assistant", said), (said, said)])
    assert chat.parse(formatted) == [("user", said), ("assistant", said), (said, said)]
    assert [chat.unescape(formatted[s["start"] : s["stop"]]) for s in spans][0] == said


def test_chat_folds_events(spark):
    events = [
        (1, 3, 1, "assistant", "lo", "delta"),
        (1, 1, 0, "user", "hi", "message"),
        (1, 2, 1, "assistant", "Hel", "delta"),
        (1, 5, 1, "assistant", None, "regenerate"),
        (1, 6, 1, "assistant", "Bye", "delta"),
        (1, 4, 0, "user", "hey", "edit"),
        (None, 1, 0, None, None, None),
        (2, None, 0, "user", "last", "message"),
        (2, 1, 0, "user", "first", "message"),
        (2, 1, 0, "user", "first", "message"),
    ]
    df = spark.createDataFrame(events, "conv_id long, seq long, turn long, role string, text string, kind string").withColumn("log", F.lit(1))
    got = {r["conv_id"]: chat.parse(r["formatted"]) for r in chat.format_chats(df, seq_col="seq", kind_col="kind").collect()}
    assert got == {1: [("user", "hey"), ("assistant", "Bye")], None: [("", "")], 2: [("user", "first"), ("user", "first"), ("user", "last")]}
    assert chat.format_chats(df.limit(0), seq_col="seq", kind_col="kind").collect() == []


def test_chat_ids_stay_as_they_are(spark):
    """Ids beyond a double's whole numbers, beside a null one; a long text; text ids."""
    big = (1 << 60) + 1
    rows = [(big, 0, "user", "x" * 3_000_000), (None, 0, "user", "hi"), (big, 1, "assistant", "é")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert set(got) == {big, None} and got[big]["n_turns"] == 2 and got[big]["loss_chars"] == 1
    assert [r["conv_id"] for r in chat.format_chats(df.withColumn("conv_id", F.lit("a"))).collect()] == ["a"]


# --- decontamination ------------------------------------------------------------------------------------------


def brute_hits(docs, items, window=10):
    import re

    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    wins: dict = {}
    for item, t in items:
        w = cut(t)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            wins.setdefault(tuple(w[i : i + n]), set()).add("null" if item is None else str(item))
    out = []
    for doc, t in docs:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    found |= wins[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def test_decontamination_equals_brute_force(spark):
    rng = random.Random(3)
    rows = corpus()
    items = [(1, words(rng, 30)), (2, rows[0][1]), (3, "w1 W2"), (4, None), (5, "!!"), (None, "w7 w8 w9"), (6, " ".join(rows[50][1].split()[100:130])), (7, words(rng, 10)), (8, words(rng, 7)), (9, "w5")]
    rows += [(500, "Start. " + items[0][1].upper() + "!", "en", "s", 1), (501, words(rng, 5) + " " + " ".join(items[0][1].split()[3:14]), "en", "s", 1), (501, "w9", "en", "s", 1), (502, items[7][1], "en", "s", 1), (503, f"x {items[8][1]} y", "en", "s", 1), (503, f"x {items[8][1]} y", "en", "s", 1)]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    for bound in (decontam.BROADCAST_WINDOWS, 0):
        got = decontam.digests(decontam.decontaminate(frame(spark, rows), bench, broadcast_windows=bound)).collect()
        assert sorted(map(tuple, got), key=str) == brute_hits([(r[0], r[1]) for r in rows], items)
    clean = decontam.decontaminate(frame(spark, rows), bench.limit(0)).collect()
    assert len(clean) == len(rows) and not any(r["spans"] or r["items"] for r in clean)
    assert decontam.decontaminate(empty(spark), bench).collect() == []


def test_decontamination_has_no_python_in_its_plan(spark):
    bench = spark.createDataFrame([(1, "a b c d e f g h i j k")], "item_id long, text string")
    plan = decontam.decontaminate(frame(spark, corpus()), bench)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


# --- repeated substrings --------------------------------------------------------------------------------------


def brute_repeats(rows, width=100):
    """Per row, taken in the order given with it: bytes, removed bytes, runs and digest, from a set of all windows."""
    seen: set = set()
    out = []
    for (doc, text), _ in sorted(rows, key=lambda x: x[1]):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if raw[i : i + width] in seen:
                gone[i : i + width] = True
            seen.add(raw[i : i + width])
        runs = np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])) == 1)
        out.append((doc, len(raw), int(gone.sum()), int(runs), hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out, key=str)


def in_order(spark, rows):
    """Each row with its place among all: by id, null last, then by Spark's hash of id and text."""
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k long, doc_id long, text string")
    hashes = {r["k"]: r["h"] for r in df.select("k", F.xxhash64("doc_id", "text").alias("h")).collect()}
    return [(r, (r[0] is None, r[0] or 0, hashes[k])) for k, r in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_repeats_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(r[0], r[1]) for r in corpus(seed) if r[0] < 900]
    base = "".join(rng.choice("ab") for _ in range(700))
    for i in range(25):
        a, b = rng.randrange(500), rng.randrange(100, 300)
        rows.append((1000 + i, words(rng, 5) + base[a : a + b] + words(rng, 4) + base[a : a + b // 2]))
    rows += [(2000, "z" * 1000), (2001, "z" * 150), (2002, "é" * 90), (2003, None)]
    rows += [(1003, words(rng, 60)), (1003, words(rng, 40) + base[50:300]), (None, words(rng, 60)), (None, base[:250] + words(rng, 30)), (None, rows[0][1] + base[100:400])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("found", F.lit(1)).repartition(5)
    got = sorted(map(tuple, suffixes.digests(suffixes.remove_repeats(df)).collect()), key=str)
    assert got == brute_repeats(in_order(spark, rows))


def test_repeats_of_rows_with_one_id(spark):
    rows = [(1, "q" * 120)] * 2 + [(None, "abc " * 60), (2, "abc " * 60)]
    got = sorted((r["n_bytes"], sum(s["stop"] - s["start"] for s in r["spans"])) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(120, 119), (120, 119), (240, 236), (240, 240)]
    assert suffixes.remove_repeats(empty(spark)).collect() == []


def test_repeats_leave_other_texts_of_an_id_alone(spark):
    """A text that stands nowhere else is whole, whatever other rows have its id, or have none as it has."""
    rng = random.Random(3)
    x, y = words(rng, 80), words(rng, 80)
    rows = [(1, x), (2, x), (2, y), (None, x), (None, words(rng, 80))]
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    left = sorted(bytes(r["kept"]).decode() for r in got)
    assert left == sorted([x, "", y, "", rows[4][1]])


# --- line templates -------------------------------------------------------------------------------------------


def line_corpus():
    rng = random.Random(5)
    notice = "this page was last changed on day {} by user {} of this site"
    rows = []
    for i in range(30):
        own = [words(rng, rng.randrange(1, 40), 5000) for _ in range(6)]
        rows.append((i, "\n".join([*own[:3], notice.format(i, f"name{i}x"), *own[3:], "short line", ""])))
    variants = ["the quick brown fox jumps over the lazy dog every single morning " + w for w in ("alpha", "beta", "gamma")]
    rows += [(100 + k, v + "\n" + words(rng, 20, 5000)) for k, v in enumerate(variants)]
    return [*rows, (200, rows[0][1]), (201, ""), (202, "\n\n"), (203, "é " * 30), (204, words(rng, 8000))]


def brute_lines(rows):
    """The texts that are left, by comparing every two lines (written from the rules, not with the operator's functions)."""

    def tokens(line):
        w = line.encode().split()
        m = [b"<*>" if any(48 <= c <= 57 for c in x) else x for x in w]
        return tuple(w if set(m) <= {b"<*>"} else m)

    def near(a, b):
        if len(a) != len(b) or len(a) < 8:
            return a == b
        head = max(4, len(a) // 4)
        n = min(6, len(a) - head)
        edges = [head + (len(a) - head) * k // n for k in range(n + 1)]
        return a[:head] == b[:head] and sum(a[x:y] != b[x:y] for x, y in zip(edges, edges[1:])) <= min(2, n // 3)

    key = {(i, t): (i is None, i or 0) for i, t in rows}
    where, by_start = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n"):
            if tokens(line):
                where.setdefault(tokens(line), set()).add((i, t))
    for x in where:
        by_start.setdefault((len(x), x[:4]), []).append(x)
    first = {}
    for group in by_start.values():
        left = set(group)
        while left:
            own = todo = {left.pop()}
            while todo:
                todo = {b for b in left if any(near(a, b) for a in todo)}
                left -= todo
                own = own | todo
            holders = set().union(*(where[x] for x in own))
            first |= dict.fromkeys(own, min(holders, key=key.get))
    return {i: "\n".join(line for line in (t or "").split("\n") if not tokens(line) or first[tokens(line)] == (i, t)) for i, t in rows}


def test_line_dedup_equals_brute_force(spark):
    rows = line_corpus()
    full = [(i, t, "en", "s", len(t)) for i, t in rows]
    got = templates.drop_recurring_lines(frame(spark, full).repartition(4), keep=("lang", "n_chars")).collect()
    assert {r["doc_id"]: r["text"] for r in got} == brute_lines(rows)
    first = {r["doc_id"]: r for r in got}
    assert "last changed" in first[0]["text"] and "last changed" not in first[7]["text"]
    assert "lazy dog" in first[100]["text"] and "lazy dog" not in first[102]["text"]
    assert first[200]["n_dropped"] == first[200]["n_parsed"] > 0
    assert first[3]["lang"] == "en"


def test_line_dedup_edges(spark):
    line = "a line of well over eight tokens that several rows here all have"
    rows = [(None, line), (5, line), (5, line), (7, None)]
    got = sorted(((r["doc_id"], r["text"], r["n_dropped"]) for r in templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, "", 1), (5, line, 0), (5, line, 0), (7, None, 0)], key=str)
    assert templates.drop_recurring_lines(empty(spark)).collect() == []


def test_line_dedup_of_rows_that_share_an_id(spark):
    """Two texts of one id are two documents: one keeps the line they share, and so for null ids."""
    line = "a line of well over eight tokens that several rows here all have"
    rows = [(3, line + "\nu"), (3, line + "\nv"), (None, line + "\nw"), (None, line + "\nx")]
    got = templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["text"].startswith(line) for r in got) == 1
    assert [r["doc_id"] for r in got if r["text"].startswith(line)] == [3]
    assert sorted(r["text"][-1] for r in got) == ["u", "v", "w", "x"]


def test_line_dedup_of_a_large_leaf_equals_brute_force(spark):
    """3,000 different lines in one leaf, some 0.3 links each; each line has 15 paths, whatever the size of the leaf."""
    rng = random.Random(11)
    rows = [(i, "these four come first " + " ".join(f"{c}{chr(97 + rng.randrange(20))}" for c in "abcdef")) for i in range(3000)]
    truth = brute_lines(rows)
    assert 100 < sum(not t for t in truth.values()) < 2900
    assert {r["doc_id"]: r["text"] for r in templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == truth


def test_line_dedup_sees_short_lines(spark):
    """Lines of 1 to 7 tokens; numbers alone are no template, but equal ones recur."""
    short = ["Licensed under the Apache License, Version 2.0.", "one", "two words", "line 7 of 9", "1984", "5 6"]
    rows = [(1, "\n".join(short)), (2, "\n".join([*short[:3], "line 8 of 9", "1985", "5 6", "", "own"])), (3, "two words\nand more")]
    got = {r["doc_id"]: r["text"] for r in templates.drop_recurring_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: rows[0][1], 2: "1985\n\nown", 3: "and more"} == brute_lines(rows)


def test_pipeline_keeps_documents_with_own_lines_left(spark):
    """A footer that recurs takes no line with it that stands nowhere else, however short; copies go whole."""
    import corpus_pipeline

    footer = "this footer of nine words stands below every page"
    rows = [(i, text, "en", "s", len(text)) for i, text in enumerate([f"roses red\n{footer}", f"violets blue\n{footer}", footer, f"\n{footer}\n \n"])] + [(9, None, "en", "s", None), (10, "", "en", "s", 0)]
    got = {r["doc_id"]: r["text"] for r in corpus_pipeline.dedup_lines(spark, frame(spark, rows, clash=False), "").collect()}
    assert got == {0: f"roses red\n{footer}", 1: "violets blue", 9: None, 10: ""}


# --- near copies ----------------------------------------------------------------------------------------------


def brute_near(rows, threshold=0.8):
    sets = [set(forest.shingles((t or "").encode()).tolist()) for _, t in rows]
    links = [[j for j in range(len(rows)) if j != i and sets[i] and sets[j] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= threshold] for i in range(len(rows))]
    out = []
    for i, (doc, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        head = min(rows[j][0] for j in seen)
        out.append((doc, len(links[i]), head, doc == head))
    return sorted(out)


def near_corpus():
    rng = random.Random(9)
    rows = [(i, words(rng, rng.randrange(3, 120), 3000)) for i in range(60)]
    for base in range(8):
        for k in range(12):
            w = rows[base][1].split()
            for _ in range(k % 4):
                w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
            rows.append((1000 + 20 * base + k, " ".join(w)))
    return [*rows, (5000, ""), (5001, " \n"), (5002, "one two"), (5003, "ONE  two"), (5004, words(rng, 9000)), (5005, None)]


def test_near_documents_equal_brute_force(spark):
    rows = near_corpus()
    full = [(i, t, "en", "s", 0) for i, t in rows]
    got = forest.near_documents(frame(spark, full).repartition(4), block=5).select("doc_id", "n_links", "component_id", "kept").collect()
    assert sorted(map(tuple, got)) == brute_near(rows)


def test_near_documents_edges(spark):
    text = "one two three four five six seven"
    rows = [(None, text, "en", "s", 1), (4, text, "en", "s", 1), (4, text, "en", "s", 1), (6, text + " eight", "en", "s", 1)]
    got = sorted((tuple(r) for r in forest.near_documents(frame(spark, rows)).select("doc_id", "n_links", "component_id", "kept").collect()), key=str)
    assert got == sorted([(None, 2, 4, False), (4, 2, 4, True), (4, 2, 4, True), (6, 0, 6, True)], key=str)
    assert forest.near_documents(empty(spark)).collect() == []


def test_prefixes_shorten_until_the_recall_is_reached():
    assert forest.prefix_depth(0.8, 20, 4, 0.999999) == 3
    assert forest.prefix_depth(0.8, 60, 8, 0.9) == 8
    assert forest.prefix_depth(0.5, 4, 6, 0.9999999) == 1


def test_recall_of_pairs_near_the_threshold(spark):
    """Many pairs of similarity 0.80 to 0.83 among sets that share boilerplate: each is found."""
    rng = random.Random(5)
    page = words(rng, 40, 10**6).split()
    rows = []
    for k in range(150):
        own = words(rng, 160, 10**6).split()
        other = list(own)
        for at in rng.sample(range(0, 150, 5), 4):
            other[at + 2] = f"x{rng.randrange(10**9)}"
        rows += [(2 * k, " ".join(page + own)), (2 * k + 1, " ".join(page + other))]
    got = forest.near_documents(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_links", "component_id", "kept").collect()
    truth = brute_near(rows)
    assert sorted(map(tuple, got)) == truth and sum(r[1] for r in truth) == 300


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 7), (200, 201), (300, 300)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(links, "a", "b").collect()}
    assert got == {i: 0 for i in range(51)} | {100: 0, 200: 200, 201: 200}


# --- embeddings -----------------------------------------------------------------------------------------------


def vectors():
    rng = np.random.default_rng(2)
    rows = []
    for g in range(30):
        base = rng.normal(size=16)
        for k in range(6):
            rows.append((len(rows), (base + rng.normal(size=16) * 0.09 * k).tolist(), g % 3))
    rows += [(1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] * 16, 1), (1004, rows[0][1], None), (1005, [1.0, None] * 8, 1), (1006, rows[0][1], 0), (1007, [2 * x for x in rows[0][1]], 0), (1008, [1.0], 0), (1009, [3.0], 0), (1010, [1e-30] * 16, 2), (1011, [1e300] * 16, 2)]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_near_vectors_equal_brute_force(spark, block):
    rows = vectors()
    ok = lambda v: v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
    links = {}
    for i, v, a in rows:
        links[i] = set()
        for j, w, b in rows:
            if i != j and a is not None and a == b and ok(v) and ok(w) and len(v) == len(w):
                x, y = np.array(v) / np.abs(v).max(), np.array(w) / np.abs(w).max()
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                    links[i].add(j)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn("cell", F.lit(1)).withColumn("n", F.lit(1))
    got = {r["vec_id"]: r for r in lattice.near_vectors(df, block=block, tables=8).collect()}
    assert len(got) == len(rows)
    assert {i: r["n_links"] for i, r in got.items()} == {i: len(x) for i, x in links.items()}
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        assert got[i]["component_id"] == min(seen) and got[i]["kept"] == (i == min(seen))


def test_lattice_points_are_nearest():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 8)) * 2
    point = lattice.decode(x)
    assert ((2 * point) % 1 == 0).all() and (point.sum(1) % 2 == 0).all()
    around = point[:, None] + lattice.NEIGHBOURS
    assert (((x[:, None] - around) ** 2).sum(2).min(1) >= ((x - point) ** 2).sum(1) - 1e-9).all()
    assert len({tuple(v) for v in lattice.NEIGHBOURS}) == 240 and np.allclose((lattice.NEIGHBOURS**2).sum(1), 2)


def test_near_vectors_edges(spark):
    schema = "vec_id long, embedding array<float>, label int"
    twice = spark.createDataFrame([(1, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (None, [1.0, 2.0], 1)], schema)
    assert sorted((tuple(r) for r in lattice.near_vectors(twice).collect()), key=str) == [(1, 1, 1, True), (1, 1, 1, True), (None, 0, None, True)]
    assert lattice.near_vectors(twice.limit(0)).collect() == []


def test_near_vectors_of_rows_that_share_an_id(spark):
    """Two vectors of one id are two: each is linked with its own neighbour only."""
    a, b = [1.0, 0.0, 0.1], [0.0, 1.0, -0.1]
    rows = [(1, a, 1), (1, b, 1), (2, [1.0, 0.01, 0.1], 1), (3, [0.01, 1.0, -0.1], 1)]
    got = sorted(tuple(r) for r in lattice.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect())
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False)]


@pytest.mark.parametrize("dim", [8, 64, 256])
def test_recall_of_pairs_at_the_threshold(dim):
    """Of pairs at cosine 0.93 exactly, the hardest, all but a few meet with the production setting."""
    rng = np.random.default_rng(dim)
    x = rng.normal(size=(20_000, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.normal(size=x.shape)
    z -= (z * x).sum(1, keepdims=True) * x
    y = 0.93 * x + (1 - 0.93**2) ** 0.5 * z / np.linalg.norm(z, axis=1, keepdims=True)
    cells = lattice.Lattice(dim, lattice.TABLES, lattice.PROBES, lattice.CELL, 0)
    met = np.zeros(len(x), bool)
    for t in range(lattice.TABLES):
        a, b = cells.cells(x, t), cells.cells(y, t)
        met |= (a == b[:, :1]).any(1) | (b == a[:, :1]).any(1)
    assert met.mean() > 0.997


# --- languages ------------------------------------------------------------------------------------------------


def spoken():
    rng = random.Random(4)
    kinds = {"en": ["the", "and", "ing", "tion", "er"], "de": ["der", "und", "sch", "ung", "ß"], "fr": ["le", "eau", "oux", "é", "ment"]}
    rows = []
    for i in range(150):
        lang = ("en", "de", "fr")[i % 3]
        rows.append((i, " ".join("".join(rng.choice(kinds[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(30)), lang, "s", 1))
    return rows


def test_language_of_held_out_texts(spark):
    rows = [*spoken(), (500, None, "en", "s", 1), (501, "123 !!", "en", "s", 1), (502, "", None, "s", 1), (None, "the and tion", None, "s", 1)]
    got = langid.identify_language(frame(spark, rows), fold(F.col("doc_id")) != 0).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r[2] for r in rows}
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 500]
    assert len(held) > 10 and all(r["lang_pred"] == truth[r["doc_id"]] and 0 <= r["score"] <= 1 for r in held)
    assert {r["lang_pred"] for r in got if r["doc_id"] in (500, 501, 502)} == {"und"}
    assert langid.identify_language(empty(spark), F.lit(True)).collect() == []
    nothing = langid.identify_language(frame(spark, rows).withColumn("lang", F.lit(None).cast("string")), F.lit(True)).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}


def test_every_language_is_learned_by_broadcast_and_by_joins(spark):
    """40 languages, each with an alphabet of its own, and some texts of none; both ways give the same."""
    rows = [(i * 100 + j, " ".join(chr(0x4E00 + 50 * i + (7 * j + k) % 9) * 2 for k in range(12)), f"l{i:02}", "s", 0) for i in range(40) for j in range(3)]
    truth = {r[0]: r[2] for r in rows}
    rows += [(9000, None, "l01", "s", 0), (9001, "12", None, "s", 0), (9002, "abc", None, "s", 0), (9003, words(random.Random(1), 9000), "l02", "s", 0)]
    one, many = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify_language(frame(spark, rows), F.col("doc_id") % 100 != 0, broadcast_grams=n).collect()} for n in (1 << 22, 0))
    assert len(one) == len(rows) and {d: x[0] for d, x in one.items() if d < 9000} == truth
    assert {d: x[0] for d, x in one.items()} == {d: x[0] for d, x in many.items()}
    assert all(one[d][1] == pytest.approx(many[d][1]) for d in one)
    assert one[9000] == one[9001] == ("und", 0.0) and len({x[1] for d, x in one.items() if d < 9000}) > 5


def test_ties_go_to_the_language_first_by_name(spark):
    rows = [(i, "same text", lang, "s", 0) for i, lang in enumerate(["b", "a", "c"])]
    for n in (1 << 20, 0):
        assert {r["lang_pred"] for r in langid.identify_language(frame(spark, rows), F.lit(True), broadcast_grams=n).collect()} == {"a"}


def test_code_lengths_equal_plain_ppm():
    import pyarrow as pa

    seen, told = ["abracadabra", "abrax"], ["abra", "zq", "", "cadabra abracadabra"]
    codes, _ = langid.grams(pa.array(seen), 2)
    found, n = np.unique(codes, return_counts=True)
    lengths = langid.ContextTrees({"x": (found, n)}, 2).lengths(pa.array(told))[:, 0]
    counts: dict = {}
    for t in seen:
        t = "\n\n" + t
        for i in range(2, len(t)):
            for k in range(3):
                counts.setdefault(t[i - k : i], {}).setdefault(t[i], 0)
                counts[t[i - k : i]][t[i]] += 1
    for t, bits in zip(told, lengths, strict=True):
        t, expected = "\n\n" + t, 0.0
        for i in range(2, len(t)):
            for k in (2, 1, 0, -1):
                c = counts.get(t[i - k : i] if k >= 0 else None)
                if k < 0:
                    expected += 8
                elif c and t[i] in c:
                    expected -= np.log2(c[t[i]] / (sum(c.values()) + len(c)))
                    break
                elif c:
                    expected -= np.log2(len(c) / (sum(c.values()) + len(c)))
        assert bits == pytest.approx(expected)


# --- quality --------------------------------------------------------------------------------------------------


def judged():
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 5 != 0
        w = words(rng, 60).split()
        text = " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)
        rows.append((i, text, "en", "s", 1))
        if i % 2 == 0:
            labels.append((i, int(good), 0))
    return rows, labels


def test_quality_of_held_out_texts(spark):
    rows, labels = judged()
    rows = [*rows, (900, None, None, None, None), (901, "", "en", "s", 0), (None, "some words", "en", "s", 1)]
    docs = frame(spark, rows)
    use = fold(F.col("doc_id")) != 0
    model = quality.train(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), use)
    assert 0.7 < model.prior < 0.9
    got = quality.score_quality(docs, model, keep=("doc_id", "source")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r["score"] <= 1
        if r["doc_id"] is not None and r["doc_id"] < 400:
            assert (r["score"] >= quality.THRESHOLD) == (r["doc_id"] % 5 != 0)
    untaught = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"), use)
    assert {r["score"] for r in quality.score_quality(docs, untaught).collect()} == {0.5}
    assert quality.score_quality(empty(spark), model).collect() == []


def test_prior_is_estimated():
    rng = np.random.default_rng(1)
    positive = rng.normal(2, 1, 4000)
    unlabelled = np.concatenate([rng.normal(2, 1, 3200), rng.normal(-4, 1, 800)])
    assert quality.estimate_prior(positive, unlabelled) == pytest.approx(0.8, abs=0.05)


# --- folds ----------------------------------------------------------------------------------------------------


def fold_of(doc_id):
    import zlib

    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5


