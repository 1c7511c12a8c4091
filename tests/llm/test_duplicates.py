"""Near duplicates, paragraphs and strings against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from siltmark.llm import lsh_forest, paragraph_dedup, suffix_dedup
from siltmark.llm.components import components
from siltmark.llm.shingles import WordHashes

SCHEMA = "doc_id long, text string"


def copies_of(prose, groups: int, size: int, seed: int) -> list[tuple[int, str]]:
    """Near copies at all distances, with exact ones among them."""
    draw, rows = random.Random(seed), []
    for _ in range(groups):
        words = prose(12).split()
        for _ in range(size):
            copy = list(words)
            for _ in range(draw.choice((0, 0, 1, 2, 4, 8))):
                copy[draw.randrange(len(copy))] = f"w{draw.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def shingle_set(text: str | None, width: int) -> frozenset:
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))) if words else frozenset()


def brute_components(rows, width: int) -> dict[int, int]:
    sets = {i: shingle_set(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 80 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("work", [4096, 4])
def test_forest_equals_brute_force(spark, prose, monkeypatch, work):
    """Also where nearly every region is split by depth."""
    monkeypatch.setattr(lsh_forest, "REGION_WORK", work)
    rows = copies_of(prose, 6, 25, 1) + [(1000 + k, prose(6)) for k in range(40)]
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=4).collect()}
    want = brute_components(rows, 4)
    assert {i: r.component_id for i, r in got.items()} == want
    assert all(r.n_shingles == len(shingle_set(t, 4)) for (i, t) in rows for r in [got[i]])
    assert {i for i, r in got.items() if r.kept} == set(want.values())


def test_regions_too_large_for_a_block_lose_no_link(spark, monkeypatch):
    """Pairs of similarity 0.8 that nothing but the comparison of whole regions can find."""
    monkeypatch.setattr(lsh_forest, "REGION_WORK", 0)
    for name in ("first_round", "neighbours"):
        monkeypatch.setattr(lsh_forest, name, lambda *args, f=getattr(lsh_forest, name): f(*args).filter("false"))
    rows = []
    for k in range(150):
        words = [f"w{k}x{j}" for j in range(93)]  # 90 shingles; ten of them differ
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:-10] + [f"v{k}x{j}" for j in range(10)]))]
    got = {r.doc_id: r.component_id for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, SCHEMA), width=4).collect()}
    assert got == {i: i // 2 * 2 for i in got} and len(got) == 300


@pytest.mark.parametrize("columns, pairs", [(4096, 1 << 22), (3, 5)])
def test_a_block_counts_all_pairs_at_once(monkeypatch, columns, pairs):
    """Shared values of every two nodes that can still be linked, by both parts of the product; no pair of sets is read alone."""
    monkeypatch.setattr(lsh_forest, "DENSE_COLUMNS", columns)
    monkeypatch.setattr(lsh_forest, "SPARSE_PAIRS", pairs)
    draw = random.Random(7)
    common = [draw.getrandbits(63) for _ in range(60)]
    sets = [set(draw.sample(common, draw.randint(1, 40))) | {draw.getrandbits(63) for _ in range(draw.randint(0, 12))} for _ in range(130)]
    sizes = np.array([len(s) for s in sets])
    owner, values = np.repeat(np.arange(130), sizes), np.array([v for s in sets for v in s])
    needed = -(-sizes * 80 // 100)
    left, right, counts = lsh_forest.shared_counts(owner, values, np.arange(0, 130, 3), np.arange(130), needed)
    assert [[len(sets[a] & sets[b]) if a != b else counts[k, j] for j, b in enumerate(right)] for k, a in enumerate(left)] == counts.tolist()
    others = [set().union(*(sets[b] for b in range(130) if b != a)) for a in range(130)]
    assert set(right) == {a for a in range(130) if len(sets[a] & others[a]) >= needed[a]} and 0 < right.size < 130


def test_forest_on_odd_rows(spark, odd_rows):
    out = lsh_forest.near_duplicates(spark.createDataFrame(odd_rows, SCHEMA), width=4).collect()
    assert len(out) == len(odd_rows)
    by_id = defaultdict(list)
    for r in out:
        by_id[r.doc_id].append(r)
    assert by_id[1][0].n_shingles == by_id[3][0].n_shingles == 0 and by_id[1][0].kept
    assert [r.component_id for r in by_id[5]] == [4, 4] and not any(r.kept for r in by_id[5])
    empty = lsh_forest.near_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []


def test_one_row_of_each_group_stays(spark, odd_rows, prose):
    copies = copies_of(prose, 2, 8, 4)
    rows = [(100 + i, t) for i, t in copies] + odd_rows + odd_rows
    out = lsh_forest.one_of_each_group(spark.createDataFrame(rows, SCHEMA)).collect()
    texts = [r.text for r in out]
    assert texts.count("one") == 1 and texts.count("no id here") == 1 and texts.count("") == 2
    groups = set(brute_components([(100 + i, t) for i, t in copies], 5).values())
    assert {r.doc_id for r in out if (r.doc_id or 0) >= 100} == groups


def test_components_of_a_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(40)]
    star = [(100, k) for k in range(101, 160)]
    got = dict(components(spark.createDataFrame(path + star, "a long, b long")).collect())
    assert {got[k] for k in range(41)} == {0} and {got[k] for k in range(100, 160)} == {100}


def planted(prose, seed: int = 2):
    """A passage of over 50 words in the middle of many texts, at other places and behind other words."""
    draw = random.Random(seed)
    passage = prose(7)
    rows = []
    for k in range(60):
        words = prose(10).split()
        if k % 3 == 0:
            at = draw.randrange(len(words))
            words[at:at] = passage.split()
        rows.append((k, " ".join(words)))
    return passage, rows


def test_planted_passage_stays_once_and_clean_texts_are_left_alone(spark, prose):
    passage, rows = planted(prose)
    got = {r.doc_id: r for r in paragraph_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[0].kept_text == rows[0][1]
    for k, text in rows[1:]:
        if k % 3:
            assert got[k].kept_text == text and got[k].n_removed == 0
        else:
            assert got[k].n_removed > 0.6 * len(passage) and passage not in got[k].kept_text
            assert got[k].n_bytes == len(got[k].kept_text.encode()) + got[k].n_removed


def test_passages_without_sentences_go_to_their_ends(spark):
    """Passages of 51 words and more behind any number of other words, also where another document shares less than that."""
    draw, rows = random.Random(8), []
    fresh = (f"n{k}" for k in range(10**6))
    passages = [[next(fresh) for _ in range(size)] for size in (51, 52, 60, 90, 200)]
    some = {}
    for k in range(75):
        before, after = ([next(fresh) for _ in range(draw.randrange(70))] for _ in range(2))
        passage = passages[k % 5]
        if k < 5:  # the earliest has the middle only
            passage = passage[8:-8]
        some[k] = (before, after)
        rows.append((k, " ".join(before + passage + after)))
    got = {r.doc_id: r for r in paragraph_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    for k, text in rows:
        if k < 5:
            assert got[k].kept_text == text
        elif k >= 10:
            before, after = some[k]
            left = got[k].kept_text.split()
            head = sum(w in set(before) for w in left)
            assert left == before[:head] + after[len(after) - len(left) + head :]
            # near paragraphs of a cluster may hang over the passage by some words
            assert head > len(before) - 12 and len(left) - head > len(after) - 12


@pytest.mark.parametrize("block", [1024, 3])
def test_links_of_paragraphs_equal_brute_force(spark, monkeypatch, block):
    """All links between full paragraphs are found, in one block or many."""
    monkeypatch.setattr(paragraph_dedup, "BLOCK", block)
    draw = np.random.default_rng(3)
    width = paragraph_dedup.WORDS - paragraph_dedup.SHINGLE + 1
    base = draw.choice(1 << 32, size=(8, width + 30), replace=False).astype(np.uint64) << np.uint64(32)
    sets = np.sort(np.array([np.concatenate([b[: width - k], b[width : width + k]]) for b in base for k in range(6)]), axis=1)
    classes = paragraph_dedup.class_of(sets).tolist()
    rows = [(c, *s[: paragraph_dedup.BANDS].view(np.int64).tolist(), bytearray((s >> np.uint64(32)).astype(np.uint32).tobytes())) for c, s in zip(classes, sets)]
    frame = spark.createDataFrame(rows, "class long, b0 long, b1 long, b2 long, shingles binary")
    got = {(r.a, r.b) for r in paragraph_dedup.links_of(frame, 80).collect()}
    want = set()
    for i, a in enumerate(sets):
        for j in range(i):
            shared = len(set(a.tolist()) & set(sets[j].tolist()))
            if 100 * shared >= 80 * (2 * width - shared):
                want.add((min(classes[i], classes[j]), max(classes[i], classes[j])))
    assert got == want and want


def test_texts_of_few_shingles_share_no_band():
    """The number that fills up sets of one or two shingles is no band: all such texts met in one, every pair of them."""
    texts = ["w " * 24, "v " * 30, "a b " * 15, None, "c d " * 40]
    sets = [paragraph_dedup.windows([t])[-1][:, : paragraph_dedup.BANDS] for t in texts]
    _, _, _, first, at, together = paragraph_dedup.windows(texts)
    assert (np.concatenate(sets) == together[:, : paragraph_dedup.BANDS]).all() and len(at) and len(first) == 6


def test_bands_of_texts_of_few_shingles(spark):
    docs = spark.createDataFrame([(1, "w " * 24), (2, "v " * 24), (3, "a b " * 15), (4, None)], "uid long, text string")
    got = {r["uid"]: r["keys"] for r in paragraph_dedup.bands_of(docs, "text").collect()}
    assert [len(got[k]) for k in (1, 2, 3, 4)] == [1, 1, 2, 0] and not any(-1 in keys for keys in got.values())


@pytest.mark.parametrize("chunk", [1 << 15, 1])
def test_growth_equals_brute_force(spark, monkeypatch, chunk):
    """In one chunk or many, a cluster far larger than a chunk among them."""
    monkeypatch.setattr(paragraph_dedup, "CHUNK", chunk)
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, draw = spark.conf.get(setting), random.Random(6)
    found, gone = [], []
    for k in range(240):
        root = 1 if k < 150 else draw.randrange(2, 12)
        sides = [bytearray(b"".join(draw.choice((b"aaaa", b"aaaa", b"aaaa", b"bbbb")) for _ in range(draw.randrange(28)))) for _ in range(2)]
        doc = draw.choice((None, *range(40)))
        found.append((1000 if doc is None else doc, doc, k, root, *sides))
        if draw.random() < 0.7:
            gone.append((found[-1][0], k, root, *(draw.choice((0, len(s) // 4)) for s in sides)))
    try:
        spark.conf.set(setting, "7" if chunk == 1 else before)
        out = paragraph_dedup.growth(
            spark.createDataFrame(found, "uid long, doc_id long, at int, class long, left binary, right binary"),
            spark.createDataFrame(gone, "uid long, at int, root long, l int, r int"),
            spark.createDataFrame([(k, k) for k in range(1, 12)], "class long, root long"),
        )
        got = {(r.uid, r.at): (r.more_l or 0, r.more_r or 0) for r in out.collect()}
    finally:
        spark.conf.set(setting, before)

    def common(a, b):
        return next((k for k in range(min(len(a), len(b)) // 4) if a[4 * k : 4 * k + 4] != b[4 * k : 4 * k + 4]), min(len(a), len(b)) // 4)

    by_place = {(f[0], f[2]): f for f in found}
    for uid, at, root, l, r in gone:
        mine = by_place[uid, at]
        want = [max((common(mine[s], f[s]) for f in found if f[3] == root and f[0] < uid), default=0) for s in (4, 5)]
        have = got.get((uid, at), (0, 0))
        assert (not l or have[0] == want[0]) and (not r or have[1] == want[1])


@pytest.mark.parametrize("rarity", [512, 2])
def test_large_bands_are_cut_by_rare_shingles(spark, monkeypatch, rarity):
    """300 classes with 12 shingles in common and eight of their own, with a copy each that lacks one: only the copies meet."""
    monkeypatch.setattr(paragraph_dedup, "BLOCK", 64)
    monkeypatch.setattr(paragraph_dedup, "RARITY", rarity)
    dealt, plain = {}, paragraph_dedup.written

    def watched(df, label):
        out = dealt[label] = plain(df, label)
        return out

    monkeypatch.setattr(paragraph_dedup, "written", watched)
    draw = np.random.default_rng(4)
    pool = np.sort(draw.choice(1 << 31, size=12 + 300 * 9, replace=False).astype(np.uint64))
    rows, want = [], set()
    for k in range(300):
        own = pool[12 + 9 * k : 21 + 9 * k]
        sets = [np.sort(np.concatenate([pool[:12], x])) << np.uint64(32) for x in (own[:8], np.append(own[:7], own[8]))]
        a, b = paragraph_dedup.class_of(np.array(sets)).tolist()
        want.add((min(a, b), max(a, b)))
        for c, s in zip((a, b), sets):
            rows.append((c, *s[: paragraph_dedup.BANDS].view(np.int64).tolist(), bytearray((s >> np.uint64(32)).astype(np.uint32).tobytes())))
    frame = spark.createDataFrame(rows, "class long, b0 long, b1 long, b2 long, shingles binary")
    assert {(r.a, r.b) for r in paragraph_dedup.links_of(frame, 80).collect()} == want
    if rarity == 512:
        assert dealt["rare-bands"].groupBy("band").count().agg({"count": "max"}).first()[0] <= 4


def test_few_links_connect_what_all_links_do(spark, prose):
    """Also in a batch that holds several groups; before, a group gave all its pairs."""
    draw = np.random.default_rng(5)
    a, b = draw.integers(0, 300, (2, 200)) - 150
    few = paragraph_dedup.forest(a, b)
    assert few[0].size < np.unique(np.concatenate([a, b])).size
    joined = [dict(components(spark.createDataFrame(list(zip(x.tolist(), y.tolist())), "a long, b long")).collect()) for x, y in ((a, b), few)]
    assert {k: v for k, v in joined[0].items() if k in joined[1]} == joined[1] and all(k == v for k, v in joined[0].items() if k not in joined[1])
    pool = np.sort(draw.choice(1 << 31, size=30, replace=False).astype(np.uint64)) << np.uint64(32)
    sets = np.array([np.append(pool[:19], pool[19 + k]) for k in range(11)])
    classes = paragraph_dedup.class_of(sets).tolist()
    rows = [(c, *s[: paragraph_dedup.BANDS].view(np.int64).tolist(), bytearray((s >> np.uint64(32)).astype(np.uint32).tobytes())) for c, s in zip(classes, sets)]
    frame = spark.createDataFrame(rows, "class long, b0 long, b1 long, b2 long, shingles binary")
    assert paragraph_dedup.links_of(frame, 80).count() == 55 and paragraph_dedup.links_of(frame, 80, every=False).count() == 10


def test_paragraphs_cover_whole_words():
    start, end, sets = paragraph_dedup.paragraphs("Größe " * 30 + "ende.\n" + "wort " * 40, WordHashes())
    raw = ("Größe " * 30 + "ende.\n" + "wort " * 40).encode()
    assert len(start) and all(raw[a : a + 1] != b" " and raw[b - 1 : b] != b" " for a, b in zip(start, end))


def test_paragraphs_on_odd_rows(spark, odd_rows):
    out = paragraph_dedup.without_repeats(spark.createDataFrame(odd_rows, SCHEMA)).collect()
    assert len(out) == len(odd_rows) and all(r.n_bytes == len((r.text or "").encode()) for r in out)
    assert paragraph_dedup.without_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_words_that_all_end_a_sentence_are_cut_and_whole_copies_go(spark, prose):
    words = " ".join(f"W{k}!!" for k in range(30))
    short = "too short for a paragraph"
    rows = [(1, words), (2, words), (3, "alpha beta " + words + " gamma delta"), (4, prose(1) + " tail of\ntwo"), (5, short), (6, short)]
    rows += [(7, rows[3][1]), (8, " " + prose(6) + " Ende"), (9, None)]
    rows += [(10, rows[7][1])]
    got = {r.doc_id: r for r in paragraph_dedup.without_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].kept_text == words and got[2].kept_text == "" and got[2].n_removed == got[2].n_bytes == len(words)
    assert got[3].kept_text.split() == ["alpha", "beta", "gamma", "delta"]
    assert got[5].kept_text == got[6].kept_text == short
    assert got[8].kept_text == rows[7][1] and got[10].kept_text == ""


def brute_strings(rows) -> dict[int, tuple[int, bytes]]:
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for k in range(len(raw) - 99):
            if raw[k : k + 100] in seen:
                gone[k : k + 100] = b"\1" * 100
            else:
                seen.add(raw[k : k + 100])
        out[i] = (sum(gone), bytes(c for c, g in zip(raw, gone) if not g))
    return out


@pytest.mark.parametrize("frequent", [1500, 2])
def test_strings_equal_brute_force(spark, prose, monkeypatch, frequent):
    """Also with nearly every gram resolved by grouping, and with batches of a few rows."""
    monkeypatch.setattr(suffix_dedup, "FREQUENT", frequent)
    monkeypatch.setattr(suffix_dedup, "BATCH", 50)
    _, rows = planted(prose, 7)
    rows += [(200 + i, t) for i, t in copies_of(prose, 3, 8, 9)]
    rows += [(300, "ab" * 300), (301, "a" * 500), (302, "ab" * 120), (303, "é" * 99 + "x" * 101), (304, "x" * 99), (305, None), (306, "")]
    got = {r.doc_id: (r.n_removed, bytes(r.kept_bytes)) for r in suffix_dedup.without_repeated_strings(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute_strings(rows)


def test_strings_on_odd_rows(spark, odd_rows):
    out = suffix_dedup.without_repeated_strings(spark.createDataFrame(odd_rows, SCHEMA)).collect()
    assert len(out) == len(odd_rows)
    assert all(len(r.kept_bytes) + r.n_removed == r.n_bytes for r in out)
    assert suffix_dedup.without_repeated_strings(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cover_sample_is_the_same_for_equal_strings(prose):
    """Two equal strings meet the sample at the same shift, across the borders of chunks too."""
    text = prose(400).encode()
    at, first, last, _ = suffix_dedup.cover_sample(text)
    shift = {}
    for a, f, b in zip(at.tolist(), first.tolist(), last.tolist()):
        for s in range(f, b + 1):
            assert shift.setdefault(text[s : s + 100], a - s) == a - s
    assert len(shift) == len({text[k : k + 100] for k in range(len(text) - 99)})
