"""Decontamination, tokenizer alignment and ranked search against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

import __spark_entry__ as entry_point
from siltmark.llm import alignment, decontaminate, term_pipeline
from siltmark.llm.bpe import byte_letters
from tests.compare import difference

SCHEMA = "doc_id long, text string"
UPPER = {c: c + 32 for c in range(65, 91)}


@pytest.mark.parametrize("name", ["op12_window_set", "op13_term_pipeline"])
def test_twins(spark, small_dir, small_duck, name):
    assert difference(entry_point.queries()[name](spark, small_dir), small_duck, entry_point.oracle_sql()[name]) is None


def low_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def brute_hits(docs, items, width: int):
    windows: dict[tuple, set] = {}
    for item, text in items:
        w = low_words(text)
        for k in range(max(1, len(w) - width + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(item)
    sizes = {len(w) for w in windows}
    out = []
    for i, text in docs:
        w = low_words(text)
        hits = [(k, tuple(w[k : k + s])) for s in sizes for k in range(len(w) - s + 1) if tuple(w[k : k + s]) in windows]
        inside = {k + j for k, x in hits for j in range(len(x))}
        found = sorted({str(x) for _, h in hits for x in windows[h] if x is not None})
        out.append((i, len(w), len(inside), len(found), hashlib.sha256(",".join(found).encode()).hexdigest(), bool(inside)))
    return out


@pytest.mark.parametrize("most", [500_000, 7])
def test_contamination_equals_brute_force(spark, odd_rows, most):
    draw = random.Random(3)
    words = ["Aa", "bB", "çé", "Éa", "d4", "中文", "e_f", "g"]
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", ", ", "\n", "-", "__"]) for _ in range(n))
    items = [(k, text(draw.randrange(1, 30))) for k in range(30)] + [(40, "Aa"), (41, "bB, g"), (41, "bB, g"), (42, None), (43, "..."), (None, "d4 d4")]
    docs = odd_rows + [(k, text(draw.randrange(60))) for k in range(100, 300)] + [(k, items[k % 30][1].upper() + text(5)) for k in range(400, 460)]
    docs += [(None, "AA x BB g")] * 40
    frame = spark.createDataFrame([(i, t, "mine", 7) for i, t in docs], SCHEMA + ", n_hit string, source long")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(frame, bench, width=4, most_windows=most)
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(brute_hits(docs, items, 4))
    assert decontaminate.contamination(frame.limit(0), bench).collect() == []
    assert not any(r.contaminated for r in decontaminate.contamination(frame, bench.limit(0)).collect())


def test_spans_and_documents_are_removed(spark):
    bench = spark.createDataFrame([(1, "one two three four"), (2, "zz")], "item_id long, text string")
    rows = [(1, "Keep, ONE two-three four; keep! zz"), (2, "nothing here"), (3, "zz"), (4, None), (5, "one two three four one two three four tail")]
    docs = spark.createDataFrame([(i, t, i * 10) for i, t in rows], SCHEMA + ", n_words int")
    spans = {r.doc_id: r.text for r in decontaminate.decontaminated(docs, bench, width=3).collect()}
    assert spans == {1: "Keep; keep", 2: "nothing here", 3: "", 4: None, 5: " tail"}
    left = decontaminate.decontaminated(docs, bench, remove="documents", width=3)
    assert left.columns == docs.columns and sorted((r.doc_id, r.n_words) for r in left.collect()) == [(2, 20), (4, 40)]


# ranked search


def brute_ranks(docs, items, top: int):
    """(item text, rank) -> (document, score); ties by document id, NULL last."""
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(UPPER))
    bags = [(i, Counter(terms(t))) for i, t in docs]
    n, total = sum(bool(b) for _, b in bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = Counter()
    for item, text in set(items):
        scored = []
        for i, bag in bags:
            size = sum(bag.values())
            m = 100 - 75 + (75 * size * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * bag[w] // (1000 * bag[w] + 8 * m)) for w in terms(text) if bag[w])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        for rank, (s, none, i) in enumerate(sorted(scored)[:top], 1):
            out[item, rank, None if none else i, -s] += 1
    return out


@pytest.mark.parametrize("options", [{}, {"block": 7, "owners": 3}, {"most_terms": 300}])
def test_ranks_equal_brute_force(spark, odd_rows, options):
    draw = random.Random(11)
    words = [a + b for a in "abcdé" for b in "xyz7"]
    text = lambda n: " ".join(draw.choices(words, weights=range(1, 21), k=n)).title()
    docs = odd_rows + [(k, text(draw.randrange(40))) for k in range(100, 200)] + [(2**62 + 1, "ax ax"), (2**62, "ax ax"), (None, "ax ax"), (300, "ax ax"), (300, "ax ax")]
    items = [(k, text(draw.randrange(1, 6))) for k in range(300)] + [(400, None), (401, "..."), (402, "one id"), (402, "one ID here"), (402, "one id"), (None, "ax one")]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA + ", score string")
    got = term_pipeline.ranked_search(frame, spark.createDataFrame(items, "item_id long, text string"), top=5, **options)
    assert Counter(map(tuple, got.collect())) == brute_ranks(docs, items, 5)


def test_search_of_empty_tables(spark):
    docs, items = (spark.createDataFrame([(1, "a b")], f"{c} long, text string") for c in ("doc_id", "item_id"))
    assert term_pipeline.ranked_search(docs.limit(0), items).collect() == []
    assert term_pipeline.ranked_search(docs, items.limit(0)).collect() == []


# alignment


def brute_alignment(docs):
    """Whole texts by the libraries, every overlapping pair of occurrences."""
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = byte_letters()
    parts, count = [], Counter()
    for i, text in docs:
        raw = (" " + (text or "")).encode()
        a = library.encode(raw.decode(), add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        ta = [bytes(letters[c] for c in library.id_to_token(x)) for x in a]
        tb = [bytes([int(p[3:5], 16)]) if pieces.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [pieces.id_to_piece(x)]]
        if not text or b"".join(ta) != raw or b"".join(tb) != raw:
            parts.append((i, [], [], "", 0))
            continue
        owner = [x for x, t in enumerate(tb) for _ in t]
        at, links = 0, []
        for x, t in zip(a, ta):
            links += [(x, b[k]) for k in sorted(set(owner[at : at + len(t)]))]
            at += len(t)
        ends = [list(accumulate(map(len, t))) for t in (ta, tb)]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups = [[[], []] for _ in common]
        for side, ids in enumerate((a, b)):
            for x, e in zip(ids, ends[side]):
                groups[bisect_left(common, e)][side].append(str(x))
        joined = ";".join("|".join(",".join(s) for s in g) for g in groups)
        parts.append((i, a, b, joined, links))
        count.update(links)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return Counter(
        (i, len(a), len(b), joined.count(";") + 1, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(joined.encode()).hexdigest())
        if joined else (i, 0, 0, 0, 0, 0, 0, "")
        for i, a, b, joined, links in parts
    )


def test_alignment_equals_brute_force(spark, odd_rows, small_dir):
    draw = random.Random(13)
    letters = " \n\t 'sdtl.,!12éß中\xa0　́\x1c\x85aBcà▁\x00"
    docs = odd_rows + [(k, "".join(draw.choices(letters[:-2] if k % 3 else letters, k=draw.randrange(60)))) for k in range(100, 900)]
    docs += [(k, t) for k, t in enumerate(["a<|endoftext|> b", "<s> x </s><unk> <0x41>", " ", "  ", " a", "a ", "a  b", "a \n b", "a\n  b ", "\n", "😀 é👍🏽", "a b " * 30_000])]
    docs += [(r.doc_id + 10_000, r.text) for r in spark.read.parquet(f"{small_dir}/documents.parquet").collect()]
    frame = spark.createDataFrame([(i, t, "x") for i, t in docs], SCHEMA + ", n_a string")
    paths = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    assert Counter(map(tuple, alignment.aligned(frame, *paths).collect())) == brute_alignment(docs)
    assert alignment.aligned(frame.limit(0), *paths).collect() == []


def test_pair_counts_hold_documents_and_links(spark):
    docs = spark.createDataFrame([(k, "the cat" + " the" * (k % 4)) for k in range(3000)], SCHEMA)
    paths = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    rows = docs.selectExpr("doc_id AS _id", "true AS _known", "text AS _text").coalesce(1)
    counts = alignment.pair_counts(alignment.pair_index(rows, *paths)).collect()
    assert sorted((r.n_docs, r.n_links) for r in counts) == [(3000, 3000), (3000, 3000 + 750 * 6)]


def test_planes_keep_every_bit():
    draw = np.random.default_rng(2)
    bits = draw.random((40, alignment.BLOCK)) < draw.random((40, 1)) ** 6
    pair, at = np.nonzero(bits)
    plane = alignment.bitmap_plane(pair, at, 40)
    back = np.zeros_like(bits)
    back[alignment.plane_entries(plane, 40)] = True
    assert (back == bits).all() and (alignment.plane_counts(plane, 40) == bits.sum(1)).all()
