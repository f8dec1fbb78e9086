import base64
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from paritas.llm import bpe, packing, spans

VOCABULARY = f"{bpe.TOKENIZERS}/{bpe.VOCABULARY}"


@pytest.fixture(scope="module")
def public():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=bpe.SPLIT, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(VOCABULARY, "rb").read())


def test_encoder_matches_the_public_library(encoder, public):
    rng = random.Random(1)
    alphabet = "ab cXé_19 \n\t\r'sll½²Ⅷ一   \x1c\x1f\x0b\x85👩‍🔬٣-+=.Á"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += ["", "a" * 3000, " " * 3001 + "x", "=" * 4001, "ab" * 3000 + "\n" * 700, "<|endoftext|> x"]
    texts += ["".join(rng.choice("ABCDEFabcdef") for _ in range(9000))]
    ids, sizes = encoder.encode(texts)
    ends = np.cumsum(sizes)
    for text, end, n in zip(texts, ends, sizes, strict=True):
        assert ids[end - n : end].tolist() == public.encode_ordinary(text), text[:80]
    assert encoder.count(texts).tolist() == sizes.tolist()


def test_forgetting_changes_nothing(public, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    enc = bpe.Encoder(open(VOCABULARY, "rb").read())
    for text in ("one two three four", "five one", "one two six"):
        assert enc.encode([text])[0].tolist() == public.encode_ordinary(text)


def test_ids_of_all_documents(spark, small, public):
    df = spark.read.parquet(f"{small}/documents.parquet")
    out = {r["doc_id"]: r["ids"] for r in bpe.token_ids(df).collect()}
    rows = df.select("doc_id", "text").collect()
    assert len(out) == len(rows)
    for doc, text in rows:
        assert out[doc] == (public.encode_ordinary(text) if text else [])


def test_ids_of_hard_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a b", "x"), (2, "again", "x"), (3, "long " * 300_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.token_ids(df).collect()
    assert sorted((r["doc_id"] or 0, len(r["ids"])) for r in out) == [(0, 2), (1, 0), (2, 0), (2, 1), (3, 300_001)]
    assert bpe.token_ids(df.limit(0)).collect() == []
    assert bpe.token_counts(df.limit(0)).collect() == []


def test_plan_places_every_item_once():
    rng = random.Random(3)
    for _ in range(30):
        counts = Counter(rng.randint(1, 100) for _ in range(rng.randint(0, 400)))
        used, seen = defaultdict(list), 0
        for length, first, last, container, each, start in packing.plan(counts.items(), 100):
            for r in range(first, last):
                at = start + (r - first) % each * length
                used[container + (r - first) // each].append((at, at + length))
                seen += 1
        assert seen == sum(counts.values())
        for spaces in used.values():
            spaces.sort()
            assert spaces[0][0] == 0 and spaces[-1][1] <= 100
            assert all(a[1] == b[0] for a, b in zip(spaces, spaces[1:], strict=False))
        assert set(used) == set(range(len(used)))
        # As few containers as one-by-one best fit, longest first, needs.
        rooms: list[int] = []
        for length in sorted(counts.elements(), reverse=True):
            fits = [r for r in rooms if r >= length]
            rooms.remove(min(fits)) if fits else None
            rooms.append((min(fits) if fits else 100) - length)
        assert len(used) == len(rooms)


def test_packing_of_documents(spark):
    rows = [(i, n) for i, n in enumerate([5000, 8192, 4096, 1, 0, None, -1, 1000, 1000, 1000, 1000])] + [(None, 7), (3, 1)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long").selectExpr("*", "1 as container_id", "2 as salt")
    out = packing.pack(df).collect()
    want = Counter({(0, 4096): 1, (0, 904): 1, (1, 4096): 2, (2, 4096): 1, (3, 1): 2, (None, 7): 1, **{(i, 1000): 1 for i in range(7, 11)}})
    assert Counter((r["doc_id"], r["n_tokens"]) for r in out) == want
    filled = Counter()
    for r in out:
        filled[r["container_id"]] += r["n_tokens"]
    assert max(filled.values()) <= 4096 and len(filled) == 6
    assert packing.pack(df.limit(0)).collect() == []


def shared(texts, window):
    """Brute force: texts by doc_id -> spans."""
    where = defaultdict(set)
    for doc, text in texts:
        for i in range(len(text) - window + 1):
            where[text[i : i + window]].add(doc)
    out = defaultdict(set)
    for doc, text in texts:
        covered = [False] * (len(text) + 1)
        for i in range(len(text) - window + 1):
            if len(where[text[i : i + window]]) > 1:
                covered[i : i + window] = [True] * window
        start = None
        for i, c in enumerate(covered):
            if c and start is None:
                start = i
            elif not c and start is not None:
                out[doc].add((start, i))
                start = None
    return {(d, a, b) for d, ss in out.items() for a, b in ss}


def found(df, **options):
    rows = [(r["doc_id"], r["span_start"], r["span_end"]) for r in spans.shared_spans(df, **options).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_spans_of_all_small_documents(spark, small):
    df = spark.read.parquet(f"{small}/documents.parquet")
    texts = [(d, t) for d, t in df.select("doc_id", "text").collect() if t]
    expected = shared(texts, spans.W)
    assert expected
    assert found(df) == expected


def test_spans_of_hard_texts(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abcé👩 \n") for _ in range(n))
    passage, other = word(700), word(400)
    rows = [
        (1, word(300) + passage + word(300)),
        (2, passage[:500] + word(10) + passage[500:] + other),
        (3, "x" * 600),
        (4, "y" + "x" * 240 + "y"),
        (5, "x" * 239),
        (6, passage[100:339]),
        (7, passage[100:340]),
        (8, other + other),
        (9, "z" * 500),
        (9, "z" * 500),
        (10, "only here " * 200),
        (11, None),
        (12, ""),
        (None, passage),
        (13, "ab" * 400),
        (14, "ba" * 130),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1L as anchor", "2 as run")
    texts = [(d, t) for d, t in rows if d is not None and t]
    assert found(df) == shared(texts, spans.W)
    # A bitmap that lets nearly everything through changes nothing.
    assert found(df, bits=32768) == shared(texts, spans.W)
    # All anchors dealt out by window, and only those of the commoner passages.
    assert found(df, hot=0) == shared(texts, spans.W)
    assert found(df, hot=300) == shared(texts, spans.W)
    assert found(df.limit(0)) == set()


def test_blocks_and_flushes_lose_nothing(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(spans, "BLOCK", 300)
    rng = random.Random(7)
    base = "".join(rng.choice("ab") for _ in range(5000))
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2]), pa.array([base, base[1000:3000]])], ["doc_id", "text"])
    windows = set()
    for codes, bounds, docs, places in spans._blocks(batch):
        _, starts, ends = spans.super_kmers(codes, bounds)
        for a, b in zip(starts, ends, strict=True):
            p = np.searchsorted(bounds, a, "right") - 1
            for i in range(a, b - spans.W + 1):
                at = places[p] + i - bounds[p]
                assert (docs[p], at) not in windows
                windows.add((docs[p], at))
    assert windows == {(1, i) for i in range(5000 - 239)} | {(2, i) for i in range(2000 - 239)}


def test_colliding_hashes_are_told_apart(monkeypatch):
    rng = random.Random(9)
    text = "".join(rng.choice("ab") for _ in range(900))
    codes = np.frombuffer((text + text).encode("utf-32-le"), np.uint32)
    at = np.arange(len(codes) - spans.W + 1)
    right = spans._same_windows(codes, at)
    monkeypatch.setattr(spans, "rolling_hash", lambda c, n: np.zeros(len(c) - n + 1, np.uint64))
    wrong = spans._same_windows(codes, at)
    pairs = lambda g: {tuple(x) for x in np.stack([g, np.arange(len(g))], 1)}
    assert len(set(right)) == len(set(wrong)) and len({*zip(right, wrong, strict=True)}) == len(set(right)) and pairs(right)


def test_packing_of_one_common_length(spark):
    sizes = spark.range(6000).selectExpr("id as doc_id", "case when id % 3 = 0 then 1365 else 1 + id % 4096 end as n_tokens")
    out = packing.pack(sizes)
    filled = out.groupBy("container_id").sum("n_tokens").collect()
    assert max(r[1] for r in filled) <= 4096 and out.count() == 6000
    total = sum(r[1] for r in filled)
    assert len(filled) <= 1.01 * -(-total // 4096) + 1


def test_hot_windows_are_split_by_further_minimisers_and_compared_by_characters(spark):
    """A passage in every third document, in ever other surroundings, with some neighbours of few or no shared windows."""
    import random

    rng = random.Random(8)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, texts = word(300), {}
    for i in range(60):
        own = word(rng.randrange(200, 500))
        texts[i] = own[:150] + (passage if i % 3 == 0 else "") + own[150:] + (passage[40:200] if i % 5 == 0 else "")
    texts = list(texts.items()) + [(60, texts[3][100:] + "x")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    expected = shared(texts, spans.W)
    assert expected and found(df, hot=0) == found(df, hot=150) == found(df) == expected


@pytest.mark.parametrize("levels", [1, 3, 7])
def test_split_runs_hold_every_window_once_and_give_equal_windows_one_key(levels):
    rng = np.random.default_rng(levels)
    passage = rng.integers(97, 123, 700)
    codes = np.concatenate([passage, rng.integers(97, 123, 400), passage]).astype(np.uint32)
    bounds = np.array([0, len(codes)])
    key, starts, ends = spans._split_runs(codes, *spans.super_kmers(codes, bounds), levels)
    at = np.concatenate([np.arange(a, b - spans.W + 1) for a, b in zip(starts, ends, strict=True)])
    assert (at == np.arange(len(codes) - spans.W + 1)).all()
    of = np.repeat(key, ends - starts - spans.W + 1)
    windows = 700 - spans.W + 1
    assert (of[:windows] == of[1100 : 1100 + windows]).all()
