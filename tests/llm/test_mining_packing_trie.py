"""Hard negatives, best-fit packing and the conversation trie on small fixtures, against brute force."""

import bisect
import hashlib
import itertools
import math
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tapeloom.llm import bestfit, negatives, trie

# Hard negatives

VECTORS = "vec_id long, embedding array<float>, label int, id long, v string, ask string"


def brute_negatives(rows, positives=5, wanted=3):
    sound = []
    for vec_id, x, label, *_ in rows:
        if vec_id is None or label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        sound.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, tuple(math.floor(256 * float(c)) for c in x)))

    def product(a, b):
        return sum(p * q for p, q in zip(a, b))

    out = []
    for a, label, x in {s for s in sound if s[0] % 5 == 0}:
        scored = [(-product(x, v), i, m) for i, m, v in sound]
        for positive in sorted((s, i) for s, i, m in scored if m == label and i != a)[:positives]:
            p = -positive[0]
            fit = sorted((s, i) for s, i, m in scored if m != label and 50 * p <= -100 * s <= 95 * p)[:wanted]
            out += [(a, positive[1], rank, i, p, -s) for rank, (s, i) in enumerate(fit, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    found = negatives.hard_negatives(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 5 == 0, shifted, **how)
    return sorted(map(tuple, found.collect()))


@pytest.mark.parametrize("tree_rows", [8_192, 40])
def test_hard_negatives_against_brute_force(spark, tree_rows):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(6, 8)) / 3
    rows = []
    for i in range(230):
        x = (centres[rng.integers(6)] + rng.normal(size=8) / 8).astype(np.float32).tolist()
        rows.append((i, x, int(rng.integers(4)), 1, "clash", "clash"))
    rows += [rows[10], rows[10], rows[25], (25, rows[26][1], 3, 1, "", ""), (25, rows[25][1], 2, 1, "", "")]  # repeated keys
    rows += [(300 + i, rows[7][1], i % 3, 1, "", "") for i in range(40)]  # ties of a common vector
    rows += [(None, rows[0][1], 1, 1, "", ""), (400, None, 1, 1, "", ""), (405, [1.0, None], 1, 1, "", ""), (410, [float("nan")] * 8, 1, 1, "", ""),
             (415, [float("inf")] * 8, 1, 1, "", ""), (420, rows[0][1], None, 1, "", ""), (425, [], 1, 1, "", ""), (430, [0.5, 0.25], 2, 1, "", ""), (435, [0.0] * 8, 2, 1, "", "")]
    want = brute_negatives(rows)
    assert mined(spark, rows, tree_rows=tree_rows, block_rows=7) == want
    assert len(want) > 200


def test_hard_negatives_of_huge_components(spark):
    rows = [(i, [2.0**20 * (i % 5 + 1) + 1, -(2.0**19) * (i % 3)], i % 2, 1, "", "") for i in range(12)]
    assert mined(spark, rows) == brute_negatives(rows) != []
    rows = [(i, [2.0**100], i % 2, 1, "", "") for i in range(12)]  # all scores at the limit of a long
    assert mined(spark, rows) == []


def test_hard_negatives_of_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(5, [1.0], 1, 1, "", "")]) == []
    assert mined(spark, [(5, [1.0], 1, 1, "", ""), (6, [1.0], 1, 1, "", ""), (8, [0.9], 2, 1, "", "")]) == [(5, 6, 1, 8, 65536, 58880)]


def test_trees_and_blocks_meet_without_a_table_of_pairs(spark, monkeypatch):
    """A joined table of trees and blocks grows with the square of the input and was broadcast."""
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=4).tolist(), int(rng.integers(3)), 1, "", "") for i in range(160)]
    plans, pin = [], negatives.pin
    monkeypatch.setattr(negatives, "pin", lambda df: (plans.append((df.columns, df._jdf.queryExecution().toString())), pin(df))[1])
    assert mined(spark, rows, tree_rows=8, block_rows=4) == brute_negatives(rows) != []
    assert [("Join" in plan) for columns, plan in plans if "rank" in columns] == [False]


@pytest.mark.parametrize("same", [True, False])
@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_anchors_search_trees_together(monkeypatch, same, spread):
    monkeypatch.setattr(negatives, "LEAF_ROWS", 16)
    monkeypatch.setattr(negatives, "CHILD_ROWS", 2)
    monkeypatch.setattr(negatives, "GROUP", 7)
    monkeypatch.setattr(negatives, "PIECE", 20)
    rng = np.random.default_rng(5)
    rows = np.floor(256 * (rng.normal(size=(8, 6))[rng.integers(8, size=500)] + spread * rng.normal(size=(500, 6))))
    rows[:, 3][rng.random(500) < 0.5] = 0
    rows[40:90] = rows[3]
    ids, labels, k = rng.integers(400, size=500), rng.integers(3, size=500), 4
    at = np.arange(0, 500, 11)
    low, high = rng.integers(-100_000, 100_000, size=(2, len(at), 2))
    asks = negatives.Asks(at, ids[at], labels[at], rows[at], low, high, k)
    for part in (slice(0, 300), slice(300, 500)):
        negatives.CoverTree(ids[part], labels[part], rows[part]).search(asks, same)
    want = []
    for n, i in enumerate(at):
        scores = rows @ rows[i]
        for w in range(2):
            fit = (scores >= low[n, w]) & (scores <= high[n, w]) & ((labels == labels[i]) & (ids != ids[i]) if same else labels != labels[i])
            want += [(i, w, m, -s) for s, m in sorted(zip(-scores[fit], ids[fit]))[:k]]
    assert sorted(map(tuple, asks.rows_found().to_numpy().tolist())) == sorted(want) != []


def test_cover_tree_bounds_hold(monkeypatch):
    rng = np.random.default_rng(2)
    rows = np.floor(rng.normal(size=(700, 6)) * rng.choice([10, 300], size=(700, 1)))
    rows[50:90] = rows[3]
    monkeypatch.setattr(negatives, "LEAF_ROWS", 16)
    tree = negatives.CoverTree(np.arange(700), np.zeros(700, dtype=np.int64), rows)
    assert sorted(map(tuple, tree.rows)) == sorted(map(tuple, rows))
    query = np.floor(rng.normal(size=6) * 100)
    nodes = np.arange(len(tree.low))
    low, high = tree.bounds(nodes, tree.rows[tree.centre] @ query, float(np.sqrt(query @ query)))
    for n in nodes:
        below = tree.rows[tree.low[n] : tree.high[n]] @ query
        assert low[n] <= below.min() and below.max() <= high[n]
        if tree.last[n]:
            children = range(tree.first[n], tree.last[n])
            assert [tree.low[n], *(tree.high[c] for c in children)] == [*(tree.low[c] for c in children), tree.high[n]]


# Best-fit packing

FILE = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " \t\n", "one", "It's 1,234 o'clock...", "ÉTÉ, Straße! ΣΑΣ Σ", "x\n" * 50, "\x1c a\x85b\xa0c d", "é ́ a", "a.,;b !?", "<|endoftext|> <|startoftext|>x",
       "\U0001f600 z", "日本語 テキスト", "word " * 3000, "lore ipsa dolor " * 1400]


def fit_decreasing(lengths, capacity):
    gaps, made = [], 0
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) - n if at < len(gaps) else capacity - n
        made += gap == capacity - n and at >= len(gaps)
        if gap:
            bisect.insort(gaps, gap)
    return made


def sound_sequences(rows, capacity):
    """Rows of (sequence, offset, length): gapless from 0 and within capacity."""
    for _, group in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        at = 0
        for _, offset, length in group:
            assert offset == at
            at += length
        assert at <= capacity


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(FILE)
    made.encode_special_tokens = True
    return made


def test_documents_are_cut_and_packed(spark, library):
    rows = [(i, t, "clash", 0, 0) for i, t in enumerate(ODD)] + [(3, "one", "x", 0, 0), (None, "no key", None, 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, length int, sequence_id int")
    packed = bestfit.pack_documents(docs, FILE, with_ids=True).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            own = ids[at : at + 2048]
            raw = struct.pack(f"<{len(own)}I", *own)
            want.append((doc_id, piece, at, len(own), zlib.crc32(raw), raw))
    got = [(r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in packed]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    sound_sequences([(r["sequence_id"], r["offset"], r["length"]) for r in packed], 2048)
    made = bestfit.sequences(bestfit.pack_documents(docs, FILE, with_ids=True)).collect()
    assert sum(len(r["ids"]) for r in made) == 4 * sum(w[3] for w in want)
    assert all(len(r["ids"]) == 4 * sum(r["lengths"]) for r in made)


def test_chunks_give_the_ids_of_whole_texts(library):
    encoder = bestfit.ChunkEncoder(open(FILE, encoding="utf-8").read())
    rng = random.Random(3)
    letters = "aAéÉßΣσİı1²'.,;:!?-́\xa0\x1c\t\n 　漢ﬁ"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)] + [t or "" for t in ODD]
    latin = "".join(map(chr, range(1, 256)))
    texts += ["".join(rng.choice(latin) for _ in range(rng.randrange(40))) for _ in range(3000)] + list(latin)
    for text in texts:
        assert np.frombuffer(encoder.packed(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    assert encoder.find and len(encoder) > 5000
    encoder.find = None
    for text in texts[:200]:
        assert np.frombuffer(encoder.packed(text), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_chunks_beyond_the_memory_are_encoded(library, monkeypatch):
    monkeypatch.setattr(bestfit, "CACHE_CHUNKS", 3)
    encoder = bestfit.ChunkEncoder(open(FILE, encoding="utf-8").read())
    for _ in range(2):
        assert np.frombuffer(encoder.packed("a few more words, than fit."), dtype="<u4").tolist() == library.encode("a few more words, than fit.", add_special_tokens=False).ids
    assert len(encoder) == 3


LENGTHS = {
    "equal": lambda rng: [100] * 400,
    "short": lambda rng: [rng.randrange(1, 100) for _ in range(1500)],
    "any": lambda rng: [rng.randrange(1, 2049) for _ in range(1200)],
    "third": lambda rng: [rng.choice([2048, 1, 683, rng.randrange(600, 700)]) for _ in range(600)],
}


@pytest.mark.parametrize("kind", sorted(LENGTHS))
def test_best_fit_is_near_the_sequential_one(spark, kind):
    lengths = LENGTHS[kind](random.Random(7))
    pieces = spark.createDataFrame(list(enumerate(lengths)), "id long, length int")
    placed = bestfit.best_fit(pieces).collect()
    assert sorted(r["id"] for r in placed) == list(range(len(lengths)))
    sound_sequences([(r["sequence_id"], r["offset"], lengths[r["id"]]) for r in placed], 2048)
    assert len({r["sequence_id"] for r in placed}) <= 1.03 * fit_decreasing(lengths, 2048) + 1


def test_sweeps_match_like_one_stack():
    rng = random.Random(5)
    for _ in range(200):
        events = [(rng.randrange(2), rng.randrange(1, 4)) for _ in range(rng.randrange(1, 40))]
        cuts = sorted(rng.sample(range(len(events) + 1), min(3, len(events))))
        blocks = [events[a:b] for a, b in itertools.pairwise([0, *cuts, len(events)])]
        stack, whole = 0, 0
        for piece, places in events:
            if not piece:
                stack += places
            elif stack:
                stack, whole = stack - 1, whole + 1
        ranges, local = [], 0
        for n, block in enumerate(blocks):
            late = left = 0
            for piece, places in block:
                if not piece:
                    left += places
                elif left:
                    left, local = left - 1, local + 1
                else:
                    late += 1
            ranges.append((n, late, left))
        shares, free, none, missed = bestfit._hand_over(ranges)
        assert local + sum(s[4] for s in shares) == whole
        assert missed == sum(1 for piece, _ in events if piece) - whole
        assert sum(f for _, f in free) == stack
        assert len(shares) <= 2 * len(ranges)


def test_best_fit_of_nothing_and_of_wrong_lengths(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bestfit.pack_documents(empty, FILE).collect() == []
    for wrong in (0, 2049, None):
        with pytest.raises(ValueError):
            bestfit.best_fit(spark.createDataFrame([(1, wrong), (2, 5)], "id long, length long"))


# Conversation trie

TURNS = "conv_id long, turn long, role string, text string, depth string, node string"


def brute_trie(rows):
    told = {}
    for conv_id, turn, role, text, *_ in rows:
        if conv_id is not None:
            told.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    told = {c: [t[2:] for t in sorted(turns)] for c, turns in told.items()}
    members, ends = {}, {}
    for c, own in told.items():
        h = zlib.crc32(str(c).encode()) % 6
        made = told.get(c - int(math.fmod(c, 100)), [])[:h] + own[h:]
        for d in range(len(made) + 1):
            members.setdefault(tuple(made[:d]), []).append(c)
        ends.setdefault(tuple(made), []).append(c)
    below = {}
    for node in members:
        for d in range(len(node) + 1):
            below.setdefault(node[:d], []).append(node)
    children = {n: [m for m in below[n] if len(m) == len(n) + 1] for n in members}
    return sorted(
        (min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), sum(not children[b] for b in below[n]),
         sum((len(members[b]) - 1) * len(b[-1][1]) for b in below[n] if b), hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in members.items()
    )


def grown(spark, rows, **how):
    turns = spark.createDataFrame(rows, TURNS)
    made = trie.conversation_trie(trie.prefix_keys(trie.shared_heads(trie.numbered_turns(turns))), **how)
    return sorted(map(tuple, made.collect()))


def some_turns():
    rng = random.Random(6)
    rows = []
    for c in [*range(0, 30), *range(100, 140), 200, 201, 250, -7, -100, -150, 5_000, 5_003]:
        for turn in range(rng.randrange(1, 7)):
            rows.append((c, turn if rng.random() > 0.1 else None, rng.choice(["user", "assistant", None]), rng.choice([None, "", "hi", "é\U0001f600", "yes " * 4]), "clash", "clash"))
    rows += [(12, t, "user", f"turn {t % 3}", "", "") for t in range(60)]  # a long one
    rows += [(c, t, "user", "the same", "", "") for c in range(300, 340) for t in range(8)]  # copies
    rows += rows[:5] + [(None, 1, "user", "no conversation", "", "")]
    return rows


@pytest.mark.parametrize("how", [{}, {"rulers": 3, "local": 5}])
def test_trie_against_brute_force(spark, how, small_blocks):
    rows = some_turns()
    want = brute_trie(rows)
    assert grown(spark, rows, **how) == want
    assert any(w[3] > 30 for w in want)


def test_trie_of_one_very_long_text_and_of_nothing(spark):
    rows = [(0, 0, "user", "long " * 100_000, "", ""), (0, 1, "assistant", "short", "", "")]
    assert grown(spark, rows) == brute_trie(rows)
    assert grown(spark, []) == []
    assert grown(spark, [(None, 0, "user", "x", "", "")]) == []


def test_digests_in_strings_of_ids(spark):
    members = spark.createDataFrame([(1, 2, 3, i) for i in range(50, 0, -1)] + [(0, 0, 0, -5)], "depth long, x1 long, x2 long, conv_id long")
    got = {r["depth"]: r["ends_sha256"] for r in trie.member_digests(members, chunk_ids=7).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, range(1, 51))).encode()).hexdigest(), 0: hashlib.sha256(b"-5").hexdigest()}
