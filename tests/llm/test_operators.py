"""Every operator against a brute-force version on small data, and on odd rows and an empty table."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from framespark.llm import conversations, decontaminate, mixing, near_dups, pii, quality, resampling, rule_ensemble, sentence_spans, suffix_dedup, token_counts, token_ids, toxicity
from tests.conftest import SF
from tests.llm.conftest import words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def docs_of(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


@pytest.fixture(scope="module")
def sf(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()]


# ---------------------------------------------------------------- 1


def brute_removal(texts, length=50):
    first = {}
    out = {}
    for i, t in enumerate(texts):
        b = t.encode()
        gone = bytearray(len(b))
        keys = [b[j : j + length] for j in range(len(b) - length + 1)]
        for j, k in enumerate(keys):
            if first.get(k, i) < i:
                gone[j : j + length] = b"\1" * length
        for k in keys:
            first.setdefault(k, i)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())
    return out


def test_suffix_dedup_small_alphabets(spark):
    rng = random.Random(1)
    pool = ["".join(rng.choice("ab") for _ in range(rng.randrange(40, 200))) for _ in range(12)] + ["a" * 300, "ab" * 90, "é" * 120]
    texts = ["".join(rng.choice(pool)[rng.randrange(30) :] + rng.choice(["", "x", "yz"]) for _ in range(rng.randrange(5))) for _ in range(120)]
    got = by_id(suffix_dedup.remove_repeats(docs_of(spark, texts)))
    want = brute_removal(texts)
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == want
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.values())


def test_suffix_dedup_query(spark, sf):
    got = by_id(suffix_dedup.op1_suffix_dedup(spark, SF))
    want = brute_removal([t for _, t in sf])
    assert {k: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for k, r in got.items()} == want


def test_sort_suffixes():
    rng = np.random.default_rng(0)
    buf = rng.choice(np.frombuffer(b"ab", np.uint8), 3000)
    buf[500:900] = buf[1500:1900]
    start = np.arange(2900)
    order, group = suffix_dedup.sort_suffixes(buf, start)
    keys = [buf[s : s + 50].tobytes() for s in start]
    assert [keys[i] for i in order] == sorted(keys)
    assert [g for g in group] == np.unique([keys[i] for i in order], return_inverse=True)[1].tolist()


def test_sort_suffixes_deep_groups():
    # long common prefixes that branch late, in the same word twice, in the last bytes only, and not at all
    rng = np.random.default_rng(1)
    base = rng.integers(97, 100, 50).astype(np.uint8)
    rows = [base.copy() for _ in range(300)]
    for i, r in enumerate(rows):
        for at in rng.choice([16, 18, 23, 24, 31, 40, 42, 49], i % 4):
            r[at] = rng.integers(0, 256)
    buf = np.concatenate(rows)
    start = rng.permutation(np.arange(300) * 50)
    order, group = suffix_dedup.sort_suffixes(buf, start)
    keys = [buf[s : s + 50].tobytes() for s in start]
    assert [keys[i] for i in order] == sorted(keys) and sorted(order.tolist()) == list(range(300))
    assert group.tolist() == np.unique([keys[i] for i in order], return_inverse=True)[1].tolist()


def test_anchors_of_a_long_text_in_chunks(monkeypatch):
    rng = np.random.default_rng(2)
    data = rng.integers(97, 101, 9000).astype(np.uint8)
    off = np.array([0, 30, 30, 700, 9000])

    def windows(parts):
        doc, first, last, h = parts
        return [(d, w, int(x)) for d, a, z, x in zip(doc, first, last, h, strict=True) for w in range(a, z + 1)]

    whole = windows(suffix_dedup.anchors(data, off))
    monkeypatch.setattr(suffix_dedup, "CHUNK", 257)
    assert windows(suffix_dedup.anchors(data, off)) == whole


def test_suffix_dedup_odd(odd, nothing):
    got = suffix_dedup.remove_repeats(odd).collect()
    assert len(got) == odd.count()
    rows = {r.doc_id: r for r in got if r.doc_id is not None}
    assert rows[6].n_removed == rows[6].n_bytes and rows[5].n_removed == 0 and rows[1].n_bytes == 0 and rows[10].n_removed == 160
    assert all(r.n_removed == 0 for r in got if r.doc_id is None or r.doc_id == 7)
    assert suffix_dedup.remove_repeats(nothing).count() == 0


# ---------------------------------------------------------------- 2


def test_token_counts(spark, sf, odd, nothing):
    import public_tokenizers
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = token_counts.load_vocabulary(public_tokenizers.path(token_counts.MODEL))
    ref = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=True))
    ref.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    size = lambda t: len(ref.encode(t or "", add_special_tokens=False).ids)
    got = by_id(token_counts.op2_token_counts(spark, SF))
    assert {k: r.n_tokens for k, r in got.items()} == {k: size(t) for k, t in sf}
    rng = random.Random(3)
    texts = ["".join(rng.choice("abc é漢\n▁<0xA>🙂") for _ in range(rng.randrange(40))) for _ in range(400)]
    counter = token_counts.Counter(vocabulary)
    assert [counter.text(t) for t in texts] == [size(t) for t in texts]
    assert {r.n_tokens for r in token_counts.token_counts(odd).where("doc_id in (1, 2)").collect()} == {0}
    assert token_counts.token_counts(odd).count() == odd.count() and token_counts.token_counts(nothing).count() == 0


def test_token_counts_ties():
    from tokenizers import Tokenizer, models, pre_tokenizers

    vocabulary = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("ba", -2.0), ("abab", -4.0), ("▁", -1.0), ("▁a", -2.0), ("c", -3.0)]
    ref = Tokenizer(models.Unigram(vocabulary, unk_id=0, byte_fallback=False))
    ref.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=True)
    counter, rng = token_counts.Counter(vocabulary), random.Random(4)
    for _ in range(2000):
        t = "".join(rng.choice("abcd ") for _ in range(rng.randrange(1, 14)))
        assert counter.text(t) == len(ref.encode(t, add_special_tokens=False).ids), t


# ---------------------------------------------------------------- 3


def shingles(t):
    w = WORD.findall(t or "")
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def jaccard(a, b):
    both = sum((a & b).values())
    return both / (sum(a.values()) + sum(b.values()) - both) if a and b else 0.0


def brute_classes(texts):
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    s = [shingles(t) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or jaccard(s[i], s[j]) >= 0.8:
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in range(len(texts))}


def family(rng, n, size, most):
    base = [f"w{rng.randrange(300)}" for _ in range(size)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(most)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("block", [8, 1])
def test_near_duplicates(spark, monkeypatch, block):
    """Families of many blocks; with blocks of one document more lots are left than bands, so buckets settle them."""
    monkeypatch.setattr(near_dups, "BLOCK_DOCS", block)
    rng = random.Random(7)
    texts = family(rng, 40, 200, 12) + family(rng, 20, 60, 4) + family(rng, 45, 200, 20) + ["same same same same same same"] * 3 + ["a b c", "a b c", "a b d", "", None, "q"] + [" ".join(f"u{rng.randrange(10**6)}" for _ in range(50)) for _ in range(20)]
    got = by_id(near_dups.near_duplicates(docs_of(spark, texts)))
    assert {k: r.class_id for k, r in got.items()} == brute_classes(texts)


def test_near_duplicates_query(spark, sf):
    got = by_id(near_dups.op3_near_duplicates(spark, SF))
    assert {k: r.class_id for k, r in got.items()} == brute_classes([t for _, t in sf])


def test_bag_min_hash_is_unbiased():
    rng = np.random.default_rng(1)
    key = rng.integers(1, 2**44, 60).astype(np.uint64)
    w = rng.integers(1, 40, (2, 60))
    doc = np.repeat([0, 1], 60)
    sig = near_dups.bag_min_hash(doc, np.tile(key, 2), w.ravel(), 2, m=4000)
    true = np.minimum(*w).sum() / np.maximum(*w).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 4 * math.sqrt(true * (1 - true) / 4000)


def test_near_duplicates_odd(odd, nothing):
    got = by_id(near_dups.near_duplicates(odd))
    assert len(got) == 10 and got[6].class_id == 5 and got[2].class_id == 1 and got[9].class_id == 9 and got[10].class_id == 10
    kept = near_dups.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 3, 4, 5, 7, 9, 10, 11] and kept.where("doc_id is null").count() == 2
    assert near_dups.near_duplicates(nothing).count() == 0


# ---------------------------------------------------------------- 4


def brute_contamination(docs, bench):
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    out = set()
    for i, t in docs:
        w = tokens(t)
        for k, item in bench:
            b = tokens(item)
            n = min(16, len(b))
            if n < 5:
                continue
            for s in range(-len(b) + 1, len(w)):
                agree = [0 <= s + j < len(w) and w[s + j] == b[j] for j in range(len(b))]
                if any(sum(agree[x : x + n]) >= math.ceil(0.8 * n) for x in range(len(b) - n + 1)):
                    out.add((i, k))
                    break
    return out


def test_decontaminate(spark, odd, nothing):
    rng = random.Random(9)
    items = [" ".join(f"b{rng.randrange(500)}" for _ in range(n)) for n in (3, 5, 9, 15, 16, 20, 40)] + [None, ""]
    docs = []
    for i in range(60):
        w = [f"w{rng.randrange(500)}" for _ in range(40)]
        item = items[i % 7].split()
        for _ in range(i % 4):
            item[rng.randrange(len(item))] = "zz"
        part = item[: len(item) // 2] if i % 9 == 8 else item
        docs.append((i, " ".join(w[:20]).upper() + ", " + " ".join(part) + ". " + " ".join(w[20:])))
    bench = spark.createDataFrame([*enumerate(items), (None, items[5])], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(df, bench).collect()}
    # four of five tokens leave no mask of five whole, so the item of five is found only when it is unchanged
    assert {x for x in got if x[1] != 1} == {x for x in brute_contamination(docs, list(enumerate(items))) if x[1] != 1}
    assert {i for i, k in got if k == 1} == {i for i in range(1, 60, 7) if i % 4 == 0 and i % 9 != 8}
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.contaminated(nothing, bench).count() == 0
    clean = decontaminate.clean_documents(odd, bench)
    assert clean.count() == odd.count() and clean.columns == odd.columns
    assert decontaminate.contaminated(df, nothing.selectExpr("doc_id as item_id", "text")).count() == 0


def test_decontaminate_long_repetitive_text(spark):
    docs = spark.createDataFrame([(1, "w " * 1_000_000), (2, "x y")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "w " * 12), (2, "w v " * 6)], "item_id long, text string")
    assert [tuple(r) for r in decontaminate.contaminated(docs, bench).collect()] == [(1, 1, 0, 12, 12)]


# ---------------------------------------------------------------- 5


def test_mixing(spark, odd, nothing):
    for rows in (mixing.op5_mixing(spark, SF).collect(), mixing.mixed_sizes(odd).collect()):
        size, taken, target = Counter(), Counter(), {}
        for r in rows:
            size[r.source] += r.size
            taken[r.source] += r.taken
            target[r.source] = r.target
            assert 0 <= r.taken <= 3 * r.size
        names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
        weight, free, goal, rest = {s: 1 + i % 3 for i, s in enumerate(names)}, set(names), {}, sum(size.values())
        while free:
            over = [s for s in free if rest * weight[s] / sum(weight[x] for x in free) > 3 * size[s]]
            if not over:
                goal |= {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
                break
            for s in over:
                goal[s] = 3.0 * size[s]
                free.discard(s)
            rest = sum(size.values()) - sum(goal.values())
        for s in names:
            assert abs(target[s] - goal[s]) < 1e-6 * sum(size.values()) and abs(taken[s] - target[s]) <= 1
    again = sorted(map(tuple, mixing.op5_mixing(spark, SF).collect()))
    assert again == sorted(map(tuple, mixing.op5_mixing(spark, SF).collect()))
    assert mixing.mixed_sizes(nothing).count() == 0
    out = mixing.mixed_documents(odd)
    assert out.columns == odd.columns and mixing.mixed_documents(nothing).count() == 0
    words = sum(len(WORD.findall(r.text)) for r in out.collect())
    # rows that repeat doc_id and text are one document, taken as often as both
    assert words == sum(r.taken for r in mixing.mixed_sizes(odd).collect())


def test_schedule_is_even(spark):
    t = mixing.source_targets(mixing.sized(spark.read.parquet(f"{SF}/documents.parquet")))
    total = t.first().total
    share = {r.source: r.hi - r.lo for r in t.collect()}
    n = -(-total // mixing.block_words(total))
    slots = sorted((r.slot, r.source) for r in mixing.schedule(t, total).collect() if r.slot < n)
    seen = Counter()
    for i, (_, s) in enumerate(slots, 1):
        seen[s] += 1
        if i % 50 == 0:
            assert all(abs(seen[k] - i * share[k]) < 6 for k in share)


def test_mix_follows_the_schedule(spark):
    """Documents stand in order of their slots, so any long part of the mix holds each source in nearly its share."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.op5_mixing(spark, SF).collect()
    assert all((r.first_slot is None) == (r.taken == 0) and (r.taken == 0 or r.first_slot <= r.last_slot) for r in rows)
    total = sum(r.size for r in rows)
    share = {r.source: r.target / total for r in rows}
    seen, n = Counter(), 0
    for r in mixing.mixed_documents(docs).collect():
        k = len(WORD.findall(r.text))
        seen[r.source] += k
        n += k
        if n > total / 4:
            assert all(abs(seen[s] / n - x) < 0.1 for s, x in share.items())
    assert n == sum(r.taken for r in rows)


# ---------------------------------------------------------------- 6


def brute_spans(texts, marks=".!?,;:", runs=None):
    runs = runs or {3: 15, 2: 20}
    parts = {}
    for i, t in enumerate(texts):
        m = list(WORD.finditer(t))
        first = [j for j in range(len(m)) if j == 0 or m[j - 1].group()[-1] in marks or "\n" in t[m[j - 1].end() : m[j].start()]]
        ends = [*first[1:], len(m)]
        sent = [tuple(x.group() for x in m[a:b]) for a, b in zip(first, ends, strict=True)]
        place = [0 if k == 0 else m[a].start() for k, a in enumerate(first)] + [len(t)]
        parts[i] = (sent, place)
    count, least = Counter(), {}
    every = {i: [(j, k, tuple(s[j : j + k])) for k, words in runs.items() for j in range(len(s) - k + 1) if sum(map(len, s[j : j + k])) >= words] for i, (s, _) in parts.items()}
    for i, found in every.items():
        for j, _, run in found:
            count[run] += 1
            least.setdefault(run, (i, j))
    out = {}
    for i, (s, p) in parts.items():
        gone = {x for j, k, run in every[i] for x in range(j, j + k) if count[run] > 1 and least[run] != (i, j)}
        out[i] = (len(s), len(gone), "".join(texts[i][p[k] : p[k + 1]] for k in range(len(s)) if k not in gone) if s else texts[i])
    return out


def test_sentence_spans(spark, sf, odd, nothing):
    got = by_id(sentence_spans.op6_sentence_spans(spark, SF))
    assert {k: (r.n_pieces, r.n_removed, r.text) for k, r in got.items()} == brute_spans([t for _, t in sf])
    got = by_id(sentence_spans.remove_repeated_spans(spark.read.parquet(f"{SF}/documents.parquet"), marks=".!?", runs={3: 10}))
    assert {k: (r.n_pieces, r.n_removed, r.text) for k, r in got.items()} == brute_spans([t for _, t in sf], ".!?", {3: 10})
    rows = sentence_spans.remove_repeated_spans(odd).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id}
    assert by[6].n_removed == by[6].n_pieces == 900 and by[5].n_removed == 0 and by[1].text == "" and by[3].text == " \n\t "
    assert sentence_spans.remove_repeated_spans(nothing).count() == 0


def test_passages_cut_inside_sentences(spark):
    """Passages of 51 to 100 words, cut and put in anywhere: nine in ten lose words, and other documents none."""
    rng = random.Random(6)

    def prose(n):
        out = []
        while n > 0:
            k = min(n, rng.choice([3, 6, 6, 10, 15, 30]))
            n -= k
            out.append(" ".join(f"w{rng.randrange(10**5)}" for _ in range(k)) + rng.choice(".,.!;"))
        return " ".join(out)

    texts, planted = [], []
    for i in range(300):
        words = prose(200).split()
        if i % 3:
            at = rng.randrange(200)
            if i % 3 == 1:
                passage = prose(150).split()[(k := rng.randrange(40)) : k + rng.randrange(51, 101)]
            else:
                planted.append(i)
            words[at:at] = passage
        texts.append(" ".join(words))
    got = by_id(sentence_spans.remove_repeated_spans(docs_of(spark, texts)))
    assert sum(got[i].n_removed > 0 for i in planted) >= 0.9 * len(planted)
    assert not any(got[i].n_removed for i in range(300) if i % 3 != 2)


# ---------------------------------------------------------------- 7


@pytest.mark.parametrize("frequent", [0, 7, 256])
def test_block_max_is_exact(monkeypatch, frequent):
    monkeypatch.setattr(toxicity, "DENSE", frequent)
    monkeypatch.setattr(toxicity, "BLOCK", 16)
    rng = np.random.default_rng(3)
    v, n = 40, 300
    dense = rng.random((n, v)) * (rng.random((n, v)) < 0.1)
    dense[5] = 0
    norm = np.linalg.norm(dense, axis=1, keepdims=True)
    dense = np.divide(dense, norm, where=norm > 0, out=np.zeros_like(dense)).astype(np.float32).astype(float)
    r, c = np.nonzero(dense)
    first = np.searchsorted(r, np.arange(n + 1))
    index = toxicity.BlockMaxIndex(first, c, dense[r, c], np.arange(n) % 2, np.arange(n), v)
    every = [(None, list(index.nearest(first, c, dense[r, c], 15))), (np.arange(n), list(index.nearest(first, c, dense[r, c], 15, np.arange(n))))]
    for without, got in every:
        for i, (ids, cos) in enumerate(got):
            want = dense @ dense[i]
            if without is not None:
                want[i] = 0
            least = np.sort(want)[::-1][14]
            near = np.flatnonzero(want >= least - 1e-9) if least > 1e-9 else np.flatnonzero(want > 1e-9)
            assert sorted(index.name[ids]) == near.tolist() and np.allclose(want[index.name[ids]], cos)


def test_scores_do_not_depend_on_ids(spark):
    """Many examples tie as the nearest of a text; all of them vote, whatever their ids."""
    rng = random.Random(8)
    texts = [f"{rng.choice(['mild', 'vile'])} {rng.choice('abc')}" for _ in range(200)]
    label = [int("vile" in t and rng.random() < 0.8) for t in texts]
    scores = []
    for ids in (list(range(200)), rng.sample(range(10**6), 200)):
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
        model = toxicity.fit(docs, spark.createDataFrame(list(zip(ids, label, strict=True)), "doc_id long, toxic int"))
        got = by_id(toxicity.toxicity(docs, model))
        scores.append([got[i].score for i in ids])
        assert all(got[i].evidence for i in ids)
    assert scores[0] == scores[1]


def test_toxicity(spark, odd, nothing):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(200)}" for _ in range(60)) + (" " + " ".join(rng.choice(["vile", "loweiza", "loweibe", "loweiqu"]) for _ in range(3)) if i % 5 == 0 else "") for i in range(600)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    got = by_id(toxicity.toxicity(docs, model))
    right = [got[i].predicted == (i % 5 == 0) for i in range(400, 600)]
    assert sum(right) >= 198 and all(0 <= r.score <= 1 for r in got.values())
    rows = toxicity.toxicity(odd, model).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows if not r.evidence}) == 1 and not any(r.predicted for r in rows)
    assert toxicity.toxicity(nothing, model).count() == 0
    assert toxicity.fit(docs, labels.where("toxic = 0")) is None and {r.score for r in toxicity.toxicity(docs, None).collect()} == {0.0}


def test_toxicity_held_out(spark):
    base = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{base}/documents.parquet"), spark.read.parquet(f"{base}/labels.parquet")
    scored = toxicity.op7_toxicity(spark, base).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.toxic for r in scored) / len(scored) > 0.95
    both = sum(r.predicted and r.toxic for r in scored)
    assert both / sum(r.toxic for r in scored) > 0.85 and both / sum(r.predicted for r in scored) > 0.9
    assert docs.count() == 10_000


# ---------------------------------------------------------------- 8


def brute_measures(t):
    w = WORD.findall(t or "")
    tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(inside)


def test_quality_rules(spark, sf, odd, nothing):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    got = by_id(quality.op8_quality_rules(spark, SF))
    for k, t in sf:
        r, m = got[k], brute_measures(t)
        assert tuple(r[n] for n in names) == m
        assert r.base_failed == (m[0] < 50 or 100 * m[4] > 50 * m[0]) and not (r.kept and r.base_failed)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    good = [got[k] for k, q in labels.items() if q == 1 and not got[k].base_failed]
    assert all(r.kept for r in good)
    rows = quality.quality_rules(odd).collect()
    assert len(rows) == odd.count() and not any(r.kept for r in rows if r.n_words < 50)
    texts = {r.doc_id: r.text for r in odd.collect()}
    assert all(tuple(r[n] for n in names) == brute_measures(texts[r.doc_id]) for r in rows if r.doc_id)
    kept = quality.kept_documents(odd)
    assert kept.columns == odd.columns and kept.count() == sum(r.kept for r in rows)
    assert quality.quality_rules(nothing).count() == 0 and quality.kept_documents(nothing).count() == 0


def test_quality_verdicts_are_the_same_in_reruns(spark):
    first = sorted(map(str, quality.op8_quality_rules(spark, SF).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = sorted(map(str, quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet").repartition(7)).select("doc_id", "kept").collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    kept = sorted(map(str, quality.op8_quality_rules(spark, SF).select("doc_id", "kept").collect()))
    assert kept == again and first == sorted(map(str, quality.op8_quality_rules(spark, SF).collect()))


def test_quality_verdicts_follow_the_sketch(spark, monkeypatch):
    """On the test table another multiple of the ranges in the sketches gives other verdicts."""
    kept = []
    for multiple in (0.0, 2.0, 8.0, 1e6):
        monkeypatch.setattr(quality, "MULTIPLE", multiple)
        kept.append(quality.op8_quality_rules(spark, "/root/testdata/sf0.01").where("kept").count())
    assert kept[0] < kept[1] < kept[2] < kept[3]


def test_quality_fences_follow_the_group(spark):
    """Groups of 100 rows whose usual values differ: an equal ratio is far out in one and usual in the other."""
    usual = {"a": (500, 0, 0, 0), "b": (900, 90, 20, 40)}
    rows = []
    for source, (chars, symbols, lines, repeats) in usual.items():
        for i in range(100):
            j = i % 5
            rows.append((source, "usual", 100, chars + 4 * j, symbols and symbols + j, lines and lines + j, repeats and repeats + j))
        if source == "a":  # repeats are rare here, and small
            rows += [(source, "usual", 100, 500, 0, 1, 3)] * 30
    probes = {"symbol_ratio_high": (500, 20, 0, 0), "dup_line_ratio_high": (500, 0, 9, 0), "repeat_ratio_high": (500, 0, 0, 20), "word_length_high": (880, 0, 0, 0)}
    for name, (chars, symbols, lines, repeats) in probes.items():
        rows.append(("a", name, 100, chars, symbols, lines, repeats))
        rows.append(("b", name, 100, 900, 36 if symbols else 0, lines, repeats))
    got = quality.judge(spark.createDataFrame([("en", *r) for r in rows], "lang string, source string, kind string, " + quality.MEASURES))
    by = {(r.source, r.kind, tuple(r.reasons)) for r in got.collect()}
    assert by == {*((s, "usual", ()) for s in "ab"), *(("a", k, (k,)) for k in probes), *(("b", k, ()) for k in probes)}


# ---------------------------------------------------------------- 9


def reference_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path(token_ids.TOKENIZER))
    return [[*e.ids, 1] for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_ids(spark, sf, odd, nothing, tmp_path, monkeypatch):
    got = by_id(token_ids.op9_token_ids(spark, SF))
    start = 0
    for (k, _), ids in zip(sf, reference_ids([t for _, t in sf]), strict=True):
        assert (got[k].start, got[k].n_tokens, got[k].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    rows = token_ids.encoded_documents(odd).collect()
    assert len(rows) == odd.count() and sorted(r.n_tokens for r in rows)[:4] == [1, 1, 1, 1]
    assert token_ids.encoded_documents(nothing).count() == 0
    table = token_ids.write_shards(spark.read.parquet(f"{SF}/documents.parquet"), str(tmp_path / "shards"), 3)
    want = sorted((k, p) for (k, _), ids in zip(sf, reference_ids([t for _, t in sf]), strict=True) for p, x in enumerate(ids) if x == 530)
    assert sorted((r.doc_id, r.position) for r in token_ids.occurrences(table, 530).collect()) == want


def test_encoder_on_odd_characters():
    import public_tokenizers

    rng = random.Random(2)
    pools = ("abZQ éÉßñÑ×÷Üÿ'\n\t. ,|<>09-日İΣ́\x1c s", "abZQ éÉßñÑÜÿÞ×.,-09")
    texts = ["", None, "<|endoftext|>", "a<|endoftext|>b c", "it's", "ÀÈ ÿŸ ẞ"] + ["".join(rng.choice(pools[i % 2]) for _ in range(rng.randrange(30))) for i in range(3000)]
    ids, size = token_ids.Encoder(public_tokenizers.path(token_ids.TOKENIZER)).encode(pa.array(texts))
    ends = np.cumsum(size)
    assert [ids[e - n : e].tolist() for e, n in zip(ends, size, strict=True)] == reference_ids(texts)


def test_wavelet_matrix():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 513, 3000):
        ids = rng.integers(0, 50_000, n).astype(np.uint16)
        ids[::3] = 7
        m = token_ids.WaveletMatrix.build(ids, 16)
        assert (m.decode() == ids).all() and (m.access(np.arange(n)) == ids).all()
        assert (m.select(7) == np.flatnonzero(ids == 7)).all() and m.rank(7, n // 2) == (ids[: n // 2] == 7).sum() and len(m.select(60_000)) == 0


# ---------------------------------------------------------------- 10


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(d)) % 10 == 0


KEY = "k"


def plain_feistel(v, mod, kind, key=KEY):
    h = len(v) // 2
    left, right, ml, mr = list(v[:h]), list(v[h:]), list(mod[:h]), list(mod[h:])
    for r in range(pii.ROUNDS):
        other = ",".join(map(str, right))
        h, w = hashlib.sha512(f"{key}|{kind}|{r}|{other}".encode()).hexdigest(), 8 if len(left) <= 16 else 4
        f = [int(h[i * w : i * w + w], 16) for i in range(len(left))]
        left, right, ml, mr = right, [(a + b) % m for a, b, m in zip(left, f, ml, strict=True)], mr, ml
    return left + right


def test_pseudonyms(spark, odd, nothing):
    rng = random.Random(1)

    def card():
        d = "4" + "".join(rng.choice("0123456789") for _ in range(14))
        return next(d + c for c in "0123456789" if luhn(d + c))

    cards = list(dict.fromkeys(card() for _ in range(60)))
    texts = [f"pay {c} now" for c in cards] + [f"again {c[:4]} {c[4:8]} {c[8:12]} {c[12:]}." for c in cards]
    rows = by_id(pii.pseudonymise(docs_of(spark, texts), KEY))
    n = len(cards)
    new = [re.search(r"\d{16}", rows[i].text).group() for i in range(n)]
    for i, c in enumerate(cards):
        d = [int(x) for x in c]
        body = plain_feistel(d[1:15], [10] * 14, "card")
        assert new[i][:15] == "4" + "".join(map(str, body)) and luhn(new[i])
        assert re.sub(" ", "", rows[n + i].text[6:-1]) == new[i], "equal values stay linked whatever their separators"
    assert len(set(new)) == n
    cases = {
        "on 2024-02-29": r"on (19|20)\d\d-\d\d-\d\d", "on 31/12/1999": r"on \d\d/\d\d/(19|20)\d\d", "ssn 123-45-6789": r"ssn \d{3}-\d{2}-\d{4}", "ip 78.241.210.149.": r"ip (\d{1,3}\.){3}\d{1,3}\.",
        "call +1 (329) 555-9184!": r"call \+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}!", "to ab.04@mail0.example.com": r"to [a-z]{2}\.\d\d@mail0\.example\.com", "GB82 WEST 1234 5698 7654 32": r"GB\d\d [A-Z]{4} \d{4} \d{4} \d{4} \d\d",
    }
    same = ["on 2023-02-30", "no 4740338827908239", "v 999.1.1.1", "000-12-3456", "plain", "", None]
    got = [r.text for r in pii.pseudonymise(docs_of(spark, [*cases, *same]), KEY).orderBy("doc_id").collect()]
    for (old, form), text in zip(cases.items(), got, strict=False):
        assert re.fullmatch(form, text) and text != old, (old, text)
    assert got[len(cases) :] == same
    out = pii.pseudonymise(odd, KEY)
    assert out.count() == odd.count() and {r.n_pii for r in out.collect()} == {0} and pii.pseudonymise(nothing, KEY).count() == 0
    assert [r.text for r in out.where("doc_id < 7").orderBy("doc_id").collect()] == [r.text for r in odd.where("doc_id < 7").orderBy("doc_id").collect()]


def test_feistel_is_a_permutation(spark):
    from pyspark.sql import functions as F

    df = spark.range(200 * 365).select(F.array((F.col("id") / 365).cast("long"), F.col("id") % 365).alias("v"))
    moved = df.select(pii.feistel(F.col("v"), F.array(F.lit(200).cast("long"), F.lit(365).cast("long")), "date", "k").alias("w"))
    assert moved.distinct().count() == 200 * 365


def test_dates_keep_apart(spark):
    """Dates of all three forms: pseudonyms are valid, of the same form, and no two dates of a form share one."""
    import datetime

    days = [datetime.date(1900, 1, 1) + datetime.timedelta(i) for i in range(0, 73049, 37)] + [datetime.date(y, 2, 29) for y in range(1904, 2100, 4)]
    days = sorted(set(days))
    forms = {"%Y-%m-%d": days, "%d/%m/%Y": days, "%m/%d/%Y": [d for d in days if d.day > 12]}
    for form, some in forms.items():
        got = [r.text for r in pii.pseudonymise(docs_of(spark, [d.strftime(form) for d in some]), KEY).orderBy("doc_id").collect()]
        assert len(set(got)) == len(some) and all(datetime.datetime.strptime(t, form).strftime(form) == t and t.count("/") in (0, 2) for t in got)
        moved = [datetime.datetime.strptime(t, form) for t in got]
        assert all(1900 <= d.year < 2100 for d in moved) and (form != "%m/%d/%Y" or all(d.day > 12 for d in moved))
    odd_ones = ["2100-01-01", "1900-02-29", "29/02/2023", "13/13/2020", "00/01/2020", "2020-04-31"]
    assert [r.text for r in pii.pseudonymise(docs_of(spark, odd_ones), KEY).orderBy("doc_id").collect()] == odd_ones
    with pytest.raises(ValueError):
        pii.pseudonymise(docs_of(spark, odd_ones), "")


def test_long_texts_of_marks(spark):
    long = ["a@b" + ".c" * 50_000, "a." * 60_000, "GB82WEST" * 12_000, "GB82 WEST " * 9_000, "1" * 200_000, "1.2." * 50_000, "+1 " * 60_000, "12/" * 60_000, "a" * 100_000 + "@b.c", "4111-" * 40_000]
    got = [r.text for r in pii.pseudonymise(docs_of(spark, long), KEY).orderBy("doc_id").collect()]
    assert [len(t) for t in got] == [len(t) for t in long] and got[1:7] == long[1:7] and re.fullmatch(r"[a-z]@b(\.c){50000}", got[0])


# ---------------------------------------------------------------- 11


def brute_resampling(docs, bench, percent=25, least=20):
    fold = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def features(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(fold))
        return len(w), [zlib.crc32(x.encode()) % 10000 for x in w + [f"{a} {b}" for a, b in zip(w, w[1:], strict=False)]]

    s, t = (Counter(b for x in texts for b in features(x)[1]) for texts in ([x for _, x in docs], bench))
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10000) / ((s[b] + 1) * (t.total() + 10000)))) for b in range(10000)]
    out = {}
    for i, text in docs:
        n, f = features(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{i}".encode()).hexdigest()[:8], 16)
        out[i] = [n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((i for i, r in out.items() if r[0] >= least), key=lambda i: (-out[i][3], i))
    for r, i in enumerate(able[: percent * len(able) // 100]):
        out[i][4] = r + 1
    return {i: tuple(r) for i, r in out.items()}


def test_importance_resampling(spark, sf, odd, nothing, monkeypatch):
    bench = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = by_id(resampling.op11_importance_resampling(spark, SF))
    names = ("n_words", "n_features", "weight", "score", "rank")
    assert {k: tuple(r[n] for n in names) for k, r in got.items()} == brute_resampling(sf, bench)
    rows = resampling.importance_ranks(odd, spark.createDataFrame([(None,), ("",)], "text string")).collect()
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id is not None}
    want = brute_resampling(list(texts.items()), [])
    assert len(rows) == odd.count() and all(r.n_features == want[r.doc_id][1] for r in rows if r.doc_id is not None)
    assert sorted(r["rank"] for r in rows if r["rank"]) == list(range(1, sum(r.n_words >= 20 for r in rows) * 25 // 100 + 1))
    assert resampling.importance_ranks(nothing, odd).count() == 0 and resampling.importance_ranks(odd, nothing).count() == len(rows)
    drawn = resampling.resampled_documents(odd.where("doc_id < 7"), odd, percent=50)
    assert drawn.columns == odd.columns and drawn.count() == 1


def test_features_of_long_texts_in_pieces(monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choice("abÀé Z.9\n") for _ in range(3000)) + "x" * 500
    whole = resampling.count_features(text)
    monkeypatch.setattr(resampling, "PIECE", 7)
    pieces = resampling.count_features(text)
    assert whole[0] == pieces[0] and (whole[1] == pieces[1]).all()


def test_bit_planes_are_exact():
    rng = np.random.default_rng(4)
    for low, high in ((-9000, 9000), (0, 1), (-1, 0), (5, 6), (-4096, 4096)):
        gain = rng.integers(low, high, resampling.BUCKETS)
        counts = rng.integers(0, 5, resampling.BUCKETS) * (rng.random(resampling.BUCKETS) < 0.1)
        counts[7] = 1_000_003
        assert resampling.GainPlanes(gain).total(counts) == int(gain @ counts)


# ---------------------------------------------------------------- 12


def test_rule_ensemble(spark, odd, nothing):
    base = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{base}/labels.parquet")
    scored = rule_ensemble.op12_quality_classifier(spark, base).join(labels, "doc_id").where("held_out").collect()
    bad = [r for r in scored if r.quality == 0]
    assert sum(r.predicted == 0 for r in bad) / len(bad) > 0.97 and sum(r.predicted for r in scored if r.quality) / (len(scored) - len(bad)) > 0.99
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in scored)


def test_rules_are_compiled_and_repeatable(spark, odd, nothing):
    rng = random.Random(8)
    texts = [words(rng, 60) + (" ##" * 20 if i % 4 == 0 else "") for i in range(400)]
    docs = docs_of(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(300)] + [(None, 1), (999, 0), (5, None)], "doc_id long, quality int")
    model = rule_ensemble.fit(docs, labels)
    assert model.weights and len(model.weights) < 100
    assert model == rule_ensemble.fit(docs.repartition(5), labels.repartition(3))
    got = by_id(rule_ensemble.classify(docs, model))
    stats = {r.doc_id: r for r in rule_ensemble.statistics(docs, ("doc_id",)).collect()}
    for i in range(300, 400):
        hold = lambda rule: all((o is None or stats[i][s] > o) and (u is None or stats[i][s] <= u) for s, o, u in rule.bounds)
        total = model.intercept + sum(w for rule, w in model.weights if hold(rule))
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-total))) and got[i].predicted == (i % 4 != 0)
    rows = rule_ensemble.classify(odd, model).collect()
    assert len(rows) == odd.count() and len({r.score for r in rows if r.doc_id in (1, 2)}) == 1
    assert rule_ensemble.classify(nothing, model).count() == 0
    for kind, score in ((0, 0.0), (1, 1.0), (7, 0.0)):
        only = rule_ensemble.fit(docs, labels.where(f"quality = {kind}"))
        assert {r.score for r in rule_ensemble.classify(docs, only).collect()} == {score}


def test_statistics(spark):
    text = "One two TWO two.\nOne two 3 !!\nOne two 3 !!\n"
    r = rule_ensemble.statistics(docs_of(spark, [text, "", None])).collect()
    assert (r[0].n_words, r[0].longest_word, r[0].top_word_ratio * 12, r[0].line_words) == (12, 4, pytest.approx(3), 3)
    assert r[0].upper_ratio == pytest.approx(6 / 31) and r[0].digit_ratio == pytest.approx(2 / 31) and r[0].distinct_ratio == pytest.approx(6 / 12)
    assert r[1] == r[2] and set(r[1]) == {0.0}


# ---------------------------------------------------------------- 13


def brute_repair(initials, forced, cuts):
    """Least (cost, audit) by extending every state of the grammar turn by turn."""
    after = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}

    def insert(best):
        todo = list(best)
        while todo:
            p = todo.pop()
            new = (best[p][0] + 3, best[p][1] + "I")
            if new < best.get(after[p][0], (10**9, "")):
                best[after[p][0]] = new
                todo.append(after[p][0])
        return best

    best = insert({0: (0, "")})
    for c, f, t in zip(initials, forced, cuts, strict=True):
        ways = []
        for p, (k, a) in best.items():
            ways.append((p, (k + 4, a + "D")))
            if not f:
                q, e = after[p]
                ways.append((q, (k + 3 * t + 3 * (c != e), a + "RK"[c == e])))
                if p == 0 and c == "s":
                    ways.append((1, (k + 3 * t, a + "K")))
        best = {}
        for p, v in ways:
            best[p] = min(v, best.get(p, v))
        best = insert(best)
    return min(best[p] for p in (0, 3) if p in best)


def test_alignment_is_the_cheapest_and_least():
    rng = random.Random(1)
    for _ in range(3000):
        n = rng.randrange(0, 12)
        wild = rng.random()
        initials = [rng.choice(["s", "u", "a", "", "t"]) if rng.random() < wild else "ua"[i % 2] for i in range(n)]
        forced = np.array([rng.random() < 0.2 for _ in range(n)], bool)
        cuts = np.array([not f and rng.random() < 0.2 for f in forced], bool)
        assert conversations._align(initials, forced, cuts) == brute_repair(initials, forced, cuts)
    initials = [rng.choice("ua") if rng.random() < 0.2 else "ua"[i % 2] for i in range(400) if rng.random() > 0.05]
    forced = np.array([rng.random() < 0.1 for _ in initials], bool)
    assert conversations.align(initials, forced, forced & False) == brute_repair(initials, forced, forced & False)


def brute_conversations(rows):
    blank = lambda x: " " if x is None else str(x)
    out = {}
    for conv in {r[0] for r in rows}:
        mine = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            kind = zlib.crc32(f"{blank(conv)}:{blank(turn)}".encode()) % 20
            role, text = "user" if kind == 4 else blank(role), "" if kind == 1 else re.sub("[.!?]", "", blank(text)) if kind == 2 else blank(text)
            mine += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        mine.sort(key=lambda r: (r[0] is not None, r[0], r[1].encode(), r[2].encode()))
        faults, seen = [], set()
        for _, role, text in mine:
            body = WORD.sub("x", text)
            last = [c for c in text if c not in " \t\n\x0b\x0c\r"][-1:]
            faults.append("blank" if "x" not in body else "duplicate" if (role, text) in seen else "" if last[0] in ".!?" else "truncated")
            seen.add((role, text))
        turns = [t for t, _, _ in mine if t is not None]
        initials = [r[1][:1] for r in mine]
        cost, audit = brute_repair(initials, [f in ("blank", "duplicate") for f in faults], [f == "truncated" for f in faults])
        size = sum(op != "D" for op in audit)
        target = "s" * (size % 2) + "ua" * (size // 2)
        left, result, names = iter(mine), [], {"u": "user", "a": "assistant", "s": "system"}
        for op in audit:
            row = next(left) if op != "I" else (None, "", "")
            if op != "D":
                result.append((row[1] if op == "K" else names[target[len(result)]]) + ":" + row[2])
        counts = [faults.count(f) for f in ("blank", "duplicate", "truncated")]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(result).encode()).hexdigest())
    return out


def reports(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


def test_conversation_repair(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet")
    assert reports(conversations.op13_conversation_repair(spark, SF)) == brute_conversations([tuple(r) for r in table.collect()])


CONVERSATION = "conv_id long, turn long, role string, text string, there boolean, kind int"


def odd_turns():
    rng = random.Random(6)
    pick = lambda *x: rng.choice(x)
    rows = [(pick(None, *range(40)), pick(None, 0, 1, 2, 3, 2**40), pick("user", "assistant", "system", "", "tool", None), pick(None, "", " \n", "Hi.", "Hi", "é!", "Yes? ", "a" * 9000)) for _ in range(400)]
    return rows + [(100, t, "user", "w" * t) for t in range(60)]


def test_long_conversations_in_segments(spark, monkeypatch):
    rows = odd_turns() + [(7, t % 50, "assistant" if t % 2 else "user", f"{t % 9}.") for t in range(120)]
    rng = random.Random(4)
    rows += [(8, t, rng.choice(["user", "assistant", "system"]) if t % 6 == 0 else "assistant" if t % 2 else "user", rng.choice(["ok", f"{t}."])) for t in range(90)]
    table = conversations.damaged(spark.createDataFrame([(*r, True, 3) for r in rows], CONVERSATION))
    want = brute_conversations(rows)
    whole = sorted(map(repr, conversations.repaired_turns(table).collect()))
    for turns, segment in ((30, 7), (2, 1), (5, 16)):
        monkeypatch.setattr(conversations, "LONG_TURNS", turns)
        monkeypatch.setattr(conversations, "SEGMENT", segment)
        assert reports(conversations.repair_reports(table)) == want
    assert sorted(map(repr, conversations.repaired_turns(table).collect())) == whole


def test_conversation_repair_odd(spark):
    rows = odd_turns()
    table = spark.createDataFrame([(*r, True, 3) for r in rows], CONVERSATION)
    want = brute_conversations(rows)
    assert reports(conversations.repair_reports(conversations.damaged(table))) == want
    assert conversations.repair_reports(table.limit(0)).count() == 0
    gone = conversations.repair_reports(table.limit(1).selectExpr("5L conv_id", "turn", "role", "text", "false there")).collect()
    assert [tuple(r) for r in gone] == [(5, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    turns = {}
    for r in conversations.repaired_turns(conversations.damaged(table)).orderBy("conv_id", "turn").collect():
        turns.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(turns.get(c, [])).encode()).hexdigest() for c in want} == {c: w[-1] for c, w in want.items()}


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    columns = docs.columns
    kept = {}
    for name, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == columns
        kept[name] = [(r.doc_id, r.text) for r in docs.collect()]
    verdict = {r.doc_id for r in quality.op8_quality_rules(spark, SF).where("kept").collect()}
    assert {k for k, _ in kept["quality"]} == verdict
    ids = sorted(verdict)
    classes = brute_classes([rows[k].text for k in ids])
    assert sorted(k for k, _ in kept["near_dups"]) == [k for i, k in enumerate(ids) if classes[i] == i]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {k for k, _ in brute_contamination(kept["near_dups"], bench)}
    assert sorted(k for k, _ in kept["decontaminate"]) == sorted({k for k, _ in kept["near_dups"]} - bad)
    mixed = Counter(k for k, _ in kept["mixing"])
    assert max(mixed.values()) <= 3 and set(mixed) <= {k for k, _ in kept["decontaminate"]}
    out = p.run(spark, SF).collect()
    want = {(k, len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for (k, _), i in zip(kept["mixing"], reference_ids([t for _, t in kept["mixing"]]), strict=True)}
    assert len(out) == len(kept["mixing"]) and {(r.doc_id, r.n_tokens, r.ids_crc32) for r in out} == want
