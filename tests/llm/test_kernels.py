"""The numpy kernels against plain Python."""

import random
import string
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sedimenta.llm import decontam, exact, linedup, mixing, neardup, pretokens, quality, rans, repeats, words
from sedimenta.llm.suffixes import suffix_array


def plain_words(text):
    """Words by the documented rule, without numpy."""
    gone = {c for c in map(chr, range(128)) if not c.isalnum() and c not in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "}
    out = []
    for chunk in "".join(" " if c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f " else c for c in text.lower()).split(" "):
        word = "".join(c for c in chunk if c not in gone)
        if word:
            out.append(word)
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab Zé.,\n\t-世", max_size=30)), min_size=1, max_size=6))
def test_words_are_those_of_the_rule(texts):
    h, offsets = words.words_of(pa.array(texts, pa.string()))
    plain = [plain_words(t or "") for t in texts]
    assert np.diff(offsets).tolist() == [len(p) for p in plain]
    flat = [w for p in plain for w in p]
    assert len(set(zip(flat, h.tolist()))) == len(set(flat)) == len(set(h.tolist()))


def test_grams_do_not_cross_rows_and_short_rows_are_one_gram():
    h, offsets = words.words_of(pa.array(["a b c d", "", "a b", None, "b c d"]))
    values, owner = words.grams_of(h, offsets, 3)
    assert sorted(owner.tolist()) == [0, 0, 2, 4]
    by = {(o, i): v for i, (o, v) in enumerate(zip(owner, values))}
    assert len({v for (o, _), v in by.items() if o in (0, 4)}) == 2


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab1é \n\t.'s 　-", max_size=24)), min_size=1, max_size=5))
def test_pretokens_encode_as_the_library_does(texts):
    enc = pretokens.worker_encoding(pretokens.TOKENIZERS, pretokens.VOCABULARY)
    ids, offsets = pretokens.worker_tokenizer().encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [enc.encode_ordinary(t) if t else [] for t in texts]


def test_a_full_cache_is_emptied_without_changing_results():
    enc = pretokens.worker_encoding(pretokens.TOKENIZERS, pretokens.VOCABULARY)
    small = pretokens.PreTokenizer(enc, bits=6)
    r = random.Random(3)
    for _ in range(20):
        texts = [" ".join("".join(r.choices(string.ascii_lowercase, k=3)) for _ in range(20)) for _ in range(3)]
        ids, offsets = small.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == [enc.encode_ordinary(t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_suffix_array_is_sorted(text):
    assert suffix_array(np.array(text, np.int64)).tolist() == sorted(range(len(text)), key=lambda i: text[i:])


def test_rans_round_trip_and_checkpoints():
    r = np.random.default_rng(1)
    tokens = (r.zipf(1.4, (3, 32 * 700)) % 500).astype(np.uint16)
    freq = rans.quantise(np.bincount(tokens.ravel(), minlength=rans.SYMBOLS))
    assert freq.sum() == 1 << rans.SCALE_BITS and (freq[np.unique(tokens)] > 0).all()
    for row, (payload, marks) in zip(tokens, rans.encode_blocks(tokens, freq)):
        assert (rans.decode_block(payload, marks, len(row), freq) == row).all()
        entropy = -np.log2(freq[row] / (1 << rans.SCALE_BITS)).sum() / 8
        assert len(payload) < entropy * 1.01 + 300
    one = np.zeros((1, 64), np.uint16)
    only = rans.quantise(np.bincount(one.ravel(), minlength=rans.SYMBOLS))
    assert (rans.decode_block(*rans.encode_blocks(one, only)[0], 64, only) == 0).all()
    with pytest.raises(ValueError):
        rans.quantise(np.zeros(4))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 1000, 30_000])
def test_fuse_filter_has_all_keys_and_few_others(n):
    keys = np.random.default_rng(n).integers(0, 2**63, n).astype(np.uint64)
    f = exact.FuseFilter.build(keys)
    assert f.contains(keys).all()
    other = np.random.default_rng(n + 1).integers(0, 2**63, 50_000).astype(np.uint64)
    assert f.contains(other).mean() < 0.01 and (n < 1000 or len(f.data) < 1.5 * n)


def test_pivot_keeps_the_sum_and_the_expectation():
    r = np.random.default_rng(5)
    p = r.random(40)
    total = np.zeros(40)
    for _ in range(3000):
        out = mixing.pivot(p, r.random(40))
        open_ = (out > 0) & (out < 1)
        assert open_.sum() <= 1 and abs(out.sum() - p.sum()) < 1e-6
        total += np.where(open_, (r.random(40) < out), out)
    assert np.abs(total / 3000 - p).max() < 0.05
    assert mixing.pivot(np.array([0.5, 0.5, 0.0, 1.0]), r.random(4)).sum() == 2


def test_sketch_agrees_with_jaccard_and_fills_small_sets():
    r = np.random.default_rng(2)
    pool = r.integers(0, 2**63, 1000).astype(np.uint64)
    a, b = pool[:700], pool[300:]
    values, owner = np.concatenate([a, b, pool[:1]]), np.repeat([0, 1, 2], [700, 700, 1])
    s = neardup.sketch(values, owner, 4, 1024 >> 3)
    assert (s[:3] != 2**64 - 1).all() and (s[3] == 2**64 - 1).all()
    many = [(neardup.sketch(np.concatenate([a + np.uint64(k), b + np.uint64(k)]), np.repeat([0, 1], [700, 700]), 2)) for k in range(20)]
    assert abs(np.mean([(m[0] == m[1]).mean() for m in many]) - 400 / 1000) < 0.03


@pytest.mark.parametrize("few", [0, 3, neardup.FEW])
def test_similar_pairs_are_all_and_only_those(few, monkeypatch):
    monkeypatch.setattr(neardup, "FEW", few)
    r = np.random.default_rng(9)
    for n in [*range(1, 14), 60]:
        pool = r.integers(0, 2**63, 60).astype(np.uint64)
        sets = [np.unique(r.choice(pool, r.integers(0, 40))) for _ in range(n)]
        ones = np.flatnonzero(r.random(n) < 0.5)
        want = {(i, j) for i in ones for j in range(n) if i != j and len(b := np.intersect1d(sets[i], sets[j])) and len(b) >= 0.3 * len(np.union1d(sets[i], sets[j]))}
        assert set(zip(*neardup.similar_pairs(sets, ones, 0.3))) == want


def test_block_max_search_finds_all_that_brute_force_finds():
    r = np.random.default_rng(4)
    vocab = np.sort(r.integers(0, 2**63, 300).astype(np.uint64))
    items = [vocab[r.zipf(1.3, r.integers(8, 40)) % 300] for _ in range(60)]
    mean = np.mean([len(i) for i in items])
    index = decontam.Index(list(range(60)), items, None, 60, mean)
    passages = [np.unique(np.concatenate([vocab[r.zipf(1.3, 50) % 300], items[k % 60][: r.integers(1, 40)]])) for k in range(80)]
    place = [np.searchsorted(index.terms, p)[np.isin(p, index.terms)] for p in passages]
    got = index.search(np.repeat(np.arange(80), [len(p) for p in place]), np.concatenate(place), 80)
    impact = {(t, i): w for t in range(len(index.terms)) for i, w in zip(index.item[index.at[t] : index.at[t + 1]], index.impact[index.at[t] : index.at[t + 1]])}
    want = {(k, i): sum(impact.get((t, i), 0) for t in p) for k, p in enumerate(place) for i in range(60)}
    want = {k: v for k, v in want.items() if v >= decontam.SCORE}
    assert {(int(a), int(b)) for a, b in zip(got[0], got[1])} == set(want) and len(want) > 20
    assert all(abs(want[int(a), int(b)] - s) < 1e-9 for a, b, s in zip(*got))


def test_training_holds_the_sample_once(monkeypatch):
    monkeypatch.setattr(quality, "EPOCHS", 1)
    r = np.random.default_rng(6)
    texts = [" ".join(map(str, r.integers(0, 10**6, 400))) for _ in range(6000)]
    rows = pa.table({"ord": np.arange(6000), "doc_id": np.arange(6000), "text": texts, "good": np.arange(6000, dtype=np.int32) % 2, "all_rows": np.ones(6000, np.int32)})
    tracemalloc.start()
    quality._train(rows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # 4.8 million features of 8 bytes, the model, and the work on one slice.
    assert peak < 130_000_000, peak


def test_block_max_search_takes_no_more_memory_for_more_passages(monkeypatch):
    r = np.random.default_rng(5)
    vocab = np.sort(r.integers(0, 2**63, 400).astype(np.uint64))
    items = [vocab[r.choice(400, 40, False)] for _ in range(300)]
    index = decontam.Index(list(range(300)), items, None, 300, 40)
    place = [np.searchsorted(index.terms, np.unique(np.concatenate([vocab[r.choice(400, 130)], items[k % 300][: r.integers(20, 40)]]))) for k in range(4000)]
    passage, term = np.repeat(np.arange(4000), [len(p) for p in place]), np.concatenate(place)
    tracemalloc.start()
    got = index.search(passage, term, 4000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got[0]) > 1000 and peak < 100_000_000
    for postings in (1, 3000, 1 << 40):
        monkeypatch.setattr(decontam, "OPEN_POSTINGS", postings)
        assert all(np.array_equal(a, b) for a, b in zip(index.search(passage, term, 4000), got))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=25), st.lists(st.integers(0, 5), max_size=25))
def test_patience_gives_ordered_common_blocks(a, b):
    blocks = linedup.patience(a, b)
    assert all(a[i : i + n] == b[j : j + n] and n for i, j, n in blocks)
    assert all(i + n <= k and j + n <= m for (i, j, n), (k, m, _) in zip(blocks, blocks[1:]))
    if a and a == b:
        assert blocks == [(0, 0, len(a))]


def test_lines_and_runs():
    h, count, rows = linedup.lines_of(pa.array(["a b\nc", "", "\n\nx y", None, "q"]))
    assert np.diff(rows).tolist() == [2, 0, 3, 0, 1] and count.tolist() == [2, 1, 0, 0, 2, 1] and (h == 0).tolist() == [False, False, True, True, False, False]
    run, row = linedup.runs_of(h, count, rows, 3)
    assert row.tolist() == [0] and len(run) == 1


def test_words_with_marks_are_those_of_split():
    texts = ["a | b -- c's, D.", "", None, "...", "x\n\t?!\n", "!", "é é! —", "a" * 3 + " " + "-" * 5]
    h, offsets = words.words_of(pa.array(texts), marks=True)
    assert np.diff(offsets).tolist() == [len((t or "").split()) for t in texts]
    one = lambda t: words.words_of(pa.array([t]), marks=True)[0].tolist()
    assert one("C's D. | --") == one("cs, d | --") and one("|") != one("--") and len({*one("a b"), *one("| --")}) == 4


@pytest.mark.parametrize("longest", [repeats.RUN, 7])
def test_homes_cover_every_passage_once(longest):
    r = np.random.default_rng(6)
    texts = [r.integers(0, 2**63, n).astype(np.uint64) for n in (120, 49, 50, 0, 300)]
    texts += [np.concatenate([texts[4][100:170], texts[0][:60]]), np.full(200, 5, np.uint64), np.tile(texts[0][:10], 7), np.concatenate([texts[4][:30], np.tile(texts[0][:10], 6), texts[4][30:70]])]
    h, offsets = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    start, length, home, twice = repeats.homes(h, offsets, longest=longest)
    assert length.max() <= longest
    of = {s + k: (int(v), bool(t)) for s, n, v, t in zip(start, length, home, twice) for k in range(n)}
    assert len(of) == length.sum()
    known, within = {}, {}
    for row, (a, b) in enumerate(zip(offsets, offsets[1:])):
        for s in range(a, b - repeats.SPAN + 1):
            passage = h[s : s + repeats.SPAN].tobytes()
            assert known.setdefault(passage, of[s][0]) == of[s][0]
            assert (row, passage) not in within or (of[s][1] and of[within[row, passage]][1])
            within[row, passage] = s
    assert len(of) == sum(max(0, len(t) - repeats.SPAN + 1) for t in texts)


def test_suffix_groups_are_equal_passages():
    r = np.random.default_rng(8)
    base = r.integers(0, 2**63, 90).astype(np.uint64)
    regions = [base, base[10:75], base[20:70], np.full(70, 3, np.uint64), r.integers(0, 2**63, 50).astype(np.uint64), np.concatenate([base[:55], base[:60]])]
    region, offset, group = repeats.suffix_groups(regions)
    by = {}
    for i, o, g in zip(region, offset, group):
        by.setdefault(g, set()).add(regions[i][o : o + repeats.SPAN].tobytes())
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by)
    assert len(region) == sum(len(x) - repeats.SPAN + 1 for x in regions)


@pytest.mark.parametrize("copies, others", [(2, 0), (4, 4), (3, 2), (1, 1)])
def test_repeated_items_and_tiny_benchmarks_are_found(copies, others):
    r = random.Random(copies)
    text = [" ".join(r.choices([f"w{i}" for i in range(40)], k=24)) for _ in range(1 + others)]
    items = [words.words_of(pa.array([t]))[0] for t in [text[0]] * copies + text[1:]]
    index = decontam.Index(list(range(len(items))), items, None, len(items), 24)
    row, item, score, _, _ = decontam._matches(index, *words.words_of(pa.array([*text, "nothing of it"])))
    found = set(zip(row.tolist(), item.tolist()))
    assert {(0, k) for k in range(copies)} | {(1 + k, copies + k) for k in range(others)} <= found
    for t, own in enumerate(text):
        term = np.searchsorted(index.terms, np.unique(words.words_of(pa.array([own]))[0]))
        _, hit, value = index.search(np.zeros(len(term), np.int64), term, 1)
        whole = np.zeros(len(items))
        for x in term:
            whole[index.item[index.at[x] : index.at[x + 1]]] += index.impact[index.at[x] : index.at[x + 1]]
        assert {k: round(v, 6) for k, v in zip(hit.tolist(), value)} == {k: round(v, 6) for k, v in enumerate(whole) if v >= decontam.SCORE - 1e-9}
