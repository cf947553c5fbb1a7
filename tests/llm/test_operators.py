"""Each operator on small tables against brute force, and on the odd rows that tables can have."""

import math
import random
import re
import shutil
from collections import Counter
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest

from sedimenta.llm import counts, decontam, exact, graph, linedup, lmscore, mixing, neardup, pretokens, quality, rans, repeats, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, node string, score string, keep string, d string, part string, x string, leaf string, p string, words string, at string, target string, copies string"
COLUMNS += "".join(f", {c} string" for c in "near_key best_key best_id at_source whole won_source won_id one _one line gone own h m n nth home homes part open region first band lead grams root top bands task print tokens item_id quality good ord every __k __copies".split() if f" {c} string" not in COLUMNS)
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n=80):
    r = random.Random(seed)
    return "".join(r.choice(WORDS) + r.choice([" ", " ", " ", ". ", "\n"]) for _ in range(n)).strip()


def table(spark, rows):
    """rows are (doc_id, text) or (doc_id, text, source); all further columns clash with names used inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *["z"] * (COLUMNS.count(",") - 4)) for r in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(3)


def odd(spark):
    """NULLs in any column, empty and very long texts, ties, repeated rows."""
    long = prose(99, 60_000)
    rows = [(1, prose(1)), (2, prose(2)), (3, prose(1)), (None, prose(1)), (None, None), (4, None), (5, ""), (6, ""), (7, "..."), (8, long), (9, long), (2, prose(2)), (None, prose(1)), (10, "one")]
    return table(spark, rows)


def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def rows_of(df):
    return Counter(map(tuple, df.collect()))


# ---------------------------------------------------------------- 1 token output

def decoded(blocks):
    parts = {}
    for r in rans.decode(blocks).collect():
        ends = [*r.doc_starts[1:], len(r.tokens)]
        for k, (i, a, b, o) in enumerate(zip(r.doc_ids, r.doc_starts, ends, r.doc_offsets)):
            parts[r.block_id, k] = (i, o, tuple(r.tokens[a:b]))
    out, now = [], None
    for _, (i, o, tokens) in sorted(parts.items()):
        if o == 0:
            now = [i, ()]
            out.append(now)
        now[1] += tokens
    return Counter((i, t) for i, t in out)


def test_op1_round_trip(spark):
    docs = odd(spark)
    enc = pretokens.encoding()
    want = Counter((r.doc_id, (*enc.encode_ordinary(r.text or ""), rans.END)) for r in docs.collect())
    blocks = rans.encode(docs)
    assert decoded(blocks) == want
    table_crc = {r.table_crc for r in blocks.collect()}
    assert len(table_crc) == 1
    assert rans.encode(empty(spark)).count() == 0 and rans.decode(rans.encode(empty(spark))).count() == 0


def test_op1_damage_is_found(spark):
    from pyspark.sql import functions as F

    blocks = rans.encode(table(spark, [(1, prose(1))]))
    broken = blocks.withColumn("tokens_crc", F.col("tokens_crc") + 1)
    with pytest.raises(Exception, match="checksum"):
        rans.decode(broken).collect()


# ---------------------------------------------------------------- 2 LM scoring

def brute_scores(rows, target, symbols):
    texts = [[int(x) for x in words.words_of(pa.array([t or ""]))[0]] for _, t in rows]
    freq = Counter(w for t in texts for w in t)
    signed = lambda w: w - 2**64 if w >= 2**63 else w
    vocab = {w: k for k, w in enumerate(sorted(w for w, _ in sorted(freq.items(), key=lambda x: (-x[1], signed(x[0])))[: symbols - 2]))}
    seqs = [[vocab.get(w, symbols - 2) for w in t] for t in texts]
    pairs = {m: Counter() for m in "tb"}
    for (i, _), s in zip(rows, seqs):
        for p in zip([symbols - 1, *s], s):
            pairs["b"][p] += 1
            pairs["t"][p] += i in target
    loss = {}
    for m, c in pairs.items():
        c = +c
        uni, his, kinds = Counter(), Counter(), Counter()
        for (h, w), n in c.items():
            uni[w] += n
            his[h] += n
            kinds[h] += 1
        total = sum(uni.values())
        base = lambda w, uni=uni, total=total: (uni[w] + 1) / (total + symbols)
        loss[m] = lambda h, w, c=c, his=his, kinds=kinds, base=base: -np.log((c[h, w] + kinds[h] * base(w)) / (his[h] + kinds[h]) if kinds[h] else base(w))
    return [(i, len(s), np.mean([loss["t"](h, w) - loss["b"](h, w) for h, w in zip([symbols - 1, *s], s)]) if s else None) for (i, _), s in zip(rows, seqs)]


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_op2_scores(spark, limit):
    rows = [(k, prose(k % 7, 60)) for k in range(20)] + [(None, prose(3)), (20, None), (21, ""), (5, prose(5))]
    target = {0, 1, 2, 3, 99}
    ids = spark.createDataFrame([(i,) for i in [*target, None, 1]], "doc_id long")
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] or 0)
    got = sorted((tuple(r) for r in lmscore.score(table(spark, rows), ids, 64, limit).collect()), key=key)
    want = sorted(brute_scores(rows, target, 64), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(g[2] is w[2] is None or abs(g[2] - w[2]) < 0.02 for g, w in zip(got, want))


def test_op2_odd(spark):
    none = spark.createDataFrame([], "doc_id long")
    out = {(r.doc_id, r.n_words): r.score for r in lmscore.score(odd(spark), none, 64).collect()}
    assert out[5, 0] is None and out[10, 1] is not None
    assert lmscore.score(empty(spark), none, 64).count() == 0


def test_op2_counts_every_word(spark, monkeypatch):
    r = random.Random(5)
    rows = [(k, " ".join(f"t{r.randrange(6000)}" if r.random() < 0.7 else f"r{k}x{j}" for j in range(400))) for k in range(40)] + [(None, None), (77, "")]
    target = {0, 3, 6, 9}
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    kinds = len({w for _, t in rows for w in (t or "").split()})
    assert kinds > 4096
    want = {i: s for i, _, s in brute_scores(rows, target, kinds + 2)}
    for tokens in (lmscore.PART_TOKENS, 700):
        monkeypatch.setattr(lmscore, "PART_TOKENS", tokens)
        got = {x.doc_id: x.score for x in lmscore.score(table(spark, rows), ids).collect()}
        assert got.keys() == want.keys()
        assert all(got[i] is want[i] is None or abs(got[i] - want[i]) < 1e-6 for i in want)


# ---------------------------------------------------------------- 3 exact dedup

def brute_exact(parts):
    first = {}
    for p, rows in enumerate(parts):
        for i, t in rows:
            if t is not None:
                first[t] = min(first.get(t, (9, True, 0)), (p, i is None, i or 0))
    out, seen = Counter(), set()
    for p, rows in enumerate(parts):
        for i, t in rows:
            if t is None:
                out[i, i, True] += 1
            else:
                q, none, j = first[t]
                j = None if none else j
                keep = (p, i) == (q, j) and t not in seen
                seen.update([t] if keep else [])
                out[i, j, keep] += 1
    return out


@pytest.mark.parametrize("case", ["broadcast", "shuffled", "colliding"])
def test_op3_against_brute_force(spark, case):
    from pyspark.sql import functions as F

    r = random.Random(1)
    parts = [[(10 * k + p, prose(r.randrange(25), 30)) for k in range(30)] for p in range(3)]
    parts[0] += [(None, "x"), (3, None), (77, ""), (10, parts[0][1][1])]
    parts[1] += [(None, None), (78, ""), (None, "x")]
    parts[2] += [(79, ""), (80, "only"), (80, "only")]
    digest = (lambda c: F.length(c).cast("long")) if case == "colliding" else F.xxhash64
    got = rows_of(exact.exact_duplicates([table(spark, p) for p in parts], 0 if case == "shuffled" else 1 << 20, digest))
    assert got == brute_exact(parts)


def test_op3_batches_read_filters_and_hit_buckets_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(exact, "SHARD_KEYS", 40)
    old = [(k, prose(k, 30)) for k in range(200)] + [(300, None), (301, ""), (302, "")]
    taken = exact.write_snapshot(table(spark, old), f"{tmp_path}/one")
    assert taken.shards == 6 and taken.filters.count() == 6 and taken.buckets.count() == 202
    batch = [(1000 + k, prose(500 + k, 30)) for k in range(20)] + [(2000, prose(500, 30)), (2001, None)]
    passed = exact.screen(table(spark, batch).where("text is not null").select(exact.F.xxhash64("text").alias("d")), taken.filters, taken.shards).count()
    again = exact.Snapshot(spark, f"{tmp_path}/one")
    if not passed:
        shutil.rmtree(tmp_path / "one" / "buckets")
    got = rows_of(exact.screen_batch(table(spark, batch), [again]))
    assert got == {**{(i, i, True): 1 for i, _ in batch[:20]}, (2000, 1000, False): 1, (2001, 2001, True): 1}
    taken = exact.write_snapshot(table(spark, old), f"{tmp_path}/two")
    copies = [(5000 + k, prose(k, 30)) for k in range(5)] + [(5100, ""), (5101, "new"), (5102, "new")]
    assert rows_of(exact.screen_batch(table(spark, copies), [again, taken][1:])) == {**{(5000 + k, k, False): 1 for k in range(5)}, (5100, 301, False): 1, (5101, 5101, True): 1, (5102, 5101, False): 1}


def test_op3_very_long_and_hot_texts(spark):
    long = prose(99, 60_000)
    parts = [[(1, long), (2, long + "."), (3, "hot")], [(10 + k, "hot") for k in range(300)] + [(5, long)], [(400 + k, "hot") for k in range(300)] + [(6, long + ".")]]
    assert rows_of(exact.exact_duplicates([table(spark, p) for p in parts])) == brute_exact(parts)


def test_op3_empty(spark):
    assert exact.exact_duplicates([empty(spark), empty(spark)]).count() == 0
    assert rows_of(exact.exact_duplicates([empty(spark), table(spark, [(1, "a"), (2, "a")])])) == {(1, 1, True): 1, (2, 1, False): 1}


# ---------------------------------------------------------------- 4 decontamination

def test_op4_planted_items(spark):
    items = [(k, prose(1000 + k, 20 + k)) for k in range(12)] + [(50, None), (51, ""), (52, "too short!"), (None, prose(2000, 30)), (53, "...")]
    docs = [(k, prose(k, 300)) for k in range(15)]
    docs += [(100 + k, prose(k, 50 * k) + "\n" + items[k][1].upper() + " !\n" + prose(k + 30, 90)) for k in range(12)]
    docs += [(200, items[3][1]), (200, items[3][1]), (None, items[4][1] + " " + items[15][1]), (201, None), (202, ""), (203, " ".join(items[5][1].split()[:8])), (204, "this is TOO, short"), (205, "too w1 short")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = Counter({**{(100 + k, k): 1 for k in range(12)}, (200, 3): 2, (None, 4): 1, (None, None): 1, (204, 52): 1})
    for size in (decontam.INDEX_WORDS, 60):
        got = decontam.contaminated(table(spark, docs), bench, size)
        assert Counter((r.doc_id, r.item_id) for r in got.collect()) == want
        kept = decontam.drop_contaminated(table(spark, docs), bench, size)
        assert Counter(r.doc_id for r in kept.collect()) == Counter([*range(15), 201, 202, 203, 205])
    assert decontam.contaminated(empty(spark), bench).count() == 0
    assert decontam.contaminated(table(spark, docs), bench.limit(0)).count() == 0
    assert decontam.drop_contaminated(table(spark, docs), bench.limit(0)).count() == len(docs)


def plain_words(text):
    return [w for w in ("".join(c for c in x if c.isalnum()) for x in (text or "").lower().split()) if w]


def brute_contaminated(docs, items):
    """BM25 of every passage and item and both overlaps in plain Python: {(doc_id, item_id): (score, q, a)}."""
    split = [(i, w) for i, w in ((i, plain_words(t)) for i, t in items) if w]
    n, mean = len(split), sum(len(w) for _, w in split) / max(1, len(split))
    df = Counter(t for _, w in split for t in set(w))
    grams = lambda w, g: {tuple(w[k : k + g]) for k in range(len(w) - g + 1)} if len(w) >= g else {tuple(w)}
    out = {}
    for d, text in docs:
        words_ = plain_words(text)
        for i, w in split:
            tf = Counter(w)
            impact = {t: np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in tf.items()}
            half = 64
            while half < len(w):
                half *= 2
            for begin in range(0, max(1, -(-len(words_) // half) - 1) * half, half):
                passage = words_[begin : begin + 2 * half]
                score = sum(impact[t] for t in set(passage) & impact.keys()) / sum(impact.values())
                if score < 0.5 - 1e-9:
                    continue
                at = len(w) - max(1, int(len(w) * 0.25))
                parts = [w[:at], w[at:]] if len(w) >= 5 else [w, w]
                q, a = (np.mean([g in grams(passage, len(g)) for g in grams(p, min(3, len(p)) if len(w) >= 5 else len(w))]) for p in parts)
                if q >= 0.5 and a >= 0.5 and score > out.get((d, i), (0,))[0]:
                    out[d, i] = (score, q, a)
    return out


def test_op4_against_brute_force(spark):
    r = random.Random(4)
    items = [(k, prose(4000 + k, r.choice([3, 8, 30, 60, 64, 65, 90, 150]))) for k in range(30)] + [(40, prose(4001, 30)), (41, prose(4002, 40)), (42, prose(4002, 40))]
    docs = []
    for k in range(60):
        own = plain_words(items[k % 33][1])
        if k % 3 == 1:
            keep = r.uniform(0.4, 1)
            own = [w if r.random() < keep**0.3 else r.choice(WORDS) for w in own]
        if k % 3 == 2:
            step = r.choice([4, 8, 20])
            own = [x for b in range(0, len(own), step) for x in [*own[b : b + step], *r.choices(WORDS, k=step * (k % 4) // 2)]]
        docs.append((k, " ".join([*r.choices(WORDS, k=r.randrange(150)), *own, *r.choices(WORDS, k=r.randrange(150))])))
    want = brute_contaminated(docs, items)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert 20 < len(want) < 80
    for size in (decontam.INDEX_WORDS, 300):
        got = {(x.doc_id, x.item_id): (x.score, x.question_overlap, x.answer_overlap) for x in decontam.contaminated(table(spark, docs), bench, size).collect()}
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k]) for k in want)
        assert {x.doc_id for x in decontam.drop_contaminated(table(spark, docs), bench, size).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_op4_other_items_change_nothing(spark):
    """An item scattered over many words is found or not whatever the lengths of the other items."""
    item = prose(4100, 20)
    spread = " ".join(x for w in plain_words(item) for x in [w, *random.Random(w).choices(WORDS, k=10)])
    docs = [(1, spread), (2, item), (3, prose(4101, 900)), (4, item + " " + prose(4102, 300))]
    found = []
    for more in ([], [(2, prose(4103, 1500))]):
        bench = spark.createDataFrame([(1, item), *more], "item_id long, text string")
        for size in (decontam.INDEX_WORDS, 100):
            found.append({(x.doc_id, x.item_id) for x in decontam.contaminated(table(spark, docs), bench, size).collect()})
    assert all(f == {(2, 1), (4, 1)} for f in found)
    long = prose(4104, 60_000)
    bench = spark.createDataFrame([(1, item), (2, long)], "item_id long, text string")
    assert {(x.doc_id, x.item_id) for x in decontam.contaminated(table(spark, [(1, long), (2, long + item), (3, "x")]), bench).collect()} == {(1, 2), (2, 2), (2, 1)}


# ---------------------------------------------------------------- 5 mixing

def test_op5_copies(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF_ROWS", 20)
    rows = [(k, "t" * 10, "big") for k in range(600)] + [(k, "t" * 10, "mid") for k in range(700, 800)] + [(k, "t" * 10, None) for k in range(900, 917)]
    for weights in (None, {"mid": 3.0}):
        want = {r.source: r.x for r in mixing.expected_copies(table(spark, rows), weights).collect()}
        out = mixing.mixed_copies(table(spark, rows), weights).collect()
        assert len(out) == len(rows) and min(want.values()) == 1
        total = Counter()
        for r in out:
            assert int(want[r.source] + 1e-9) <= r.copies <= want[r.source] + 1
            total[r.source] += r.copies
        n = Counter(r[2] for r in rows)
        assert all(abs(total[s] - n[s] * x) < 1 + 1e-6 for s, x in want.items())
    if weights:
        share = total["mid"] / sum(total.values())
        assert abs(share - 3 / 5) < 0.02
    assert rows_of(mixing.mixed_copies(table(spark, rows).repartition(1))) == rows_of(mixing.mixed_copies(table(spark, rows)))
    mixed = mixing.mix_sources(table(spark, rows))
    assert mixed.columns == table(spark, rows).columns and mixed.count() == sum(r.copies for r in mixing.mixed_copies(table(spark, rows)).collect())


def plain_pivotal(p):
    """All outcomes of pivotal rounding and their probabilities, in exact arithmetic."""
    out = Counter()
    stack = [(tuple(p), Fraction(1))]
    while stack:
        now, chance = stack.pop()
        left = [k for k, x in enumerate(now) if 0 < x < 1]
        if len(left) < 2:
            out[now] += chance
            continue
        i, j = left[:2]
        a, b = now[i], now[j]
        ways = [((0, a + b), b / (a + b)), ((a + b, 0), a / (a + b))] if a + b < 1 else [((1, a + b - 1), (1 - b) / (2 - a - b)), ((a + b - 1, 1), (1 - a) / (2 - a - b))]
        for (x, y), share in ways:
            after = list(now)
            after[i], after[j] = x, y
            stack.append((tuple(after), chance * share))
    return out


@pytest.mark.parametrize("p", [(1, 3, 2), (4, 3, 2, 1), (4, 4, 4, 4), (1, 1, 2, 3, 4), (0, 3, 5, 2)])
def test_op5_pivot_against_all_outcomes(p):
    p = [Fraction(x, 5) for x in p]
    want = plain_pivotal(p)
    assert sum(want.values()) == 1 and all(sum(o[k] * c for o, c in want.items()) == x for k, x in enumerate(p))
    r, n, seen = np.random.default_rng(1), 20_000, Counter()
    for _ in range(n):
        seen[tuple(round(x * 5) for x in mixing.pivot(np.array([float(x) for x in p]), r.random(len(p))))] += 1
    want = {tuple(int(x * 5) for x in o): float(c) for o, c in want.items()}
    assert seen.keys() <= want.keys() and all(abs(seen[o] / n - c) < 0.02 for o, c in want.items())


def test_op5_every_document_has_its_expectation(monkeypatch):
    """Leaves, inner nodes and root by hand over many seeds: each of a source's documents is drawn as often as its p."""
    rows = pd.DataFrame([("a", k, k % 3, 0.3) for k in range(9)] + [("b", k, k % 3, 0.75) for k in range(20, 24)] + [(None, 30, 0, 0.5), (None, None, 1, 0.5)], columns=["source", "doc_id", "leaf", "p"])
    drawn, n = Counter(), 2500
    for seed in range(n):
        done = pd.concat([mixing._round(g, 0, seed, True) for _, g in rows.groupby("leaf")])
        open_ = mixing._round(done[done.p < 1].assign(leaf=0), 1, seed, True)
        last = mixing._round(open_[open_.p < 1], -1, seed, False)
        draw = np.random.default_rng(seed).random(len(last))
        last = last[(last.p >= 1 - 1e-9) | (draw < last.p)]
        won = pd.concat([done[done.p >= 1], open_[open_.p >= 1], last])
        assert abs(len(won) - rows.p.sum()) < 1
        drawn.update((s if isinstance(s, str) else None, None if pd.isna(i) else int(i)) for s, i in zip(won.source, won.doc_id))
    for s, i, _, p in rows.itertuples(index=False):
        assert abs(drawn[s if isinstance(s, str) else None, None if pd.isna(i) else int(i)] / n - p) < 0.05


def test_op5_odd(spark):
    from pyspark.sql import functions as F

    docs = odd(spark).withColumn("source", F.when(F.col("doc_id") > 3, "s")).withColumn("n_chars", F.when(F.col("doc_id") != 8, F.col("n_chars")))
    out = mixing.mixed_copies(docs).collect()
    assert len(out) == docs.count() and all(r.copies >= 1 for r in out)
    assert mixing.mixed_copies(empty(spark)).count() == 0 and mixing.mix_sources(empty(spark)).count() == 0


# ---------------------------------------------------------------- 6 line dedup

def brute_lines(rows):
    """Pairs every two texts that share a line."""
    least = {}
    for i, t in rows:
        if t is not None:
            least[t] = min(least.get(t, (True, 0)), (i is None, i or 0))
    order = sorted(least, key=lambda t: least[t])
    gone = {}
    for n, t in enumerate(order):
        own = t.split("\n") if t else []
        size = [len(x.split()) for x in own]
        hit = set()
        for e in order[:n]:
            hit.update(linedup.common_lines(e.split("\n"), own, size))
        gone[t] = hit
    out = Counter()
    for i, t in rows:
        if t is None:
            out[i, None, 0] += 1
            continue
        own = t.split("\n")
        copy = (i is None, i or 0) != least[t] and sum(len(x.split()) for x in own) >= linedup.LEAST_WORDS
        drop = set(range(len(own))) if copy else gone[t]
        out[i, "" if copy else "\n".join(x for k, x in enumerate(own) if k not in drop), len(drop)] += 1
    return out


def test_op6_against_brute_force(spark):
    r = random.Random(8)
    lines = [" ".join(r.choices(WORDS, k=r.randint(3, 12))) for _ in range(60)] + ["boilerplate of every text here"]
    rows = []
    for k in range(40):
        start = r.randrange(50)
        body = lines[start : start + r.randint(2, 9)] if k % 3 else r.sample(lines, 6)
        rows.append((k, "\n".join([*body[:3], "", *body[3:], lines[60]])))
    rows += [(90, rows[4][1]), (None, rows[4][1]), (4, rows[4][1]), (91, None), (92, ""), (93, ""), (94, "\n\n"), (95, "x")]
    assert rows_of(linedup.deduped_lines(table(spark, rows))) == brute_lines(rows)


def test_op6_frequent_lines_are_covered(spark):
    shared = "\n".join(prose(500 + k, 9).replace("\n", " ") for k in range(4))
    rows = [(k, prose(k, 30).replace("\n", " ") + "\n" + shared) for k in range(3 * linedup.RARE)]
    out = {r.doc_id: r.removed_lines for r in linedup.deduped_lines(table(spark, rows)).collect()}
    assert out[0] == 0 and all(out[k] == 4 for k in range(1, len(rows)))
    assert linedup.deduped_lines(empty(spark)).count() == 0
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    assert rows_of(linedup.deduped_lines(odd(spark))) == brute_lines(rows)


def test_op6_very_long_texts_of_few_lines(spark):
    body = "\n".join(["one two three four five six", "seven eight nine ten eleven"] * 20_000)
    out = {r.doc_id: r.removed_lines for r in linedup.deduped_lines(table(spark, [(1, body), (2, "head\n" + body + "\ntail"), (3, "seven eight nine ten eleven")])).collect()}
    assert out == {1: 0, 2: 40_000, 3: 1}


def test_op6_short_frequent_lines_are_deleted(spark):
    once = lambda k, n: " ".join(f"own{k}x{j}" for j in range(n))
    nine, six, four = (" ".join(f"{c}{j}" for j in range(n)) for c, n in (("n", 9), ("s", 6), ("f", 4)))
    rows = [(k, "\n".join([once(k, 12), nine, once(1000 + k, 7), *[six] * (k % 2), once(2000 + k, 9), four])) for k in range(4 * linedup.RARE)]
    got = rows_of(linedup.deduped_lines(table(spark, rows)))
    assert got == brute_lines(rows)
    kept = [t for _, t, _ in got]
    assert [sum(x in t.split("\n") for t in kept) for x in (nine, six, four)] == [1, 1, len(rows)]


# ---------------------------------------------------------------- 7 suffix-array dedup

def test_op7_against_brute_force(spark, monkeypatch):
    shared = [prose(700 + k, 55 + 20 * k) for k in range(3)]
    rows = [(k, prose(k, 40) + " " + shared[k % 3] + " " + prose(k + 50, 30)) for k in range(9)]
    rows += [(20, prose(20, 120)), (21, prose(20, 120) + " end"), (22, " ".join(["same"] * 130)), (23, shared[0][: len(shared[0]) // 2]), (24, None), (25, ""), (None, shared[1]), (20, prose(20, 120)), (26, rows[2][1])]
    rows += [(30, " ".join(["a b c d e f g h"] * 12) + " " + prose(31, 20) + " " + " ".join(["a b c d e f g h"] * 9)), (31, prose(33, 60) + " " + " ".join(["same"] * 90))]
    rows += [(40 + k, prose(40 + k, 20) + " " + " | ".join(plain_words(prose(44, 30)))) for k in range(2)]
    plain = {}
    for i, t in rows:
        if t is not None and (t not in plain or (i is None, i or 0) < plain[t]):
            plain[t] = (i is None, i or 0)
    first, want = {}, set()
    for t, key in sorted(plain.items(), key=lambda x: x[1]):
        h = words.words_of(pa.array([t]), marks=True)[0].tolist()
        for k in range(len(h) - repeats.SPAN + 1):
            w = tuple(h[k : k + repeats.SPAN])
            if w in first:
                want.add((None if key[0] else key[1], k, first[w]))
            first.setdefault(w, None if key[0] else key[1])
    for i, t in rows:
        if t is not None and ((i is None, i or 0) != plain[t] or (i, t) == rows[9]):
            n = len(t.split())
            if (i is None, i or 0) != plain[t]:
                want.update((i, k, plain[t][1]) for k in range(n - repeats.SPAN + 1))
    want.update((20, k, 20) for k in range(120 - repeats.SPAN + 1))
    for size in (repeats.BLOCK_WORDS, 50):
        monkeypatch.setattr(repeats, "BLOCK_WORDS", size)
        got = set()
        for r in repeats.repeated_passages(table(spark, rows)).collect():
            got.update((r.doc_id, k, r.first_doc_id) for k in range(r.start_word, r.end_word - repeats.SPAN + 1))
        assert got == want


def test_op7_odd(spark):
    out = repeats.repeated_passages(odd(spark)).collect()
    assert {(r.doc_id, r.first_doc_id) for r in out} >= {(3, 1), (None, 1), (9, 8), (2, 2)}
    # One word over and over, longer than a run may be.
    out = repeats.repeated_passages(table(spark, [(1, "same " * 120_000), (2, "x " + "same " * 60)])).collect()
    assert Counter(map(tuple, out)) == Counter([(1, 1, 120_000, 1), (2, 1, 61, 1)])
    assert repeats.repeated_passages(empty(spark)).count() == 0


# ---------------------------------------------------------------- 8 token counts

def test_op8_counts(spark):
    enc = pretokens.encoding()
    docs = odd(spark)
    want = Counter((r.doc_id, None if r.text is None else len(enc.encode_ordinary(r.text))) for r in docs.collect())
    assert rows_of(counts.token_counts(docs)) == want
    assert rows_of(counts.token_counts(docs, sample_rows=1)) == want
    assert counts.token_counts(empty(spark)).count() == 0
    plan = counts.token_counts(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Join" not in plan


# ---------------------------------------------------------------- 9 quality classifier

def test_op9_held_out_accuracy(spark):
    def text(k, good):
        return prose(k, 60) if good else prose(k, 60).upper().replace(" ", "!! ")

    rows = [(k, text(k, k % 4 != 0)) for k in range(400)]
    labels = spark.createDataFrame([(k, int(k % 4 != 0), None if k % 3 else 0) for k in range(300)] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    out = {r.doc_id: r.keep for r in quality.classify(table(spark, rows), labels).collect()}
    assert np.mean([out[k] == (k % 4 != 0) for k in range(300, 400)]) > 0.95
    kept = quality.keep_good(table(spark, rows), labels)
    assert kept.columns == table(spark, rows).columns and {r.doc_id for r in kept.collect()} == {k for k, keep in out.items() if keep}


def plain_classifier(train, texts):
    """Words and punctuation runs, their bigrams, and FTRL in plain Python over dicts."""

    def vector(text):
        tokens = re.findall(r"[0-9A-Za-z\u0080-\uffff]+|[^\s0-9A-Za-z\u0080-\uffff]+", text or "")
        seen = Counter([("one", t) for t in tokens] + [("same",) if a == b else ("two", a, b) for a, b in zip(tokens, tokens[1:])])
        return {f: math.log2(1 + c) for f, c in seen.items()}

    z, n = Counter(), Counter()

    def weight(f):
        if abs(z[f]) <= (quality.L1 if f != "bias" else 0):
            return 0.0
        return -(z[f] - math.copysign(quality.L1 if f != "bias" else 0, z[f])) / ((quality.BETA + math.sqrt(n[f])) / quality.ALPHA + quality.L2)

    for _ in range(quality.EPOCHS):
        for text, label in train:
            x = vector(text) | {"bias": 1.0}
            w = {f: weight(f) for f in x}
            error = 1 / (1 + math.exp(-sum(w[f] * v for f, v in x.items()))) - label
            for f, v in x.items():
                g = error * v
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / quality.ALPHA * w[f]
                n[f] += g * g
    return [1 / (1 + math.exp(-sum(weight(f) * v for f, v in (vector(t) | {"bias": 1.0}).items()))) if vector(t) else None for t in texts]


def test_op9_against_plain_ftrl(spark):
    from pyspark.sql import functions as F

    rows = [(k, prose(k, 40) + (" !! zz zz " * (k % 5)) + ("" if k % 2 else " bad thing é,;")) for k in range(60)] + [(70, ""), (71, None)]
    labels = [(k, k % 2, 0) for k in range(40)] + [(100 + k, 1, 0) for k in range(50)]
    order = [r.k for r in spark.range(40).select(F.col("id").alias("k")).orderBy(F.xxhash64("k")).collect()]
    want = plain_classifier([(rows[k][1], k % 2) for k in order], [t for _, t in rows])
    got = {r.doc_id: r.score for r in quality.classify(table(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert all((got[i] is w is None) or abs(got[i] - w) < 1e-4 for (i, _), w in zip(rows, want))


def test_op9_labels_of_absent_documents_take_no_room(spark):
    rows = [(k, prose(k, 30) if k % 2 else prose(k, 30).upper()) for k in range(40)]
    labels = spark.createDataFrame([(k, k % 2, 0) for k in range(40)] + [(1000 + k, 1, 0) for k in range(400)], "doc_id long, quality int, toxic int")
    assert np.count_nonzero(quality.train(table(spark, rows), labels, 40)) > 10
    one = quality.train(table(spark, rows), labels, 40)
    assert (one == quality.train(table(spark, rows), labels.where("doc_id < 40"), 40)).all()


def test_op9_odd(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 1, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        out = quality.classify(odd(spark), labels).collect()
        assert len(out) == odd(spark).count()
        assert all(r.keep and r.score is None for r in out if r.doc_id in (4, 5, 6))
    assert all(r.keep for r in quality.classify(odd(spark), none).collect())
    assert quality.classify(empty(spark), some).count() == 0 and quality.keep_good(empty(spark), some).count() == 0


# ---------------------------------------------------------------- 10 near duplicates

def near_rows():
    r = random.Random(12)
    rows = []
    for base in range(12):
        own = prose(base, 150).split()
        for copy in range(base % 4 + 1):
            some = list(own)
            for k in r.sample(range(150), 4 * bool(copy)):
                some[k] = r.choice(WORDS)
            rows.append((100 * base + copy, " ".join(some)))
    return rows


def shingles(text):
    """The word 3-grams of a text in plain Python."""
    plain = [w for w in ("".join(c for c in x if c.isalnum()) for x in text.lower().split()) if w]
    return {tuple(plain[k : k + 3]) for k in range(max(1, len(plain) - 2))}


def alike(one, two):
    return len(one & two) >= 0.55 * len(one | two)


def joined(nodes, pairs):
    """Components as a dict node -> least node."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def triples(n):
    """Three texts each, of which the second is like the others and the others hardly like one another."""
    rows = []
    for k in range(n):
        r, own = random.Random(k), prose(3000 + k, 60).split()
        first, last = list(own), list(own)
        for at in range(4, 12, 2):
            first[at] = r.choice(WORDS)
        for at in range(40, 50, 2):
            last[at] = r.choice(WORDS)
        rows += [(10 * k, " ".join(first)), (10 * k + 1, " ".join(own)), (10 * k + 2, " ".join(last))]
    return rows


def test_op10_against_brute_force(spark):
    rows = near_rows() + [(9000 + i, t) for i, t in triples(40)]
    sets = {i: shingles(t) for i, t in rows}
    want = joined(sets, [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b])])
    got = {r.doc_id: r.keep_id for r in neardup.near_duplicates(table(spark, rows)).collect()}
    assert got.keys() == want.keys()
    assert all(want[i] == want[k] for i, k in got.items()), "only similar documents are joined"
    assert np.mean([got[i] == want[i] for i in want]) >= 0.95


def test_op10_is_the_same_for_all_sizes_of_tasks(spark):
    rows = near_rows() + [(9000 + i, t) for i, t in triples(60)]
    found = []
    for size in (1, 7, neardup.TASK_TEXTS):
        texts, groups = neardup.near_groups(table(spark, rows), size)
        named = groups.join(texts.select("node", "doc_id"), "node").join(texts.select(texts["node"].alias("root"), texts["doc_id"].alias("root_id")), "root")
        found.append({(r.doc_id, r.root_id) for r in named.collect()})
        by = {}
        for i, root in found[-1]:
            by.setdefault(root, set()).add(i)
        found[-1] = {frozenset(x) for x in by.values()}
    assert found[0] == found[1] == found[2] and len(found[0]) > 40


@pytest.mark.parametrize("size", [neardup.TASK_TEXTS, 1, 3])
def test_op10_pairs_led_by_a_text_unlike_them(spark, size, monkeypatch):
    # One band for all texts, led by a text that is like none of them, and pairs that are alike without a band in common.
    texts = [prose(700), *[prose(701 + k // 2) + " end" * (k % 2) for k in range(6)], *[t for _, t in triples(5)]]
    bands = {k: [7] if k < 20 else [k] for k in range(len(texts))}
    fixed = spark.createDataFrame([(k, k, b) for k, b in bands.items()], "doc_id long, node long, bands array<long>")
    monkeypatch.setattr(neardup, "distinct_texts", lambda docs: docs.select("doc_id", neardup.text_key().alias("key")).join(fixed, "doc_id"))
    _, groups = neardup.near_groups(table(spark, list(enumerate(texts))), size)
    found = {}
    for r in groups.collect():
        found.setdefault(r.root, set()).add(r.node)
    sets = [shingles(t) for t in texts]
    want = joined(range(len(texts)), [(a, b) for a in range(20) for b in range(20) if a < b and alike(sets[a], sets[b])])
    expected = {frozenset(n for n in want if want[n] == root) for root in want.values()}
    assert {frozenset(g) for g in found.values()} == {g for g in expected if len(g) > 1}


def test_op10_similar_pairs_kernel():
    r = np.random.default_rng(3)
    sets = [np.unique(r.integers(0, 40 if k % 2 else 4000, 30)).astype(np.uint64) for k in range(90)]
    sets += [sets[0], np.zeros(0, np.uint64), np.append(sets[1], np.uint64(5000))]
    ones = np.arange(0, len(sets), 3)
    i, j = neardup.similar_pairs(sets, ones)
    want = {(a, b) for a in ones for b in range(len(sets)) if a != b and len(set(sets[a]) & set(sets[b])) >= max(1, 0.55 * len(set(sets[a]) | set(sets[b])))}
    assert set(zip(i, j)) == want and len(want) > 5


def test_op10_odd(spark):
    out = rows_of(neardup.near_duplicates(odd(spark)))
    assert sum(out.values()) == odd(spark).count()
    assert out[1, 1, True] == 1 and out[3, 1, False] == 1 and out[None, 1, False] == 2 and out[2, 2, True] == 1 and out[2, 2, False] == 1
    assert out[None, None, True] == 1 and out[4, 4, True] == 1 and out[5, 5, True] == 1 and out[6, 5, False] == 1 and out[9, 8, False] == 1
    kept = neardup.keep_one(odd(spark))
    assert kept.columns == odd(spark).columns
    assert Counter(r.doc_id for r in kept.collect()) == Counter([1, 2, 4, 5, 7, 8, 10, None])
    assert neardup.near_duplicates(empty(spark)).count() == 0 and neardup.keep_one(empty(spark)).count() == 0


def test_hot_keys_are_never_ranked_in_one_task(spark, monkeypatch):
    """Nine rows in ten have one text, one digest and one band: no plan has a window over any of them."""
    plans = []
    for module in (neardup, graph, exact):
        monkeypatch.setattr(module, "cut", lambda df, name, f=module.cut: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), f(df, name))[1])
    docs = table(spark, [(k, "all of them say this one thing here" if k % 10 else prose(k)) for k in range(200)])
    for out in (neardup.near_duplicates(docs), exact.exact_duplicates([docs.where("doc_id < 150"), docs.where("doc_id >= 150")])):
        plans.append(out._jdf.queryExecution().optimizedPlan().toString())
        rows = {r.doc_id: (r.keep_id, r.keep) for r in out.collect()}
        assert rows == {k: (1, k == 1) if k % 10 else (k, True) for k in range(200)}
    assert len(plans) > 15 and not any("Window" in p for p in plans)
    lines = linedup.overlapping(linedup.distinct_texts(docs))._jdf.queryExecution().optimizedPlan().toString()
    assert lines.count("Window [") == lines.count("WindowGroupLimit")


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randrange(200), r.randrange(200)) for _ in range(130)] + [(1, 1), (2, 2)]
    root = list(range(200))

    def find(i):
        return i if root[i] == i else find(root[i])

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    nodes = {n for e in edges if e[0] != e[1] for n in e}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: find(n) for n in nodes}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
