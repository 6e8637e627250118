"""Learned operators by held-out accuracy, pieces by exact round trip, leaks by containment."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import TINY

from runlens.llm import language, leaks, pieces, quality, toxicity
from runlens.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"


def table(spark, name, sf=SMALL):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def area(y, score):
    order = np.argsort(np.argsort(score)) + 1.0
    for s in np.unique(score):
        order[score == s] = order[score == s].mean()
    n = y.sum()
    return (order[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


def held_out(spark, name, label):
    found = QUERIES[name](spark, SMALL)
    assert found.count() == table(spark, "documents").count()
    rows = found.where("held_out").join(table(spark, "labels"), "doc_id").select("score", "predicted", label).toPandas()
    return rows["score"].to_numpy(), rows["predicted"].to_numpy(), rows[label].to_numpy()


def test_language_held_out(spark):
    found = QUERIES["op8_language"](spark, SMALL)
    both = found.join(table(spark, "documents").select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(both) > 300 and (both["lang"] == both["lang_pred"]).mean() > 0.99
    assert both["score"].between(0, 1).all()


def test_language_edges(spark):
    train = spark.createDataFrame([("the cat and the dog", "en"), ("le chat et le chien", "fr"), (None, "fr"), ("x", None)],
                                  "text string, lang string")
    rows = [(1, None, "a"), (2, "", "a"), (3, "12 !", "a"), (4, "the dog", "a"), (4, "the dog", "a"), (None, "le chien", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted((r.doc_id or 0, r.lang_pred) for r in language.identify(df, train).collect())
    assert got == [(0, "fr"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert {r.lang_pred for r in language.identify(df, train.where("false")).collect()} == {"und"}
    assert language.identify(df.where("false"), train).count() == 0


def test_language_score_by_hand():
    """The batched sums equal the sum over a text's n-grams."""
    rng = np.random.default_rng(1)
    table = rng.normal(size=(language.LENGTHS * language.BUCKETS, 2)).astype(np.float32)
    names, prior, texts = ["a", "b"], np.log([0.5, 0.5]), ["Hello wörld", "", None, "x", "longer text here"]
    best, sure = language.score(texts, names, table, prior)
    for i, t in enumerate(texts):
        if t:
            alone = language.score([t], names, table, prior)
            assert alone[0][0] == best[i] and alone[1][0] == sure[i]


def test_quality_held_out(spark):
    score, predicted, y = held_out(spark, "op5_quality", "quality")
    assert area(y, score) > 0.9 and (predicted == y).mean() > 0.93
    assert ((score >= 0) & (score <= 1)).all() and (predicted == (score >= 0.7)).all()


def test_isotonic_is_the_best_monotone_fit():
    rng = random.Random(3)
    y = np.array([rng.random() + i / 20 for i in range(30)])
    w = np.array([rng.randint(1, 5) for _ in range(30)], float)
    fit = quality.isotonic(y, w)
    assert (np.diff(fit) >= -1e-12).all()
    for i in range(30):  # minimax formula
        want = max(min((y[a : b + 1] * w[a : b + 1]).sum() / w[a : b + 1].sum() for b in range(i, 30)) for a in range(i + 1))
        assert abs(fit[i] - want) < 1e-9


def test_quality_edges(spark):
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (2, "", 0), (None, "some words here.", 0)], "doc_id long, text string, x int")
    labels = spark.createDataFrame([(1, 1), (9, 0), (2, None)], "doc_id long, quality int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 4 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.classify(docs, labels.where("false")).collect()} == {0.5}
    assert quality.classify(docs.where("false"), labels).count() == 0


def test_toxicity_held_out(spark):
    score, predicted, y = held_out(spark, "op3_toxicity", "toxic")
    assert area(y, score) > 0.8 and (predicted == y).mean() > 0.93


def test_field_equals_enumeration():
    """Marginals of all state sequences, one by one."""
    from itertools import product

    rng = np.random.default_rng(2)
    line = np.array([0, 0, 0, 0, 1, 2, 2])
    emit, moves = rng.normal(size=7), rng.normal(size=(2, 2))
    chance, ahead, back = toxicity.marginals(emit, line, moves)
    expected = np.zeros(4)
    for k in np.unique(line):
        at = np.flatnonzero(line == k)
        total, hit, moved = 0.0, np.zeros(len(at)), np.zeros(4)
        for states in product((0, 1), repeat=len(at)):
            steps = [2 * a + b for a, b in zip(states, states[1:])]
            p = np.exp(sum(emit[i] * s for i, s in zip(at, states)) + sum(moves.ravel()[s] for s in steps))
            total += p
            hit += p * np.array(states)
            moved += p * np.bincount(steps, minlength=4)
        assert np.allclose(chance[at], hit / total)
        expected += moved / total
    assert np.allclose(toxicity.expected_moves(emit, line, moves, ahead, back), expected)


def test_toxicity_edges(spark):
    rows = spark.createDataFrame([("you idiot now", 1)] * 5 + [("a calm line of text", 0)] * 5, "text string, y int")
    field = toxicity.train(rows)
    docs = spark.createDataFrame([(1, "é you Idiot!\nwell", 1), (2, None, 1), (3, "", 1), (None, "calm", 1)], "doc_id long, text string, y int")
    got = {r.doc_id or 0: (r.score, [(s.start, s.end) for s in r.spans]) for r in toxicity.detect(docs, field).collect()}
    assert any(a <= 6 and b >= 11 for a, b in got[1][1]) and got[1][0] >= got[3][0] == got[2][0]
    none = toxicity.train(rows.where("y = 0"))
    assert {r.score < 0.01 for r in toxicity.detect(docs, none).collect()} == {True}
    assert toxicity.detect(docs.where("false"), field).count() == 0


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


def slow_viterbi(v, text):
    s = (" " + text).encode()
    keys = {}
    for i, x in enumerate(v.texts):
        if v.kinds[i] in (1, 4) and x:
            keys.setdefault(x, i)
    best, back = [0.0] + [-np.inf] * len(s), [None] * (len(s) + 1)
    for a in range(len(s)):
        if best[a] == -np.inf or s[a] & 0xC0 == 0x80:
            continue
        size = 1 + (s[a] >= 0xC0) + (s[a] >= 0xE0) + (s[a] >= 0xF0)
        for e in range(a + 1, min(len(s), a + 60) + 1):
            i = keys.get(s[a:e])
            if i is not None and best[a] + v.scores[i] > best[e]:
                best[e], back[e] = best[a] + v.scores[i], (a, [i])
        if s[a : a + size] not in keys and best[a] + v.unknown > best[a + size]:
            best[a + size], back[a + size] = best[a] + v.unknown, (a, [int(v.byte_ids[b]) for b in s[a : a + size]])
    out, at = [], len(s)
    while at:
        out, at = back[at][1] + out, back[at][0]
    return out


def test_pieces_equal_a_plain_viterbi(vocabulary):
    rng = random.Random(0)
    texts = ["Hello world", "", None, " ", "  a  b ", "▁x ▁▁", "日本語😀 text\n\nnew\tline é"]
    parts = ["the ", "ing", "a", "\n", " ", "▁", "é", "日", "😀", "\x00", "\r", "zq", "ß"]
    texts += ["".join(rng.choices(parts, k=rng.randint(0, 25))) for _ in range(60)]
    ids, ends = pieces.Encoder(vocabulary).encode(texts)
    begin = 0
    for t, end, back in zip(texts, ends, pieces.decode(ids, ends, vocabulary)):
        assert ids[begin:end].tolist() == (slow_viterbi(vocabulary, t) if t else [])
        assert back.decode() == (t or "")
        begin = end


def test_pieces_of_the_tables(spark):
    texts = {r.doc_id: r.text for r in table(spark, "documents", TINY).collect()}
    import hashlib

    for r in QUERIES["op7_pieces"](spark, TINY).collect():
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.n_pieces == len(r.ids)


def test_pieces_edges(spark, vocabulary):
    df = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "x" * 50_000)], "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.ids is None, r.decoded) for r in pieces.encode_texts(df, vocabulary).collect()), key=lambda x: x[0])
    assert got == [(0, False, "x" * 50_000), (1, True, None), (2, False, ""), (2, False, "")]
    assert pieces.encode_texts(df.where("false"), vocabulary).count() == 0


def test_leaks_hold_what_documents_contain(spark):
    docs, items = table(spark, "documents"), table(spark, "benchmark")
    got = {(r.doc_id, r.item_id) for r in leaks.find_leaks(docs, items).collect()}
    bench = [(r.item_id, r.text) for r in items.collect()]
    whole = {(r.doc_id, k) for r in docs.collect() for k, t in bench if t in r.text}
    assert whole and len(got & whole) >= 0.9 * len(whole)
    assert len(got - whole) <= 0.05 * len(whole)


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = 0
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
        return row[-1]

    rng = random.Random(8)
    for _ in range(200):
        a, b = ([rng.randrange(5) for _ in range(rng.randint(1, 30))] for _ in range(2))
        masks = {x: sum(1 << i for i, y in enumerate(a) if y == x) for x in a}
        assert leaks.common_subsequence(masks, len(a), b) == plain(a, b)


def test_leaks_edges(spark):
    item = "seven little words make one short benchmark question here. The answer is blue"
    docs = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, f"before that. {item} and after", 0), (3, f"x {item}", 0), (None, item, 0)],
                                 "doc_id long, text string, item_id int")
    items = spark.createDataFrame([(7, item), (7, item), (8, None), (9, "")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id) for r in leaks.find_leaks(docs, items).collect())
    assert got == [(0, 7), (3, 7)]
    assert leaks.find_leaks(docs, items.where("false")).count() == 0
    assert leaks.find_leaks(docs.where("false"), items).count() == 0


def test_leak_space_is_fitted_on_every_passage(spark):
    docs = spark.range(3200).selectExpr("if(id = 0, null, id) as id", "concat('w', id) as text")
    long = spark.range(2).selectExpr("id + 5000 as id", "array_join(transform(sequence(1, 640), i -> concat('v', id, 'x', i)), ' ') as text")
    frequency, size, sketch = leaks.corpus_statistics(docs.unionByName(long).repartition(5))
    assert size == 3202 and frequency.sum() >= 3200 + 2 * 600
    # a passage of one word is 1 in a cell, one of 64 has 64 cells of an eighth; few of them meet in a cell
    assert abs(abs(sketch).sum() - (3200 + 2 * 10 * 8)) < 40
    # all directions of few passages are kept
    items = np.eye(leaks.BUCKETS)[:3]
    basis = leaks.latent_space(items, np.eye(leaks.SKETCH, leaks.BUCKETS, 7) * (np.arange(leaks.SKETCH) < 4)[:, None], np.ones(leaks.BUCKETS))
    assert basis.shape[1] == 7 and np.allclose(basis.T @ basis, np.eye(7))


def planted_leaks():
    """Documents of over 400 words that each hold one item word for word, and the items, by length; common words only last."""
    rng = random.Random(12)
    vocab = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(4000)]
    common, heavy = vocab[:40], [1 / (k + 10) for k in range(4000)]
    docs, items, sizes = [], [], {}
    for n in (5, 8, 10, 15, 30, 64, 200, 1000, -12):
        for _ in range(15 if n < 200 else 4):
            item = rng.choices(common, k=-n) if n < 0 else rng.choices(vocab, heavy, k=n)
            text = rng.choices(vocab, heavy, k=450)
            at = rng.randrange(450)
            sizes[len(docs)] = n
            items.append((len(docs), " ".join(item)))
            docs.append((len(docs), " ".join(text[:at] + item + text[at:])))
    return docs, items, sizes


def test_runs_held_by_table_and_by_lookup():
    docs, items, _ = planted_leaks()
    runs = leaks.item_runs(pa.array([t for _, t in items]))
    w, _ = leaks._split(pa.array([t for _, t in docs] + ["", "a b", " ".join(t for _, t in items[:40])]))
    blocks = leaks._blocks(w, leaks.STRIDE)
    one = leaks.held_runs(runs, runs.table(), w, *blocks)
    other = leaks.held_runs(runs, None, w, *blocks)
    assert set(zip(*map(list, one))) == set(zip(*map(list, other))) and len(one[0]) >= len(docs)


def test_leaks_of_every_length_are_found(spark):
    docs, items, sizes = planted_leaks()
    docs = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    found = leaks.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    missed = set(sizes) - {r.doc_id for r in found if r.doc_id == r.item_id}
    assert sorted(sizes[i] for i in missed) == []
