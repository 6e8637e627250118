"""Fingerprints, collocations and ranked search against brute force, and their odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from conftest import TINY

from runlens.llm import collocations as col
from runlens.llm import fingerprints as fp
from runlens.llm import ranked
from runlens.llm.tables import prepare

MASK = (1 << 64) - 1


@pytest.fixture(autouse=True)
def workers(spark):
    prepare(spark)


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def hash_long(value, seed=42):
    return xxhash.xxh64_intdigest((value & MASK).to_bytes(8, "little"), seed)


def samples(text):
    """The samples of a text by the formulas, one by one."""
    terms = Counter(xxhash.xxh64_intdigest(w.encode(), 42) & ~1 for w in re.findall(r"[a-z0-9\x80-\U0010FFFF]+", (text or "").lower()))
    if not terms:
        return ""
    out = []
    for d in range(fp.SAMPLES):
        best = None
        for term, w in terms.items():
            first = hash_long(term)
            a, b = (xxhash.xxh64_intdigest((2 * d + k).to_bytes(4, "little"), first) for k in (0, 1))
            x, y, v, z = (((half & 0xFFFFFFFF) + 0.5) * 2.0**-32 for bits in (a, b) for half in (bits, bits >> 32))
            r, c, u = -math.log(x * y), -math.log(v * z), math.log(x) / math.log(x * y)
            t = math.floor(math.log(w) / r + u)
            worth = c * y if t == 0 else c * math.exp(-r * (t - u + 1))
            best = worth if best is None else min(best, worth)
        out.append(hash_long(int(best * 2.0**40)) & 0xFFFFFFFF)
    return "".join(f"{x:08x}" for x in out)


def signed_rows(df):
    return df.select(
        "id", "n_chars", "edited_sha256", fp.fingerprint("own_signature").alias("own"), fp.fingerprint("edited_signature").alias("edited"),
        fp.likeness("own_signature", "edited_signature").alias("near_edited"), fp.likeness("own_signature", "next_signature").alias("near_next"),
    ).collect()


def expected(rows):
    """rows: (id, text) in the order of succession."""
    out = []
    for k, (i, text) in enumerate(rows):
        text, after = text or "", rows[(k + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other, nxt = samples(text), samples(edited), samples(after)

        def like(a, b):
            return 1.0 if a == b == "" else 0.0 if "" in (a, b) else sum(a[j : j + 8] == b[j : j + 8] for j in range(0, len(a), 8)) / fp.SAMPLES

        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, other, like(own, other), like(own, nxt)))
    return out


def test_fingerprints_follow_the_formulas(spark):
    rng = random.Random(3)
    words = ["alpha", "Beta", "gämma", "δ", "42", "omega", "x"]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40])))) for i in range(0, 60, 3)]
    rows += [(100, None), (101, ""), (102, "!!! ..."), (103, "😀😀 alpha"), (None, "last of all")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    order = sorted((r for r in rows if r[0] is not None), key=lambda r: -r[0]) + [rows[-1]]
    assert Counter(map(tuple, signed_rows(fp.compare_with_edited(df)))) == Counter(expected(order))


@pytest.mark.parametrize("rows_a_range", [1, 2, 7])
def test_successors_over_range_bounds(spark, monkeypatch, rows_a_range):
    monkeypatch.setattr(fp, "RANGE_ROWS", rows_a_range)
    rows = [(i, f"text number {i}") for i in (-5, 0, 1, 2, 3, 10, 11, 12, 500, 10**12)] + [(7, f"copy {k}") for k in range(9)]
    rows += [(None, "a"), (None, "b"), (3, "text number 3")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(4)
    got = fp.with_next(df, "id").where("own").collect()
    assert Counter((r.id, r.text) for r in got) == Counter(rows)

    def key(i, text):
        return (i is not None, i or 0, signed(xxhash.xxh64_intdigest(text.encode(), 42)))

    order = sorted(rows, key=lambda r: key(*r), reverse=True)
    want = Counter((a[0], a[1], b[1]) for a, b in zip(order, [*order[1:], order[0]], strict=True))
    assert Counter((r.id, r.text, r.next_text) for r in got) == want


def test_fingerprint_edges_and_similarity(spark):
    one = spark.createDataFrame([(1, "only a b c", 5)], "doc_id long, text string, n_chars long")
    assert [tuple(r)[:2] for r in signed_rows(fp.compare_with_edited(one))] == [(1, 10)]
    assert signed_rows(fp.compare_with_edited(one.where("false"))) == []
    # the share of equal samples follows the generalised Jaccard similarity; every pair has words of
    # its own, because the samples of a word are the same in all pairs
    rng, errors = random.Random(5), []
    texts = [[f"p{i}w{rng.randrange(300)}" for _ in range(200)] for i in range(80)]
    rows = []
    for i, w in enumerate(texts):
        keep = rng.randrange(200)
        rows += [(2 * i + 1, " ".join(w)), (2 * i, " ".join(w[:keep] + [f"p{i}w{rng.randrange(300)}" for _ in range(200 - keep)]))]
    near = {r.id: r.near_next for r in fp.compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string")).select("id", fp.likeness("own_signature", "next_signature").alias("near_next")).collect()}
    text = dict(rows)
    for i in range(80):
        a, b = Counter(text[2 * i + 1].split()), Counter(text[2 * i].split())
        errors.append(near[2 * i + 1] - sum((a & b).values()) / sum((a | b).values()))
    print(sum(errors) / 80, (sum(e * e for e in errors) / 80) ** 0.5)
    assert abs(sum(errors) / 80) < 0.02 and (sum(e * e for e in errors) / 80) ** 0.5 < 0.075


def brute_collocations(rows, least, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", low):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cands = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in cands.items():
        if any(100 * b >= 50 * a for (g, q), b in cands.items() if g == lang and len(q) > len(p) and p in (q[:2], q[1:])):
            continue
        cuts = [(10**6 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return [
        (lang, i, ph.decode(), -a, left, right, n[lang], -s)
        for lang, found in out.items() for i, (s, a, ph, left, right) in enumerate(sorted(found)[:top], 1)
    ]


@pytest.mark.parametrize("entries", [1 << 20, 40])
def test_collocations(spark, entries):
    rng = random.Random(1)
    words = ["A", "b", "c", "é", "de", "x-y", "\x0bz", "q\x00", "long" * 20]
    rows = []
    for _ in range(60):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", ". ", ", ", "\n", "  "]) for _ in range(rng.choice([0, 1, 2, 30])))
        rows.append((text, rng.choice(["en", "fr", None, ""])))
    rows += [(None, "en"), ("", None), ("new york new york city " * 30, "en"), ("B c " * 400, "de")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "text string, lang string, rank int").repartition(5)
    got = [tuple(r) for r in col.collocations(df, least=4, top=15, entries=entries).collect()]
    assert sorted(got) == sorted(brute_collocations(rows, 4, 15))


def test_collocations_of_nothing(spark):
    df = spark.createDataFrame([(None, None), ("", "x"), ("a b", "x")], "text string, lang string")
    assert col.collocations(df).collect() == [] and col.collocations(df.where("false")).collect() == []


def brute_ranks(docs, items, top):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    tf = [Counter(term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))) for _, t in docs]
    n_docs, total = sum(1 for t in tf if t), sum(sum(t.values()) for t in tf)
    df = Counter(w for t in tf for w in t)
    out = []
    for item, text in set(items):
        asked = set(term.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
        scored = []
        for (i, _), t in zip(docs, tf, strict=True):
            m = 50 + 50 * sum(t.values()) * n_docs // max(total, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (10**9 * t[w] // (1000 * t[w] + 20 * m)) for w in asked if w in t)
            if score > 0:
                scored.append((-score, i is None, i or 0))
        out += [(item, k, None if none else i, -s) for k, (s, none, i) in enumerate(sorted(scored)[:top], 1)]
    return out


@pytest.mark.parametrize(("postings", "at_once", "top"), [(1 << 21, 1 << 16, 50), (60, 9, 5), (200, 40, 3)])
def test_ranked(spark, monkeypatch, postings, at_once, top):
    monkeypatch.setattr(ranked, "BLOCK", 4)
    monkeypatch.setattr(ranked, "WINDOW", 8)
    rng = random.Random(2)
    words = ["the", "The", "of", *[f"w{k}" for k in range(25)], "über", "中文", "a_b"]
    weights = [30, 10, 20, *[25 / (k + 1) for k in range(25)], 1, 1, 2]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.choice([0, 1, 3, 20, 200])))) for i in range(150)]
    docs += [(3, "w1 w2"), (None, "w1 w2"), (None, None), (7, ""), (8, "..."), (9, docs[0][1])] + [(500 + k, "w24 tie") for k in range(9)]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 4, 12])))) for i in range(12)] + [(3, "other w2"), (None, "w24"), (50, None), (51, "unseen")]
    items += items[:2]
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, score int").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = ranked.rank(d, q, top, postings=postings, query_terms_at_once=at_once).collect()
    assert Counter((r["item"], r["rank"], r["id"], r["score"]) for r in got) == Counter(brute_ranks(docs, items, top))


def test_ranked_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked.rank(d.where("false"), q).count() == 0 and ranked.rank(d, q.where("false")).count() == 0


def test_block_maxima_spare_blocks(spark, monkeypatch):
    """Most blocks of a long non-essential list are never unpacked."""
    monkeypatch.setattr(ranked, "WINDOW", 64)
    docs = spark.read.parquet(f"{TINY.replace('0.001', '0.01')}/documents.parquet").selectExpr("doc_id as id", "text")
    n, total = ranked.corpus_size(docs)
    rows = ranked.build(docs.coalesce(1), n, total).toArrow().to_pydict()
    import numpy as np

    head = rows["term"].index(None)
    m, ids = (np.frombuffer(rows[c][head], np.int64) for c in ("last", "body"))
    lists = [ranked.Postings(*(rows[c][k] for c in ("top", "last", "best", "at", "body")), m) for k in np.argsort([-x for x in rows["df"]])[1:400]]
    rare = lists[-1]
    got, _ = ranked.best_of_shard([(1, p) for p in lists[:3]] + [(1000, rare)], ids, np.ones(len(ids), bool), 3)
    assert len(got) == 3 and any(len(p.known) < len(p.last) for p in lists[:3])
