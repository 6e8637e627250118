"""Substrings, n-gram join, vectors and lines against brute force, and their edge cases."""

import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import TINY

from runlens.llm import lines, ngram_join, substrings, vectors
from runlens.llm.tables import components, prepare, stored

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def without_repeats(rows, size):
    seen, out = set(), {}
    for i, w in sorted((i, WORD.findall(t or "")) for i, t in rows):
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            if key in seen:
                gone[p : p + size] = [True] * size
            seen.add(key)
        out[i] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def jaccard_groups(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[p : p + 5]) for p in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent, holders = {i: i for i in sets}, defaultdict(list)
    for i in sorted(sets):
        shared = Counter(j for t in sets[i] for j in holders[t])
        for j, n in shared.items():
            if 5 * n >= 4 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((find(parent, i), find(parent, j)))
                parent[b] = a
        for t in sets[i]:
            holders[t].append(i)
    return {i: (len(s), find(parent, i)) for i, s in sets.items()}


def documents(spark, sf=TINY):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_substrings_small(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choices("ab", k=rng.choice([0, 1, 3, 10, 60])))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "a b\ta  b\na b a b é ü")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeated(df, size=4).collect()}
    assert got == without_repeats(rows, 4)


def test_substrings_of_the_tables(spark):
    df = documents(spark)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in substrings.remove_repeated(df.repartition(4)).collect()}
    assert got == without_repeats([(r.doc_id, r.text) for r in df.collect()], 20)


def test_substrings_edges(spark):
    df = spark.createDataFrame([(None, "a b c d", 1), (5, "a b c d", 1), (5, "a b c d", 1)], "doc_id long, text string, id int")
    got = sorted((r.doc_id or 0, r.n_removed) for r in substrings.remove_repeated(df, size=3).collect())
    assert got == [(0, 0), (5, 4), (5, 4)]
    assert substrings.remove_repeated(df.where("false")).count() == 0


def test_rows_without_id_are_judged_one_by_one(spark):
    first, other = " ".join(f"w{i}" for i in range(40)), " ".join(f"v{i}" for i in range(40))
    again = "a b c d e " + " ".join(first.split()[:15])
    rows = [(None, first), (None, f"short {other}"), (None, again), (None, "only five words are here"), (7, other)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in substrings.remove_repeated(df, size=4).collect())
    assert got == [(0, 5, 0), (0, 20, 15), (0, 40, 0), (0, 41, 0), (7, 40, 40)]
    line, new = "this line is in two of the texts", "these words are of the {} text and nothing like others {}"
    texts = [f"{line}\n{new.format('first', first)}", f"{new.format('second', other)}\n{line}", f"clean one {first[80:120]}\n{other[80:]}"]
    df = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string").coalesce(1)
    got = {r.text for r in lines.dedup_lines(df).collect()}
    assert got == {texts[0], texts[1].split("\n")[0], texts[2]}


@pytest.mark.parametrize("frequent", [3, 50])
def test_ngram_groups_small(spark, frequent):
    """With a low bound nearly all tokens are frequent: the combinations must find the groups."""
    rng = random.Random(2)
    base = [[rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(n)] for n in (3, 5, 6, 8, 12, 30, 60, 120)]
    rows = []
    for i in range(400):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = rng.choice(["q", "R", "zz", "Z"])
        rows.append((i, " ".join(w + (rng.choice(base)[: rng.randint(0, 6)] if rng.random() < 0.3 else []))))
    rows += [(700, None), (701, ""), (702, " \n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df, frequent=frequent).collect()}
    assert got == jaccard_groups(rows)


def test_ngram_groups_of_edited_copies(spark, monkeypatch):
    """Copies of one text that lie apart from each other meet at the least edited; the rest is compared by marks."""
    compared = []
    verified = ngram_join.verified
    monkeypatch.setattr(ngram_join, "verified", lambda pairs, *rest: compared.append(pairs.count()) or verified(pairs, *rest))
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = [(500, " ".join(base))]
    for i in range(300):
        w = list(base)
        for at in rng.sample(range(150), rng.choice([1, 2, 3, 4, 5, 7])):
            w[at] = f"x{rng.random()}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df).collect()}
    assert got == jaccard_groups(rows)
    assert 1 < len({c for _, c in got.values()}) and sum(compared) < 10 * len(rows)


def test_ngram_marks_never_exceed_the_difference():
    rng = np.random.default_rng(3)
    for size in (1, 5, 80, 900):
        a = rng.integers(0, 1 << 62, size, np.uint64)
        b = np.unique(np.concatenate([a[: size // 2], rng.integers(0, 1 << 62, size // 3, np.uint64)]))
        owner = np.repeat([0, 1], [len(a), len(b)])
        m = ngram_join.marks(owner, np.concatenate([a, b]), 2)
        differ = sum(int(x).bit_count() for x in (m[0] ^ m[1]).view(np.uint64))
        assert differ <= len(np.setxor1d(a, b)) and (size < 80 or differ > 0)


def test_ngram_groups_of_the_tables(spark):
    df = documents(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.groups(df).collect()}
    assert got == jaccard_groups([(r.doc_id, r.text) for r in df.collect()])


def test_ngram_edges(spark):
    df = spark.createDataFrame([(None, "a b c d e", 1), (5, "A b c d e", 1), (5, "A b c d e", 1), (4, "a b c d e", 2)],
                               "doc_id long, text string, component_id int")
    assert sorted(map(tuple, ngram_join.groups(df).collect()), key=str) == [(4, 1, 4), (5, 1, 4), (None, 1, None)]
    assert ngram_join.groups(df.where("false")).count() == 0


def linked_vectors(rows, least=0.98):
    ok = {
        i: np.array(v, float) for i, (_, v, label) in enumerate(rows)
        if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
    }
    parent, n = list(range(len(rows))), [0] * len(rows)
    for i in ok:
        for j in ok:
            if j < i and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]):
                if ok[i] @ ok[j] / np.linalg.norm(ok[i]) / np.linalg.norm(ok[j]) >= least:
                    n[i], n[j] = n[i] + 1, n[j] + 1
                    a, b = sorted((find(parent, i), find(parent, j)), key=lambda k: rows[k][0])
                    parent[b] = a
    return {rows[i][0]: (n[i], rows[find(parent, i)][0]) for i in range(len(rows))}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    rows = []
    for c in range(10):
        p = rng.normal(size=16)
        for _ in range(20):
            q = np.float32(p + rng.normal(size=16) * rng.choice([0, 0.02, 0.15, 0.2]))
            rows.append((len(rows) * 7 % 1000, [float(x) for x in q], c % 3))
    nan, inf = float("nan"), float("inf")
    rows += [(1001, None, 1), (1002, [0.0] * 16, 1), (1003, [1.0, None] + [0.0] * 14, 1), (1004, [nan] * 16, 1)]
    rows += [(1005, [inf] + [1.0] * 15, 1), (1006, rows[0][1], None), (1007, [1.0, 2.0], 1), (1008, [1.0, 2.0], 1), (1009, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(4)
    got = {r.vec_id: (r.n_links, r.component_id) for r in vectors.links(df).collect()}
    assert got == linked_vectors(rows)
    assert vectors.links(df.where("false")).count() == 0


def test_vectors_that_share_an_id(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    rows = [(1, a, 1), (1, b, 2), (2, [1.0, 0.01, 0.0], 1), (3, [0.01, 1.0, 0.0], 2), (5, a, 3), (5, [1.0, 0.02, 0.0], 3), (5, None, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = sorted(map(tuple, vectors.links(df).collect()))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (5, 0, 5, True), (5, 1, 5, True), (5, 1, 5, True)]


def test_vector_recall():
    """Pairs at exactly the bound share a bucket."""
    rng = np.random.default_rng(0)
    a, o = rng.normal(size=(2, 1000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o -= (o * a).sum(axis=1)[:, None] * a
    b = 0.98 * a + np.sqrt(1 - 0.98**2) * o / np.linalg.norm(o, axis=1)[:, None]
    hit = np.zeros(1000, bool)
    for table in range(vectors.TABLES):
        x, y = vectors.buckets(a, table), vectors.buckets(b, table)
        hit |= (x[:, :1] == y).any(axis=1) | (y[:, :1] == x).any(axis=1)
    assert hit.mean() >= 0.999


def test_components(spark):
    rng = random.Random(4)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000, x) for x in range(1001, 1400)]
    links += [(x, x + 1) for x in range(2000, 2100)]
    parent = {x: x for x in [*range(300), *range(1000, 1400), *range(2000, 2101)]}
    for a, b in links:
        a, b = sorted((find(parent, a), find(parent, b)))
        parent[b] = a
    nodes = spark.createDataFrame([(x,) for x in parent], "id long")
    got = dict(map(tuple, components(nodes, spark.createDataFrame(links, "a long, b long")).collect()))
    assert got == {x: find(parent, x) for x in parent}


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines(spark):
    """One line of every group stays, groups by brute force over the distinct lines; 90 % of the rest go at least."""
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(400)]
    long = [" ".join(rng.choices(words, k=12)) for _ in range(12)]
    rows = []
    for i in range(30):
        own = []
        for _ in range(4):
            w = rng.choice(long).split()
            if rng.random() < 0.3:
                w[rng.randrange(12)] = "other"
            own.append(" ".join(w).upper() + "." if rng.random() < 0.3 else " ".join(w))
        rows.append((i, "\n".join([*own, "too short", ""])))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = {r.doc_id: r.text.split("\n") for r in lines.dedup_lines(df).collect()}
    distinct = sorted({" ".join(re.findall("[a-z]+", x.lower())) for _, t in rows for x in t.split("\n")[:-2]})
    parent = {x: x for x in distinct}
    for i, x in enumerate(distinct):
        for y in distinct[:i]:
            if levenshtein(x, y) <= 0.2 * max(len(x), len(y)):
                parent[find(parent, x)] = find(parent, y)
    groups = len({find(parent, x) for x in distinct})
    left = [x for v in kept.values() for x in v if len(x.split()) >= 4]
    assert groups < len(distinct) < 4 * len(rows)
    assert groups <= len(left) <= groups + 0.1 * (len(distinct) - groups)
    assert len({" ".join(re.findall("[a-z]+", x.lower())) for x in left}) == len(left)
    assert all("too short" in v for v in kept.values())


def test_near_lines_are_found_at_ordinary_lengths(spark):
    """Pairs of lines of 5 to 50 words with an edit similarity of 0.8 or more, by brute force: 95 % and more are found."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    rows, near = [], Counter()
    for n in (5, 8, 10, 15, 20, 30, 50):
        while near[n] < 60:
            w = rng.choices(words, k=n)
            other = list(w)
            for _ in range(rng.randint(1, max(1, n // 6))):
                at = rng.randrange(n)
                if rng.random() < 0.5:
                    other[at] = rng.choice(words)
                else:
                    other[at] = other[at][:-1] + "q"
            a, b = " ".join(w), " ".join(other)
            if a != b and levenshtein(a, b) <= 0.2 * max(len(a), len(b)):
                near[n] += 1
                rows += [(len(rows), a), (len(rows) + 1, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    gone = {r.doc_id for r in lines.dedup_lines(df).where("text = ''").collect()}
    assert not any(i % 2 == 0 for i in gone)
    size = {i: len(t.split()) for i, t in rows}
    found = Counter(size[i - 1] for i in gone)
    assert {n: found[n] for n in near if found[n] < 0.95 * near[n]} == {}


def test_unlike_lines_under_a_frequent_key_are_not_paired(spark, monkeypatch):
    """Lines with a common pair of words only: pairs to verify stay in proportion to the lines."""
    rng = random.Random(12)
    rows = [(i, "of the " + " ".join("".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(3))) for i in range(600)]
    near = [(1000 + i, t[:-1] + "z") for i, t in rows[:40]]
    seen, join = [], lines.links_through_keys

    def counted(entries, fits, prepare, *close):
        def prepared(nodes):
            found = prepare(nodes)
            verify = found[0] if isinstance(found, tuple) else found

            def check(pairs):
                seen.append(pairs.count())
                return verify(pairs)

            return (check, *found[1:]) if isinstance(found, tuple) else check

        return join(entries, fits, prepared, *close)

    monkeypatch.setattr(lines, "links_through_keys", counted)
    df = spark.createDataFrame(rows + near, "doc_id long, text string").repartition(4)
    gone = {r.doc_id for r in lines.dedup_lines(df).where("text = ''").collect()}
    assert gone == {i for i, _ in near}
    assert sum(seen) < 4 * len(rows)


def test_lines_of_rows_that_share_an_id(spark):
    line = "some line with enough words in it to count"
    rows = [(1, f"own\n{line}"), (1, "short"), (2, f"{line}s"), (3, f"{line}ed")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text) for r in lines.dedup_lines(df).collect())
    assert got == [(1, f"own\n{line}"), (1, "short"), (2, ""), (3, "")]


def test_edit_check_of_large_lines(spark):
    """Parts settle copies, the whole distance the rest: as by the built-in distance alone."""
    rng = random.Random(13)
    pairs = []
    for share in (0.0, 0.02, 0.1, 0.17, 0.19, 0.2, 0.21, 0.24, 0.5):
        a = "".join(rng.choices("abcdef é", k=rng.randint(2100, 2600)))
        b = "".join(rng.choice(["", "xx", "y"]) if rng.random() < share else c for c in a)
        pairs += [(a, b), (a, "q" * rng.randint(0, 300) + b), (a, a[::-1])]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.selectExpr(lines._near("a", "b"), "levenshtein(a, b) <= 0.2 * greatest(length(a), length(b)) + 1e-9").collect()
    assert all(x == y for x, y in got) and {x for x, _ in got} == {True, False}


def test_edit_check_by_words_and_beginnings(spark):
    """A distance by whole words is never below the edit distance and settles lines with other, more or fewer words; all checks agree."""
    rng = random.Random(14)
    words = ["".join(rng.choices("abcdeéf", k=rng.randint(1, 9))) for _ in range(300)]
    pairs = []
    for i in range(150):
        a = rng.choices(words, k=rng.randint(1, 120))
        b = list(a)
        for _ in range(rng.choice([0, 1, 3, len(a) // 6, len(a) // 3, len(a)])):
            at = rng.randrange(len(b))
            b[at : at + 1] = rng.choice([[rng.choice(words)], [b[at][1:] + "e"], [b[at], rng.choice(words)], []]) or b[:1]
        pairs += [(" ".join(a), " ".join(b)), (" ".join(a), " ".join(rng.choices(words, k=len(a))))]
    one = rng.choices(words, k=80)
    pairs += [(" ".join(one), " ".join([*one[:30], "some", "more", "words", *one[30:79], "x"])), ("", "a"), ("a", "a")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = df.selectExpr(
        lines._near("a", "b"), "levenshtein(a, b) <= 0.2 * greatest(length(a), length(b)) + 1e-9", f"{lines._by_words('a', 'b')} as w",
        f"{lines._by_words('b', 'a')} as v", "levenshtein(a, b) as d",
    ).collect()
    assert all(x == y and w == v >= d for x, y, w, v, d in got) and {r[0] for r in got} == {True, False}
    assert got[-3].w < 40 and sum(r.w < 2 * r.d + 1 for r in got if r[0]) > 0.5 * sum(r[0] for r in got)


def test_shuffle_files_go_with_their_query(spark):
    """What a stored step has shuffled is gone soon after it, while the session goes on."""
    prepare(spark)

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", files))

    before = shuffled()
    made = stored(spark.range(0, 100_000, 1, 8).repartition(7, "id").groupBy("id").count(), "shuffled")
    for _ in range(100):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before and made.count() == 100_000


def test_repeats_of_short_lines(spark):
    rows = [(1, "Too short\n这一行没有空格但是很长也会重复出现\n---\n\n \nonce"), (2, "too  short!\n这一行没有空格但是很长也会重复出现\n---\n\n \nsecond")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.text for r in lines.dedup_lines(df, every=True).collect()} == {1: rows[0][1], 2: "\n \nsecond"}


def test_lines_keep_columns_with_names_of_their_own(spark):
    line = "some line with enough words in it to count"
    df = spark.createDataFrame([(1, line, 7, "x"), (2, line, 8, "y")], "doc_id long, text string, line_row int, removed_lines string")
    got = sorted(lines.dedup_lines(df).collect())
    assert [tuple(r) for r in got] == [(1, line, 7, None), (2, "", 8, [0])]
    other = lines.dedup_lines(df, removed_col="gone")
    assert sorted((r.line_row, r.removed_lines, r.gone) for r in other.collect()) == [(7, "x", None), (8, "y", [0])]


def test_lines_edges(spark):
    line = "some line with enough words in it to count"
    rows = [(None, line, 1), (3, None, 1), (4, "", 1), (5, f"{line}!\nown\n", 1), (5, f"{line}!\nown\n", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, place int")
    got = sorted((r.doc_id or 0, r.text or "", r.place) for r in lines.dedup_lines(df).collect())
    assert got == [(0, line, 1), (3, "", 1), (4, "", 1), (5, "own\n", 1), (5, "own\n", 1)]
    assert lines.dedup_lines(df.where("false")).count() == 0
