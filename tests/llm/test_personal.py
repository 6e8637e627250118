import random
import re

import pyarrow.parquet as pq
from conftest import TINY

from runlens.llm import personal
from runlens.llm.queries import QUERIES


def base(t):
    def digits(x):
        return re.sub("[^0-9]", "", x)

    return {
        "email": [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)],
        "ip": [
            m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
            if all(int(x) <= 255 for x in m[0].split("."))
        ],
        "card": [
            m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
            if 16 <= len(digits(m[0])) <= 19 and personal.luhn(digits(m[0]))
        ],
        "phone": [
            m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= len(digits(m[0])) <= 15
        ],
    }


def test_base_kinds_equal_the_patterns():
    rng = random.Random(5)
    parts = ["a", "@", ".", "-", "+", "1", "25", "4 ", "(", ")", " ", "é", "x.y", "4111 1111 1111 1111", "٣", "\n", "_%"]
    for _ in range(20_000):
        t = "".join(rng.choices(parts, k=rng.randint(0, 24)))
        found, want = personal.find(t), base(t)
        assert {k: found[k] for k in personal.BASE} == want, t


def test_added_kinds():
    t = "IBAN: DE89 3704 0044 0532 0130 00, acct no. 1234-5678 see https://a.b/c?d. é"
    found = personal.find(t)
    assert [t[a:b] for a, b in found["url"]] == ["https://a.b/c?d"]
    assert [t[a:b] for a, b in found["account"]] == ["DE89 3704 0044 0532 0130 00", "1234-5678"]


def test_query_on_whole_texts(spark):
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{TINY}/documents.parquet").to_pylist()}
    got = QUERIES["op6_personal_data"](spark, TINY).collect()
    assert len(got) == len(texts)
    for r in got:
        want = base(texts[r.doc_id] or "")
        joined = ",".join(f"{k}:{a}:{b}" for k in personal.BASE for a, b in want[k])
        assert [r[f"n_{k}"] for k in personal.BASE] == [len(want[k]) for k in personal.BASE]
        assert r.base_sha256 == personal.sha256(joined)


def test_edges(spark):
    rows = [(1, None, "x"), (2, "", "x"), (2, "", "x"), (None, "a@b.c", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = sorted((r.doc_id or 0, len(r.spans)) for r in personal.find_personal(df).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (2, 0)]
    assert personal.find_personal(df.where("false")).count() == 0
    assert personal.find("1" * 100_000 + "@a.b")["email"] == [(0, 100_004)]
