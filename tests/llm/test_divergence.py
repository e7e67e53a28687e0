"""Source divergence: kept terms against counting, all rows against the SQL, and edge cases."""

import collections
import random
import re

import duckdb
import pyarrow as pa
import pytest

from tabflow.llm import divergence as d
from tabflow.llm.queries import SQL
from tests.oracle import _rows

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain_kept(rows, least=3):
    """(lang, term) by plain counting."""
    n = collections.Counter()
    for _, text, lang, *_ in rows:
        n.update({(lang or "", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in TERM.findall(text or "")})
    return sorted(k for k, v in n.items() if v >= least)


@pytest.mark.parametrize("slice_bytes", [1, 3000, 1 << 24])
def test_refinement_keeps_what_counting_keeps(spark, docs, rows, slice_bytes):
    long = [(500 + i, "a" * 300 + "b" * (i % 2) + " Zz" + "É" * 40, "en", "a") for i in range(5)]
    more = docs.select("doc_id", "text", "lang", "source").unionByName(spark.createDataFrame(long, "doc_id long, text string, lang string, source string"))
    kept = d.kept_terms(d.slices_of(more, 3, slice_bytes), 3)
    got = sorted((r.lang, bytes(r.term)[:-1].decode()) for r in kept.collect())
    assert got == plain_kept([*rows, *long])


def test_a_slice_counts_the_documents_of_each_prefix(spark):
    """Numbers that add up over slices: no document numbers are handed on, spread and counted apart."""
    rng = random.Random(7)
    long = ["".join(rng.choice("ab") for _ in range(n)) * 3 for n in (1, 2, 3, 4, 6, 9, 12) for _ in range(4)]
    texts = [(rng.choice(["en", "fr"]), " ".join(rng.choices(long, k=6))) for _ in range(30)]
    cut = d.slices_of(spark.createDataFrame([(*t, "s") for t in texts], "lang string, text string, source string").coalesce(1), 5)
    got, want = collections.Counter(), collections.defaultdict(set)
    for r in cut.collect():
        assert len(r.docs) == next(k for k in range(9) if len(r.term) <= d.FIRST << k) + 1
        for k, n in enumerate(r.docs):
            got[r.lang, k, bytes(r.term)[: d.FIRST << k]] += n
    for i, (lang, text) in enumerate(texts):
        for term in (t.encode() + b"\0" for t in text.split()):
            for k in range(next(k for k in range(9) if len(term) <= d.FIRST << k) + 1):
                want[lang, k, term[: d.FIRST << k]].add(i)
    assert got == {key: min(len(ids), 5) for key, ids in want.items()}


def _want(frame):
    pandas = frame.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841  read by DuckDB
    found = duckdb.connect().execute("WITH documents AS (SELECT * FROM pandas) SELECT * FROM (" + SQL["op12_source_divergence"] + ")")
    return _rows([x[0] for x in found.description], found.fetchall())


@pytest.mark.parametrize("dense", [1024, 0])
def test_sums_over_a_block_of_terms(monkeypatch, dense):
    monkeypatch.setattr(d, "MOST_DENSE", dense)
    monkeypatch.setattr(d, "PAIRS_AT_ONCE", 20)
    rng = random.Random(4)
    cells = [(t, s, rng.randint(1, 10**9), 1 + len(s)) for t in range(12) for s in ("a", "bb", "ccc", "dddd") if rng.random() < 0.6]
    block = pa.table({"lang": ["x"] * len(cells), "term": [str(t) for t, *_ in cells], "source": [s for _, s, *_ in cells], "p": [c[2] for c in cells], "p0": [c[3] for c in cells]})
    f = lambda x, y: (x - y) * (x - y) // y
    want = collections.Counter()
    for t, s, p, p0 in cells:
        for t2, s2, q, q0 in cells:
            if t == t2:
                want[s, s2] += f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)
    got = {(r["source"], r["item"]): r["value"] for r in d._both(block).to_pylist()}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def test_rows_equal_the_sql_in_blocks_and_shuffled(spark, docs, monkeypatch):
    monkeypatch.setattr(d, "measured", lambda df: df)
    monkeypatch.setattr(d, "BLOCK_CELLS", 60)
    got = d.divergence(docs, slice_bytes=5000)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _want(docs)


def test_edge_cases(spark, none):
    assert d.divergence(none).count() == 0
    schema = "doc_id long, text string, lang string, source string, term string, count long, p long"
    rows = [(1, None, None, None, "t", 1, 1), (1, "", "", "x", "t", 1, 1), (None, "1 2 3", "en", "b", "t", 1, 1), (2, "Only here", "en", None, "t", 1, 1)]
    rows += [(3, "same same words", "fr", s, "t", 1, 1) for s in ("a", "a", "b", "é", None)] + [(4, "x" * 50_000 + " words", "fr", "long", "t", 1, 1)]
    frame = spark.createDataFrame(rows, schema)
    got = d.divergence(frame)
    found = _rows(got.columns, [tuple(r) for r in got.collect()])
    assert found == _want(frame)
    assert {(r.lang, r.source, r["item"], r.value) for r in got.filter("lang = ''").collect()} == {("", "", "x", 0), ("", "x", "", 0)}
    assert got.filter("part = 'term' AND lang = 'fr' AND source = 'long'").select("item").collect() == [("words",)]
