import hashlib

import pytest
from tests.llm import brute
from tillroll.llm import pii

TEXTS = [
    "mail a.b@c.de and a@b.c_x@y.z then x@y, @z.q and aaa@bbb ccc", "a@b.co@d.ef", "é@ü.de ñame@host.example.com é",
    "1.2.3.4 and 256.1.1.1 and 1.2.3.4.5.6.7.8 and 001.002.003.0255 1..2.3.4", "4111 1111 1111 1111, 4111-1111-1111-1112",
    "4111111111111111 4111111111111111", "12 4111 1111 1111 1111", "+1 (988) 555-2485", "+1 (269) 555-3296 4524132264652876",
    "+12", "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6", "++44 20 7946 0958", "1-2-3-4  5", "0000000000000000", "1.1.1.1.1", "",
    "\U0001f600 a@b.co \U0001f600 1.2.3.4", "1 " * 9000 + "a@b.co", "1" * 60_000, "a" * 60_000 + "@", "1.2." * 5000,
]


def test_base_spans_equal_brute_force(spark, edge_rows):
    rows = [(i, t) for i, t in enumerate([*TEXTS, None, *[r[1] for r in edge_rows]])]
    for r in pii.report(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        want = brute.base_spans(rows[r["doc_id"]][1])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), rows[r["doc_id"]][1][:80]
        assert [r[f"n_{k}"] for k in brute.KINDS] == [sum(s.startswith(k) for s in want.split(",")) for k in brute.KINDS]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


@pytest.fixture(scope="module")
def taught(spark):
    rows = [(i, f"word {n} +1 (2{i % 10}0) 555-1{i % 9}3{i % 7} word a.b{i}@mail{i % 9}.example.com and") for i, n in enumerate(range(60))]
    rows += [(i, f"ref 4111 1111 1111 11{i} thing") for i in range(61, 99)]
    rows += [(200, "call +1 (269) 555-3296 4524132264652876 now"), (201, "nothing here")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_candidates_add_what_base_rules_lose(taught):
    got = {r["doc_id"]: r["spans"] for r in pii.report(taught).collect()}
    assert "phone:5:22" in got[200] and got[201] == ""


def test_native(taught):
    plan = pii.report(taught)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Exchange" not in plan


def test_redaction(edge, edge_rows, empty, taught):
    clean = {r["doc_id"]: r["text"] for r in pii.redact(taught).collect()}
    assert clean[201] == "nothing here"
    assert clean[3] == "word 3 [phone] word [email] and"
    got = pii.redact(edge)
    assert got.columns == edge.columns and got.count() == len(edge_rows)
    assert got.where("text is null").count() == 1 and got.where("pii_base = 'extra'").count() == len(edge_rows)
    assert pii.redact(empty).count() == 0 and pii.report(empty).count() == 0


def test_cells_are_bounded(taught):
    found = pii.cells(pii.located(taught)).collect()
    assert 0 < len(found) <= pii.CELLS and any(r["label"] == 1 for r in found)
