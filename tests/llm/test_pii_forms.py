"""Identifiers in forms that no seed has, found by their contexts, and contexts taught by what was found."""

import pytest

pytest.importorskip("driftline.llm")

from driftline.llm import pii  # noqa: E402


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = dict(rows)
    return {
        r["doc_id"]: [(s.split(":")[0], texts[r["doc_id"]][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in r["spans"].split(",") if s]
        for r in pii.report(docs).collect()
    }


def test_unseen_forms_in_taught_contexts(spark):
    rows = [(i, f"hi {i} just call me at +1 212 555 01{i:02d} after lunch today") for i in range(20)]
    rows += [(100 + i, f"hi {i} send mail to person{i}@site{i}.org before the weekend") for i in range(20)]
    rows += [(50, "x just call me at (555) 123-4567 after lunch today"), (51, "the part (555) 123-4568 is sold out")]
    rows += [(150, "x send mail to user@localhost before the weekend"), (151, "y send mail to jane at example before the weekend"), (152, "we look at pictures of cats")]
    got = found(spark, rows)
    assert got[50] == [("phone", "(555) 123-4567")] and got[51] == []
    assert got[150] == [("email", "user@localhost")] and got[151] == [("email", "jane at example")] and got[152] == []


def test_found_instances_teach_new_contexts(spark):
    rows = [(i, f"hi {i} just call me at +1 212 555 01{i:02d} after lunch today") for i in range(20)]
    rows += [(100 + i, f"x just call me at (555) 123-45{i:02d} after lunch today") for i in range(20)]
    rows += [(200 + i, f"y the front desk: (555) 123-45{i:02d} is always open") for i in range(20)]
    rows += [(300, "y the front desk: (555) 987-6543 is always open"), (301, "item (555) 987-6544 is sold out")]
    got = found(spark, rows)
    assert got[300] == [("phone", "(555) 987-6543")] and got[301] == []
