"""Queries read the whole of their texts, against brute force."""

import difflib
import random
import re

import pytest

from lexspan.operators import diff, evaluation
from lexspan.plans import texts


@pytest.mark.parametrize("autojunk", [True, False])
def test_matched_is_the_sum_of_difflibs_blocks(autojunk):
    r = random.Random(1)
    for k in range(400):
        letters = "ab" if k % 3 == 0 else "abcdefghijkl mnop"
        a = "".join(r.choice(letters) for _ in range(r.randint(0, r.choice([3, 30, 250, 600]))))
        b = a
        for _ in range(r.randint(0, 20)):
            i = r.randrange(len(b) + 1)
            b = b[:i] + r.choice(letters + "XYZ") * r.randint(0, 3) + b[i + r.randint(0, 4) :]
        b = b if k % 2 else "".join(r.choice(letters + "XYZ") for _ in range(r.randint(0, 400)))
        want = sum(m.size for m in difflib.SequenceMatcher(None, a, b, autojunk=autojunk).get_matching_blocks())
        assert evaluation.matched(a, b, autojunk) == want


def test_order_ratio_reads_every_line(spark, tmp_path):
    first = "the same first line of both"
    bodies = [f"{first}\none two three\nfour five six", f"{first}\nfour five six\none two three", f"{first}\nfóur  FIVE", first, ""]
    docs = spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(bodies)], "doc_id long, text string, lang string, source string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: (r["order_ratio"], r["similarity"]) for r in texts.order_ratio(spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2, 3, 4]
    for k in got:
        a, b = bodies[k - 1], bodies[k]
        u, v = re.findall(r"\w+", a), re.findall(r"\w+", b)
        blocks = difflib.SequenceMatcher(None, u, v, autojunk=False).get_matching_blocks()
        assert got[k] == (sum(m.size for m in blocks) / len(u) if u and v else 1.0, difflib.SequenceMatcher(None, diff.comparable(a), diff.comparable(b)).ratio())
    assert got[1][0] == 9 / 12 and got[2][0] == 6 / 12  # 1.0 by the first lines alone
