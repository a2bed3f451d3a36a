"""Verdicts on documents of sources and languages with few rows."""

import random

import pytest

from duoscope.llm.quality_rules import quality_rules


def prose(r):
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(3, 9))) for _ in range(120))


def junk(r):
    return " ".join(r.choice("#$%&|<>") * 3 + str(r.randrange(10**6)) for _ in range(120))


@pytest.mark.parametrize("small", [1, 150])
def test_outliers_in_small_groups(spark, small):
    """Small sources are judged by all of their language, small languages by all of the table."""
    r = random.Random(0)
    rows = [(k, prose(r), "en", "web" if k % 2 else None) for k in range(800)]
    groups = [("en", "rare"), ("xx", "rare"), (None, None)]
    for g, (lang, source) in enumerate(groups, 1):
        rows += [(1000 * g + k, junk(r), lang, source) for k in range(small)]
    rows += [(5000, prose(r), "en", "lone"), (5001, prose(r), "yy", "lone"), (5002, prose(r), None, "web")]
    got = {x.doc_id: x.kept for x in quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(rows)
    assert not [d for d, kept in got.items() if 1000 <= d < 5000 and kept]
    assert sum(kept for d, kept in got.items() if d < 1000) > 780
    assert got[5000] and got[5001] and got[5002]
