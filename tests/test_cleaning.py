"""Cleaning and language score in one pass over lines."""

import random
import re
import unicodedata

import pyarrow as pa
import pytest

from tokenlake.operators import clean
from tokenlake.plans import registry


def cleaned(line):
    line = re.sub("[\u200b-\u200d\ufeff]", "", line)
    line = "".join(c for c in line if c in "\t\n" or not unicodedata.category(c).startswith("C"))
    return unicodedata.normalize("NFC", re.sub("[ \t]+", " ", line).strip())


def score(line):
    words = set(line.lower().split())
    if not words:
        return 0.0
    letters = [c for c in line if unicodedata.category(c).startswith("L")]
    own = 0.4 if any(c in clean.SPECIFIC for c in line) else 0.0
    return own + (sum(c in clean.ALPHABET for c in letters) / len(letters) if letters else 0.0) * 0.3 + min(len(words & set(clean.STOPWORDS)) / len(words) * 2.0, 0.3)


def test_lines_are_cleaned_and_scored_by_the_rules():
    rnd = random.Random(2)
    pool = [*"abcçğıİIöşüé \t \u200b\u200d\ufeff\xad\x07\x85\xa0\u3000e\u0301.,?1字語я\ufb01\U0001f600\u2028\n", " ve ", " bir ", "da"]
    lines = ["".join(rnd.choices(pool, k=rnd.randrange(30))) for _ in range(2000)] + [None, "", " ", "ve", "12345"]
    out = clean._clean_and_score(pa.array(lines)).to_pylist()
    assert [r["clean"] for r in out] == [None if x is None else cleaned(x) for x in lines]
    assert [r["score"] for r, x in zip(out, lines) if x is not None] == pytest.approx([score(r["clean"]) for r in out if r["clean"] is not None], abs=1e-15)


@pytest.mark.parametrize("name", ["language_score", "preprocess_status", "preprocess_kept", "preprocess_summary"])
def test_lines_go_through_one_function(spark, tmp_path, name):
    spark.createDataFrame([(1, "tr", "güzel bir gün ve yeni bir ev\nx"), (2, "tr", "güzel bir gün ve yeni bir ev")], "doc_id long, lang string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    rows = registry.QUERIES[name](spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?m)ArrowEvalPython \[", plan)) == 1 and "regexp_replace" not in plan and "array_distinct" not in plan
    assert rows.count() == {"language_score": 3, "preprocess_status": 3, "preprocess_kept": 1, "preprocess_summary": 1}[name]


def test_only_lines_that_pass_are_shuffled(spark):
    rows = spark.createDataFrame([(1, 0, "x"), (1, 1, "güzel bir gün ve yeni bir ev")], "doc_id long, line_no int, line string")
    plan = clean.kept(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan[plan.index("Window ") :] and "concat_ws" not in plan
    assert clean.kept(rows, dedup=False).count() == clean.kept(rows).count() == 1
