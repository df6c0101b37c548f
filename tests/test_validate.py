import json

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import validate
from sparkloom.sources.files import json_lines, lenient, strict

GOOD = {
    "claim_id": "S01-C001", "source_id": "S01", "claim_text": "Nightly compaction halves read cost", "claim_type": "finding", "topic_tags": ["storage"],
    "supporting_quote_location": "Results", "confidence_as_stated": "medium", "depends_on": [], "source_locator": {"page": 4},
}


def faults(spark, raw):
    line = raw if isinstance(raw, str) else json.dumps(raw)
    rows = json_lines(spark.createDataFrame([("f", line)], "file string, text string"))
    return rows.select(validate.claim_faults(validate.JsonRecord(), F.lit("S01")).alias("p")).first()["p"]


def test_good_claim(spark):
    assert faults(spark, GOOD) == []


@pytest.mark.parametrize(
    "change,part",
    [
        ({"claim_id": "S1-C1"}, "does not match SNN-CNNN"), ({"claim_id": "S02-C001"}, "does not belong to source S01"), ({"claim_id": 7}, "claim_id '7' does not match"),
        ({"source_id": "S02"}, "source_id 'S02' does not match file source S01"), ({"claim_text": "  "}, "claim_text must be"), ({"claim_type": "guess"}, "claim_type 'guess' not in ['definition'"),
        ({"topic_tags": []}, "topic_tags must be"), ({"topic_tags": ["a", 1]}, "topic_tags must be"), ({"topic_tags": "a"}, "topic_tags must be"), ({"supporting_quote_location": ""}, "must be a non-empty string"),
        ({"supporting_quote_location": "x" * 241}, "too long"), ({"confidence_as_stated": None}, "confidence_as_stated 'None' not in"), ({"depends_on": ["S1"]}, "depends_on must be"), ({"depends_on": None}, "depends_on must be"),
        ({"source_locator": []}, "source_locator must be an object"), ({"source_locator": {}}, "at least one of"), ({"source_locator": {"line": 1}}, "unknown source_locator key line"),
        ({"source_locator": {"page": True}}, "positive integer"), ({"source_locator": {"page": 12.0}}, "positive integer"), ({"source_locator": {"page": "12"}}, "positive integer"),
        ({"source_locator": {"page": 0}}, "positive integer"), ({"source_locator": {"timestamp": "1:2"}}, "must look like"), ({"source_locator": {"url": " "}}, "source_locator.url"), ({"source_locator": {"anchor": 1}}, "source_locator.anchor"),
    ],
)
def test_single_faults(spark, change, part):
    got = faults(spark, GOOD | change)
    assert len(got) == 1 and part in got[0], got


def test_shape_comes_first(spark):
    bad = {k: v for k, v in GOOD.items() if k not in ("claim_type", "claim_text")} | {"zeal": 1, "claim_id": "no"}
    assert faults(spark, bad) == ["missing field claim_text", "missing field claim_type", "unknown field zeal"]


def test_lines_keep_numbers_and_errors(spark):
    text = '# comment\n\n{"a": 1}\nnot json\n[1]\n{"a": NaN}\r\n{"b": 2}'
    rows = json_lines(spark.createDataFrame([("f", text)], "file string, text string"))
    got = [(r.lineno, r.error) for r in rows.orderBy("lineno").select("lineno", "error").collect()]
    assert got == [(3, None), (4, "invalid JSON"), (5, "line is not a JSON object"), (6, "invalid JSON"), (7, None)]
    assert lenient(rows).count() == 2
    with pytest.raises(ValueError, match="f:4: invalid JSON"):
        strict(rows)


def test_decisions(spark):
    schema = "group_id string, claim_ids array<string>, decision string, rule_applied string, decided_by string, winner string, note string"
    rows = [
        ("G001", ["S01-C001"], "UNIQUE", "r", "op", None, None),
        ("G1", [], "MAYBE", "", " ", None, None),
        ("G002", ["S01-C001", "S01-C009", None], "SUPERSEDED", "x", "op", "S01-C007", None),
        ("G003", ["S01-C001"], "OUT_OF_SCOPE", "r", "op", None, " "),
    ]
    df = spark.createDataFrame(rows, schema)
    made = validate.decision_faults(validate.TableRecord(df), F.array(F.lit("S01-C009")), F.array(F.lit("r")))
    got = {r.group_id: r.p for r in df.select("group_id", made.alias("p")).collect()}
    assert got["G001"] == []
    assert len(got["G1"]) == 5
    assert got["G002"] == ["claim id 'S01-C009' was never extracted", "claim id 'None' does not match SNN-CNNN format", "SUPERSEDED decision requires a winner drawn from claim_ids", "SUPERSEDED rule_applied 'x' not in merge-rules.yaml"]
    assert got["G003"] == ["OUT_OF_SCOPE decision requires a one line note giving the reason"]
