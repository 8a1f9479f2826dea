"""Strict reading of responses: types as written, and rows dealt to all tasks before they are read."""

import json

from plateau.operators import strict as K
from plateau.plans import strictness

SOUND = {name: {"from": "1", "to": "9"} for name in K.RANGES}


def _response(result=None, **outer):
    inner = {"status_code": 200, "check_code": K.CHECK_UNSPECIFIED, "debug_msg": "", **SOUND, **(result or {})}
    return json.dumps({"retCode": 0, "status_code": 200, "retMsg": "OK", "result": inner, **outer})


def test_types_and_names_count_as_written(spark):
    cases = {  # (envelope_valid, result_schema_valid, validate_ok)
        _response(): (True, True, True), _response(retCode="0"): (False, True, False), _response(retCode=0.0): (False, True, False), _response(retMsg=None): (False, True, False),
        _response({"status_code": 200.0}): (True, False, False), _response({"investment_from": None}): (True, False, False), _response({"profit.to": "1"}): (True, False, False),
        _response({"leverage": {"from": 1, "to": "9"}}): (True, False, False), _response({"leverage": {"from": "1", "to": "9", "x": None}}): (True, False, False),
        _response({"leverage": {"from": "1", "to": None}}): (True, False, False), _response({"leverage": ["1", "9"]}): (True, False, False), _response({"debug_msg": None}): (True, False, False),
        _response(debug_msg="e"): (True, True, False), "[1]": (False, False, False), "": (False, False, False), _response(result=[]) : (True, True, True),
        json.dumps({"retCode": 0, "result": "text"}): (True, False, False)}
    rows = [(i, body, 5.0, 5, 5.0, 2.0, 3.0, 1.0) for i, body in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, body string, " + ", ".join(f"{c} double" if c != "cell_number_requested" else f"{c} int" for c in K.MEMBERSHIP))
    got = {r.i: (r.envelope_valid, r.result_schema_valid, r.validate_ok) for r in K.parse_strict(df).select("i", "envelope_valid", "result_schema_valid", "validate_ok").collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_rows_of_one_file_are_read_by_many_tasks(spark):
    assert strictness._responses(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
