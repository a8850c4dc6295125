"""Nested payloads against a walk over Python's own parse."""

import json

import pytest

from tavola.operators import payloads

FIELDS = {"id": "bigint", "guest.name": "string", "guest.address.city": "string", "guest.age": "int", "items": "array<int>"}
TEXTS = [
    '{"id": 1, "guest": {"name": "A", "address": {"city": "X", "zip": "9"}, "age": 3}, "items": [1, 2]}',
    '{"id": "one", "guest": {"name": "B", "age": "old"}, "extra": {"a": 1}}',
    '{"id": 2, "guest": "none", "items": {"a": 1}}',
    '{"guest": {"address": [1], "x": null}, "id": null}',
    "[1, 2]", "5", "null", "not json", None, "", "{}",
]


def test_paths(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "row long, body string")
    got = {r["row"]: r.asDict() for r in payloads.typed_payload(df, "body", FIELDS).collect()}
    assert (got[0]["id"], got[0]["guest_name"], got[0]["guest_address_city"], got[0]["guest_age"], got[0]["items"]) == (1, "A", "X", 3, [1, 2])
    assert got[0]["unknown_paths"] == ["guest.address.zip"] and got[0]["ill_typed"] == []
    assert got[1]["unknown_paths"] == ["extra"] and got[1]["ill_typed"] == ["guest.age", "id"] and got[1]["guest_name"] == "B"
    assert got[2]["ill_typed"] == ["guest", "items"] and got[2]["guest_name"] is None
    assert got[3]["unknown_paths"] == ["guest.x"] and got[3]["ill_typed"] == ["guest.address"] and got[3]["id"] is None
    for n, text in enumerate(TEXTS):
        try:
            json.loads(text or "")
            good = True
        except ValueError:
            good = False
        assert got[n]["is_json"] == good, text
        if not good or text in ("null", "{}", "5", "[1, 2]"):
            assert got[n]["unknown_paths"] == [] and got[n]["ill_typed"] == [] and got[n]["id"] is None


def test_overlapping_declarations(spark):
    with pytest.raises(ValueError):
        payloads.typed_payload(spark.createDataFrame([("{}",)], "body string"), "body", {"a": "int", "a.b": "int"})
