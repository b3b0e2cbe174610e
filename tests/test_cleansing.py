"""Masking, null tokens, inference, casts and duplicates."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sluicework.functions.masks import mask
from sluicework.operators import cleansing as C
from sluicework.operators.quality import QualityRules, dq_assert, dq_report
from sluicework.streaming.ingest import clean_rows


def frame(spark, rows, names):
    ddl = ", ".join(f"`{n}` string" for n in names)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {ddl}")


def detect(spark, rows, names):
    return C.detect_pii(frame(spark, rows, names), names, ["i"])


@pytest.mark.parametrize("name,kind", [("email", "email"), ("phone_number", "phone"), ("ssn", "ssn"), ("first_name", "name"), ("Client_IP", "ip")])
def test_personal_columns_by_name(name, kind):
    assert C.pii_by_name([name, "score"]) == {name: kind}


def test_underscore_joins_words():
    assert C.pii_by_name(["user_email", "email-work"]) == {"email-work": "email"}


def test_personal_columns_by_value(spark):
    """Eleven of 20 sampled cells are enough, nine are not; what follows the sample does not count."""
    def cells(good):
        return [f"crew-{i}@harbour-{i % 3}.net" if i % 20 < good else f"berth {i}" for i in range(20)] + ["mail@quay.org"] * 30

    rows = list(zip(cells(11), cells(9), [f"{i:03}-{i:02}-{i:04}" for i in range(50)], strict=True))
    assert detect(spark, rows, ["reach", "mixed", "mark"]) == {"reach": "email", "mark": "ssn"}


def test_half_the_values_are_enough_and_less_is_not(spark):
    half = [("a@b.co",), ("x",), (None,), ("  ",)]
    assert detect(spark, half, ["c"]) == {"c": "email"}
    assert detect(spark, [*half, ("y",)], ["c"]) == {}


def test_no_personal_data(spark):
    df = frame(spark, [("7.5", "tug"), ("-1", "ferry"), (None, "")], ["draught", "vessel"])
    assert C.detect_pii(df, ["draught", "vessel"], ["i"]) == {}
    assert C.mask_pii(df, {}) is df
    assert C.pii_report(df, {}).count() == 0


def test_report_counts_cells_that_hold_text(spark):
    df = frame(spark, [("", "301.555.0188"), ("pilot@quay.org", "301.555.0199"), ("  ", None)], ["email", "phone"])
    report = {r["column_name"]: r["masked_cells"] for r in C.pii_report(df, {"email": "email", "phone": "phone"}).collect()}
    assert report == {"email": 2, "phone": 2}
    masked = C.mask_pii(df, {"email": "email"}).orderBy("i").collect()
    assert masked[0]["email"] == "" and masked[1]["email"].endswith("@masked.invalid") and masked[2]["email"] == "  "


@pytest.mark.parametrize(
    "kind,value,want",
    [
        ("email", " Alice@Example.com ", hashlib.sha256(b"alice@example.com").hexdigest()[:16] + "@masked.invalid"),
        ("phone", "+1-555-123-4567", "***-***-4567"),
        ("phone", "12", "***-***-****"),
        ("ssn", "123-45-6789", "***-**-6789"),
        ("credit_card", "4111 1111 1111 1234", "****-****-****-1234"),
        ("credit_card", "x", "****-****-****-****"),
        ("name", "Alice  Ann Smith", "A*** A*** S***"),
        ("name", " Al", " A***"),
        ("address", "123 Main St", "*** Main St"),
        ("address", "Main St 5", "Main St 5"),
        ("dob", "1990-05-15", "1990-**-**"),
        ("dob", "born 1990/05/15!", "born 1990-**-**!"),
        ("ip", "192.168.1.100", "192.168.xxx.xxx"),
        ("ip", "::1", "xxx.xxx.xxx.xxx"),
        ("name", "", ""),
        ("ssn", None, None),
    ],
)
def test_masks(spark, kind, value, want):
    row = spark.createDataFrame([(value,)], "v string").select(mask(F.col("v"), kind).alias("m")).first()
    assert row["m"] == want


def test_null_tokens_are_trimmed_and_case_sensitive(spark):
    values = [" NA ", "null", "Null", "", " None\t", "0", "#N/A"]
    got = [r["v"] for r in C.standardise_nulls(frame(spark, [(v,) for v in values], ["v"]), ["v"]).orderBy("i").collect()]
    assert got == [None, None, "Null", None, None, "0", None]


def test_inference_order_of_types(spark):
    names = ["b", "n", "f", "t", "s", "none"]
    rows = [("yes", "7", "1.5", "2024-01-01", "x", "NA"), ("0", "-3", "2e3", "2024-13-45x", "1", ""), ("NULL", "0", "4", "2024-01-01 10:00", "y", "nan")]
    got = C.schema_of(C.infer_types(frame(spark, rows, names), names, ["i"]))
    assert got == {"b": "BOOLEAN", "n": "INT64", "f": "FLOAT64", "t": "TIMESTAMP", "s": "STRING", "none": "STRING"}


def test_inference_sees_the_first_hundred_rows_only(spark):
    rows = [("5",)] * 100 + [("x",)]
    df = frame(spark, rows, ["v"])
    assert C.schema_of(C.infer_types(df, ["v"], ["i"])) == {"v": "INT64"}
    good, bad = C.cast_rows(df, {"v": "INT64"})
    assert good.count() == 100
    assert [r["errors"] for r in bad.collect()] == [['v: expected INT64, got "x"']]


def test_preview_types(spark):
    names = ["n", "b", "d", "z", "s"]
    rows = [("1", "TRUE", "2024-01-01", "", "a"), ("", "false", "2024-02-01T10:00", "null", "1")]
    got = {r["source_column"]: (r["preview_type"], r["type"]) for r in C.preview_types(frame(spark, rows, names), names, ["i"]).collect()}
    assert got == {"n": ("number", "FLOAT64"), "b": ("boolean", "BOOL"), "d": ("date", "TIMESTAMP"), "z": ("null", "STRING"), "s": ("string", "STRING")}


def test_casts(spark):
    df = frame(spark, [("9007199254740993", "1e2", "Yes", "2024-01-01"), ("99999999999999999999", "x", "maybe", "soon")], list("abcd"))
    good, bad = C.cast_rows(df, {"a": "INT64", "b": "FLOAT64", "c": "BOOLEAN", "d": "TIMESTAMP"})
    assert good.drop("i").collect() == [(9007199254740993, 100.0, True, "2024-01-01")]
    assert len(bad.first()["errors"]) == 4


def test_copies_go_and_null_equals_empty(spark):
    df = frame(spark, [("a", None), ("a", ""), ("a", "b"), ("a", "b")], ["x", "y"])
    assert sorted(C.dedup_rows(df, ["x", "y"]).collect()) == [("a", ""), ("a", "b")]


def test_cleaning_masks_before_inference_and_counts(spark):
    rows = [("N/A", "1"), ("Al Bo", "2"), ("Al Bo", "2"), ("Cy", "3")] + [(f"P{i}", str(i)) for i in range(100)] + [("Z", "bad"), ("Z", "bad")]
    out = clean_rows(frame(spark, rows, ["full_name", "n"]), ["full_name", "n"], ["i"])
    assert out.pii == {"full_name": "name"} and out.schema == {"full_name": "STRING", "n": "INT64"}
    names = {r["full_name"] for r in out.good.collect()}
    assert "N***" in names and "A*** B***" in names and "N/A" not in names
    assert out.stats == {"total_records": 106, "valid": 103, "rejected": 1, "duplicates_removed": 2, "loaded": 0}
    assert out.bad.count() == 1


def test_quality_report(spark):
    df = spark.createDataFrame([(1, 11.0, None, 5), (1, 3.0, None, 5), (2, 4.0, None, 5)], "player_id int, rating double, gone string, flat int")
    rules = QualityRules(10, 0.5, {"rating": (0, 10)}, ("player_id",), ("player_id",))
    bad = {(r["check_name"], r["column_name"]) for r in dq_report(df, rules).where("violated").collect()}
    assert bad == {("min_rows", None), ("all_null", "gone"), ("range", "rating"), ("duplicate_key", "player_id"), ("zero_variance", "flat")}
    with pytest.raises(ValueError, match="duplicate_key"):
        dq_assert(df, rules)
    assert dq_assert(df.select("rating"), QualityRules(1)).count() == 3


def test_rows_of_one_task_are_masked_by_several(spark, monkeypatch):
    """A file may be one split: its rows are dealt out before the masks."""
    from sluicework.streaming import ingest as N

    names = ["email", "n"]
    raw = spark.range(0, 2000, 1, 1).select(F.col("id").alias("i"), F.concat("id", F.lit("@quay.org")).alias("email"), F.col("id").cast("string").alias("n"))
    shares, masked = [], N.mask_pii

    def seen(df, kinds):
        shares.append([r["count"] for r in df.withColumn("task", F.spark_partition_id()).groupBy("task").count().collect()])
        return masked(df, kinds)

    monkeypatch.setattr(N, "mask_pii", seen)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = clean_rows(raw, names, ["i"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = next(s for s in shares if sum(s) == 2000)
    assert len(whole) > 1 and max(whole) < 1000
    assert out.stats == {"total_records": 2000, "valid": 2000, "rejected": 0, "duplicates_removed": 0, "loaded": 0}
