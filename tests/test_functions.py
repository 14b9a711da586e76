import pytest
from pyspark.sql import functions as F

from veilspark.conf import EngineConf, deep_merge
from veilspark.functions import labels as lb
from veilspark.functions import parsers, synthetic, vocab
from veilspark.functions import text as tx
from veilspark.operators import detect, replace


def one(spark, rows, schema, *columns):
    """Each column over each row, as a list of tuples in the order of rows."""
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


@pytest.mark.parametrize("n, chunks", [(0, 0), (1, 1), (1400, 1), (1401, 2), (1600, 2), (2801, 3)])
def test_chunk_counts(spark, n, chunks):
    (got,), = one(spark, [("x" * n,)], "t string", tx.chunk_array(F.col("t")))
    assert len(got) == chunks and all(len(c) <= 1600 for c in got)


def test_chunks_cover_the_collapsed_text(spark):
    text = "  a b\n\tc " * 300
    (got, none, wide), = one(spark, [(text,)], "t string", tx.chunk_array(F.col("t"), 100, 30), tx.chunk_array(F.lit(None).cast("string")), tx.chunk_array(F.col("t"), 50, 60))
    flat = " ".join(text.split())
    assert got[0] + "".join(c[30:] for c in got[1:]) == flat and none in (None, []) and "".join(wide) == flat


@pytest.mark.parametrize("text, masked", [("", "#####"), (None, "#####"), ("ab", "##"), ("abc", "a#c"), ("998221", "9####1"), ("1234567890", "12######90"), ("placeholders", "pl########rs"), ("x" * 30, "xxxx" + "#" * 22 + "xxxx")])
def test_masks(spark, text, masked):
    assert one(spark, [(text,)], "t string", tx.partial_mask(F.col("t"))) == [(masked,)]


def test_entropy_and_luhn(spark):
    rows = [("a" * 16,), ("abcdefghijklmnop",), ("",), ("4111 1111 1111 1111",), ("4111 1111 1111 1112",)]
    got = one(spark, rows, "t string", tx.entropy(F.col("t")), tx.luhn(F.col("t")))
    assert [round(g[0], 9) for g in got[:3]] == [0, 4, 0] and [g[1] for g in got[3:]] == [True, False]


def test_context(spark):
    rows = [("hello World again", "world"), ("hello", "zz"), ("", "a"), ("abcabc", "c")]
    got = one(spark, rows, "c string, s string", tx.span_context(F.col("c"), F.col("s"), 3))
    assert got == [("lo World ag",), ("(span not in chunk) «zz»",), ("",), ("abcabc",)] or got[3] == ("abcabc",)


AGREE = [("person", "name", True), ("email", "email address", True), ("email address", "city", True), ("email", "city", False), ("dob", "date of birth", True), ("date of birth", "date", True), ("dob", "date", False), ("phone", "phone number", True), ("Organization", "organization name", True), ("pan", "pan number", True), ("ssn", "pan", False)]


def test_label_agreement_in_both_spellings(spark):
    a, b = F.col("a"), F.col("b")
    got = one(spark, [r[:2] for r in AGREE], "a string, b string", lb.agrees(a, b), lb.agrees(b, a), lb.agrees(a, b, True))
    assert [g[0] for g in got] == [r[2] for r in AGREE] == [g[1] for g in got]
    words = [*dict.fromkeys((*vocab.ZERO_SHOT_LABELS, *vocab.SLM_LABELS, "dob", "organization name"))]
    df = spark.createDataFrame([(x, y) for x in words for y in words], "a string, b string")
    same = [lb.signatures_agree(lb.signature(a, e), lb.signature(b, e)).alias(f"s{e}") for e in (False, True)]
    for r in df.select("a", "b", lb.agrees(a, b).alias("g"), lb.agrees(a, b, True).alias("e"), *same).collect():
        assert (r.g, r.e) == (r.sFalse, r.sTrue)
    assert got[7][2] is False and got[4][2] is False


@pytest.mark.parametrize("text, shape", [("1990-08-15", "yyyymmdd"), ("15/08/1990", "ddmmyyyy"), ("08/15/1990", "ddmmyyyy"), ("08/15/90", "mmddyyyy"), ("March 15, 2025", "mmddyyyy")])
def test_date_formats(spark, text, shape):
    assert one(spark, [(text,)], "t string", synthetic.date_format(F.col("t"))) == [(shape,)]


@pytest.mark.parametrize("text, prefix", [("0701234567", "0"), ("+46701234567", "+46"), ("+1 (743) 555-3824", "+1"), ("+971501234567", "+971"), ("555-123-4567", "+1")])
def test_phone_prefixes(spark, text, prefix):
    assert one(spark, [(text,)], "t string", synthetic.phone_prefix(F.col("t"))) == [(prefix,)]


def test_made_values_have_their_shape_and_repeat(spark):
    kinds = ["email", "phone number", "person", "ssn", "credit card number", "bank account number", "date", "aadhaar number", "pan number", "udyam_number"]
    rows = [(k, f"original {i}") for k in kinds for i in range(30)]
    made = synthetic.synthetic(F.col("t"), F.col("o"))
    got = one(spark, rows, "t string, o string", made, synthetic.datatype_match(made, F.col("t")))
    assert all(fits for _, fits in got) and got == one(spark, rows, "t string, o string", made, synthetic.datatype_match(made, F.col("t")))
    assert one(spark, [("gst number", "x"), ("username", "x")], "t string, o string", made)[0][0].startswith("<gst_number_")


def test_replacements_cascade_and_are_literal(spark):
    def put(text, *pairs):
        listed = F.array(*(F.struct(F.lit(a).alias("original_value"), F.lit(b).alias("anonymized_value")) for a, b in pairs))
        return one(spark, [(text,)], "t string", replace.apply_pairs(F.col("t"), listed))[0][0]

    assert put("John Smith met John", ("John", "B"), ("John Smith", "A")) == "A met B"
    assert put("a.c abc", ("a.c", "x\\1$")) == "x\\1$ abc"
    assert put("aaa", ("", "z"), ("a", "a")) == "aaa"


def test_indian_ids(spark):
    text = "1234 5678 9012, 1234-5678-9013 123456789014 1234567890123456 ABCDE1234F abcde1234f 22AAAAA0000A1Z5 27AABCU9603R1ZM udyam-mh-12-1234567 UDYAM-MH-12-1234567"
    df = spark.createDataFrame([(1, 1, text)], "doc_id long, chunk_index int, chunk string")
    got = sorted((r.text, r.label) for r in detect.indian_ids(df).collect())
    assert got == [("1234 5678 9012", "aadhaar"), ("1234-5678-9013", "aadhaar"), ("123456789014", "aadhaar"), ("22AAAAA0000A1Z5", "gst_number"), ("ABCDE1234F", "pan"), ("udyam-mh-12-1234567", "udyam_number")]


def test_parsers(spark):
    rows = [("**Full Name**: Asha",), ("**Full Name:** Asha",), ("**Hat**: x",), (None,)]
    got = one(spark, rows, "t string", parsers.prose_entities(F.col("t")))
    assert [[(e.text, e.label) for e in g[0] or []] for g in got] == [[("Asha", "person")], [("Asha", "person")], [], []]
    assert parsers.best_list('x [1] [{"a": "]"}] [{"b": 1}, {"c": 2}]') == '[{"b": 1}, {"c": 2}]' and parsers.best_list(None) == "[]"
    assert parsers.json_like('see ```json\n{"a": [1]}\n``` ok') == '{"a": [1]}' and parsers.json_like("") == '{"error": "Empty text"}'
    verdicts = one(spark, [('```{"results":[{"id":1,"is_pii":"YES"},{"id":1,"is_pii":false},{"id":"2","pii":"1"}]}```',), ("none",)], "t string", parsers.verdicts(F.col("t")))
    assert verdicts[0][0] == {1: False, 2: True} and not verdicts[1][0]


def test_conf():
    assert deep_merge({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"c": 3}, "d": {"e": 1}}) == {"a": {"b": 1, "c": 3}, "d": {"e": 1}}
    conf = EngineConf.load({"chunk_size": 10, "other": 1}, {"min_agreement": 2}, env={"VEILSPARK_MAX_CHUNKS_PER_DOC": "1", "VEILSPARK_TIMEOUT_SECONDS": "5", "VEILSPARK_LLM_MODE": "CPU"})
    assert (conf.chunk_size, conf.min_agreement, conf.max_chunks_per_doc, conf.timeout_seconds, conf.llm_mode) == (10, 2, 1, 60, "cpu")
    assert conf.snapshot()["chunk_overlap"] == 200
