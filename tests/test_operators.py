import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from veilspark.conf import EngineConf
from veilspark.functions import labels as lb
from veilspark.operators import detect, ensemble, evaluate, filters, report
from veilspark.plans.pipeline import process
from veilspark.sources import files, store
from veilspark.streaming import watch

DETECTION = "doc_id long, chunk_index int, detector string, detector_ord int, pos int, text string, label string, score double"
SAID = [
    (1, 1, "a", 0, 0, "John Smith", "person", 0.85), (1, 1, "a", 0, 1, "2024-01-05", "date", 0.85), (1, 1, "b", 1, 0, "john smith", "person", 0.95),
    (1, 1, "b", 1, 1, "Acme", "organization", 0.5), (1, 1, "c", 2, 0, "John Smith", "name", 0.8), (1, 1, "c", 2, 1, "Acme", "organization", 0.8),
]


@pytest.fixture
def said(spark):
    return spark.createDataFrame(SAID, DETECTION)


def test_merge_and_agreement(said):
    want = {("2024-01-05", "date", 0.85), ("john smith", "person", 0.95), ("John Smith", "name", 0.8), ("Acme", "organization", 0.8)}
    got = lambda df: {(r.text, r.label, r.score) for r in df.collect()}
    assert got(ensemble.merge(said)) == want == got(ensemble.agreement(said, 1, 1))
    assert got(ensemble.agreement(said, 2, 1)) == {w for w in want if w[1] != "date"}
    lost = ensemble.dropped(said, 2, 1).collect()
    assert [(r.text, r.found_by) for r in lost] == [("2024-01-05", ["a"])] and "at least 2" in lost[0].reason


def test_findings_fold(said):
    found = said.select("doc_id", "chunk_index", F.col("text").alias("value"), F.col("label").alias("pii_type"), "score", F.array("detector").alias("found_by"), (F.col("detector_ord") * 9 + F.col("pos")).alias("ord"))
    got = {(r.value, r.pii_type, r.score, tuple(r.found_by)) for r in ensemble.dedupe_findings(found).collect()}
    assert got == {("john smith", "person", 0.95, ("a", "b", "c")), ("2024-01-05", "date", 0.85, ("a",)), ("Acme", "organization", 0.8, ("b", "c"))}
    rows = [(1, 1, v, t, x, [str(x)], i) for i, (v, t, x) in enumerate([("John", "person", 0.5), ("John Smith", "name", 0.9), ("Smith", "person", 0.7), ("Rome", "city", 0.4)])]
    df = said.sparkSession.createDataFrame(rows, FINDINGS)
    got = {(r.value, r.score, tuple(r.found_by)) for r in ensemble.dedupe_findings(df).collect()}
    assert got == {("John Smith", 0.9, ("0.5", "0.7", "0.9")), ("Rome", 0.4, ("0.4",))}


FINDINGS = "doc_id long, chunk_index int, value string, pii_type string, score double, found_by array<string>, ord int"
KINDS = ("person", "name", "city", "email address", "address", "dob", "date", "date of birth", "phone", "ssn", "organization", "organization name")
WORDS = ("ann", "ann lee", "lee", "n", "rome", "rome 12", "12", "x12", "Ann")


def test_folds_against_plain_loops(spark):
    """Random findings and entities, grouped and matched by loops; labels agree as the expression has it."""
    rng = random.Random(5)
    df = spark.createDataFrame([(a, b) for a in KINDS for b in KINDS], "a string, b string")
    agree = {(r.a, r.b): (r.g, r.e) for r in df.select("a", "b", lb.agrees(F.col("a"), F.col("b")).alias("g"), lb.agrees(F.col("a"), F.col("b"), True).alias("e")).collect()}
    said = [(d, 1, rng.choice(WORDS), rng.choice(KINDS), rng.randrange(1, 9) / 10, [rng.choice("abc")], i) for d in range(60) for i in range(rng.randrange(1, 9))]
    merged = ensemble.findings_by_value(spark.createDataFrame(said, FINDINGS)).collect()
    want = set()
    for d in {r.doc_id for r in merged}:
        groups = []
        for r in sorted((r for r in merged if r.doc_id == d), key=lambda r: r.ord):
            home = next((g for g in groups if agree[g[0].pii_type, r.pii_type][0] and any(r.low in m.low or m.low in r.low for m in g)), None)
            home.append(r) if home else groups.append([r])
        for g in groups:
            top = max(g, key=lambda m: (len(m.value), m.score))
            want.add((d, top.value, top.pii_type, top.score, tuple(sorted({x for m in g for x in m.found_by})), g[0].ord))
    found = ensemble.dedupe_findings(spark.createDataFrame(said, FINDINGS)).collect()
    assert {(r.doc_id, r.value, r.pii_type, r.score, tuple(r.found_by), r.ord) for r in found} == want and len(found) == len(want)

    sides = [{d: [(i, rng.choice(WORDS), rng.choice(KINDS)) for i in range(rng.randrange(6))] for d in range(60)} for _ in "ab"]
    frames = [spark.createDataFrame([(d, *x) for d, xs in side.items() for x in xs], "k long, pos int, value string, label string") for side in sides]
    got = {r.k: (r.our_entities, r.llm_entities, r.same) for r in evaluate.evaluate(*frames, "k").collect()}

    def distinct(items):
        groups = []
        for _, v, la in items:
            home = next((g for g in groups if g[0][1] == la and any(v in w or w in v for w, _ in g)), None)
            home.append((v, la)) if home else groups.append([(v, la)])
        return [max(g, key=lambda p: len(p[0])) for g in groups]

    for d in range(60):
        ours, theirs = (distinct(side[d]) for side in sides)
        free, same = list(ours), 0
        for v, la in theirs:
            hit = next((x for x in free if agree[x[1], la][1] and (x[0] in v or v in x[0])), None)
            if hit:
                free.remove(hit)
                same += 1
        assert got.get(d, (0, 0, 0)) == (len(ours), len(theirs), same)


def test_precision(spark):
    drop = [("12345", "person"), ("Metformin 500mg", "person"), ("Patient Care", "organization"), ("DOB", "date of birth"), ("Coordination", "suspicious_token"), ("12345678", "bank account number"), (" ", "name")]
    keep = [("1234567890", "bank account number"), ("15-Aug-1990", "date of birth")]
    df = spark.createDataFrame(drop + keep, "text string, label string")
    assert [tuple(r) for r in filters.precision_filter(df).collect()] == keep


def test_rates_and_matching(spark):
    df = spark.createDataFrame([(4, 3, 2), (4, 0, 0)], "our_entities long, llm_entities long, same long")
    assert [(r.different_llm, r.recall_pct, r.precision_pct) for r in evaluate.with_rates(df).collect()] == [(1, 66.7, 50.0), (0, 0.0, 0.0)]
    entity = "k int, pos int, value string, label string"
    ours = spark.createDataFrame([(1, 0, "john smith", "person"), (1, 1, "rome", "city"), (2, 0, "x", "city")], entity)
    theirs = spark.createDataFrame([(1, 0, "john", "name"), (1, 1, "smith", "person"), (1, 2, "rome italy", "address"), (3, 0, "x", "city")], entity)
    got = {r.k: (r.our_entities, r.llm_entities, r.same) for r in evaluate.evaluate(ours, theirs, "k").collect()}
    assert got == {1: (2, 3, 2), 2: (1, 0, 0), 3: (0, 1, 0)}


class Words(detect.Detector):
    name, ord, most_chars = "words", 3, 50

    def detect(self, texts):
        if any("boom" in t for t in texts) :
            raise RuntimeError("a model that fails")
        return [[(w, "person", 0.9) for w in t.split() if w.istitle()] for t in texts]


def test_a_model_is_a_plug_in_and_may_fail(spark):
    chunks = spark.createDataFrame([(1, 1, "call Anna"), (2, 1, "boom Bob"), (3, 1, None)], "doc_id long, chunk_index int, chunk string").coalesce(1)
    assert [(r.doc_id, r.text) for r in Words().apply(chunks, 0.5).collect()] == [(1, "Anna")]
    assert Words().apply(chunks, 0.95).count() == 0


def test_the_whole_job(spark):
    text = "Asha Rao, PAN ABCDE1234F, mail asha@example.com or +44 20 7946 0123. Token Zx9Qw8Er7Ty6Ui5Op4. ABCDE1234F again."
    docs = spark.createDataFrame([(1, text), (2, "nothing here"), (3, None), (4, "")], "doc_id long, text string")
    done = process(docs, EngineConf(min_agreement=1), detectors=[detect.RecogniserDetector(), detect.PatternDetector("qwen", 1), Words()])
    put = {r.doc_id: r for r in done.anonymised.collect()}
    assert set(put) == {1, 2} and put[2].anonymized == "nothing here" and put[2].n_replacements == 0
    for secret in ("ABCDE1234F", "asha@example.com", "7946", "Zx9Qw8Er7Ty6Ui5Op4", "Asha"):
        assert secret not in put[1].anonymized
    chunks = done.chunk_reports()
    reports = {r.doc_id: r for r in report.file_reports(chunks).collect()}
    kinds = {f.value: (f.pii_type, f.found_by) for f in reports[1].all_findings}
    assert kinds["ABCDE1234F"][0] in ("pan", "pan number") and "qwen" in kinds["ABCDE1234F"][1]
    assert kinds["Zx9Qw8Er7Ty6Ui5Op4"] == ("suspicious_token", ["audit"])
    meta = {r.doc_id: r for r in report.run_meta(report.file_reports(chunks)).collect()}
    assert meta[1].chunks_processed == 1 and meta[2].entity_count == 0 and meta[1].chunk_logs[0].presidio_count >= 2


def test_judge(spark):
    chunks = spark.createDataFrame([(1, 1, "a Rome b")], "doc_id long, chunk_index int, chunk string")
    asked = spark.createDataFrame([(1, 1, f"v{i}", "city", 0.5) for i in range(9)] + [(1, 1, "Rome", "city", 0.99)], "doc_id long, chunk_index int, value string, pii_type string, score double")
    batches = ensemble.judge_batches(asked, chunks)
    assert sorted(r["count"] for r in batches.groupBy("batch").count().collect()) == [2, 8]
    got = ensemble.judge(batches, lambda rows: {r["id"]: r["value"] in ("Rome", "v3") for r in rows}).collect()
    assert sorted((r.text, r.score) for r in got) == [("Rome", 0.95), ("v3", 0.72)]
    assert ensemble.judge(batches, lambda rows: 1 / 0).count() == 0


def docx() -> bytes:
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    xml = f"<w:document {w}><w:body>{p('First')}{p(' ')}<w:tbl><w:tr><w:tc>{p('a')}</w:tc><w:tc>{p('b')}</w:tc></w:tr></w:tbl>{p('Last')}</w:body></w:document>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", xml)
    return out.getvalue()


def xlsx() -> bytes:
    m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    r = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {m} {r}><sheets><sheet name="People" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {m}><si><t>Name</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c t="s"><v>0</v></c><c><v>42</v></c></row><row><c t="inlineStr"><is><t>Asha</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_files(spark, tmp_path):
    for name, content in {"b.txt": b"ok \xff bytes", "A.DOCX": docx(), "c d+1.xlsx": xlsx(), "bad.pdf": b"no pdf", "x.png": b"-"}.items():
        (tmp_path / name).write_bytes(content)
    listed = files.list_files(spark, str(tmp_path))
    assert [r.file_name for r in listed.select("file_name").collect()] == ["A.DOCX", "b.txt", "bad.pdf", "c d+1.xlsx"]
    got = {r.file_name: r for r in files.extract(listed).collect()}
    assert got["A.DOCX"].text == "First\nLast\na | b" and got["b.txt"].text == "ok  bytes" and got["c d+1.xlsx"].text == "[Sheet: People]\nName | 42\nAsha"
    assert got["bad.pdf"].text is None and got["bad.pdf"].error
    assert files.list_files(spark, str(tmp_path), ["b.txt", "no.txt"]).count() == 1 and files.list_files(spark, str(tmp_path), most=2).count() == 2
    assert [r.file_name for r in files.missing_files(spark, str(tmp_path), ["b.txt", "no.txt"]).collect()] == ["no.txt"]
    assert files.documents(listed).count() == 3


def test_store(spark, tmp_path):
    s = store.RunStore(spark, str(tmp_path))
    assert s.runs().count() == 0 and s.evaluations().count() == 0
    finding = "array<struct<value:string,pii_type:string,score:double,found_by:array<string>>>"
    rows = spark.createDataFrame([("a.txt", [("1234 5678 9012", "suspicious_token", 0.9, ["gliner"]), ("12", "x", 0.1, ["audit"])], 1)], f"file_name string, all_findings {finding}, chunks_anonymized int")
    for run in ("2026-01-01_00-00-00", "2026-01-02_00-00-00", "2026-01-02_00-00-00"):
        s.write_run(run, run[:10], rows)
    assert s.runs().count() == 2 and s.report().collect()[0].run_id == "2026-01-02_00-00-00"
    assert [(r.last_run_id, r.last_scanned_at) for r in store.latest_scans(s.runs()).collect()] == [("2026-01-02_00-00-00", "2026-01-02")]
    s.migrate(0.5)
    s.migrate(0.5)
    assert [[(f.value, f.pii_type) for f in r.all_findings] for r in s.runs().collect()] == [[("1234 5678 9012", "aadhaar number")]] * 2
    assert s.report().collect()[0].chunks_anonymized == 1 and s.report().collect()[0].chunks is None
    e = lambda *r: spark.createDataFrame([(n, 1, 1, 1, 0, 1.0, 1.0, "r", None) for n in r], store.EVALUATION)
    s.save_evaluations(e("a.txt", "b.txt"))
    s.save_evaluations(e("b.txt", "c.txt"))
    assert sorted(r.file_name for r in s.evaluations().collect()) == ["a.txt", "b.txt", "c.txt"]
    s.delete(spark.createDataFrame([("a.txt",)], "file_name string"))
    assert [r.file_name for r in s.deleted().collect()] == ["a.txt"] and s.evaluations().count() == 2
    s.restore()
    assert s.deleted().count() == 0
    s.export_json("2026-01-01_00-00-00", str(tmp_path / "json"))
    assert s.import_report(str(tmp_path / "json")).collect()[0].file_name == "a.txt"


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("key Zx9Qw8Er7Ty6Ui5Op4 and 123456789")
    for _ in range(2):  # the second time there is nothing new
        watch.watch(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "mark"), once=True).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.file_name, r.anonymized, r.n_found) for r in got] == [("a.txt", "key Zx9############p4 and 1#######9", 2)] or got[0].n_found == 2


def test_events(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (1, 4, None), (1, 5, None), (2, 1, None)], "u int, t int, k string")
    assert sorted((r.u, r.t) for r in report.new_events(df, "k", "t", "u").collect()) == [(1, 1), (1, 3), (1, 4), (2, 1)]
