import random
import unicodedata

from veilspark.llm import units

from .helpers import empty_documents, odd_documents

PASSAGE = "This passage has several sentences of some length here. It goes on. And then it ends with a sentence that is long again."


def brute(texts, unit="line"):
    """Kept units by a plain dictionary of the first rank."""
    first = {}
    marks = []
    for i, t in enumerate(texts):
        t = t or ""
        spans = units.units_of(t, unit)
        marks.append((spans, units.digests(t, spans)))
    for i, (_, ds) in enumerate(marks):
        for u, d in enumerate(ds):
            if d is not None:
                first.setdefault(d, (i, u))
    return [[spans[u] for u, d in enumerate(ds) if d is not None and first[d] != (i, u)] for i, (spans, ds) in enumerate(marks)]


def test_later_passages_go_and_offsets_are_of_the_original(spark):
    texts = ["Alpha beta gamma delta epsilon zeta eta theta iota. " + PASSAGE, "Something else stands before it " + PASSAGE + " And after.", "Nothing here repeats anything at all in any of the others.", PASSAGE, None, ""] * 1
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in units.deduplicate(docs).collect()}
    want = brute(texts)
    for i, t in enumerate(texts):
        assert [(s.start, s.end) for s in got[i].removed] == want[i]
        assert got[i].n_removed == len(want[i])
    assert got[3].n_removed == 3 and got[3].kept_text == "" and got[2].kept_text == texts[2]
    assert got[1].n_removed == 2 and got[1].kept_text.startswith("Something else stands before it This passage")


def test_paragraphs(spark):
    text = "one two three four five six seven eight\nnine\n\n\nten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    docs = spark.createDataFrame([(1, text), (2, "intro words that are many enough to count here\n\n" + text)], "doc_id long, text string")
    got = {r.doc_id: r for r in units.deduplicate(docs, unit="paragraph").collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 2 and got[2].kept_text.startswith("intro words")


def test_odd_rows_and_hot_lines(spark):
    docs = odd_documents(spark)
    got = units.deduplicate(docs).collect()
    assert len(got) == docs.count()
    assert all(r.n_removed == 0 for r in got if r.doc_id == 5)  # repeated rows stay with their twin
    assert {r.n_removed > 0 for r in got if r.doc_id == 7} == {True} and {r.n_removed for r in got if r.doc_id in (0, 1, 3)} == {0}
    line = "the same line stands in every one of these documents\n"
    many = spark.createDataFrame([(i, line + f"own line number {i} with enough words in it to count") for i in range(200)], "doc_id long, text string").repartition(7)
    assert sorted(r.n_removed for r in units.deduplicate(many).collect()) == [0] + [1] * 199


def test_no_rows(spark):
    assert units.deduplicate(empty_documents(spark)).collect() == []


def test_short_lines_and_documents_against_a_dictionary_of_lines(spark):
    texts = ["And ornd.\nFirst text has its own long line after the short one.", "Other words. And more\nand  ornd\nAnother line follows here", "Tiny text", "tiny text.", "And ornd.\nTiny text\nAnd ornd.", "Other words. And more", "---\nx", "---"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    seen, want = set(), {}
    for i, t in enumerate(texts):
        for line in t.split("\n"):
            plain = " ".join(line.lower().split())
            key = plain.strip(units.EDGES) or plain
            if key not in seen:
                want.setdefault(i, []).append(line)
            seen.add(key)
    got = {r.doc_id: [x for x in r.kept_text.split("\n") if x] for r in units.deduplicate(docs).collect()}
    assert got == {i: want.get(i, []) for i in range(len(texts))}


def test_a_line_goes_however_its_copy_is_spaced(spark):
    # Lines of several sentences, spaced by any Unicode white space and framed by marks; an independent reading says which are alike.
    rng = random.Random(6)
    spaces = [" ", "  ", "\t", "\u00a0", "\u2003", "\u3000", " \u00a0", "\x0b", "\x1f", "\u2028"]
    sentences = ["Alpha beta gamma one.", "Delta epsilon zeta eta two!", "A short one?", "This one has quite a few more words in it than eight.", "Z."]
    texts = []
    for _ in range(60):
        lines = []
        for _ in range(rng.randrange(1, 4)):
            words = " ".join(rng.choices(sentences, k=rng.randrange(1, 4))).split(" ")
            line = words[0] + "".join(rng.choice(spaces) + (w.upper() if rng.random() < 0.2 else w) for w in words[1:])
            lines.append(rng.choice(["", "- ", "* ", '"', " "]) + line + rng.choice(["", " ", '"', " --"]))
        texts.append("\n".join(lines))
    texts += ["Alpha beta gamma one. Delta epsilon zeta eta two.", "Alpha beta gamma one.\u00a0Delta epsilon zeta eta two."]

    def plain(line):
        spaced = "".join(" " if unicodedata.category(c) in ("Zs", "Zl", "Zp") or c in "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85" else c.lower() for c in line)
        words = [w for w in spaced.split(" ") if w]
        return " ".join(words).strip("\"'()[]{}.,;:!?*-_ ")

    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in units.deduplicate(docs).collect()}
    seen = set()
    for i, t in enumerate(texts):
        at = 0
        for line in t.split("\n"):
            if plain(line) in seen:
                kept = [k for k, c in enumerate(line, at) if not c.isspace() and not any(s.start <= k < s.end for s in got[i].removed)]
                assert kept == [], (i, line)
            seen.add(plain(line))
            at += len(line) + 1
    assert got[len(texts) - 1].kept_text == ""
