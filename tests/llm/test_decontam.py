import math
import random
import re
from collections import Counter

from veilspark.llm import decontam

from .helpers import empty_documents, odd_documents

random.seed(5)
WORDS = [f"w{i}" for i in range(400)] + ["the", "of", "and"] * 60
ITEMS = [(i, " ".join(random.choice(WORDS) for _ in range(random.randrange(8, 45))) + ". " + " ".join(random.choice(WORDS) for _ in range(6)) + ".") for i in range(40)]


def test_block_max_wand_retrieves_what_scoring_all_retrieves():
    rng = random.Random(6)
    for shelf in decontam.Index(ITEMS, block=3).shelves:
        for _ in range(60):
            ids = sorted(rng.sample(range(len(shelf.postings)), min(60, len(shelf.postings))))
            score = Counter()
            for k in ids:
                for d, x in zip(*shelf.postings[k]):
                    score[d] += x
            for least in (0.05, 0.15, 0.3):
                want = {d for d, s in score.items() if s >= least}
                got = {d for d, _ in shelf.search(ids, least)}
                assert {d for d in got ^ want if abs(score[d] - least) > 1e-5} == set()


def brute(texts, items, retrieve=0.5, verify=0.8):
    """Every passage against every item, from the definitions: windows by class, BM25 over all items, shares of shingles."""
    plain = lambda t: re.findall(r"[^\s!-/:-@\[-`{-~]+", t.lower())
    split = {}
    for i, t in items:
        end = max((t.rstrip()[:-1].rfind(m) for m in ".?!\n"), default=-1) + 1
        q, a = plain(t.rstrip()[:end]), plain(t.rstrip()[end:])
        if not q or not a:
            every = q + a
            q, a = every[: len(every) * 3 // 4], every[len(every) * 3 // 4 :]
        split[i] = (q, a)
    n, mean = len(items), sum(len(q + a) for q, a in split.values()) / len(items)
    df = Counter(w for q, a in split.values() for w in {*q, *a})

    def impacts(words):
        return {w: math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * len(words) / mean)) for w, f in Counter(words).items()}

    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    out, own = [], {i: impacts(q + a) for i, (q, a) in split.items()}
    for t in texts:
        words, retrieved, found = plain(t), 0, {}
        for i, (q, a) in split.items():
            wide, whole = 16, sum(own[i].values())
            while wide < len(q + a):
                wide *= 2
            mine = own[i]
            for p in range(max(1, -(-len(words) // wide) - 1)):
                window = words[p * wide : (p + 2) * wide]
                there = set(window)
                score = sum(x for w, x in mine.items() if w in there) / whole
                if score < retrieve - 1e-6:
                    continue
                retrieved += 1
                shares = []
                for part in (q, a):
                    k = min(5, len(part))
                    shares.append(len(grams(part, k) & grams(window, k)) / len(grams(part, k)))
                if min(shares) >= verify:
                    found[i] = max(found.get(i, 0), score)
        out.append((retrieved, sorted(found), max(found.values(), default=0.0)))
    return out


def test_whole_documents_against_brute_force_with_any_number_of_indexes(spark, monkeypatch):
    rng = random.Random(11)
    texts = []
    for i, t in ITEMS:
        words = t.split()
        for _ in range(rng.randrange(1 + len(words) // 4)):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        cut = rng.randrange(len(words))
        texts.append(" ".join(rng.choices(WORDS, k=rng.randrange(150)) + words + rng.choices(WORDS, k=rng.randrange(150)) + words[:cut]))
    long = [(77, " ".join(f"x{i}" for i in range(66_000)) + ". the answer of it")]
    items, docs = ITEMS + long, texts + [long[0][1], "x1 " * 40]
    want = brute(docs, items)
    assert want[len(texts)][1] == [77]
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(3)
    for index_bytes, sums in ((1 << 20, 1 << 22), (900, 1 << 22), (20_000, 40)):
        monkeypatch.setattr(decontam, "SUMS", sums)
        rows = decontam.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string").repartition(3), index_bytes=index_bytes)
        got = {r.doc_id: (r.n_retrieved, r.item_ids, r.best_score) for r in rows.collect()}
        for i, (retrieved, found, best) in enumerate(want):
            assert got[i][:2] == (retrieved, found) and abs(got[i][2] - best) < 1e-9


def test_items_are_found_wherever_they_stand(spark):
    items = spark.createDataFrame([*ITEMS, (99, None), (100, ""), (None, ITEMS[3][1])], "item_id long, text string")
    rng = random.Random(7)
    filler = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    docs = [(i, f"{filler(rng.randrange(200))} {t.upper() if i % 2 else t} {filler(rng.randrange(200))}") for i, t in ITEMS]
    docs += [(1000 + i, filler(300)) for i in range(20)] + [(2000, ITEMS[5][1][:25])]
    got = {r.doc_id: r for r in decontam.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    for i, _ in ITEMS:
        assert i in got[i].item_ids and got[i].contaminated
    assert got[3].item_ids == [3, None] and not any(got[1000 + i].contaminated for i in range(20)) and not got[2000].contaminated


def test_question_without_its_answer_is_clean():
    index = decontam.Index(ITEMS)
    question = ITEMS[8][1].split(". ")[0]
    assert index.hits(decontam.words_of(question + " " + " ".join(f"z{i}" for i in range(50))))[1] == {}
    assert 8 in index.hits(decontam.words_of("z " * 70 + ITEMS[8][1] + " y" * 70))[1]


def test_a_filter_by_more_indexes_than_a_worker_holds(spark, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    made = decontam.build(items, index_bytes=1000)
    sizes = sorted(made.read(n)[1] for n in made.names)
    monkeypatch.setattr(decontam, "HELD_BYTES", sizes[-1] + sizes[-2])
    assert len(made.names) > 4 and sum(len(s.ids) for x in made for s in x.shelves) == len(ITEMS) and 1 < len(made.held) < len(made.names)
    docs = spark.createDataFrame(ITEMS, "doc_id long, text string")
    assert decontam.clean_rows(docs, items).count() == 0


def test_each_index_is_read_once_where_all_can_be_held(spark, monkeypatch):
    items = spark.createDataFrame([(i, f"question {i} " + t) for i, t in ITEMS * 3], "item_id long, text string")
    made, read = decontam.build(items, index_bytes=300), []
    assert len(made.names) > 20
    monkeypatch.setattr(decontam.Indexes, "read", lambda self, name, f=decontam.Indexes.read: (read.append(name), f(self, name))[1])
    monkeypatch.setattr(decontam, "CHARS", 200)
    for _ in range(3):
        made.judge([t for _, t in ITEMS], 0.5, 0.8)
    assert sorted(read) == sorted(made.names)


def test_ids_of_any_type(spark):
    items = spark.createDataFrame([("gsm8k/1", ITEMS[3][1]), ("gsm8k/2", ITEMS[4][1]), (None, ITEMS[3][1]), ("-1", ITEMS[3][1])], "item_id string, text string")
    docs = spark.createDataFrame([("a", ITEMS[3][1]), (None, "clean text of no item"), ("b", ITEMS[4][1])], "doc_id string, text string")
    got = {r.doc_id: r.item_ids for r in decontam.decontaminate(docs, items).collect()}
    assert got == {"a": ["-1", "gsm8k/1", None], None: [], "b": ["gsm8k/2"]}


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.decontaminate(docs, items).where("contaminated").count() == 0
    assert decontam.clean_rows(docs, items).count() == docs.count() and decontam.clean_rows(docs, items).columns == docs.columns
    assert decontam.decontaminate(docs, items.limit(0)).count() == docs.count()
    assert decontam.decontaminate(empty_documents(spark), items).collect() == []
