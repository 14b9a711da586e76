"""DuckDB SQL of the queries, written on its own terms and with RE2's spelling of the patterns."""

from __future__ import annotations

from ..functions import vocab
from . import derived as dv
from .derived import duck

ORACLE_SQL: dict[str, str] = {}
WS = r"[\s\p{Z}\x0b\x1c-\x1f\x85]"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


def flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '{WS}+', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def re2(pattern: str) -> str:
    return pattern.replace("(?Ui)", "(?i)").replace("(?U)", "")


def case(x: str, table: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {x} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {other} END"


def canonical(x: str, evaluator: bool = False) -> str:
    table = {k: v for k, v in vocab.CANONICAL.items() if not (evaluator and k == "dob")}
    x = f"lower({strip(x)})"
    return case(x, table, x)


def agrees(a: str, b: str, evaluator: bool = False) -> str:
    x, y = (f"lower({strip(c)})" for c in (a, b))

    def both(test: str) -> str:
        return f"({test.format(x)} AND {test.format(y)})"

    rules = [
        f"{x} = {y}",
        f"{canonical(a, evaluator)} = {canonical(b, evaluator)}",
        both("{} IN ('person', 'name')"),
        both("({0} IN ('state', 'location', 'city') OR contains({0}, 'address'))"),
        both("{} IN ('date', 'date of birth', 'date_of_birth')"),
    ]
    if not evaluator:
        rules += [both("{} IN ('email', 'email address')"), both("{} IN ('phone', 'phone number')"), both("contains({}, 'organization')")]
    return "(" + " OR ".join(rules) + ")"


def chunk_sql(source: str, size: int, overlap: int, most: int | None = None) -> str:
    step = size - overlap if overlap < size else size
    some = f" WHERE i < {most}" if most else ""
    return f"""SELECT doc_id, (i + 1)::INT AS chunk_index, substr(t, (i * {step} + 1)::INT, {size}) AS chunk
FROM (SELECT doc_id, t, unnest(range(0, (length(t) + {step - 1}) // {step})) AS i FROM (SELECT doc_id, {flat('text')} AS t FROM {source})){some}"""


DET, IDS, VAL = (f"({duck(x)})" for x in (dv.DETECTIONS, dv.ID_TEXTS, dv.VALUES))
DOCS = "(SELECT doc_id, text FROM documents)"
ORACLE_SQL |= {
    "chunk_documents": chunk_sql("documents", 1600, 200),
    "chunk_first_only": chunk_sql("documents", 1600, 200, 1),
    "chunk_stats": f"SELECT doc_id, count(*) AS n_chunks, sum(length(chunk))::BIGINT AS n_chars, max(length(chunk))::BIGINT AS longest FROM ({chunk_sql('documents', 700, 100)}) GROUP BY doc_id",
    "chunk_conversations": chunk_sql("(SELECT conv_id * 1000 + turn AS doc_id, text FROM conversations)", 300, 300),
}

# Audit: \w of Python and Java is not RE2's, so words are taken as Unicode runs first.
W = r"[\pL\pN_]"
RUNS = rf"regexp_extract_all(text, '[\pL\pN\pM_]+')"
# RE2's word boundaries know ASCII only; Latin letters beyond it are made an ASCII one that no pattern takes.
ASCII = "regexp_replace(text, '[ªµºÀ-ÖØ-öø-ɏ]', '_', 'g')"
AUDIT = {n: f"regexp_extract_all({ASCII}, {q(re2(p))})" for n, p in vocab.AUDIT.items()}
AUDIT["alphanumeric"] = f"list_filter({RUNS}, lambda x: regexp_full_match(x, '[A-Za-z0-9]{{12,}}') AND NOT regexp_full_match(x, '[A-Za-z]{{12,22}}'))"
AUDIT["obfuscated_email"] = rf"regexp_extract_all(text, '(?i){W}+{WS}*(?:at|\(at\)){WS}*{W}+{WS}*(?:dot|\.){WS}*{W}+')"
for _n in vocab.AUDIT:
    _source = IDS if _n in ("uuid", "hex_32", "hex_64") else DOCS
    ORACLE_SQL[f"audit_{_n}"] = f"SELECT DISTINCT doc_id, unnest({AUDIT[_n]}) AS text FROM {_source}"
EDGES = q(vocab.TOKEN_EDGES)
BITS = "list_sum(list_transform(list_distinct(string_split(t, '')), lambda c: -(len(list_filter(string_split(t, ''), lambda x: x = c)) / length(t)) * log2(len(list_filter(string_split(t, ''), lambda x: x = c)) / length(t))))"


def tokens(source: str) -> str:
    return f"""SELECT DISTINCT doc_id, t AS text FROM (SELECT doc_id, trim(unnest(string_split({flat('text')}, ' ')), {EDGES}) AS t FROM {source})
WHERE length(t) >= 16 AND {BITS} >= 3.5"""


ORACLE_SQL["entropy_tokens"] = tokens(f"(SELECT doc_id, text FROM documents UNION ALL SELECT doc_id + 1000000000, text FROM {IDS})")
ORACLE_SQL["audit_all"] = " UNION ".join([f"SELECT doc_id, unnest({AUDIT[n]}) AS text FROM documents" for n in vocab.AUDIT] + [tokens("documents")])


def matches(rules, source: str) -> str:
    """Rows rule, i, text, label, score of all matches."""
    parts = [
        f"SELECT doc_id, chunk_index, {o} AS rule, {q(label)} AS label, {score} AS score, unnest(list_transform(regexp_extract_all(text, {q(re2(p))}), lambda x, i: {{'i': i, 't': x}})) AS m FROM {source}"
        for o, (p, label, score) in enumerate(rules)
    ]
    return f"SELECT doc_id, chunk_index, rule, label, score, m.i AS i, {strip('m.t')} AS text FROM ({' UNION ALL '.join(parts)})"


ORACLE_SQL["indian_ids"] = f"""SELECT doc_id, chunk_index, text, label, 1.0::DOUBLE AS score FROM ({matches([(p, la, 1.0) for p, la in vocab.INDIAN_IDS], IDS)})
QUALIFY row_number() OVER (PARTITION BY doc_id, lower(text), label ORDER BY rule, i) = 1"""
SUPPLEMENT = f"""SELECT doc_id, chunk_index, text, label, score::DOUBLE AS score, rule::INT AS rule FROM ({matches(vocab.SUPPLEMENT, IDS)})
QUALIFY row_number() OVER (PARTITION BY doc_id, lower(text) ORDER BY rule, i) = 1"""
ORACLE_SQL["pattern_supplement"] = SUPPLEMENT
ORACLE_SQL["pattern_supplement_known"] = rf"""SELECT * FROM ({SUPPLEMENT}) s WHERE NOT EXISTS (SELECT 1 FROM (
  SELECT doc_id, text FROM {DET} UNION ALL SELECT doc_id, regexp_extract(text, '(\d{{3}}-\d{{2}}-\d{{4}})', 1) FROM {IDS} WHERE doc_id % 2 = 0) k
  WHERE k.doc_id = s.doc_id AND lower(k.text) = lower(s.text))"""
LUHN = r"""list_sum(list_transform(string_split(reverse(regexp_replace(text, '\D', '', 'g')), ''), lambda d, i:
  CASE WHEN i % 2 = 1 THEN d::INT WHEN d::INT > 4 THEN 2 * d::INT - 9 ELSE 2 * d::INT END)) % 10 = 0"""
for _n, (_raw, _p, _score) in vocab.RECOGNISERS.items():
    _test = f" WHERE {LUHN}" if _n == "card" else ""
    ORACLE_SQL[f"recognise_{_n}"] = f"""SELECT doc_id, chunk_index, text, {q(vocab.SHARED_LABELS[_raw])} AS label, {_score}::DOUBLE AS score
FROM (SELECT DISTINCT doc_id, chunk_index, unnest(regexp_extract_all(text, {q(re2(_p))})) AS text FROM {IDS}){_test}"""
ORACLE_SQL["recognise_documents"] = " UNION ALL ".join(
    f"SELECT doc_id, text, {q(vocab.SHARED_LABELS[vocab.RECOGNISERS[n][0]])} AS label, {vocab.RECOGNISERS[n][2]}::DOUBLE AS score FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, {q(re2(vocab.RECOGNISERS[n][1]))})) AS text FROM documents)"
    for n in ("email", "url")
)
ORACLE_SQL["language_of_texts"] = r"""SELECT doc_id, CASE WHEN 2 * len(regexp_extract_all(t, '\p{Arabic}')) > len(regexp_extract_all(t, '\pL')) THEN 'ar' ELSE 'en' END AS language
FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 20) || ' هذا نص عربي طويل بما يكفي لكي يغلب على غيره من الحروف' ELSE text END AS t FROM documents)"""
ROUTES = " UNION ALL ".join(f"SELECT {q(k)} AS route, {i}::INT AS detector_ord, {q(d)} AS detector" for k, names in vocab.ROUTES.items() for i, d in enumerate(names))
ORACLE_SQL["detector_routes"] = f"""SELECT doc_id, detector_ord, detector FROM documents JOIN ({ROUTES})
ON route = CASE WHEN doc_id % 4 = 0 THEN 'ar' ELSE 'en' END"""

# Labels
_key = "upper(trim(label))"
_mapped = f"coalesce({case(_key, vocab.SHARED_LABELS)}, CASE WHEN lower(replace({_key}, '_', ' ')) IN {listed(vocab.ZERO_SHOT_LABELS)} THEN lower(replace({_key}, '_', ' ')) END)"
ORACLE_SQL["map_labels"] = f"""SELECT ord, {_mapped} AS mapped, coalesce({_mapped}, nullif(lower(trim(replace(label, '_', ' '))), ''), 'entity') AS named
FROM ({duck(dv.RAW_LABELS)})"""
_lab = "lower(trim(label))"
_near = f"list_filter([{', '.join(map(q, vocab.SLM_LABELS))}], lambda c: contains(c, {_lab}) OR contains({_lab}, c))"
ORACLE_SQL["canonical_labels"] = f"""SELECT ord, {canonical('label')} AS canonical, {canonical('label', True)} AS evaluator, replace({_lab}, ' ', '_') AS slug,
  CASE WHEN {_lab} IN {listed(vocab.SLM_LABELS)} THEN {_lab} WHEN len({_near}) > 0 THEN {_near}[1]
    WHEN contains({_lab}, 'name') OR contains({_lab}, 'per') THEN 'person' ELSE {_lab} END AS slm,
  {case('lower(label)', vocab.TYPE_COLOURS, q(vocab.OTHER_COLOUR))} AS colour
FROM ({duck(dv.OUR_LABELS)})"""
ORACLE_SQL["label_agreement_matrix"] = f"""SELECT ord, label, label_2, {agrees('label', 'label_2')} AS agrees, {agrees('label', 'label_2', True)} AS evaluator
FROM ({duck(dv.LABEL_PAIRS)})"""
A, P, G = (q(re2(x)) for x in (vocab.AADHAAR, vocab.PAN, vocab.GST))
_by_pattern = f"""CASE WHEN regexp_matches(text, {A}) AND label IN ('date', 'date of birth', 'date_of_birth', 'date time') THEN 'aadhaar number'
  WHEN label = 'organization' AND regexp_matches(text, {P}) THEN 'pan number' WHEN label = 'organization' AND regexp_matches(text, {G}) THEN 'gst number'
  WHEN label = 'organization' AND regexp_full_match(regexp_replace(text, '[\\s-]', '', 'g'), '\\d{{12}}') THEN 'aadhaar number' END"""
ORACLE_SQL["normalize_by_pattern"] = f"""SELECT doc_id, chunk_index, detector, pos, text, coalesce(n, label) AS label, CASE WHEN n IS NULL THEN score ELSE greatest(score, 0.85) END AS score
FROM (SELECT *, {_by_pattern} AS n FROM {DET})"""
ORACLE_SQL["person_normalisation"] = """SELECT c_custkey, CASE WHEN h THEN 'person' WHEN c_custkey % 3 = 0 THEN 'First Name' ELSE 'last name' END AS label,
  CASE WHEN h THEN greatest(s, 0.6) ELSE s END AS score FROM (SELECT c_custkey, contains(trim(replace(c_name, '#', CASE WHEN c_custkey % 2 = 0 THEN ' ' ELSE '-' END)), ' ') AS h,
  (c_custkey % 100)::DOUBLE / 100 AS s FROM customer)"""

# Ensemble
ORACLE_SQL["dedup_detections"] = f"""WITH d AS (SELECT * FROM {DET} UNION ALL SELECT doc_id, chunk_index, detector, detector_ord, pos + 10, ' ' || upper(text), label, score + 0.01::DOUBLE * (doc_id % 3) FROM {DET})
SELECT doc_id, chunk_index, detector, detector_ord, trim(text) AS text, lower(trim(label)) AS label, score FROM d
QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_index, detector, lower(trim(text)), lower(trim(label)) ORDER BY score DESC, pos) = 1"""
MERGED = f"""SELECT doc_id, chunk_index, text, {canonical('label')} AS label, score FROM {DET}
QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_index, lower(text), {canonical('label')} ORDER BY score DESC, detector_ord, pos) = 1"""
ORACLE_SQL["merge_detections"] = MERGED
VOTED = f"""SELECT m.doc_id, m.chunk_index, m.text, m.label, m.score, string_agg(DISTINCT d.detector, '|' ORDER BY d.detector) AS found_by, count(DISTINCT d.detector) AS n_votes
FROM ({MERGED}) m JOIN {DET} d ON d.doc_id = m.doc_id AND d.chunk_index = m.chunk_index AND lower(d.text) = lower(m.text) AND {agrees('d.label', 'm.label')} GROUP BY ALL"""


def needed(least: int, names: int) -> str:
    return f"CASE WHEN label IN ('person', 'name') THEN {names} ELSE {least} END"


ORACLE_SQL["agreement_1"] = VOTED
ORACLE_SQL["agreement_2"] = f"SELECT * FROM ({VOTED}) WHERE n_votes >= {needed(2, 2)}"
ORACLE_SQL["agreement_names"] = f"SELECT * FROM ({VOTED}) WHERE n_votes >= {needed(2, 1)}"
ORACLE_SQL["dropped_findings"] = f"""SELECT *, 'agreement < required (kept only when at least ' || {needed(2, 1)} || ' detector(s) agree)' AS reason
FROM ({VOTED}) WHERE n_votes < {needed(2, 1)}"""
ORACLE_SQL["weighted_agreement"] = f"""SELECT doc_id, chunk_index, text, label, score, found_by,
  round(list_sum(list_transform(string_split(found_by, '|'), lambda x: CASE x WHEN 'presidio' THEN 0.3::DOUBLE WHEN 'qwen' THEN 0.45::DOUBLE ELSE 0.25::DOUBLE END)), 6) AS weight
FROM ({VOTED}) WHERE weight >= 0.5"""
ORACLE_SQL["relabel_suspicious"] = f"""WITH d AS (SELECT * FROM {DET}),
s AS (SELECT doc_id, lower(trim(text)) AS low, detector_ord, pos, CASE WHEN regexp_matches(text, {A}) OR contains(lower(label), 'aadhaar') THEN 'aadhaar number'
  WHEN regexp_matches(text, {P}) OR contains(lower(label), 'pan') THEN 'pan number' ELSE lower(trim(label)) END AS said FROM d),
b AS (SELECT doc_id, low, coalesce(arg_max(said, (detector_ord, pos)) FILTER (said IN ('aadhaar number', 'pan number')), arg_min(said, (detector_ord, pos))) AS said FROM s GROUP BY ALL)
SELECT d.doc_id, d.chunk_index, upper(d.text) AS text, CASE WHEN d.doc_id % 10 = 0 THEN 'other' ELSE b.said END AS label, d.score, d.detector
FROM d JOIN b ON b.doc_id = d.doc_id AND b.low = lower(upper(d.text)) WHERE d.pos < 3"""
ORACLE_SQL["audit_not_detected"] = "SELECT DISTINCT a.doc_id, a.chunk_index, a.text FROM (" + " UNION ".join(
    [f"SELECT doc_id, chunk_index, unnest({AUDIT[n]}) AS text FROM {IDS}" for n in vocab.AUDIT]
    + [f"SELECT doc_id, 1, text FROM ({tokens(IDS)})"]
) + f""") a WHERE NOT EXISTS (SELECT 1 FROM ({ORACLE_SQL['indian_ids']}) i WHERE i.doc_id = a.doc_id AND i.text = a.text)"""
ORACLE_SQL["findings_exact"] = f"""SELECT doc_id, chunk_index, b.value AS value, b.kind AS pii_type, b.score AS score, found_by, ord::INT AS ord FROM (
  SELECT doc_id, chunk_index, lower(trim(text)) AS low, arg_max({{'value': trim(text), 'kind': {canonical('label')}, 'score': score}}, (score, length(trim(text)), -(detector_ord * 10 + pos))) AS b,
    string_agg(DISTINCT detector, '|' ORDER BY detector) AS found_by, min(detector_ord * 10 + pos) AS ord FROM {DET} GROUP BY ALL)"""
def holds(a: str, b: str) -> str:
    return f"(contains({a}, {b}) OR contains({b}, {a}))"


def grouped(items: str, key: str, fits: str, first: str, more: str) -> str:
    """{key}, gs: items(key, n, x) folded in order: ``x`` joins the first group ``g`` it fits, else makes a new one."""
    return f"""WITH RECURSIVE i AS ({items}),
s AS (SELECT {key}, 0::BIGINT AS n, list_filter([{first}], lambda g: false) AS gs FROM i WHERE n = 1
  UNION ALL SELECT {key}, n, CASE WHEN coalesce(spot, 0) = 0 THEN list_append(gs, {first}) ELSE list_transform(gs, lambda g, k: CASE WHEN k = spot THEN {more} ELSE g END) END
  FROM (SELECT s.{key}, i.n, i.x, s.gs, list_position(list_transform(s.gs, lambda g: {fits}), true) AS spot FROM s JOIN i ON i.{key} = s.{key} AND i.n = s.n + 1))
SELECT {key}, arg_max(gs, n) AS gs FROM s GROUP BY {key}"""


def findings_folded(exact: str) -> str:
    """Findings of ``exact(doc_id, chunk_index, value, pii_type, score, found_by, ord)``, merged by value, folded to groups."""
    items = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, lower(value)) AS n,
      {{'kind': pii_type, 'lows': [lower(value)], 'value': value, 'top': pii_type, 'score': score, 'by': string_split(found_by, '|'), 'ord': ord}} AS x FROM ({exact})"""
    fits = f"{agrees('g.kind', 'x.kind')} AND len(list_filter(g.lows, lambda m: {holds('m', 'x.lows[1]')})) > 0"
    better = "(length(x.value) > length(g.value) OR (length(x.value) = length(g.value) AND x.score > g.score))"
    top = ", ".join(f"'{c}': CASE WHEN {better} THEN x.{c} ELSE g.{c} END" for c in ("value", "top", "score"))
    more = f"{{'kind': g.kind, 'lows': list_concat(g.lows, x.lows), {top}, 'by': list_concat(g.by, x.by), 'ord': g.ord}}"
    return f"""SELECT doc_id, g.value AS value, g.top AS pii_type, round_even(g.score, 4) AS score, array_to_string(list_sort(list_distinct(g.by)), '|') AS found_by, g.ord AS ord
FROM (SELECT doc_id, unnest(gs) AS g FROM ({grouped(items, 'doc_id', fits, 'x', more)}))"""


ORACLE_SQL["dedupe_findings"] = f"SELECT doc_id, 1::INT AS chunk_index, value, pii_type, score, found_by, ord FROM ({findings_folded(ORACLE_SQL['findings_exact'])})"
ORACLE_SQL["judge_batches"] = f"""SELECT doc_id, chunk_index, ((n - 1) // 4)::INT AS batch, ((n - 1) % 4)::INT AS id, value, pii_type, score FROM (
  SELECT doc_id, chunk_index, trim(text) AS value, trim(label) AS pii_type, max(score) AS score,
    row_number() OVER (PARTITION BY doc_id, chunk_index ORDER BY length(trim(text)) DESC, lower(trim(text)), trim(text), trim(label)) AS n
  FROM (SELECT * FROM {DET} UNION ALL SELECT doc_id, chunk_index, detector, detector_ord, pos, text || ' II', label, score FROM {DET})
  WHERE doc_id IN (SELECT c_custkey FROM customer) GROUP BY doc_id, chunk_index, trim(text), trim(label))"""
ORACLE_SQL["span_context"] = f"""SELECT doc_id, span, CASE WHEN p = 0 THEN '(span not in chunk) «' || substr(span, 1, 80) || '»'
  ELSE substr(text, greatest(1, p - 20), p - greatest(1, p - 20) + length(span) + 20) END AS context FROM (
  SELECT doc_id, text, span, coalesce(nullif(strpos(text, span), 0), strpos(lower(text), lower(span))) AS p FROM (
    SELECT doc_id, text, unnest(['mail user', 'GST 27ABCDE', 'nowhere', 'Customer', right(text, 5)]) AS span FROM {IDS}))"""

# Filters
MED = q(re2(vocab.MEDICATION))
_v, _l = "trim(value)", "lower(trim(label))"
PRECISE = f"""NOT CASE WHEN {_v} = '' THEN true
  WHEN {_l} IN ('person', 'name', 'first name', 'last name') THEN regexp_full_match({_v}, '\\d+') OR (length({_v}) <= 80 AND regexp_matches({_v}, {MED}))
  WHEN {_l} = 'organization' THEN lower({_v}) IN {listed((*vocab.TITLE_PHRASES, *vocab.FORM_PHRASES))}
  WHEN {_l} IN ('date of birth', 'date_of_birth', 'dob') THEN lower({_v}) IN ('dob', 'd.o.b.', 'date of birth')
  WHEN {_l} = 'suspicious_token' THEN lower({_v}) IN {listed(vocab.COMMON_WORDS)}
  WHEN {_l} IN ('bank account number', 'bank account') THEN length(regexp_replace({_v}, '\\D', '', 'g')) BETWEEN 6 AND 9 ELSE false END"""
ORACLE_SQL["precision_filter"] = f"SELECT doc_id, kind, value AS text, label FROM {VAL} WHERE {PRECISE}"
ORACLE_SQL["min_score"] = f"SELECT doc_id, kind FROM {VAL} WHERE CASE WHEN doc_id % 9 != 0 THEN score ELSE 0.8 END >= 0.75"
ORACLE_SQL["form_label_filter"] = f"""SELECT ord, text FROM ({duck(dv.FORM_TEXTS)})
WHERE lower(trim(text)) NOT IN {listed(vocab.FORM_PHRASES)}"""
ORACLE_SQL["recogniser_false_positives"] = f"""WITH f AS (SELECT *, CASE
    WHEN regexp_matches(text, {A}) AND label IN ('date', 'date of birth', 'date_time') THEN {{'t': trim(regexp_extract(text, {A})), 'l': 'aadhaar number', 's': greatest(score, 0.85)}}
    WHEN label = 'organization' AND regexp_matches(text, {q(re2(vocab.STATE_PIN))}) THEN {{'t': text, 'l': 'address', 's': greatest(score, 0.8)}}
    WHEN label = 'organization' AND regexp_matches(text, {P}) THEN {{'t': text, 'l': 'pan number', 's': greatest(score, 0.85)}}
    WHEN label = 'organization' AND regexp_matches(text, {G}) THEN {{'t': text, 'l': 'gst number', 's': greatest(score, 0.85)}}
    ELSE {{'t': text, 'l': label, 's': score}} END AS x FROM {DET}
  WHERE NOT (label = 'organization' AND lower(text) IN {listed((*vocab.FORM_PHRASES, *vocab.TITLE_PHRASES))}))
SELECT doc_id, chunk_index, detector, x.t AS text, x.l AS label, x.s AS score FROM f
QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_index, detector, lower(x.t), lower(x.l) ORDER BY pos) = 1"""
ORACLE_SQL["likely_medication"] = f"SELECT doc_id, kind, {_v} != '' AND length({_v}) <= 80 AND regexp_matches({_v}, {MED}) AS medication FROM {VAL}"


# Replacement
def mask(c: str) -> str:
    s = strip(c)
    k = f"greatest(1, round_even(length({s}) * 0.15::DOUBLE, 0)::INT)"
    k = f"CASE WHEN 2 * {k} >= length({s}) THEN greatest(1, length({s}) // 3) ELSE {k} END"
    return f"CASE WHEN {s} = '' THEN '#####' WHEN length({s}) <= 2 THEN repeat('#', length({s})) ELSE substr({s}, 1, ({k})::INT) || repeat('#', (length({s}) - 2 * ({k}))::INT) || right({s}, ({k})::INT) END"


ORACLE_SQL["partial_mask"] = f"SELECT doc_id, 0 AS kind, md5({mask('text')}) AS masked FROM documents UNION ALL SELECT doc_id, kind + 1, md5({mask('value')}) FROM {VAL}"


def date_format(c: str) -> str:
    return rf"""CASE WHEN regexp_matches({c}, '\b(19|20)\d{{2}}[-/]\d{{1,2}}[-/]\d{{1,2}}\b') THEN 'yyyymmdd'
  WHEN regexp_matches({c}, '\b\d{{1,2}}[-/]\d{{1,2}}[-/](19|20)\d{{2}}\b') THEN 'ddmmyyyy' ELSE 'mmddyyyy' END"""


_d = r"regexp_replace(value, '\D', '', 'g')"
PREFIX = f"""CASE WHEN starts_with({_v}, '0') AND length({_d}) >= 9 THEN '0' WHEN starts_with({_v}, '+') AND length({_d}) >= 10 THEN
  CASE WHEN starts_with({_d}, '1') THEN '+1' WHEN {_d}[1:2] IN ('44', '46', '33', '49') THEN '+' || {_d}[1:2] ELSE '+' || {_d}[1:3] END ELSE '+1' END"""
ORACLE_SQL["date_format"] = f"SELECT doc_id, kind, {date_format(_v)} AS format FROM {VAL}"
ORACLE_SQL["phone_prefix"] = f"SELECT doc_id, kind, {PREFIX} AS prefix FROM {VAL}"
_src = "lower(label) || chr(1) || value"


def number(c: str) -> str:
    return f"('0x' || substr(md5({c}), 1, 8))::BIGINT"


def draw(k: int, a: int, b: int) -> str:
    return f"({a} + {number(f'{_src} || chr(1) || {q(str(k))}')} % {b - a + 1})"


def join(*parts: str) -> str:
    return " || ".join(p if p.startswith("'") else f"({p})::VARCHAR" for p in parts)


SEED = f"({number(_src)} % 1000000)"


def word(words, at: str) -> str:
    return f"[{', '.join(map(q, words))}][({at} % 6 + 1)::INT]"


def made_name(first, last) -> str:
    return f"{word(first, SEED)} || ' ' || {word(last, f'({SEED} // 7)')}"


def letter(x: str) -> str:
    return f"chr((65 + {x})::INT)"


def two(x: str) -> str:
    return f"lpad(({x})::VARCHAR, 2, '0')"


def made_sql() -> str:
    from ..functions import synthetic as sy

    power = [letter(f"({SEED} // {26**k}) % 26") for k in range(5)]
    year, month, day = draw(0, 1970, 1999), two(draw(1, 1, 12)), two(draw(2, 1, 28))
    four = [draw(k, 1000, 9999) for k in range(4)]
    fmt = date_format(_v)
    kinds = [
        ("suspicious_token", mask("value")),
        ("email", join("'user'", f"{SEED} % 100000", "'@example.com'")),
        (
            "phone",
            f"CASE {PREFIX} WHEN '0' THEN {join(chr(39) + '0' + chr(39), draw(0, 70, 79), draw(1, 1000000, 9999999))} WHEN '+46' THEN {join(q('+46'), draw(0, 70, 79), draw(1, 100000, 999999))}"
            f" WHEN '+44' THEN {join(q('+44'), draw(0, 7700, 7799), draw(1, 100000, 999999))} WHEN '+33' THEN {join(q('+33'), draw(0, 1, 9), draw(1, 10000000, 99999999))}"
            f" WHEN '+49' THEN {join(q('+49'), draw(0, 150, 179), draw(1, 1000000, 9999999))} ELSE {join(q('+1-555-'), draw(0, 100, 999), q('-'), draw(1, 1000, 9999))} END",
        ),
        ("name|person", f"CASE WHEN ar THEN {made_name(sy.FIRST_AR, sy.LAST_AR)} ELSE {made_name(sy.FIRST, sy.LAST)} END"),
        ("address", f"CASE WHEN ar THEN {join(q('شارع '), draw(0, 10, 999), q('، حي النور، الرياض'))} ELSE {join(draw(0, 10, 999), q(' Example Street, Springfield'))} END"),
        ("organization|company", f"CASE WHEN ar THEN {join(q('شركة الخدمات المتحدة '), f'{SEED} % 1000')} ELSE {join(q('Acme Holdings '), f'{SEED} % 1000')} END"),
        ("ssn", join(draw(0, 100, 999), "'-'", draw(1, 10, 99), "'-'", draw(2, 1000, 9999))),
        ("passport", join("'P'", draw(0, 10000000, 99999999))),
        ("credit.*card|card.*credit", f"concat_ws(' ', {', '.join(four)})"),
        ("bank.*account|account.*bank", join(*(draw(k, 0, 9) for k in range(12)))),
        ("ip", join("'10.'", draw(0, 0, 255), "'.'", draw(1, 0, 255), "'.'", draw(2, 1, 254))),
        ("date", f"CASE {fmt} WHEN 'yyyymmdd' THEN {join(year, q('-'), month, q('-'), day)} WHEN 'ddmmyyyy' THEN {join(day, q('/'), month, q('/'), year)} ELSE {join(month, q('/'), day, q('/'), year)} END"),
        ("aadhaar", f"concat_ws(' ', {', '.join(four[:3])})"),
        ("pan", join(*power, draw(0, 1000, 9999), letter(draw(1, 0, 25)))),
        ("gst_number", join(draw(0, 10, 99), *power, draw(1, 1000, 9999), letter(draw(2, 0, 25)), draw(3, 1, 9), letter(draw(4, 0, 25)), draw(5, 1, 9))),
        ("udyam", join("'UDYAM-'", *power[:2], "'-'", draw(0, 10, 99), "'-'", draw(1, 100000, 9999999))),
    ]
    cases = " ".join(f"WHEN regexp_matches(lower(label), '{k}') THEN {v}" for k, v in kinds)
    return f"CASE {cases} ELSE '<' || replace(lower(trim(label)), ' ', '_') || '_' || ({SEED} % 100000)::VARCHAR || '>' END"


ORACLE_SQL["synthetic_values"] = f"SELECT doc_id, kind, {made_sql()} AS made FROM (SELECT *, doc_id % 5 = 0 AS ar FROM {VAL})"


def fits(t: str) -> str:
    return rf"""CASE WHEN contains({t}, 'suspicious_token') THEN false WHEN contains({t}, 'email') THEN regexp_full_match(value, '[^@\s]+@[^@\s]+\.[^@\s]+')
  WHEN contains({t}, 'phone') THEN length({_d}) >= 7 WHEN contains({t}, 'ssn') THEN regexp_full_match(value, '\d{{3}}-\d{{2}}-\d{{4}}')
  WHEN contains({t}, 'ip') THEN regexp_full_match(value, '(?:\d{{1,3}}\.){{3}}\d{{1,3}}') WHEN contains({t}, 'name') OR contains({t}, 'person') THEN regexp_matches(value, '\pL') AND length({_v}) >= 2
  WHEN contains({t}, 'credit') AND contains({t}, 'card') THEN length({_d}) BETWEEN 13 AND 19 WHEN contains({t}, 'bank') AND contains({t}, 'account') THEN length({_d}) >= 8
  WHEN contains({t}, 'date') THEN regexp_matches(value, '\d') WHEN contains({t}, 'aadhaar') THEN regexp_full_match({_v}, {A}) WHEN contains({t}, 'pan') THEN regexp_full_match({_v}, {P})
  WHEN contains({t}, 'gst_number') THEN regexp_full_match({_v}, {G}) WHEN contains({t}, 'udyam') THEN regexp_full_match({_v}, {q(re2(vocab.UDYAM))}) ELSE {_v} != '' END"""


_others = f"[{', '.join(map(q, (*vocab.SLM_LABELS, 'company', 'other')))}]"
ORACLE_SQL["datatype_match"] = f"SELECT doc_id, kind, {fits('lower(label)')} AS own, {fits('o')} AS other FROM (SELECT *, {_others}[(doc_id % 21 + 1)::INT] AS o FROM {VAL})"
ORACLE_SQL["apply_replacements"] = r"""SELECT doc_id, md5(replace(replace(replace(replace(text, 'the th', 'x$1\'), 'the', 'THE'), 'ion', '[i]'), 'a', 'b')) AS digest FROM documents"""


def masked_sql() -> str:
    every = " UNION ".join([f"SELECT doc_id, unnest({AUDIT[n]}) AS h FROM f" for n in vocab.AUDIT] + [f"SELECT doc_id, text AS h FROM ({tokens('f')})"])
    return f"""WITH RECURSIVE f AS (SELECT doc_id, {flat('text')} AS text FROM documents),
h AS (SELECT * FROM ({every}) WHERE lower(h) NOT IN {listed(vocab.COMMON_WORDS)}),
r AS (SELECT doc_id, h, {mask('h')} AS m, row_number() OVER (PARTITION BY doc_id ORDER BY length(h) DESC, encode(h)) AS n FROM h),
s AS (SELECT doc_id, 0::BIGINT AS n, text FROM f UNION ALL SELECT s.doc_id, r.n, replace(s.text, r.h, r.m) FROM s JOIN r ON r.doc_id = s.doc_id AND r.n = s.n + 1)
SELECT doc_id, max(n) AS n_found, length(arg_max(text, n))::BIGINT AS n_chars, md5(arg_max(text, n)) AS digest FROM s GROUP BY doc_id"""


ORACLE_SQL["masked_documents"] = masked_sql()

# Reports, runs and evaluation
ORACLE_SQL["entity_types"] = f"SELECT doc_id, string_agg(DISTINCT {canonical('label')}, '|' ORDER BY {canonical('label')}) AS entity_types, count(*) FILTER ({PRECISE}) AS n_precise FROM {VAL} GROUP BY doc_id"
ORACLE_SQL["new_events"] = """SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) WHERE n = 1 OR before IS DISTINCT FROM event_type"""
ORACLE_SQL["event_changes_stream"] = """WITH e AS (SELECT *, epoch_ms(ts) AS ms FROM events WHERE user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL)
SELECT user_id, event_id, event_type FROM (SELECT *, lag(event_type) OVER w AS before, row_number() OVER w AS n FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id))
WHERE (n = 1 OR before IS DISTINCT FROM event_type) AND ms <= (SELECT max(ms) FROM e) - 600000"""
_place = lambda c: f"list_position([{', '.join(map(q, dv.STAGES))}], {c})"
ORACLE_SQL["stage_state"] = f"""SELECT ord, label, current, CASE WHEN {_place('label')} < {_place('current')} THEN 'done' WHEN label = current THEN 'active' ELSE 'pending' END AS state
FROM ({duck(dv.STAGE_EVENTS)})"""
ORACLE_SQL["positional_join"] = """SELECT doc_id, i::INT AS pos, a[i + 1] AS word, b[i + 1] AS later FROM (
  SELECT doc_id, a, b, unnest(range(0, least(len(a), len(b)))) AS i FROM (
    SELECT doc_id, string_split(text, ' ') AS a, string_split(reverse(text), ' ')[3:] AS b FROM documents))"""
SCANS, EVALS, GONE, WANT, OURS, THEIRS = (f"({duck(x)})" for x in (dv.SCANS, dv.EVALUATIONS, dv.DELETED, dv.WANTED, dv.OURS, dv.THEIRS))
LATEST = f"SELECT file_name, max(run_id) AS last_run_id, arg_max(created_at, run_id) AS last_scanned_at FROM {SCANS} GROUP BY file_name"
ORACLE_SQL["latest_scan_per_file"] = LATEST
ORACLE_SQL["latest_run"] = f"SELECT max(run_id) AS run_id, count(DISTINCT file_name) AS n_files FROM {SCANS}"
ORACLE_SQL["run_list"] = f"SELECT run_id, created_at, count(*) AS file_count FROM {SCANS} GROUP BY ALL"
ORACLE_SQL["pending_files"] = f"""SELECT file_name FROM (SELECT DISTINCT file_name FROM {SCANS}) s WHERE NOT EXISTS (
  SELECT 1 FROM {EVALS} e WHERE e.file_name = s.file_name AND coalesce(e.llm_error, '') = '')"""
ORACLE_SQL["scanned_minus_deleted"] = f"SELECT DISTINCT file_name FROM {SCANS} WHERE file_name NOT IN (SELECT file_name FROM {GONE})"
ORACLE_SQL["missing_files"] = f"SELECT file_name FROM {WANT} WHERE file_name NOT IN (SELECT file_name FROM {SCANS})"
ORACLE_SQL["evaluation_upsert"] = f"SELECT file_name, CASE WHEN llm_entities > 5 THEN llm_entities + 100 ELSE llm_entities END AS llm_entities, CASE WHEN llm_entities > 5 THEN NULL ELSE llm_error END AS llm_error FROM {EVALS}"
BOARD = f"""SELECT l.last_run_id, l.file_name, l.last_scanned_at, c.our_entities, e.llm_entities, e.same, e.different_llm, e.recall_pct, e.precision_pct, e.llm_error, e.file_name IS NOT NULL AS evaluated
FROM ({LATEST}) l LEFT JOIN {SCANS} c ON c.run_id = l.last_run_id AND c.file_name = l.file_name LEFT JOIN {EVALS} e ON e.file_name = l.file_name
WHERE l.file_name NOT IN (SELECT file_name FROM {GONE})"""
ORACLE_SQL["dashboard"] = BOARD


def rates(same: str, theirs: str, ours: str) -> str:
    def rate(whole: str) -> str:
        return f"CASE WHEN {whole} > 0 THEN round_even(100.0::DOUBLE * {same} / {whole}, 1) ELSE 0 END::DOUBLE"

    return f"{rate(theirs)} AS recall_pct, {rate(ours)} AS precision_pct"


ORACLE_SQL["combined_totals"] = f"""SELECT *, {rates('same', 'llm_entities', 'our_entities')} FROM (
  SELECT sum(our_entities)::BIGINT AS our_entities, sum(llm_entities)::BIGINT AS llm_entities, sum(same)::BIGINT AS same, sum(different_llm)::BIGINT AS different_llm FROM ({BOARD}))"""
ORACLE_SQL["precision_recall"] = f"""SELECT *, llm_entities - same AS different_llm, {rates('same', 'llm_entities', 'our_entities')} FROM (
  SELECT o_orderkey, o_orderkey % 97 AS our_entities, o_custkey % 61 AS llm_entities, least(o_orderkey % 97, o_custkey % 61, o_orderkey % 23) AS same FROM orders)"""
ORACLE_SQL["evaluate_pairs"] = f"""SELECT a.doc_id, a.pos AS our_pos, b.pos AS their_pos FROM {OURS} a JOIN {THEIRS} b ON a.doc_id = b.doc_id
WHERE (contains(a.value, b.value) OR contains(b.value, a.value)) AND {agrees('a.label', 'b.label', True)}"""


def distinct_entities(source: str) -> str:
    items = f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n, {{'label': label, 'vals': [value], 'top': value}} AS x FROM {source}"""
    fits = f"g.label = x.label AND len(list_filter(g.vals, lambda v: {holds('v', 'x.top')})) > 0"
    more = "{'label': g.label, 'vals': list_concat(g.vals, x.vals), 'top': CASE WHEN length(x.top) > length(g.top) THEN x.top ELSE g.top END}"
    return grouped(items, "doc_id", fits, "x", more)


ORACLE_SQL["evaluate_greedy"] = f"""WITH RECURSIVE o AS ({distinct_entities(OURS)}), t AS ({distinct_entities(THEIRS)}),
m AS (SELECT t.doc_id, t.gs AS todo, coalesce(o.gs, list_filter(t.gs, lambda g: false)) AS free, 0::BIGINT AS same, 0::BIGINT AS n FROM t LEFT JOIN o USING (doc_id)
  UNION ALL SELECT doc_id, todo[2:], CASE WHEN spot > 0 THEN list_concat(free[1:spot - 1], free[spot + 1:]) ELSE free END, same + CASE WHEN spot > 0 THEN 1 ELSE 0 END, n + 1
  FROM (SELECT *, coalesce(list_position(list_transform(free, lambda g: {agrees('g.label', 'todo[1].label', True)} AND {holds('g.top', 'todo[1].top')}), true), 0) AS spot FROM m WHERE len(todo) > 0)),
e AS (SELECT doc_id, arg_max(same, n) AS same FROM m GROUP BY doc_id),
f AS (SELECT doc_id, coalesce(len(o.gs), 0)::BIGINT AS our_entities, coalesce(len(t.gs), 0)::BIGINT AS llm_entities, coalesce(e.same, 0)::BIGINT AS same
  FROM o FULL JOIN t USING (doc_id) LEFT JOIN e USING (doc_id))
SELECT *, llm_entities - same AS different_llm, {rates('same', 'llm_entities', 'our_entities')} FROM f"""
ORACLE_SQL["parse_verdicts"] = "SELECT c_custkey, i::INT AS id, i = 0 OR c_custkey % 2 = 0 AS is_pii FROM customer CROSS JOIN range(0, 2) t(i)"
ORACLE_SQL["detected_in_prompt"] = "SELECT c_custkey, c_name AS value, 'person' AS pii_type, 0.5::DOUBLE AS confidence FROM customer"
ORACLE_SQL["parse_prose"] = """SELECT c_custkey, n::INT AS n, CASE n WHEN 0 THEN c_name WHEN 1 THEN 'ABCDE' || c_custkey ELSE '1990-01-01' END AS text,
  CASE n WHEN 0 THEN 'person' WHEN 1 THEN 'pan' ELSE 'date_of_birth' END AS label FROM customer CROSS JOIN range(0, 3) t(n)"""
ORACLE_SQL["parse_entities"] = """SELECT c_custkey, n::INT AS n, CASE n WHEN 0 THEN c_name ELSE 'x' || c_custkey END AS text, CASE n WHEN 0 THEN 'person' ELSE 'id' END AS label
FROM customer CROSS JOIN range(0, 2) t(n) WHERE c_custkey % 4 < 3"""
ORACLE_SQL["parse_best_list"] = """SELECT c_custkey, '[{"text": "' || c_name || '"}, {"text": "b"}]' AS best FROM customer"""
ORACLE_SQL["parse_json_like"] = """SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '{"a": 1}' WHEN 1 THEN '{"result": [1, ' || c_custkey || ']}' ELSE '{"raw_response": "nothing"}' END AS parsed FROM customer"""

# Replacements and spans
_WORDS = ("GST", "Customer", "mail", "nowhere", "PAN", "User")


def _highlighted(words) -> str:
    """Where words stand in ``text``, each behind the one before: they are taken by their first place, one step each."""
    order = ", ".join(f"{{'p': instr(text, {q(w)}), 'i': {i}, 'v': {q(w)}}}" for i, w in enumerate(words))
    steps = [f"s0 AS (SELECT doc_id, text, list_sort([{order}]) AS w, 0 AS last, []::STRUCT(\"start\" INT, \"end\" INT, pii_type VARCHAR)[] AS found FROM {IDS})"]
    for k in range(1, len(words) + 1):
        at = f"instr(substr(text, last + 1), w[{k}].v)"
        span = f"{{'start': (last + {at} - 1)::INT, 'end': (last + {at} - 1 + length(w[{k}].v))::INT, 'pii_type': lower(w[{k}].v)}}"
        steps.append(
            f"""s{k} AS (SELECT doc_id, text, w, CASE WHEN {at} > 0 THEN last + {at} - 1 + length(w[{k}].v) ELSE last END AS last,
  CASE WHEN {at} > 0 THEN list_append(found, {span}) ELSE found END AS found FROM s{k - 1})"""
        )
    return ", ".join(steps)


ORACLE_SQL["highlight_spans"] = f"""WITH {_highlighted(_WORDS)}
SELECT doc_id, (i - 1)::INT AS n, found[i]."start" AS start, found[i]."end" AS "end", found[i].pii_type AS pii_type
FROM (SELECT doc_id, found, unnest(range(1, len(found) + 1)) AS i FROM s{len(_WORDS)})"""
ORACLE_SQL["replacement_backfill"] = f"""WITH f AS ({ORACLE_SQL['indian_ids']}), c AS (SELECT doc_id, chunk_index, text AS chunk FROM {IDS}),
p AS (SELECT doc_id, chunk_index, upper(text) AS o, label, length(text) AS ord FROM f JOIN c USING (doc_id, chunk_index) WHERE doc_id % 2 = 0 AND contains(chunk, upper(text))),
g AS (SELECT doc_id, chunk_index, o, label, ord, o AS value, false AS ar, fit FROM (SELECT *, {fits('lower(label)')} AS fit FROM (SELECT *, 'nothing' AS value FROM p))),
k AS (SELECT doc_id, chunk_index, o AS original_value, CASE WHEN fit THEN 'nothing' ELSE {made_sql()} END AS anonymized_value, label AS pii_type FROM g
  QUALIFY row_number() OVER (PARTITION BY doc_id, chunk_index, lower(o), lower(label) ORDER BY ord) = 1)
SELECT * FROM k UNION ALL SELECT doc_id, chunk_index, text AS original_value, {made_sql()} AS anonymized_value, label AS pii_type FROM (SELECT *, text AS value, false AS ar FROM f) m
WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.doc_id = m.doc_id AND k.chunk_index = m.chunk_index AND lower(k.original_value) = lower(m.text))"""

_DIMS = ("run_id", "source", "lang")
_level = "concat_ws('+', " + ", ".join(f"CASE WHEN grouping({c}) = 0 THEN '{c}' END" for c in _DIMS) + ")"
_sets = ", ".join("(" + ", ".join(level) + ")" for level in dv.LEVELS)
_pct = lambda whole: f"CASE WHEN {whole} > 0 THEN round_even(100.0::DOUBLE * same / {whole}, 1) ELSE 0 END::DOUBLE"
ORACLE_SQL["totals_by_level"] = f"""SELECT CASE level WHEN '' THEN 'total' ELSE level END AS level, run_id, source, lang, n_files, our_entities, llm_entities, same, llm_entities - same AS different_llm,
  {_pct('llm_entities')} AS recall_pct, {_pct('our_entities')} AS precision_pct FROM (
  SELECT {_level} AS level, run_id, source, lang, count(*) AS n_files, sum(our_entities)::BIGINT AS our_entities, sum(llm_entities)::BIGINT AS llm_entities, sum(same)::BIGINT AS same
  FROM ({duck(dv.MEASURED)}) GROUP BY GROUPING SETS ({_sets}))"""
