"""Label functions as Columns: canonical forms, agreement and normalisation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import strip

PERSONS, EMAILS, PHONES = ("person", "name"), ("email", "email address"), ("phone", "phone number")
DATES, PLACES = ("date", "date of birth", "date_of_birth"), ("state", "location", "city")


def lookup(key: Column, table: dict[str, str]) -> Column:
    """The value of a fixed table, or null."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), key)


def plain(label: Column) -> Column:
    return F.lower(strip(label))


def canonical(label: Column, evaluator: bool = False) -> Column:
    """One form for each kind of id and for birth dates. The evaluator leaves ``dob`` as it is and takes null as empty."""
    table = {k: v for k, v in vocab.CANONICAL.items() if not (evaluator and k == "dob")}
    x = plain(F.coalesce(label, F.lit(""))) if evaluator else plain(label)
    return F.coalesce(lookup(x, table), x)


def agrees(left: Column, right: Column, evaluator: bool = False) -> Column:
    """Whether two labels may name one thing. Not transitive. The evaluator knows no e-mail, organisation or phone rule."""
    a, b = (plain(F.coalesce(x, F.lit(""))) if evaluator else plain(x) for x in (left, right))

    def both(test) -> Column:
        return test(a) & test(b)

    rules = [
        a == b,
        canonical(a, evaluator) == canonical(b, evaluator),
        both(lambda x: x.isin(*PERSONS)),
        both(lambda x: x.isin(*PLACES) | x.contains("address")),
        both(lambda x: x.isin(*DATES)),
    ]
    if not evaluator:
        rules += [both(lambda x: x.isin(*EMAILS)), both(lambda x: x.isin(*PHONES)), both(lambda x: x.contains("organization"))]
    found = rules[0]
    for r in rules[1:]:
        found = found | r
    return found


def signature(label: Column, evaluator: bool = False) -> Column:
    """``agrees`` made ready for many comparisons: the canonical form, and a bit for each rule that a label falls under."""
    x = plain(F.coalesce(label, F.lit(""))) if evaluator else plain(label)
    rules = [x.isin(*PERSONS), x.isin(*PLACES) | x.contains("address"), x.isin(*DATES)]
    if not evaluator:
        rules += [x.isin(*EMAILS), x.isin(*PHONES), x.contains("organization")]
    bits = F.lit(0)
    for i, rule in enumerate(rules):
        bits = bits + F.when(rule, F.lit(1 << i)).otherwise(F.lit(0))
    return F.struct(canonical(x, evaluator).alias("form"), bits.alias("rules"))


def signatures_agree(left: Column, right: Column) -> Column:
    return (left["form"] == right["form"]) | (left["rules"].bitwiseAND(right["rules"]) != 0)


def is_person(label: Column) -> Column:
    return plain(label).isin(*PERSONS)


def shared_label(raw: Column) -> Column:
    """A recogniser's entity type as a shared label; null if there is none."""
    key = F.upper(strip(raw))
    spelled = F.lower(F.replace(key, F.lit("_"), F.lit(" ")))
    return F.coalesce(lookup(key, vocab.SHARED_LABELS), F.when(spelled.isin(*vocab.ZERO_SHOT_LABELS), spelled))


def shared_label_or_spelled(raw: Column) -> Column:
    """As ``shared_label``, else the type in words, else ``entity``."""
    spelled = F.lower(strip(F.replace(raw, F.lit("_"), F.lit(" "))))
    return F.coalesce(shared_label(raw), F.when(spelled != "", spelled), F.lit("entity"))


def slug(label: Column) -> Column:
    """Lower case, with white space as underscores."""
    return F.regexp_replace(plain(label), r"(?U)[\s\x1c-\x1f]+", "_")


def slm_label(label: Column) -> Column:
    """A small model's label as one of its list: itself, else the first that contains it or is contained, else as it is."""
    x = plain(label)
    near = F.filter(F.array(*map(F.lit, vocab.SLM_LABELS)), lambda c: c.contains(x) | x.contains(c))
    persons = F.when(x.contains("name") | x.contains("per"), F.lit("person")).otherwise(x)
    return F.when(x.isin(*vocab.SLM_LABELS), x).otherwise(F.coalesce(F.get(near, F.lit(0)), persons))


def person_from_parts(text: Column, label: Column, score: Column) -> tuple[Column, Column]:
    """(label, score): a first or last name of several words is a person, of at least 0.6."""
    hit = plain(label).isin("first name", "last name") & strip(text).contains(" ")
    return F.when(hit, F.lit("person")).otherwise(label), F.when(hit, F.greatest(score, F.lit(0.6))).otherwise(score)


def relabel_by_pattern(text: Column, label: Column, score: Column) -> tuple[Column, Column]:
    """(label, score): dates and organisations that look like an Indian id get its label and at least 0.85."""
    t, x = strip(text), plain(label)
    org = x == "organization"
    number = F.regexp_replace(t, r"(?U)[\s\-]", "")
    new = (
        F.when(x.isin("date", "date of birth", "date_of_birth", "date time") & t.rlike(vocab.AADHAAR), F.lit("aadhaar number"))
        .when(org & t.rlike(vocab.PAN), F.lit("pan number"))
        .when(org & t.rlike(vocab.GST), F.lit("gst number"))
        .when(org & number.rlike(r"(?U)^\d{12}$"), F.lit("aadhaar number"))
    )
    return F.coalesce(new, label), F.when(new.isNotNull(), F.greatest(score, F.lit(0.85))).otherwise(score)


def colour(label: Column) -> Column:
    return F.coalesce(lookup(F.lower(F.coalesce(label, F.lit(""))), vocab.TYPE_COLOURS), F.lit(vocab.OTHER_COLOUR))
