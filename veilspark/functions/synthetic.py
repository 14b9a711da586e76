"""Replacement values of the right shape, drawn from a hash of type and original, so that equal originals get equal fakes."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .labels import slug
from .text import let, partial_mask, strip

# --- Fixed values: what invented names and addresses are made of ------------------------------------------------------
FIRST = ("Alex", "Jordan", "Taylor", "Casey", "Morgan", "Avery")
LAST = ("Smith", "Johnson", "Clark", "Davis", "Miller", "Brown")
FIRST_AR = ("أحمد", "محمد", "علي", "خالد", "عمر", "يوسف")
LAST_AR = ("العلي", "الحسن", "المرعي", "الشامي", "الغربي", "النجار")


def number(c: Column) -> Column:
    """The first 32 bits of a text's MD5."""
    return F.conv(F.substring(F.md5(c.cast("binary")), 1, 8), 16, 10).cast("bigint")


def date_format(original: Column) -> Column:
    """yyyymmdd, ddmmyyyy or mmddyyyy, as the original looks."""
    s = strip(original)
    return (
        F.when(s.rlike(r"(?U)\b(19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}\b"), F.lit("yyyymmdd"))
        .when(s.rlike(r"(?U)\b\d{1,2}[-/]\d{1,2}[-/](19|20)\d{2}\b"), F.lit("ddmmyyyy"))
        .otherwise(F.lit("mmddyyyy"))
    )


def phone_prefix(original: Column) -> Column:
    """0 for national numbers, the country code of international ones, +1 otherwise."""
    s, digits = strip(original), F.regexp_replace(original, r"(?U)\D", "")
    n = F.length(digits)
    abroad = F.lit("+1")
    code = F.when(digits.startswith("1"), abroad)
    for c in ("44", "46", "33", "49"):
        code = code.when(digits.startswith(c), F.lit("+" + c))
    code = code.otherwise(F.concat(F.lit("+"), F.substring(digits, 1, 3)))
    return F.when(s.startswith("0") & (n >= 9), F.lit("0")).when(s.startswith("+") & (n >= 10), code).otherwise(abroad)


def synthetic(pii_type: Column, original: Column, lang: Column | None = None) -> Column:
    """A value of the type's shape. The first kind that the type's name contains decides, so ``username`` is a name."""
    given = F.struct(F.lower(pii_type).alias("t"), original.alias("o"), (F.lit("en") if lang is None else lang).alias("lang"))

    def seeded(x: Column) -> Column:
        source = F.concat(x["t"], F.lit("\u0001"), x["o"])
        whole = F.struct(
            x["t"].alias("t"),
            x["o"].alias("o"),
            x["lang"].alias("lang"),
            source.alias("source"),
            (number(source) % 1_000_000).alias("seed"),
        )
        return let(whole, _shaped)

    return let(given, seeded)


def _shaped(x: Column) -> Column:
    """The value for a struct of all that decides it."""
    t, original, source, seed = (x[c] for c in ("t", "o", "source", "seed"))
    arabic = x["lang"] == "ar"

    def draw(k: int, low: int, high: int) -> Column:
        return low + F.pmod(number(F.concat(source, F.lit(f"\u0001{k}"))), F.lit(high - low + 1))

    def pick(words: tuple[str, ...], at: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, words)), at.cast("int") + 1)

    def letter(at: Column) -> Column:
        return F.chr(65 + at)

    def spelled(power: int) -> Column:
        return letter(F.floor(seed / 26**power) % 26)

    def line(*parts) -> Column:
        return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    def has(*words: str) -> Column:
        found = t.contains(words[0])
        for w in words[1:]:
            found = found & t.contains(w)
        return found

    def two(k: int, low: int, high: int) -> Column:
        return F.lpad(draw(k, low, high).cast("string"), 2, "0")

    def name(first, last) -> Column:
        return line(pick(first, seed % 6), " ", pick(last, F.floor(seed / 7) % 6))

    # Fixed values, from here to the end of ``kinds``: the shapes of replacements, their ranges of numbers and their words.
    def phone(prefix: Column) -> Column:
        return (
            F.when(prefix == "0", line("0", draw(0, 70, 79), draw(1, 1000000, 9999999)))
            .when(prefix == "+46", line("+46", draw(0, 70, 79), draw(1, 100000, 999999)))
            .when(prefix == "+44", line("+44", draw(0, 7700, 7799), draw(1, 100000, 999999)))
            .when(prefix == "+33", line("+33", draw(0, 1, 9), draw(1, 10000000, 99999999)))
            .when(prefix == "+49", line("+49", draw(0, 150, 179), draw(1, 1000000, 9999999)))
            .otherwise(line("+1-555-", draw(0, 100, 999), "-", draw(1, 1000, 9999)))
        )

    year, month, day = draw(0, 1970, 1999), two(1, 1, 12), two(2, 1, 28)

    def date(shape: Column) -> Column:
        return (
            F.when(shape == "yyyymmdd", line(year, "-", month, "-", day))
            .when(shape == "ddmmyyyy", line(day, "/", month, "/", year))
            .otherwise(line(month, "/", day, "/", year))
        )

    street = line(draw(0, 10, 999), " Example Street, Springfield")
    street = F.when(arabic, line("شارع ", draw(0, 10, 999), "، حي النور، الرياض")).otherwise(street)
    firm = F.when(arabic, line("شركة الخدمات المتحدة ", seed % 1000)).otherwise(line("Acme Holdings ", seed % 1000))
    groups = [draw(k, 1000, 9999) for k in range(4)]
    kinds = (
        (has("suspicious_token"), partial_mask(original)),
        (has("email"), line("user", seed % 100000, "@example.com")),
        (has("phone"), let(phone_prefix(original), phone)),
        (has("name") | has("person"), F.when(arabic, name(FIRST_AR, LAST_AR)).otherwise(name(FIRST, LAST))),
        (has("address"), street),
        (has("organization") | has("company"), firm),
        (has("ssn"), line(draw(0, 100, 999), "-", draw(1, 10, 99), "-", draw(2, 1000, 9999))),
        (has("passport"), line("P", draw(0, 10000000, 99999999))),
        (has("credit", "card"), F.concat_ws(" ", *(g.cast("string") for g in groups))),
        (has("bank", "account"), line(*(draw(k, 0, 9) for k in range(12)))),
        (has("ip"), line("10.", draw(0, 0, 255), ".", draw(1, 0, 255), ".", draw(2, 1, 254))),
        (has("date"), let(date_format(original), date)),
        (has("aadhaar"), F.concat_ws(" ", *(g.cast("string") for g in groups[:3]))),
        (has("pan"), line(*map(spelled, range(5)), draw(0, 1000, 9999), letter(draw(1, 0, 25)))),
        (
            has("gst_number"),
            line(draw(0, 10, 99), *map(spelled, range(5)), draw(1, 1000, 9999), letter(draw(2, 0, 25)), draw(3, 1, 9), letter(draw(4, 0, 25)), draw(5, 1, 9)),
        ),
        (has("udyam"), line("UDYAM-", spelled(0), spelled(1), "-", draw(0, 10, 99), "-", draw(1, 100000, 9999999))),
    )
    out = F.when(*kinds[0])
    for test, value in kinds[1:]:
        out = out.when(test, value)
    return out.otherwise(line("<", slug(t), "_", seed % 100000, ">"))


def datatype_match(value: Column, pii_type: Column) -> Column:
    """Whether a value has the shape that its type asks for; the first kind that the type's name contains decides."""
    given = F.struct(F.lower(pii_type).alias("t"), value.alias("v"), strip(value).alias("s"), F.regexp_replace(value, r"(?U)\D", "").alias("digits"))
    return let(given, _fits)


def _fits(x: Column) -> Column:
    t, value, s, digits = x["t"], x["v"], x["s"], x["digits"]

    def whole(pattern: str) -> Column:
        return s.rlike("^(?:" + pattern.removeprefix("(?U)").removeprefix("(?Ui)") + ")$")

    return (
        F.when(t.contains("suspicious_token"), F.lit(False))
        .when(t.contains("email"), value.rlike(r"(?U)\A[^@\s]+@[^@\s]+\.[^@\s]+\z"))
        .when(t.contains("phone"), F.length(digits) >= 7)
        .when(t.contains("ssn"), value.rlike(r"(?U)\A\d{3}-\d{2}-\d{4}\z"))
        .when(t.contains("ip"), value.rlike(r"(?U)\A(?:\d{1,3}\.){3}\d{1,3}\z"))
        .when(t.contains("name") | t.contains("person"), value.rlike(r"\p{L}") & (F.length(s) >= 2))
        .when(t.contains("credit") & t.contains("card"), F.length(digits).between(13, 19))
        .when(t.contains("bank") & t.contains("account"), F.length(digits) >= 8)
        .when(t.contains("date"), value.rlike(r"(?U)\d"))
        .when(t.contains("aadhaar"), whole(vocab.AADHAAR))
        .when(t.contains("pan"), whole(vocab.PAN))
        .when(t.contains("gst_number"), whole(vocab.GST))
        .when(t.contains("udyam"), s.rlike("(?i)^(?:" + vocab.UDYAM.removeprefix("(?Ui)") + ")$"))
        .otherwise(F.length(s) > 0)
    )
