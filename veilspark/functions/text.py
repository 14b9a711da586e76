"""Text functions as Columns: chunking, entropy, masking and context."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str methods have it.
SPACE = r"(?U)[\s\x1c-\x1f]+"
#: The same, one by one.
SPACES = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def let(c: Column, body) -> Column:
    """``body`` of a value that is made once, however often the body names it."""
    return F.get(F.transform(F.array(c), body), F.lit(0))


def strip(c: Column) -> Column:
    """Without white space at the ends, of any kind."""
    return F.btrim(c, F.lit(SPACES))


def collapse(c: Column) -> Column:
    """White space runs become one blank; none at the ends."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def chunk_array(c: Column, size: int = 1600, overlap: int = 200) -> Column:
    """Overlapping slices of the collapsed text, stepped from its start; none of a blank or null text.

    An overlap not below the size counts as none. The last slice may lie within the one before.
    """
    step = size - overlap if overlap < size else size

    def slices(flat: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(flat), F.lit(step))
        made = F.transform(starts, lambda s: F.substring(flat, s, F.lit(size)))
        return F.when(F.length(flat) > 0, made).otherwise(F.array().cast("array<string>"))

    # A slice that named the expression would collapse the whole text again.
    return let(collapse(c), slices)


def entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for an empty text."""
    n = F.length(c).cast("double")
    letters = F.array_remove(F.array_distinct(F.split(c, "")), "")
    shares = F.transform(letters, lambda x: (n - F.length(F.replace(c, x, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(shares, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))).otherwise(F.lit(0.0))


def partial_mask(c: Column, visible: float = 0.3) -> Column:
    """The middle replaced by #; about ``visible`` of the characters stay, half at each end (rounded half to even)."""

    def mask(s: Column) -> Column:
        n = F.length(s)
        half = F.greatest(F.lit(1), F.bround(n * F.lit(visible / 2), 0).cast("int"))

        def around(keep: Column) -> Column:
            return F.concat(F.substring(s, F.lit(1), keep), F.repeat(F.lit("#"), n - 2 * keep), F.right(s, keep))

        keep = F.when(half * 2 >= n, F.greatest(F.lit(1), F.floor(n / 3).cast("int"))).otherwise(half)
        return F.when(n == 0, F.lit("#####")).when(n <= 2, F.repeat(F.lit("#"), n)).otherwise(let(keep, around))

    return let(strip(F.coalesce(c, F.lit(""))), mask)


def span_context(chunk: Column, span: Column, radius: int = 72) -> Column:
    """The text around a span's first occurrence, exact or else in any case; a note if there is none."""
    s = strip(span)
    places = (F.position(s, chunk), F.position(F.lower(s), F.lower(chunk)))
    at = F.coalesce(*(F.nullif(p, F.lit(0)) for p in places))
    start = F.greatest(F.lit(1), at - radius)
    found = F.substring(chunk, start, at - start + F.length(s) + radius)
    missing = F.concat(F.lit("(span not in chunk) «"), F.substring(s, 1, 80), F.lit("»"))
    empty = chunk.isNull() | (chunk == "") | s.isNull() | (s == "")
    return F.when(empty, F.lit("")).when(at.isNull(), missing).otherwise(found)


def luhn(c: Column) -> Column:
    """Whether the digits of a text pass the Luhn test."""
    digits = F.reverse(F.split(F.regexp_replace(c, r"\D", ""), ""))
    digits = F.filter(digits, lambda x: x != "")

    def value(x: Column, i: Column) -> Column:
        d = x.cast("int")
        return F.when(i % 2 == 0, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return (F.size(digits) > 0) & (F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x) % 10 == 0)
