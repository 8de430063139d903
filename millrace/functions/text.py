"""String, regex, date and JSON functions as column expressions (all JVM-side)."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """df with these columns, each evaluated once a row: later uses read the value, they don't repeat the expression."""
    item = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*[F.col(c) for c in df.columns if c not in columns], F.inline(F.array(item)))


def words(text: Column) -> Column:
    """The runs between white space; none for an empty text."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text))


def strip(text: Column) -> Column:
    """Trims all white space, where SQL's trim takes blanks only."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def contains_any(text: Column, phrases: list[str]) -> Column:
    """Whether any phrase is a substring; phrases and text in one case already."""
    return reduce(or_, [F.contains(text, F.lit(p)) for p in phrases], F.lit(False))


def count_contained(text: Column, phrases: list[str]) -> Column:
    """How many different phrases are substrings."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(p)).cast("int") for p in phrases], F.lit(0))


def quoted(phrase: str) -> str:
    """phrase as a regex that any dialect reads literally."""
    return "".join("\\" + c if c in r".^$*+?()[]{}|\-/" else c for c in phrase)


def whole_word(phrase: str) -> str:
    return rf"(?iu)\b{quoted(phrase)}\b"


def count_whole(text: Column, phrase: str) -> Column:
    """Case-insensitive whole-word occurrences of a literal phrase."""
    return F.coalesce(F.regexp_count(text, F.lit(whole_word(phrase))), F.lit(0))


def first_of(text: Column, table: dict[str, list[str]], default: str | None = None) -> Column:
    """The first name of table one of whose phrases text contains; order is precedence."""
    out = F.lit(default).cast("string")
    for name, phrases in reversed(table.items()):
        out = F.when(contains_any(text, phrases), F.lit(name)).otherwise(out)
    return out


def all_of(text: Column, table: dict[str, list[str]]) -> Column:
    """All names of table one of whose phrases text contains, in table order."""
    return F.array_compact(F.array(*[F.when(contains_any(text, phrases), F.lit(name)) for name, phrases in table.items()]))


def found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group's text at the first match; null where the pattern or group is missing."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def _folds() -> tuple[str, str]:
    """Letters with marks of the Latin blocks, and what is left without the marks: derived, not listed."""
    pairs = []
    for i in range(0xC0, 0x250):
        plain = "".join(c for c in unicodedata.normalize("NFKD", chr(i)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(i):
            pairs.append((chr(i), plain))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, PLAIN = _folds()


def fold_accents(text: Column) -> Column:
    """Letters without diacritics, composed (Latin blocks) or combining."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"\p{Mn}+", "")


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 after folding case and accents."""
    return F.regexp_extract_all(fold_accents(F.lower(text)), F.lit("([a-z0-9]+)"), F.lit(1))


# ------------------------------------------------------------- labels, numbers


def spaced(label: Column) -> Column:
    return F.translate(label, "_-", "  ")


def humanized(label: Column, overrides: dict[str, str], default: str = "Unknown") -> Column:
    """A label for the screen: separators to blanks, first letter up, set phrases as in overrides."""
    text = strip(F.regexp_replace(spaced(label), r"\s+", " "))
    known = F.create_map(*[F.lit(x) for pair in overrides.items() for x in pair]) if overrides else None
    shown = F.concat(F.upper(F.substring(text, 1, 1)), F.expr("substring('', 1, 0)"), text.substr(F.lit(2), F.length(text)))
    if known is not None:
        shown = F.coalesce(F.try_element_at(known, F.lower(text)), shown)
    return F.when(label.isNull() | (text == ""), F.lit(default)).otherwise(shown)


def number_text(x: Column) -> Column:
    """22.0 as 22, 92.5 as 92.5, others to six significant digits without trailing zeros."""
    return F.when(x.isNull(), None).when(x == F.floor(x), F.floor(x).cast("long").cast("string")).otherwise(F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", ""))


def percent_text(x: Column) -> Column:
    return F.concat(F.round(x * 100).cast("int").cast("string"), F.lit("%"))


def html_escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def title_case(text: Column) -> Column:
    """Letters behind anything but a letter up, all others down: o'brien and half-life as O'Brien and Half-Life."""
    letter = lambda c: F.coalesce(c.rlike(r"^\p{L}$"), F.lit(False))
    shown = let(F.split(text, ""), lambda cs: F.transform(cs, lambda c, i: F.when((i > 0) & letter(F.get(cs, i - 1)), F.lower(c)).otherwise(F.upper(c))))
    return F.when(text.isNotNull(), F.array_join(shown, ""))


def round_binary(x: Column, digits: int) -> Column:
    """x rounded by its exact binary value, ties to even, where round() goes by the shortest decimal, half up.

    The two differ only where x * 2 * 10**digits is an odd whole number but for rounding; the product's error,
    taken exactly from halves of both factors, then says on which side of the tie x lies.
    """
    twice, split = 2.0 * 10**digits, 134217729.0
    a = F.abs(x)
    b1 = split * twice - (split * twice - twice)
    b2 = twice - b1
    a1 = a * split - (a * split - a)
    p = a * twice
    e = ((a1 * b1 - p) + a1 * b2 + (a - a1) * b1) + (a - a1) * b2
    odd = F.floor(p / 2) * 2.0 + 1
    side, up, down = (p - odd) + e, (odd + 1) / 2, (odd - 1) / 2
    whole = F.when(side > 0, up).when(side < 0, down).when(up % 2 == 0, up).otherwise(down)
    return F.when((a < 1e12) & (F.abs(p - odd) < odd * 1e-14), F.signum(x) * whole / 10.0**digits).otherwise(F.round(x, digits))


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


# ------------------------------------------------------------- dates, ids, JSON


def duration_seconds(text: Column) -> Column:
    """Seconds of an ISO-8601 duration of days, hours, minutes and seconds; 0 for anything else."""
    whole = r"^P(?:(\d+)D)?T(?:(\d+)H)?(?:(\d+)M)?(?:(\d+)S)?$"
    part = lambda g, unit: F.coalesce(found(text, whole, g).cast("int"), F.lit(0)) * unit
    return F.when(text.rlike(whole), part(1, 86400) + part(2, 3600) + part(3, 60) + part(4, 1)).otherwise(0)


def chunk_id(source_id: Column, text: Column) -> Column:
    """source, _, and eight hex digits of the SHA-256 of the stripped first 200 characters."""
    return F.concat(source_id, F.lit("_"), F.substring(F.sha2(strip(F.substring(text, 1, 200)), 256), 1, 8))


def iso_timestamp(text: Column) -> Column:
    """An ISO-8601 time with its offset (without one, of the session's zone); null where there is none."""
    return F.try_to_timestamp(text)


def midnight(ts: Column) -> Column:
    return F.date_trunc("day", ts)


def session_id() -> Column:
    return F.substring(F.uuid(), 1, 8)


def short_time(ts: Column) -> Column:
    return F.date_format(ts, "dd MMM HH:mm")


def without_reasoning(text: Column) -> Column:
    """A model's reply without its think blocks, closed or not."""
    return strip(F.regexp_replace(text, r"(?s)<think>.*?(?:</think>|\z)", ""))


def json_in(text: Column) -> Column:
    """The outermost braces of a reply as a variant; null where they hold no JSON."""
    return F.try_parse_json(found(text, r"(?s)(\{.*\})"))


def ordered_union(a: Column, b: Column) -> Column:
    """Both lists, each element once, where it comes first."""
    return F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity in double precision; 0 where a vector has no length."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    length = norm(a) * norm(b)
    return F.when(length > 0, dot / length).otherwise(0.0)


def retry_delay(attempt: Column, retry_after: Column, jitter: Column) -> Column:
    """Seconds to wait before a retry: what the server asks, else doubling from one second plus jitter."""
    return F.coalesce(retry_after, F.pow(F.lit(2.0), attempt) + jitter)
