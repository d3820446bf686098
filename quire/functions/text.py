"""Text columns in built-in functions. Blanks are Unicode blanks and U+001C to U+001F, as str.split() has them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The blanks, given one by one, which a pattern finds faster than by property.
_BLANKS = r"\x09-\x0D\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
BLANK = f"[{_BLANKS}]"
WORD = f"[^{_BLANKS}]+"

# The script block and the punctuation and digits that count as its own.
SCRIPT = (0x0C80, 0x0CFF)
COMMON = "।॥|/Il.,:;-—'\"()[]0123456789"
LATIN = (0x0041, 0x024F)
MOST_CHARS = 1200
LEAST_RATIO_CHARS = 40
LEAST_RATIO = 0.28
FOREIGN_SHARE = 0.3
LOW_CONFIDENCE = 0.90
DANDAS = ("।", "॥")


def words(t: Column) -> Column:
    """Words of a text; null stays null, a blank text has none. Splitting takes a tenth of the time of finding all matches."""
    return F.array_remove(F.split(t, f"{BLANK}+"), "")


def n_words(t: Column) -> Column:
    return F.coalesce(F.size(words(t)), F.lit(0)).cast("long")


def lstrip(t: Column) -> Column:
    return F.regexp_replace(t, f"^{BLANK}+", "")


def rstrip(t: Column) -> Column:
    """One match from the start: a pattern that ends in $ would try every run of blanks in the text."""
    return F.regexp_extract(t, f"(?s)^(.*[^{_BLANKS}])?", 0)


def strip(t: Column) -> Column:
    return rstrip(lstrip(t))


def normalised(t: Column) -> Column:
    """Words joined by one blank. Only runs of blanks and other blanks than the plain one are looked for; most blanks stay."""
    other = _BLANKS.replace("\\x1C-\\x20", "\\x1C-\\x1F")
    return F.trim(F.regexp_replace(t, f"{BLANK}{{2,}}|[{other}]", " "))


def blank_to_null(t: Column) -> Column:
    s = strip(t)
    return F.when(s != "", s)


def truthy(*texts: Column) -> Column:
    """The first text that is neither null nor empty; the last one as it is."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts[:-1]], texts[-1])


def without_tags(html: Column) -> Column:
    return normalised(F.regexp_replace(html, "<[^>]+>", " "))


def consensus(*readings: Column) -> Column:
    """Words that stand in two readings or more, sorted.

    Each reading's set of words is made once; sorted together, a word of two sets stands beside itself. The array of one
    gives the sorted words a name within the expression, else every use would sort them again."""
    sets = F.array(*[F.array_distinct(words(F.coalesce(r, F.lit("")))) for r in readings])

    def twice(all_: Column) -> Column:
        n = F.greatest(F.size(all_) - 1, F.lit(0))
        return F.array_distinct(F.array_compact(F.zip_with(F.slice(all_, F.lit(1), n), F.slice(all_, F.lit(2), n), lambda a, b: F.when(a == b, a))))

    return F.element_at(F.transform(F.array(F.sort_array(F.flatten(sets))), twice), 1)


def mark_floor(mark: str, *readings: Column) -> Column:
    """Most often that a one-character mark stands in any reading; null where it stands in none."""
    counts = [F.length(F.coalesce(r, F.lit(""))) - F.length(F.replace(F.coalesce(r, F.lit("")), F.lit(mark))) for r in readings]
    return F.nullif(F.greatest(*counts), F.lit(0))


def foreign_share(t: Column, script: tuple[int, int] = SCRIPT) -> Column:
    """Characters outside the script and the common ones, blanks not counted, over all characters."""
    kept = "".join(f"\\x{{{ord(c):X}}}" for c in COMMON)
    alien = F.length(F.regexp_replace(t, f"(?U)[\\s\\x1C-\\x1F{kept}\\x{{{script[0]:X}}}-\\x{{{script[1]:X}}}]+", ""))
    return alien / F.greatest(F.length(t), F.lit(1))


def suspect(t: Column, ratio: Column, script: tuple[int, int] = SCRIPT) -> Column:
    """Whether a reading looks like a decoder's failure; ratio is its compressed size over its size."""
    long = F.length(t) > MOST_CHARS
    loops = (F.length(t) > LEAST_RATIO_CHARS) & (ratio < LEAST_RATIO)
    return F.coalesce(t == "", F.lit(True)) | F.coalesce(long | loops | (foreign_share(t, script) > FOREIGN_SHARE), F.lit(False))


def file_key(name: Column) -> tuple[Column, Column]:
    """Page number and side in IMG_<date>_<page>_<side>; 0 and '' where the name isn't of this form."""
    form = r"IMG_\d{8}_(\d+)_([A-Z])"
    page = F.coalesce(F.nullif(F.regexp_extract(name, form, 1), F.lit("")).cast("int"), F.lit(0))
    return page, F.regexp_extract(name, form, 2)


def minted_name(day: Column, page: Column, side: Column) -> Column:
    return F.format_string("IMG_%s_%04d_%s.tif", F.date_format(day, "yyyyMMdd"), page, side)


def safe_name(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)[^\w.-]", "_")


def escaped(t: Column) -> Column:
    """Text for HTML."""
    fixed = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))
    return reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), fixed, t)


def percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100, 0).cast("long").cast("string"), F.lit("%"))


def quoted(t: Column) -> Column:
    """Percent-encoding with %20 for a blank."""
    return F.replace(F.url_encode(t), F.lit("+"), F.lit("%20"))


def ago(seconds: Column) -> Column:
    """A humanised age; null is never. Halves round up."""
    up = lambda x: F.floor(x + 0.5).cast("long")
    m = F.greatest(F.lit(0).cast("long"), up(seconds / 60.0))
    return (
        F.when(seconds.isNull(), "never")
        .when(m < 2, "just now")
        .when(m < 60, F.concat(m.cast("string"), F.lit(" min ago")))
        .when(m < 2880, F.concat(up(m / 60.0).cast("string"), F.lit(" h ago")))
        .otherwise(F.concat(up(m / 1440.0).cast("string"), F.lit(" days ago")))
    )


def canonical_json(t: Column) -> Column:
    """JSON with an object's keys in order and no blanks, so that equal values have equal texts."""
    return F.to_json(F.parse_json(t))


def cache_key(t: Column, length: int = 12) -> Column:
    """The first hex digits of the SHA-1 of a JSON value, however it is written."""
    return F.substring(F.sha1(canonical_json(t)), 1, length)
