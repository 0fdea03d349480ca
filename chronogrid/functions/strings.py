"""Text expressions: numbers in texts, cleaning, hashing, tests of urls."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_hash(text: Column) -> Column:
    """The absolute 32-bit rolling hash (times 31, plus the UTF-16 unit) of a text, in hexadecimal digits."""
    def step(h: Column, unit: Column) -> Column:
        return F.pmod(h * 31 + unit + 2**31, F.lit(2**32)) - 2**31

    def add(h: Column, char: Column) -> Column:
        point = F.ascii(char).cast("long")
        high = point > 0xFFFF
        wide = step(step(h, F.lit(0xD800) + F.shiftright(point - 0x10000, 10)), F.lit(0xDC00) + (point - 0x10000).bitwiseAND(F.lit(0x3FF)))
        return F.when(high, wide).otherwise(step(h, point))

    return F.lower(F.hex(F.abs(F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda h, c: F.when(c == "", h).otherwise(add(h, c))))))


def european_number(text: Column) -> Column:
    """The number in a text with points between thousands and a comma before decimals; the leading number if more follows."""
    kept = F.regexp_replace(F.regexp_replace(F.trim(text), r"[^0-9.,-]", ""), r"\.", "")
    pointed = F.regexp_replace(kept, r",(?=[^,]*$)", ".")
    return F.regexp_extract(pointed, r"^-?(?:\d+\.?\d*|\.\d+)", 0).try_cast("double")


def strip_non_numerics(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9.\-]", "")


def strip_markdown(text: Column) -> Column:
    """Without emphasis, headings, quotes, list marks, code marks and the addresses of links."""
    out = F.regexp_replace(text, r"!?\[([^\]]*)\]\([^)]*\)", "$1")
    out = F.regexp_replace(out, r"(?m)^\s{0,3}(?:#{1,6}\s+|>\s?|[-*+]\s+)", "")
    return F.regexp_replace(out, r"(\*\*|__|\*|_|`|~~)", "")


def equal_ignoring_case(a: Column, b: Column) -> Column:
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def capitalise(text: Column) -> Column:
    """The first letter of every word, as spaces part them, in upper case; the rest as it is."""
    words = F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.expr("''"), w.substr(F.lit(2), F.length(w))))
    return F.array_join(words, " ")


def truncate(text: Column, n: int) -> Column:
    """At most n characters, the last three of a longer text being points."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def list_phrase(items: Column) -> Column:
    """``a, b and c``."""
    n = F.size(items)
    many = F.concat(F.array_join(F.slice(items, F.lit(1), F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(items, -1))
    return F.when(n == 0, F.lit("")).when(n == 1, F.get(items, F.lit(0))).otherwise(many)


def is_url(text: Column) -> Column:
    return F.rlike(text, F.lit(r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://)?[^\s/?#]\S*$"))


#: The endings of image files.
IMAGE_ENDINGS = ("avif", "gif", "jpeg", "jpg", "png", "svg", "webp")


def is_image(text: Column) -> Column:
    """Whether a web address ends like an image file, with something before the ending; queries and fragments are ends too."""
    ending = F.substring_index(text, ".", -1)
    named = F.length(F.substring_index(text, "://", -1)) > F.length(ending) + 1
    return F.substring_index(text, "://", 1).isin("http", "https") & F.contains(text, F.lit("://")) & ending.isin(*IMAGE_ENDINGS) & named


def escape_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for char, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out
