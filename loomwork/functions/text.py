"""Text, number, time and URL expressions; all are Catalyst expressions, none is a Python UDF."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of a missing value, compared without case and outer white space.
NULL_TOKENS = ("", "na", "n/a", "nan", "null", "none")
#: Query parameters that only track; everything that starts with utm_ does too.
TRACKING = ("fbclid", "gclid", "mc_cid", "mc_eid", "ref", "cmpid")


def _accents() -> tuple[str, str]:
    """Lower-case letters below U+0250 that decompose to one ASCII letter and marks, and those letters."""
    a, b = [], []
    for c in map(chr, range(0xC0, 0x250)):
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if c == c.lower() and len(base) == 1 and base.isascii() and base != c:
            a.append(c)
            b.append(base)
    return "".join(a), "".join(b)


_FROM, _TO = _accents()


def strip(c: Column) -> Column:
    """Without outer white space, Unicode's included."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def is_null_token(c: Column) -> Column:
    return c.isNull() | F.lower(strip(c)).isin(*NULL_TOKENS)


def optional_text(c: Column) -> Column:
    return F.when(~is_null_token(c), strip(c))


def optional_number(c: Column) -> Column:
    """A double; forms that only the JVM takes (type suffixes) are null. A real 0 stays 0."""
    ok = strip(c).rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(~is_null_token(c) & ok, strip(c).try_cast("double"))


def optional_int(c: Column) -> Column:
    ok = strip(c).rlike(r"^[+-]?\d+(\.0+)?$")
    return F.when(~is_null_token(c) & ok, F.regexp_replace(strip(c), r"\.0+$", "").try_cast("int"))


def valid_url(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^https?://[^/?#\s]+"), F.lit(False))


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(c), _FROM, _TO)


def tokens(c: Column) -> Column:
    """White-space tokens of the folded text; punctuation stays on."""
    return F.filter(F.split(fold(c), r"\s+"), lambda x: x != "")


def words(c: Column) -> Column:
    """Word tokens of the folded text."""
    return F.regexp_extract_all(fold(c), F.lit(r"[a-z0-9_]+"), F.lit(0))


def keywords(c: Column, stop: tuple[str, ...] = ()) -> Column:
    """Distinct words of four letters or more outside the stop set, first occurrence first."""
    return F.array_distinct(F.filter(words(c), lambda x: (F.length(x) >= 4) & ~x.isin(*(stop or ("",)))))


def coverage(query: Column, title: Column) -> Column:
    """Share of the query's keywords whose five-letter start begins a word of the title; 0 without keywords."""
    starts = F.transform(words(title), lambda x: F.substring(x, 1, 5))
    hit = F.filter(query, lambda k: F.array_contains(starts, F.substring(k, 1, 5)))
    return F.when(F.size(query) > 0, F.size(hit) / F.size(query)).otherwise(F.lit(0.0))


def comparable_title(c: Column) -> Column:
    """Folded, without bracketed agency tags, other signs as single spaces."""
    bare = F.regexp_replace(fold(c), r"\([^)]{1,40}\)", " ")
    return F.trim(F.regexp_replace(bare, r"[^a-z0-9]+", " "))


def clean_html(c: Column) -> Column:
    """References decoded twice (the five basic ones), tags removed, white space collapsed."""
    for _ in range(2):
        for ref, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            c = F.replace(c, F.lit(ref), F.lit(sign))
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"<[^>]*>", " "), r"\s+", " "))


def shorten(c: Column, most: int = 1000) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…"))).otherwise(c)


def host(c: Column) -> Column:
    """Lower-case host without user, port and www."""
    h = F.regexp_extract(F.lower(c), r"^https?://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.regexp_replace(h, r"^www\.", "")


def url_key(c: Column) -> Column:
    """Identity of an address: https, bare host, path without closing slash, sorted parameters that say something."""
    path = F.regexp_replace(F.regexp_extract(c, r"^https?://[^/?#]+([^?#]*)", 1), r"/+$", "")
    query = F.regexp_extract(c, r"^[^?#]*\?([^#]*)", 1)
    keep = F.filter(
        F.split(query, "&"),
        lambda p: p.rlike("^[^=]+=.") & ~F.lower(p).rlike("^utm_") & ~F.lower(F.split_part(p, F.lit("="), F.lit(1))).isin(*TRACKING),
    )
    sorted_ = F.array_join(F.array_sort(keep), "&")
    return F.concat(F.lit("https://"), host(c), path, F.when(sorted_ != "", F.concat(F.lit("?"), sorted_)).otherwise(F.lit("")))


def news_id(c: Column) -> Column:
    """Up to 12 letters of the host's first label and 12 hex digits of the key's hash."""
    label = F.substring(F.regexp_replace(F.split_part(host(c), F.lit("."), F.lit(1)), "[^a-z0-9]", ""), 1, 12)
    return F.concat(label, F.lit("-"), F.substring(F.sha2(url_key(c), 256), 1, 12))


def group_id(ids: Column) -> Column:
    return F.concat(F.lit("g-"), F.substring(F.sha2(F.array_join(F.array_sort(ids), "|"), 256), 1, 12))


def language(c: Column) -> Column:
    names = {"english": "en", "spanish": "es", "french": "fr", "german": "de", "portuguese": "pt"}
    low = F.lower(strip(c))
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(known[low], F.when(low.rlike("^[a-z]{2}([-_].*)?$"), F.substring(low, 1, 2)), low)


def utc_time(c: Column) -> Column:
    """Compact, ISO-8601 (without zone: UTC), RFC-2822 and epoch-millisecond texts; others are null."""
    s = strip(c)
    mail = F.regexp_replace(s, r"^[A-Za-z]{3},\s*", "")
    return F.coalesce(
        F.when(s.rlike(r"^\d{8}T\d{6}Z$"), F.try_to_timestamp(s, F.lit("yyyyMMdd'T'HHmmss'Z'"))),
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), s.try_cast("timestamp")),
        F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} [+-]\d{4}$"), F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z"))),
        F.when(mail.rlike(r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2} (GMT|UTC|Z)$"), F.try_to_timestamp(F.regexp_replace(mail, " (GMT|UTC|Z)$", " +0000"), F.lit("d MMM yyyy HH:mm:ss Z"))),
        F.when(s.rlike(r"^\d{12,14}$"), F.timestamp_millis(s.try_cast("long"))),
    )


def figures(c: Column) -> Column:
    """Distinct figures of a text without separators and leading zeros, sorted."""
    found = F.regexp_extract_all(c, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    bare = F.transform(found, lambda x: F.regexp_replace(F.regexp_replace(x, "[.,]", ""), "^0+(?=.)", ""))
    return F.array_sort(F.array_distinct(bare))


def word_count(c: Column) -> Column:
    """Words, citation marks like [a1] aside."""
    return F.size(F.regexp_extract_all(F.regexp_replace(fold(c), r"\[a\d+\]", " "), F.lit(r"[a-z0-9_]+"), F.lit(0)))


def whole_word(text: Column, word: str) -> Column:
    return text.rlike(rf"(^|[^a-z0-9_])\Q{word}\E([^a-z0-9_]|$)")


def first_keyword(text: Column, listed: tuple[str, ...]) -> Column:
    """The first listed word that the folded text has as a whole word."""
    return F.coalesce(*[F.when(whole_word(text, w), F.lit(w)) for w in listed], F.lit(None))


def domain_matches(h: Column, pattern: str) -> Column:
    """.suffix, or the domain itself and its subdomains."""
    return h.endswith(pattern) if pattern.startswith(".") else (h == pattern) | h.endswith("." + pattern)


def escape_markdown(c: Column) -> Column:
    return F.regexp_replace(c, r"([\\`*_{}\[\]()#+!|<>~-])", r"\\$1")


def escape_html(c: Column) -> Column:
    for sign, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(ref))
    return c


def fence(c: Column, tag: str = "data") -> Column:
    """Text that a prompt may hold as data: a closing tag in it is made harmless, and the whole is enclosed."""
    safe = F.regexp_replace(c, rf"(?i)<\s*/\s*{tag}\s*>", f"<\\\\/{tag}>")
    return F.concat(F.lit(f"<{tag}>"), safe, F.lit(f"</{tag}>"))


def number_text(c: Column) -> Column:
    """Thousands in groups without decimals, smaller numbers with up to two."""
    small = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", c), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.abs(c) >= 1000, F.format_number(c, 0)).otherwise(small)


def json_payload(c: Column) -> Column:
    """The JSON of an answer that may be fenced."""
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"^```(?:json)?\s*", ""), r"\s*```$", "")


def utc_text(c: Column) -> Column:
    """A time as canonical text in UTC, to the second."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def custom_time(c: Column, pattern: str, zone: str = "UTC") -> Column:
    """A time written in a source's own pattern (without zone) and zone; a weekday before it is passed over; null if unreadable."""
    return F.to_utc_timestamp(F.try_to_timestamp(F.regexp_replace(strip(c), r"^\p{L}+\.?,\s*", ""), F.lit(pattern)), zone)


def annotated(text: Column, notes: Column) -> Column:
    """The text with [a1] written as [a1: note] where the map has a note; notes themselves are not searched for marks."""
    marks = F.regexp_extract_all(text, F.lit(r"\[(a\d+)\]"), F.lit(1))

    def piece(part: Column, i: Column) -> Column:
        mark = F.get(marks, i)
        return F.concat(part, F.coalesce(F.concat(F.lit("["), mark, F.coalesce(F.concat(F.lit(": "), notes[mark]), F.lit("")), F.lit("]")), F.lit("")))

    return F.array_join(F.transform(F.split(text, r"\[a\d+\]", -1), piece), "")


def canonical_key(fields: Column) -> Column:
    """sha256 of a map as compact JSON with sorted keys: equal for equal maps in any order of their entries."""
    return F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(fields)))), 256)


def cited_indicator(name: Column, country: Column, year: Column, value: Column, unit: Column) -> Column:
    """`name, country, year: value unit`; a year without a value is said to have none."""
    said = F.when(value.isNull(), F.lit("no published value")).otherwise(F.concat_ws(" ", number_text(value), unit))
    return F.concat(F.concat_ws(", ", name, country, year.cast("string")), F.lit(": "), said)


def cited_quake(magnitude: Column, place: Column, at: Column) -> Column:
    """`M magnitude, place, time`, leaving out what is null."""
    return F.concat_ws(", ", F.concat(F.lit("M "), number_text(magnitude)), place, utc_text(at))
