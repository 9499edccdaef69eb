"""Tokens and text as Column expressions (no Python on the executors)."""

from __future__ import annotations

import unicodedata
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that don't count as question terms.
STOP_WORDS = (
    "the a an of is are was were in on at to for and or what who when where which how does do did it its this that be by with as from "
    "about tell me name his her their s ' ? , ."
).split()
#: Character classes for tokens; ASCII punctuation includes symbols.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}"
PUNCTUATION = r"!-/:-@\[-`{-~\p{P}"
TOKEN = rf"[{CJK}]|[{PUNCTUATION}]|[^\s\p{{Z}}{CJK}{PUNCTUATION}]+"
#: The same tokens, found faster in ASCII text: its letters and digits pass without a look at the classes.
FAST_TOKEN = rf"(?:[a-z0-9]++|[^\s\p{{Z}}{CJK}{PUNCTUATION}])++|[{CJK}]|[{PUNCTUATION}]"
CONTROL = r"[\p{Cf}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\x{FFFD}]"


def _accents() -> tuple[str, str]:
    """All characters of the basic plane that decompose into one base character and marks, and those base characters."""
    rows = []
    for code in range(0xC0, 0xFFFE):
        if 0xAC00 <= code < 0xE000:  # Hangul syllables, which decompose into letters, and surrogates
            continue
        parts = [c for c in unicodedata.normalize("NFD", chr(code)) if unicodedata.category(c) != "Mn"]
        if len(parts) == 1 and parts[0] != chr(code) and not chr(code).isupper():
            rows.append((chr(code), parts[0]))
    return "".join(a for a, _ in rows), "".join(b for _, b in rows)


ACCENTED, PLAIN = _accents()


def normalised(text: Column) -> Column:
    """Without control characters, in lower case, without accents; null is empty."""
    text = F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, "")
    return F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{Mn}", "")


def tokens(text: Column) -> Column:
    """array<string>: words, single punctuation characters and single CJK characters, in order."""
    return F.regexp_extract_all(normalised(text), F.lit(FAST_TOKEN), F.lit(0))


#: A token where it stands: a word holds what is removed from it, but doesn't begin with it.
SOURCE_TOKEN = rf"[{CJK}]|[{PUNCTUATION}]|[^ \t\n\r\p{{Z}}{CJK}{PUNCTUATION}{CONTROL[1:-1]}][^ \t\n\r\p{{Z}}{CJK}{PUNCTUATION}]*"


def token_pieces(text: Column) -> Column:
    """array<string> whose elements 1, 3, 5, ... (from 0) are the text's tokens as they stand, the others what lies between them.

    Joined, they are the text, but for the character U+0001, which becomes U+0002.
    """
    plain = F.translate(F.coalesce(text, F.lit("")), "\x01", "\x02")
    return F.split(F.regexp_replace(plain, f"({SOURCE_TOKEN})", "\x01$1\x01"), "\x01")


def truncated(found: Column, most: int) -> Column:
    return F.slice(found, 1, most)


def is_stop(term: Column) -> Column:
    return term.isin(STOP_WORDS)


def question_terms(text: Column, most: int = 128) -> Column:
    """Distinct tokens that are no stop words, in first order."""
    return F.filter(F.array_distinct(truncated(tokens(text), most)), lambda t: ~is_stop(t))


def related(a: Column, b: Column) -> Column:
    """Equal, or one a prefix of the other with at most 3 bytes more; both of at least 4 bytes and no word pieces."""
    x, y = F.octet_length(a), F.octet_length(b)
    near = (F.least(x, y) >= 4) & (F.abs(x - y) <= 3) & ~a.startswith("#") & ~b.startswith("#")
    return (a == b) | (near & (a.startswith(b) | b.startswith(a)))


def second_question(text: Column) -> Column:
    """What follows the first question mark, without leading spaces, commas and one "and "; null if it has fewer than 6 bytes."""
    rest = F.regexp_extract(text, r"(?s)\?[\s,]*(.*)", 1)
    rest = F.regexp_replace(rest, "^(?i:and )", "")
    return F.when(F.octet_length(rest) >= 6, rest)


def _pair_parts(question: Column, context: Column, most: int) -> tuple[Column, Column]:
    q = F.slice(question, 1, 62)
    return q, F.slice(context, 1, F.greatest(F.lit(0), most - 3 - F.size(q)))


def encoded_pair(question: Column, context: Column, most: int = 384) -> Column:
    """[CLS] question [SEP] context [SEP]; the context is cut, the question has at most 62 tokens."""
    q, c = _pair_parts(question, context, most)
    return F.concat(F.array(F.lit("[CLS]")), q, F.array(F.lit("[SEP]")), c, F.array(F.lit("[SEP]")))


def pair_types(question: Column, context: Column, most: int = 384) -> Column:
    """Of each token of encoded_pair its type: 0 up to the first [SEP], 1 behind it."""
    q, c = _pair_parts(question, context, most)
    return F.concat(F.array_repeat(F.lit(0), F.size(q) + 2), F.array_repeat(F.lit(1), F.size(c) + 1))


def bound(value: Column, then) -> Column:
    """then(value), with value computed once a row, whatever the optimiser merges."""
    return F.transform(F.array(value), then)[0]


def padded(text: Column, keep: str = "") -> Column:
    """Lower-case ASCII letters and digits (and the characters of keep) between spaces, with a space at both ends."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.concat(F.lit(" "), F.regexp_replace(low, f"[^a-z0-9{keep}]", " "), F.lit(" "))


def contains_any(text: Column, phrases: list[str] | tuple[str, ...]) -> Column:
    out = F.lit(False)
    for phrase in phrases:
        out = out | text.contains(phrase)
    return out


def sentences(text: Column) -> Column:
    """array<string> cut after [.?!] and one space before an upper-case letter, digit, quote or parenthesis.

    A full stop after a token of at most 3 characters that begins in upper case is an abbreviation. At most 64.
    """
    marked = F.regexp_replace(F.coalesce(text, F.lit("")), r'([.?!]) (?=[A-Z0-9"(])', "$1\x01")
    rejoined = F.regexp_replace(marked, r"((?:^|\s)[A-Z][^\s]{0,2}\.)\x01", "$1 ")
    return F.transform(F.split(rejoined, "\x01", 64), lambda s: F.translate(s, "\x01", " "))


def url_decoded(text: Column) -> Column:
    """Percent codes and plus signs decoded; a percent sign that begins no code stays."""
    return F.url_decode(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"))


def packed_sentences(text: Column, most: int = 600) -> Column:
    """Passages of at most `most` characters filled greedily with sentences; one longer sentence stays whole."""
    parts = F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])")

    def add(state: Column, s: Column) -> Column:
        full = (F.length(state.cur) > 0) & (F.length(state.cur) + 1 + F.length(s) > most)
        return F.struct(
            F.when(full, F.concat(state.out, F.array(state.cur))).otherwise(state.out).alias("out"),
            F.when(full | (F.length(state.cur) == 0), s).otherwise(F.concat_ws(" ", state.cur, s)).alias("cur"),
        )

    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))
    end = lambda s: F.filter(F.concat(s.out, F.array(s.cur)), lambda x: x != "")
    return F.when(F.length(text) <= most, F.array(text)).otherwise(F.aggregate(parts, start, add, end))


def merged_forward(paragraphs: Column, least: int = 60) -> Column:
    """While the last paragraph so far is shorter than `least`, the next one is appended to it."""

    def add(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.concat_ws(" ", last, p)))
        return F.when((F.size(out) > 0) & (F.length(F.try_element_at(out, F.lit(-1))) < least), joined).otherwise(F.concat(out, F.array(p)))

    return F.aggregate(paragraphs, F.array().cast("array<string>"), add)


#: The standard's named characters that end with a semicolon, those that needn't, and a pattern of these, longest first.
NAMED = {n: c for n, c in html5.items() if n.endswith(";")}
OPEN = {n: c for n, c in html5.items() if not n.endswith(";")}
_OPEN = "^(" + "|".join(sorted(OPEN, key=lambda n: (-len(n), n))) + ")"
#: Numbers whose characters the standard replaces: those of a Western code page, nothing, and a return.
_REPLACED = {0x00: "�", 0x0D: "\r"} | {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)}


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def _numbered(s: Column) -> Column:
    """The character of #123; or #x7B;: none for those that aren't characters, the replacement character beyond the range."""
    digits = F.regexp_replace(s, "^#[xX]?0*|;$", "")
    hexadecimal = s.rlike("^#[xX]")
    code = F.when(F.length(digits) > 8, F.lit(0x110000)).otherwise(F.when(hexadecimal, F.conv(F.concat(F.lit("0"), digits), 16, 10)).otherwise(F.conv(F.concat(F.lit("0"), digits), 10, 10)).cast("long"))

    def character(n: Column) -> Column:
        odd = F.lit(False)
        for low, high in ((1, 8), (14, 31), (127, 159), (0xFDD0, 0xFDEF), (11, 11)):
            odd = odd | n.between(low, high)
        odd = odd | (F.pmod(n, F.lit(0x10000)) >= 0xFFFE)
        plain = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
        return F.coalesce(F.try_element_at(_literal_map(_REPLACED), F.least(n, F.lit(0x110000)).cast("int")), F.when(n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "�").when(odd, "").otherwise(plain))

    return bound(code, character)


def _after_ampersand(part: Column) -> Column:
    """What follows an ampersand, with the character that it names, if any, in place of its name."""

    def named(s: Column) -> Column:
        prefix = F.regexp_extract(s, _OPEN, 1)
        short = F.try_element_at(_literal_map(OPEN), prefix)
        found = F.when(s.endswith(";"), F.try_element_at(_literal_map(NAMED), s))
        whole = F.coalesce(found, F.when(prefix != "", F.concat(short, F.substring(s, F.length(prefix) + 1, F.length(s)))), F.concat(F.lit("&"), s))
        return F.when(s == "", "&").when(s.startswith("#"), _numbered(s)).otherwise(whole)

    pattern = r"^(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
    return bound(F.regexp_extract(part, pattern, 1), lambda s: F.concat(named(s), F.substring(part, F.length(s) + 1, F.length(part))))


def unescaped(text: Column) -> Column:
    """Named and numbered characters replaced, as the HTML standard does: names without semicolon too, where it knows them."""
    parts = F.split(text, "&")
    rest = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), _after_ampersand)
    whole = F.concat(parts[0], F.array_join(rest, ""))
    return F.when(text.contains("&"), whole).otherwise(text)


# The patterns of pages below (content element, footer, references, edit links, removed elements, paragraphs).
def body_of(html: Column) -> Column:
    """What follows the parser-output element, if there is one, up to the archive's footer."""
    inner = F.regexp_extract(html, r'(?s)class="[^"]*mw-parser-output[^"]*"[^>]*>(.*)', 1)
    body = F.when(html.rlike(r'class="[^"]*mw-parser-output[^"]*"[^>]*>'), inner).otherwise(html)
    at = F.instr(body, 'class="zim-footer"')
    return F.when(at > 1, F.substring(body, F.lit(1), at - 1)).otherwise(body)


def cleaned_fragment(fragment: Column) -> Column:
    """References, edit links and tags go, entities are replaced, empty parentheses and extra white space go."""
    out = F.regexp_replace(fragment, r'(?s)<sup[^>]*class="[^"]*reference[^"]*"[^>]*>.*?</sup>', "")
    out = F.regexp_replace(out, r'(?s)<span[^>]*class="[^"]*mw-editsection[^"]*"[^>]*>.*?</span>', "")
    out = unescaped(F.regexp_replace(out, r"<[^>]+>", ""))
    out = F.regexp_replace(out, r"\(\s*[;,]?\s*\)", "")
    return F.replace(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit("[edit]"), F.lit(""))


def html_paragraphs(html: Column, least: int = 20) -> Column:
    """array<string> of the cleaned paragraphs of at least that many characters."""
    body = F.regexp_replace(body_of(F.coalesce(html, F.lit(""))), r"(?s)<(script|style|table|math)[^>]*>.*?</\1>", "")
    found = F.regexp_extract_all(body, F.lit(r"(?s)<p(?:\s[^>]*)?>(.*?)</p>"), F.lit(1))
    return F.filter(F.transform(found, cleaned_fragment), lambda p: F.length(p) >= least)
