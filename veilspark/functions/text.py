"""Scalar text helpers."""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let
from .html import BLOCKS, RENDERED_TOKENS, TOKENS
from .html import SPACE as HTML_SPACE
from .patterns import JAVA_SPACE

# The run at the end is only tried from its start: from every character of an inner run, the
# search would cost the square of its length.
_TRIM = f"^[{JAVA_SPACE}]+|(?<![{JAVA_SPACE}])[{JAVA_SPACE}]++\\z"

# The references of HTML, by name; some may be written without their semicolon.
_NAMED = json.dumps(html5)
_OPEN_NAMES = sorted((n for n in html5 if not n.endswith(";")), key=len, reverse=True)
_OPEN_NAME = f"^(?:{'|'.join(_OPEN_NAMES)})"
_NUMBER = "^#(?:[xX][0-9A-Fa-f]++|[0-9]++);?"
# Numbers 128 to 159 name the characters that windows-1252 has there.
_WINDOWS = "".join(bytes([b]).decode("cp1252", "ignore") or chr(b) for b in range(128, 160))


def js_trim(text: Column) -> Column:
    """Strip every Unicode white-space character from both ends."""
    return F.regexp_replace(text, _TRIM, "")


def trim_word(word: Column) -> Column:
    """``js_trim`` of a word: the pattern is only tried where an end is not visible ASCII."""
    visible = F.ascii(word).between(33, 126) & F.ascii(F.substring(word, -1, 1)).between(33, 126)
    return F.when(visible, word).otherwise(js_trim(word))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return ~F.coalesce(text.rlike(f"[^{JAVA_SPACE}]"), F.lit(False))


def field_text(*candidates: Column) -> Column:
    """First candidate that is neither null nor empty, else the last one."""
    head = [F.nullif(c, F.lit("")) for c in candidates[:-1]]
    return F.coalesce(*head, candidates[-1])


def escape_html(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("\u00a0", "&nbsp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _code_point(number: Column) -> Column:
    """The character of a code point given as int; U+FFFD where there is none."""
    valid = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
    raw = F.unhex(F.lpad(F.hex(F.when(valid, number).otherwise(0xFFFD)), 8, "0"))
    windows = F.substring(F.lit(_WINDOWS), number - 127, F.lit(1))
    return F.when(number.between(128, 159), windows).otherwise(F.decode(raw, "UTF-32"))


def _decode_references(text: Column) -> Column:
    """Decode named, decimal and hexadecimal references in one pass over the ampersands."""
    named = F.from_json(F.lit(_NAMED), "map<string,string>")

    def number_of(written: Column) -> Column:
        is_hex = F.lower(F.substring(written, 2, 1)) == "x"
        digits = F.regexp_extract(written, "^#[xX]?0*+([0-9A-Fa-f]*)", 1)
        number = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("long")
        return F.when(digits == "", 0).when(F.length(digits) > 8, -1).otherwise(
            F.least(number, F.lit(0x110000))
        ).cast("int")

    def decoded(part: Column, written: Column, char: Column) -> Column:
        return F.concat(char, F.substring(part, F.length(written) + 1, F.length(part)))

    def by_name(part: Column) -> Column:
        closed = F.regexp_extract(part, "^[A-Za-z][A-Za-z0-9]*+;", 0)
        opened = F.regexp_extract(part, _OPEN_NAME, 0)
        return F.coalesce(
            let(closed, lambda name: decoded(part, name, F.try_element_at(named, name))),
            let(opened, lambda name: decoded(part, name, F.try_element_at(named, name))),
        )

    def by_number(part: Column) -> Column:
        written = F.nullif(F.regexp_extract(part, _NUMBER, 0), F.lit(""))
        return let(
            written, lambda w: decoded(part, w, let(number_of(w), _code_point))
        )

    def piece(part: Column, i: Column) -> Column:
        known = F.when(part.startswith("#"), by_number(part)).when(
            part.rlike("^[A-Za-z]"), by_name(part)
        )
        plain = F.when(i > 0, F.concat(F.lit("&"), part)).otherwise(part)
        return F.coalesce(F.when(i > 0, known), plain)

    joined = F.array_join(F.transform(F.split(text, "&"), piece), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def _marked(html: Column, tokens: str, marks: str) -> Column:
    """The page with its tokens replaced by marks, so that no reference reaches across one."""
    clean = F.regexp_replace(html, r"[\x00-\x08\x0E\x0F]", "�")
    return _decode_references(F.regexp_replace(clean, tokens, marks))


def text_content(html: Column) -> Column:
    """Text of an HTML page: no comments, scripts, styles, other hidden raw text, or tags.

    The page is read as a browser's tokenizer does, in one state at a time: markup inside a
    script or a quoted attribute is none, tags in a ``textarea`` or ``title`` are its text.
    References are decoded as a browser does in text: every name of HTML, the longest that
    fits, those that may be without a semicolon also so; numbers with or without one.
    Control characters that serve as marks here become U+FFFD.
    """
    marked = _marked(html, TOKENS, "\x01${areaText}${shownText}${restText}")
    return F.replace(marked, F.lit("\x01"), F.lit(""))


# Marks of ``inner_text``: breaks of paragraphs, blocks, lines and cells; the bounds of text
# whose white space counts, and that space.
_P, _B, _N, _C, _PRE, _ERP, _BLANK, _TAB = "\x03\x04\x05\x06\x07\x08\x0e\x0f"
_LAYOUT = (
    ("\x01/?\x02", ""),
    (f"(?i)\x01/t[dh]\x02[{HTML_SPACE}]*+\x01t[dh]\x02", _C),
    ("(?i)\x01/?p\x02", _P),
    ("(?i)\x01br\x02", _N),
    ("(?i)\x01(?:pre|listing)\x02", _B + _PRE),
    ("(?i)\x01/(?:pre|listing)\x02", _ERP + _B),
    ("(?i)\x01textarea\x02", _PRE),
    ("(?i)\x01/textarea\x02", _ERP),
    (f"(?i)\x01/?(?:{'|'.join(BLOCKS)})\x02", _B),
    ("\x01[^\x02]*+\x02", ""),
)
_BREAKS = f" *+(?:[{_P}{_B}] *+)++"


def inner_text(html: Column) -> Column:
    """Text of an HTML page as it is laid out, as ``innerText`` gives it without style sheets.

    Block elements stand on lines of their own, paragraphs with an empty line around them,
    ``br`` ends a line, cells of a row are kept apart by tabs.  White space is one blank, and
    none next to a break, but counts in ``pre``, ``listing`` and ``textarea``.  Otherwise as
    ``text_content``, without the title.
    """
    marks = "\x01${tag}${wide}${area}\x02${areaText}${shownText}${restText}\x01/${area}\x02"
    marked = _marked(html, RENDERED_TOKENS, marks)
    for pattern, mark in _LAYOUT:
        marked = F.regexp_replace(marked, pattern, mark)

    def collapsed(text: Column) -> Column:
        return F.regexp_replace(text, f"[{HTML_SPACE}]++", " ")

    def part(text: Column, i: Column) -> Column:
        """The text behind a start of counting white space, up to its end, and the rest."""
        wide = F.substring_index(text, _ERP, 1)
        kept = F.regexp_replace(F.regexp_replace(wide, "\r\n?", "\n"), "\n", _N)
        kept = F.replace(F.replace(kept, F.lit(" "), F.lit(_BLANK)), F.lit("\t"), F.lit(_TAB))
        rest = F.substring(text, F.length(wide) + 1, F.length(text))
        return F.when(i == 0, collapsed(text)).otherwise(F.concat(kept, collapsed(rest)))

    flowed = F.array_join(F.transform(F.split(marked, _PRE), part), "")
    flowed = F.replace(flowed, F.lit(_ERP), F.lit(""))
    flowed = F.regexp_replace(flowed, "  ++", " ")
    flowed = F.regexp_replace(flowed, f" ?([{_N}{_C}]) ?", "$1")

    def lines(text: Column) -> Column:
        breaks = F.regexp_extract_all(text, F.lit(f"({_BREAKS})"), F.lit(1))
        parts = F.transform(F.split(text, _BREAKS), lambda p: F.regexp_replace(p, "^ | \\z", ""))

        def joined(found: Column, pieces: Column) -> Column:
            def one(piece: Column, i: Column) -> Column:
                first = (i == 0) | ((i == 1) & (pieces[0] == ""))
                last = (i == F.size(pieces) - 1) & (piece == "")
                ahead = F.get(found, i - 1)
                gap = F.when(ahead.contains(_P), "\n\n").otherwise("\n")
                return F.concat(F.when(first | last, "").otherwise(gap), piece)

            return F.array_join(F.transform(pieces, one), "")

        return let(breaks, lambda found: let(parts, lambda pieces: joined(found, pieces)))

    shown = let(flowed, lines)
    for mark, char in ((_N, "\n"), (_C, "\t"), (_BLANK, " "), (_TAB, "\t")):
        shown = F.replace(shown, F.lit(mark), F.lit(char))
    return shown
