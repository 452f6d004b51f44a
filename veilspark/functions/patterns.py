"""The eighteen patterns and their translation to the two regex dialects in use.

``PATTERNS`` states them in their original ECMAScript form.  That dialect has an ASCII
``\\b`` and a Unicode ``\\s``; Java has it the other way round, and RE2 has both ASCII.
``java_pattern`` and ``re2_pattern`` derive the form each engine needs.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

# Fixed values: (type, ignore case, pattern), in priority order.
PATTERNS = (
    ("ssn", False, r"\b\d{3}-\d{2}-\d{4}\b"),
    ("creditCard", False, r"\b(?:4\d{3}|5[1-5]\d{2}|6011|3[47]\d{2})[\s-]?\d{4}[\s-]?\d{4}[\s-]?\d{4}\b"),
    ("cvv", True, r"\b(?:(?:CVV|CVC|CSC)[-:\s]+\d{3,4}|(?:expires\s+\d{1,2}\/\d{4}\))\s+should|\d{4,16}[,\s]+(?:CVV|CVC|CSC)[-:\s]+\d{3,4})\b"),
    ("policyNumber", True, r"\b(?:policy|insurance)(?:\s+(?:number|#))?[-:\s]*(?:POL-|POLICY-)?\d{4}-\d{7,10}\b"),
    ("medicalRecord", True, r"\b(?:MRN|HIC|medical\s+record(?:\s+number)?)[-:\s]+\d{2,3}-?\d{2,3}-?\d{4,5}[A-Z]?\b"),
    ("vin", True, r"\b(?:(?:VIN|vehicle\s+identification\s+number)[-:\s]+)?[A-HJ-NPR-Z0-9]{17}\b"),
    ("routingNumber", True, r"\b(?:routing(?:\s+(?:number|#))?[-:\s]+)\d{9}\b"),
    ("bankAccount", True, r"\b(?:account(?:\s+(?:number|#|no\.?))?[-:\s]+)\d{10,17}\b"),
    ("passport", True, r"\b(?:passport(?:\s+(?:number|#|no\.?))?[-:\s]+)?[A-Z]{1,2}\d{7,9}\b"),
    ("driversLicense", True, r"\b(?:(?:driver'?s?\s+(?:license|DL)(?:\s+(?:number|#|no\.?))?[-:\s]+)|(?:license\s+number(?:\s+is)?[-:\s]+))[A-Z]\d{7,8}\b"),
    ("email", False, r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("phone", False, r"(?:\+\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"),
    ("zipCode", False, r"\b\d{5}(?:-\d{4})?\b"),
    ("ipv4", False, r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    ("dateOfBirth", True, r"\b(?:DOB|date\s+of\s+birth|born\s+on|birth\s+date)[-:\s]+(?:(?:0?[1-9]|1[0-2])[-\/](?:0?[1-9]|[12][0-9]|3[01])[-\/](?:19|20)\d{2}|(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[\s]+\d{1,2},?[\s]+(?:19|20)\d{2})\b"),
    ("titleName", False, r"\b(?:Dr|Mr|Mrs|Ms|Prof|Professor)\.?\s+[A-Z][a-z]+(?:[-'\s][A-Z][a-z]+)*(?:\s+[A-Z][a-z]+(?:[-'][A-Z][a-z]+)*){0,2}\b"),
    ("fullName", False, r"\b(?:my\s+(?:name|colleague)\s+is|with|coordinating\s+with)\s+([A-Z][a-z]+\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"),
    ("organization", False, r"\b(?:[A-Z][A-Za-z]+\s+){1,4}(?:Corporation|Corp\.?|Inc\.?|LLC|Ltd\.?|Limited|Company|Co\.?|Bank|Services|Systems|Solutions|Technologies|Group|Partners|Industries|Medical\s+Center|University|College|Pharmacy)\b"),
)

PATTERN_NAMES = tuple(name for name, _, _ in PATTERNS)

# The white-space set of ECMAScript, as the inside of a character class.
JAVA_SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
RE2_SPACE = (
    r"\t\n\x0B\f\r \x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"
)

# Java's own \w is ASCII whatever the version, unlike its \b.
_ANY_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"
_WORD_START = r"(?<!\w)"
_WORD_END = r"(?!\w)"


@dataclass(frozen=True)
class Scan:
    """How a pattern is run on the JVM.

    ``lead`` is a class holding every character a match can begin with.  Testing it
    before the look-behind lets the matcher skip most positions cheaply.
    ``digits`` says that every match contains what ``DIGITS`` matches, ``literal`` is a
    string and ``gate`` a cheaper regex found wherever the pattern matches; ``keyword``
    says that every match contains one of ``KEYWORDS``.  These only rule texts out early.
    ``word_edges`` says whether a match always starts / ends with a word character, in
    which case a one-sided look-around replaces ``\\b``.
    """

    lead: str
    digits: bool = False
    keyword: bool = False
    literal: str = ""
    gate: str = ""
    word_edges: tuple[bool, bool] = (True, True)


# Three digits in a row, or two around a dot: one scan rules most patterns out of most texts.
DIGITS = r"\d(?:\d\d|\.\d)"

# Words at whose start a match of a keyword pattern, or a part of it, begins.  One scan for
# all of them takes the place of one scan per pattern in texts that have none.
KEYWORDS = (
    r"(?i)(?=[abcdehilmpr])(?<!\w)(?:cvv|cvc|csc|expires|policy|insurance|mrn|hic|medical"
    r"|routing|account|driver|license|dob|date[^\w]+of|born|birth)"
)

SCANS = {
    "ssn": Scan("[0-9]", digits=True),
    "creditCard": Scan("[3-6]", digits=True),
    "cvv": Scan("[0-9ceCE]", digits=True, keyword=True),
    "policyNumber": Scan("[piPI]", digits=True, keyword=True),
    "medicalRecord": Scan("[mhMH]", digits=True, keyword=True),
    "vin": Scan("[0-9A-Za-z]", gate=r"(?<!\w)\p{Alnum}{17}(?!\w)"),
    "routingNumber": Scan("[rR]", digits=True, keyword=True),
    "bankAccount": Scan("[aA]", digits=True, keyword=True),
    "passport": Scan("[A-Za-z]", digits=True, gate=r"\d{7}"),
    "driversLicense": Scan("[dlDL]", digits=True, keyword=True),
    "email": Scan(
        "[A-Za-z0-9._%+-]",
        literal="@",
        gate=r"[\w.%+-]@[A-Za-z0-9.-]+\.[A-Za-z|]{2}",
        word_edges=(False, False),
    ),
    "phone": Scan(r"[+(\d]", digits=True),
    "zipCode": Scan("[0-9]", digits=True),
    "ipv4": Scan("[0-9]", digits=True),
    "dateOfBirth": Scan("[dbDB]", digits=True, keyword=True),
    "titleName": Scan("[DMP]"),
    "fullName": Scan("[cmw]"),
    "organization": Scan("[A-Z]", word_edges=(True, False)),
}

# Two patterns need a form that stays safe on long texts.  Each finds the same matches.
#
# titleName: Java runs an unbounded group loop on the call stack, so some thousand
# capitalised words in a row would end the executor.  A possessive loop does not recurse.
# It may not give words back, so each word must itself end at a word boundary, which
# every word of a match does: it is followed by a separator or by the final boundary.
#
# email: trying every boundary of a long dotted run costs the square of its length.
# Whether a run is followed by a domain does not depend on where in the run one starts,
# so only its first boundary matters.  \G keeps the one start that can follow a previous
# match directly: a separator right behind it.
_CAPITALISED = r"[A-Z][a-z]++(?!\w)"
_LONG_TEXT_FORMS = {
    "titleName": (
        r"(?:Dr|Mr|Mrs|Ms|Prof|Professor)\.?\s+"
        + _CAPITALISED
        + r"(?:[-'\s]" + _CAPITALISED + r")*+"
        + r"(?:\s+" + _CAPITALISED + r"(?:[-']" + _CAPITALISED + r")*+){0,2}"
    ),
    "email": (
        r"(?:(?=\w)(?<!\w)(?<!\w[.%+-]{1,8})|\G(?<=\w)(?=[.%+-]))"
        + r"[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}"
        + _ANY_EDGE
    ),
}


def _expand_space(pattern: str, space: str) -> str:
    out, in_class, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two == r"\s":
            out.append(space if in_class else f"[{space}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            in_class = {"[": True, "]": False}.get(two[0], in_class)
            out.append(two[0])
            i += 1
    return "".join(out)


def _body(pattern: str) -> tuple[bool, str, bool]:
    starts, ends = pattern.startswith(r"\b"), pattern.endswith(r"\b")
    return starts, pattern[2 if starts else 0 : -2 if ends else None], ends


def plain_java_pattern(name: str) -> str:
    """Java form with every boundary spelled out and nothing tuned."""
    _, ignore_case, pattern = _lookup(name)
    starts, body, ends = _body(pattern)
    return (
        ("(?i)" if ignore_case else "")
        + (_ANY_EDGE if starts else "")
        + _expand_space(body, JAVA_SPACE)
        + (_ANY_EDGE if ends else "")
    )


@lru_cache(maxsize=None)
def java_pattern(name: str) -> str:
    """Java form used in plans: same matches as ``plain_java_pattern``, scanned faster."""
    _, ignore_case, pattern = _lookup(name)
    scan = SCANS[name]
    starts, body, ends = _body(pattern)
    head = f"(?={scan.lead})" + (_WORD_START if starts else "")
    tail = "" if not ends else _WORD_END if scan.word_edges[1] else _ANY_EDGE
    if name == "email":
        head = tail = ""
    body = _LONG_TEXT_FORMS.get(name, body)
    return ("(?i)" if ignore_case else "") + head + _expand_space(body, JAVA_SPACE) + tail


@lru_cache(maxsize=None)
def re2_pattern(name: str) -> str:
    """RE2 form, for checking results with another SQL engine."""
    _, ignore_case, pattern = _lookup(name)
    return ("(?i)" if ignore_case else "") + _expand_space(pattern, RE2_SPACE)


def _lookup(name: str) -> tuple[str, bool, str]:
    for spec in PATTERNS:
        if spec[0] == name:
            return spec
    raise KeyError(f"unknown pattern: {name}")
