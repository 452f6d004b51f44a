"""The tokens of HTML as one pattern, so that a page is read once, in one state at a time.

At every ``<`` exactly one alternative applies, as in a browser's tokenizer: a comment, a script
(whose text may hold comments that hold scripts), other raw text, text in which only references
count (``textarea``, ``title``), a tag with quoted and bare attribute values, or markup that is
skipped to the next ``>``.  What is opened and not closed reaches to the end of the page.  Every
loop is possessive and its steps cannot overlap, so the work is linear in the page and does not
recurse.
"""

from __future__ import annotations

# White space of HTML, elements by how their content is read, and by layout.
SPACE = r"\t\n\f\r "
_HIDDEN = ("style", "iframe", "noembed", "noframes", "noscript")
BLOCKS = (
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
    "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend",
    "li", "listing", "main", "menu", "nav", "ol", "optgroup", "option", "pre", "search",
    "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul", "xmp",
)

_EDGE = rf"(?=[{SPACE}/>])"
_VALUE = rf"""(?:"[^"]*+(?:"|\z)|'[^']*+(?:'|\z)|(?=>)|[^{SPACE}>"'][^{SPACE}>]*+|\z)"""
_ATTRIBUTE = rf"[^{SPACE}/>][^{SPACE}/>=]*+(?:[{SPACE}]*+=[{SPACE}]*+{_VALUE})?+"
_REST = rf"(?:[{SPACE}/]++|{_ATTRIBUTE})*+(?:>|\z)"  # of a tag, behind its name
_NEWLINE = r"(?:\r?\n)?+"  # dropped at the start of pre, listing and textarea

_COMMENT = r"!--(?:-?>|.*?(?:--!?>|\z))"
# In a script's comment a further <script> hides the next </script>.
_TWICE = rf"<script{_EDGE}(?:[^<-]++|-(?!->)|<(?!/script[{SPACE}/>]))*+(?:</script{_EDGE})?+"
_ESCAPED = rf"<!(?=--)(?:[^<-]++|-(?!->)|{_TWICE}|<(?!/script[{SPACE}/>]))*+"
_SCRIPT = (
    rf"script{_EDGE}{_REST}(?:[^<]++|{_ESCAPED}|<(?!/script[{SPACE}/>]))*+(?:</script{_EDGE}{_REST}|\z)"
)
_OTHER = r"(?:[!?][^>]*+(?:>|\z)|/(?:>|[^a-z>][^>]*+(?:>|\z)))"


def _raw(names: tuple[str, ...], group: str, kept: str = "") -> str:
    """Elements that only their own end tag ends; with ``kept``, their text is that group."""
    body = rf"(?:[^<]++|<(?!/\k<{group}>[{SPACE}/>]))*+"
    body = f"(?<{kept}>{body})" if kept else body
    newline = _NEWLINE if names == ("textarea",) else ""
    return (
        rf"(?<{group}>{'|'.join(names)}){_EDGE}{_REST}{newline}{body}(?:</\k<{group}>{_EDGE}{_REST}|\z)"
    )


def _tokens(hidden: tuple[str, ...], shown: tuple[str, ...]) -> str:
    ways = (
        _COMMENT,
        _SCRIPT,
        _raw(hidden, "hidden"),
        _raw(("textarea",), "area", "areaText"),
        _raw(shown, "shown", "shownText"),
        rf"plaintext{_EDGE}{_REST}(?<restText>.*+)",
        rf"(?<wide>pre|listing){_EDGE}{_REST}{_NEWLINE}",
        rf"(?<tag>/?[a-z][^{SPACE}/>]*+){_REST}",
        _OTHER,
    )
    return f"(?is)<(?:{'|'.join(ways)})"


TOKENS = _tokens(_HIDDEN, ("title", "xmp"))
# A title is no part of what is rendered.
RENDERED_TOKENS = _tokens((*_HIDDEN, "title"), ("xmp",))
