"""Reading HTML: against a tokenizer that goes character by character, and layout rules."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions.html import BLOCKS
from veilspark.functions.spans import detect_regex
from veilspark.functions.text import inner_text, text_content

SPACE = "\t\n\f\r "
RAW = ("style", "iframe", "noembed", "noframes", "noscript")


def tag_end(s, i):
    """Behind the ``>`` of the tag whose name ends at ``i``, by the tokenizer's states."""
    state, quote = "before", ""
    while i < len(s):
        c = s[i]
        if state == "before":
            if c == ">":
                return i + 1
            if c not in SPACE + "/":
                state = "name"
        elif state == "name":
            if c == ">":
                return i + 1
            if c == "/":
                state = "before"
            elif c in SPACE:
                state = "after"
            elif c == "=":
                state = "value"
        elif state == "after":
            if c == ">":
                return i + 1
            if c == "/":
                state = "before"
            elif c == "=":
                state = "value"
            elif c not in SPACE:
                state = "name"
        elif state == "value":
            if c == ">":
                return i + 1
            if c in "\"'":
                state, quote = "quoted", c
            elif c not in SPACE:
                state = "bare"
        elif state == "quoted":
            if c == quote:
                state = "before"
        elif state == "bare":
            if c == ">":
                return i + 1
            if c in SPACE:
                state = "before"
        i += 1
    return len(s)


def named(s, i, text):
    """``text`` at ``i``, as a whole name."""
    end = i + len(text)
    return s[i:end].lower() == text and end < len(s) and s[end] in SPACE + "/>"


def raw_end(s, i, name):
    while i < len(s) and not named(s, i, "</" + name):
        i += 1
    return i


def script_end(s, i):
    state = "data"
    while i < len(s):
        if state != "twice" and named(s, i, "</script"):
            return i
        if state == "data" and s.startswith("<!--", i):
            state, i = "escaped", i + 2
            continue
        if state != "data" and s.startswith("-->", i):
            state = "data"
        elif state == "escaped" and named(s, i, "<script"):
            state, i = "twice", i + 6
        elif state == "twice" and named(s, i, "</script"):
            state, i = "escaped", i + 7
        i += 1
    return i


def tokens(s, title=True):
    """('text', t), ('kept', t) and ('tag', name) of a page."""
    i, text = 0, ""
    while i < len(s):
        c, rest = s[i], s[i + 1 : i + 2]
        name = re.match(r"/?[A-Za-z][^\t\n\f\r />]*", s[i + 1 :]) if c == "<" else None
        if c != "<" or (rest == "/" and i + 2 == len(s)) or not (name or rest and rest in "!?/"):
            text += c
            i += 1
            continue
        if text:
            yield "text", text
            text = ""
        if name is None:
            if s.startswith("<!--", i):
                i += 4
                short = re.match("-?>", s[i:])
                m = re.search("--!?>", s[i:])
                i += short.end() if short else m.end() if m else len(s)
            elif s.startswith("</>", i):
                i += 3
            else:
                at = s.find(">", i)
                i = len(s) if at < 0 else at + 1
            yield "tag", ""
            continue
        tag = name[0].lower()
        i = tag_end(s, i + 1 + len(tag))
        if tag in ("script", *RAW) or tag == "title" and not title:
            end = script_end(s, i) if tag == "script" else raw_end(s, i, tag)
            i = tag_end(s, end + 2 + len(tag)) if end < len(s) else end
            yield "tag", ""
        elif tag in ("textarea", "title", "xmp"):
            if tag == "textarea":
                i += len(re.match("(\r?\n)?", s[i:])[0])
            end = raw_end(s, i, tag)
            yield "tag", ""
            yield ("kept" if tag == "textarea" else "text"), s[i:end]
            yield "tag", ""
            i = tag_end(s, end + 2 + len(tag)) if end < len(s) else end
        elif tag == "plaintext":
            yield "tag", ""
            yield "text", s[i:]
            i = len(s)
        else:
            if tag in ("pre", "listing"):
                i += len(re.match("(\r?\n)?", s[i:])[0])
            yield "tag", tag
    if text:
        yield "text", text


def content(s):
    return "".join(html.unescape(t) for kind, t in tokens(s) if kind != "tag")


def rendered(s):
    """White space and breaks one character at a time; only for pages whose pre is closed."""
    out, pending, blank, wide = "", 0, False, False
    before = [None]

    def put(c, free=False):
        nonlocal out, pending, blank
        if pending:
            out += "\n" * pending if out else ""
            pending, blank = 0, False
        if blank and not free:
            out += "" if not out or out[-1] in "\n\t" and out_free[-1] else " "
            out_free.append(False)
        blank = False
        out += c
        out_free.append(free)

    out_free = [True]
    for kind, t in tokens(s, title=False):
        if kind == "tag":
            if t.strip("/") in ("pre", "listing"):
                pending, wide = max(pending, 1), not t.startswith("/")
            elif t.strip("/") == "p":
                pending = 2
            elif t == "br":
                put("\n", True)
            elif t.strip("/") in BLOCKS:
                pending = max(pending, 1)
            elif t in ("td", "th") and before[0] in ("/td", "/th"):
                put("\t", True)
            if t:
                before[0] = t
        else:
            for c in html.unescape(t):
                if kind == "kept" or wide:
                    put(c)
                elif c in SPACE:
                    blank = True
                else:
                    put(c)
                    before[0] = None
    return out


PIECES = [
    "a", "b c", " ", "\n", "<", ">", "</", "<!", "<!--", "-->", "--", "-", "--!>", "<!-->", "<b>", "</b>", "<i x=1>",
    '<a href="x>y">', "<a b='c>d'e=\">\">", "<a b=c>d", "<a =\">", "<a b = 'q'>", "<a/b>", "<A B", "</a x='>'>", "</>", "</ x>",
    "<?php x>", "<!DOCTYPE html>", "<script>", "</script>", "<script ", "</script x>", "<SCRIPT/>", "<style>", "</style>", "</styl>",
    "<textarea>", "</textarea>", "<textarea>\n", "<title>", "</title>", "<xmp>", "</xmp>", "<noscript>", "</noscript >",
    "&amp;", "&lt", "&#65;", "&am", "p;", "&", "<p>", "</p>", "<br>", "<div>", "</div>", "é", "日本",
]


def both(spark, pages):
    df = spark.createDataFrame(list(enumerate(pages)), "id int, h string")
    rows = df.select("id", text_content(F.col("h")).alias("t"), inner_text(F.col("h")).alias("i")).orderBy("id")
    return [(r["t"], r["i"]) for r in rows.collect()]


def test_random_markup_is_read_as_by_states(spark):
    rng = random.Random(11)
    pages = ["".join(rng.choices(PIECES, k=rng.randint(1, 30))) for _ in range(4000)]
    pages += ["<script>" + "".join(rng.choices(PIECES[8:40] + ["<!--", "<script>", "</script>"] * 4, k=20)) for _ in range(1000)]
    for page, (got, _) in zip(pages, both(spark, pages)):
        assert got == content(page), page


def test_random_layout(spark):
    rng = random.Random(12)
    pieces = [
        "a", "b ", " c", " ", "\n ", "<b>", "</b>", "<p>", "</p>", "<div>", "</div>", "<br>", "<li>", "</li>", "<td>", "</td>", "</td> <td>",
        "</tr>", "<tr>", "<!-- x -->", "<pre>x\n  y </pre>", "<pre>\nz</pre>", "<h1>", "</H1>", "&nbsp;", "&#32;", "<span> ", "<title>no</title>",
    ]
    pages = ["".join(rng.choices(pieces, k=rng.randint(1, 16))) for _ in range(2000)]
    for page, (_, got) in zip(pages, both(spark, pages)):
        assert got == rendered(page), page


@pytest.mark.parametrize(
    ("page", "text", "shown"),
    [
        (None, None, None),
        ("", "", ""),
        ("<script>var a='<!--';</script>kept<!-- x -->tail", "kepttail", "kepttail"),
        ("<script><!--<script></script>--></script>x", "x", "x"),
        ("<textarea><b>q</b>\n r</textarea>", "<b>q</b>\n r", "<b>q</b>\n r"),
        ("<ul><li>123</li><li>45-6789</li></ul>", "12345-6789", "123\n45-6789"),
        ("<title>t</title><p>a</p><p>b<br>c</p>d", "tabcd", "a\n\nb\nc\n\nd"),
        ("<tr><td>1</td>\n<td>2</td></tr><tr><th>3</th></tr>", "1\n23", "1\t2\n3"),
        ("x<plaintext>a<b>\nc", "xa<b>\nc", "xa<b> c"),
        ("a\x01b\x00", "a�b�", "a�b�"),
    ],
)
def test_pages(one, page, text, shown):
    assert one(text_content(F.lit(page).cast("string"))) == text
    assert one(inner_text(F.lit(page).cast("string"))) == shown


def test_detections_behind_scripts_and_across_items(spark):
    page = "<script>if (a <!--b) f();</script><li>Mail ann@example.com</li><li>123-45-6789</li>"
    df = spark.createDataFrame([(page,)], "h string")
    apart = page.replace("</li>", "</li> ")
    for reading, shown in ((text_content, apart), (inner_text, page)):
        found = df.select(detect_regex(reading(F.lit(shown))).alias("d")).first()["d"]
        assert {d["type"] for d in found} >= {"email", "ssn"}
    kinds = [(d["type"], d["value"]) for d in found]
    assert ("email", "ann@example.com") in kinds and ("ssn", "123-45-6789") in kinds


def test_long_pages(spark):
    n = 60_000
    pages = [
        "<b>" * n + "x", "<a " + "b='>' " * n + ">x", "<!--" + "-" * n + "x", "<script>" + "<!--" * n + "</script>x",
        "<" * n, "<p>" * n + "x", "<textarea>" + "<" * n, "&lt;" * n, " <br>" * n + "x", "<td>a</td>" * n,
    ]
    for page, (got, shown) in zip(pages, both(spark, pages)):
        assert got == content(page)
        assert len(shown) <= len(page)
