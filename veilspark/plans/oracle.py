"""The registered queries as SQL for another engine, written independently of the plans.

Patterns run in RE2 form.  Sequential rules are recursive queries.
"""

from __future__ import annotations

from html.entities import html5

from ..functions.html import BLOCKS
from ..functions.labels import CONFIDENCE, DEFAULT_CONFIDENCE, ENTITY_TYPES, MASK_LABELS
from ..functions.patterns import PATTERN_NAMES, RE2_SPACE, re2_pattern
from ..operators.lexical import PIECE, TAGS
from .queries import KINDS, PAGE_SITES


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


OPEN, CLOSE = "chr(57344)", "chr(57345)"
MARK = rf"{OPEN} || '\0' || {CLOSE}"
BLANK = q(f"[^{RE2_SPACE}]")


def pad(value: str, width: int, fill: str = "0") -> str:
    return f"lpad(CAST({value} AS VARCHAR), {width}, '{fill}')"


MESSAGE = f"""CASE k % 18
  WHEN 0 THEN 'ssn ' || {pad('k % 900 + 100', 3)} || '-' || {pad('k % 90 + 10', 2)} || '-' || {pad('k', 4)}
  WHEN 1 THEN 'card 4111-' || {pad('k', 4)} || '-2222-3333'
  WHEN 2 THEN 'CVV: ' || {pad('k % 1000', 3)}
  WHEN 3 THEN 'policy number: POL-2024-' || {pad('k', 7)}
  WHEN 4 THEN 'MRN: 12-345-' || {pad('k', 5)}
  WHEN 5 THEN 'VIN: 1HGCM826' || {pad('k', 9)}
  WHEN 6 THEN 'routing number: ' || {pad('k', 9, '1')}
  WHEN 7 THEN 'account no. ' || {pad('k', 12, '7')}
  WHEN 8 THEN 'passport # C' || {pad('k', 8)}
  WHEN 9 THEN 'driver''s license number: D' || {pad('k', 7)}
  WHEN 10 THEN 'mail user' || CAST(k AS VARCHAR) || '@example.com'
  WHEN 11 THEN 'call (206) 555-' || {pad('k', 4)}
  WHEN 12 THEN 'zip ' || {pad('k', 5, '9')}
  WHEN 13 THEN 'ip 10.0.' || CAST(k % 256 AS VARCHAR) || '.7'
  WHEN 14 THEN 'DOB: 01/02/19' || {pad('k % 100', 2)}
  WHEN 15 THEN 'ask Dr. Ann Lee'
  WHEN 16 THEN 'my name is Ann Lee'
  ELSE 'at Acme Widget Corporation' END"""

# name -> (key column, query with columns id and text)
SOURCES = {
    "messages": (
        "k",
        f"SELECT k AS id, scope, {MESSAGE} AS text FROM (SELECT c_custkey AS k, "
        "CAST(c_nationkey AS VARCHAR) AS scope FROM customer)",
    ),
    "letters": (
        "k",
        f"SELECT k AS id, 'Dear Bob Stone, ' || {MESSAGE} AS text FROM (SELECT c_custkey AS k FROM customer)",
    ),
    "documents": ("doc_id", "SELECT doc_id AS id, text FROM documents"),
    "pages": ("page_id", "SELECT page_id AS id, html AS text FROM pages"),
}


def label(kind: str) -> str:
    cases = " ".join(f"WHEN {q(t)} THEN {q(name)}" for t, name in MASK_LABELS.items())
    return f"('[' || CASE {kind} {cases} ELSE 'REDACTED_' || upper({kind}) END || ']')"


def cascade(text: str) -> str:
    for name in PATTERN_NAMES:
        mask = MASK_LABELS.get(name, "REDACTED_" + name.upper())
        text = f"regexp_replace({text}, {q(re2_pattern(name))}, '[{mask}]', 'g')"
    return text


def matches(text: str, name: str) -> str:
    return f"regexp_matches({text}, {q(re2_pattern(name))})"


def any_match(text: str) -> str:
    return "(" + " OR ".join(matches(text, name) for name in PATTERN_NAMES) + ")"


def first_type(text: str) -> str:
    cases = " ".join(f"WHEN {matches(text, n)} THEN {q(n)}" for n in PATTERN_NAMES)
    return f"CASE {cases} END"


def offset_of(parts: str, i: str) -> str:
    """Start of the match in the i-th part of a marked and split text."""
    return (
        f"CAST(list_sum(list_transform({parts}[1:{i} - 1], lambda p: length(p))) - ({i} - 2) AS INTEGER)"
    )


def hits(source: str, names: tuple[str, ...] = PATTERN_NAMES) -> str:
    """CTEs src and det: raw detections, numbered in detection order."""
    marked = " UNION ALL ".join(
        f"SELECT id, {n} AS pat, {q(name)} AS type, string_split(regexp_replace(text, "
        f"{q(re2_pattern(name))}, {MARK}, 'g'), {OPEN}) AS parts FROM src"
        for n, name in enumerate(names)
    )
    return f"""src AS ({source}),
marked AS ({marked}),
part AS (SELECT id, pat, type, parts, unnest(range(2, len(parts) + 1)) AS i FROM marked WHERE len(parts) > 1),
hit AS (SELECT id, pat, type, i, string_split(parts[i], {CLOSE})[1] AS value, {offset_of('parts', 'i')} AS "index" FROM part),
det AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY pat, i) - 1 AS INTEGER) AS ordinal,
  type, value, "index", 'regex' AS source, CAST(1.0 AS DOUBLE) AS confidence FROM hit)"""


# From det to kept: the spans that survive, in order.
RESOLVE = """ranked AS (SELECT *, "index" + length(value) AS stop,
  row_number() OVER (PARTITION BY id ORDER BY "index", ordinal) AS rn FROM det),
walk AS (SELECT id, rn, stop AS reach, TRUE AS keep FROM ranked WHERE rn = 1
  UNION ALL SELECT r.id, r.rn, CASE WHEN r."index" >= w.reach THEN r.stop ELSE w.reach END, r."index" >= w.reach
  FROM walk w JOIN ranked r ON r.id = w.id AND r.rn = w.rn + 1),
kept AS (SELECT r.*, row_number() OVER (PARTITION BY r.id ORDER BY r.rn) - 1 AS kn,
  lag(r.stop, 1, 0) OVER (PARTITION BY r.id ORDER BY r.rn) AS prior
  FROM ranked r JOIN walk w ON w.id = r.id AND w.rn = r.rn WHERE w.keep)"""

MASK = f"""piece AS (SELECT k.id, k.kn, k.stop, substring(s.text, k.prior + 1, k."index" - k.prior) ||
  CASE WHEN substring(s.text, k."index" + 1, length(k.value)) = k.value THEN {label('k.type')}
  ELSE substring(s.text, k."index" + 1, length(k.value)) END AS out FROM kept k JOIN src s ON s.id = k.id),
glued AS (SELECT id, string_agg(out, '' ORDER BY kn) AS head, max(stop) AS stop FROM piece GROUP BY id),
masked AS (SELECT s.id, s.text, CASE WHEN g.id IS NULL THEN s.text
  ELSE g.head || substring(s.text, g.stop + 1) END AS masked FROM src s LEFT JOIN glued g ON g.id = s.id)"""

PREVIEW = """counted AS (SELECT m.*, coalesce(c.n, 0) AS n FROM masked m
  LEFT JOIN (SELECT id, count(*) AS n FROM det GROUP BY id) c ON c.id = m.id),
preview AS (SELECT id, text, masked, CAST(n AS INTEGER) AS n_detected, n > 0 AS has_pii,
  CASE WHEN n > 0 THEN 'PII Detected - Review Before Sending' ELSE 'Ready to Send' END AS title,
  CASE WHEN n = 1 THEN 'Found 1 sensitive item that will be protected'
    WHEN n > 0 THEN 'Found ' || CAST(n AS VARCHAR) || ' sensitive items that will be protected'
    ELSE 'No sensitive information detected - safe to send' END AS subtitle FROM counted)"""


def detection_sql(source: str, names: tuple[str, ...] = PATTERN_NAMES) -> str:
    key, body = SOURCES[source]
    return (
        f"WITH {hits(body, names)} SELECT id AS {key}, ordinal, type, value, \"index\", source, "
        "confidence FROM det"
    )


def resolved_sql(source: str) -> str:
    key, body = SOURCES[source]
    return (
        f"WITH RECURSIVE {hits(body)}, {RESOLVE} SELECT id AS {key}, CAST(kn AS INTEGER) AS no, "
        'type, value, "index", source, confidence FROM kept'
    )


def masked_sql(source: str, select: str) -> str:
    _, body = SOURCES[source]
    return f"WITH RECURSIVE {hits(body)}, {RESOLVE}, {MASK} {select}"


def preview_sql(body: str, select: str) -> str:
    shown = f"SELECT * FROM ({body}) WHERE regexp_matches(text, {BLANK})"
    return f"WITH RECURSIVE {hits(shown)}, {RESOLVE}, {MASK}, {PREVIEW} {select}"


# --- text ----------------------------------------------------------------------------


_WS = r"\t\n\f\r "
_ATTRIBUTES = (
    rf"""(?:[{_WS}/]+|[^{_WS}/>][^{_WS}/>=]*(?:[{_WS}]*=[{_WS}]*(?:"[^"]*(?:"|\z)|'[^']*(?:'|\z)|[^{_WS}>"'][^{_WS}>]*)?)?)*(?:>|\z)"""
)


def _element(name: str, content: str = ".*?") -> str:
    edge = rf"(?:[{_WS}/]{_ATTRIBUTES}|>|\z)"
    return rf"{name}{edge}{content}(?:</{name}{edge}|\z)"


def _markup(rendered: bool) -> str:
    """Everything between visible texts; groups: tag name, a textarea's text, a title's text."""
    hidden = ["script", "style", "iframe", "noembed", "noframes", "noscript"]
    ways = [r"!--(?:-?>|.*?(?:--!?>|\z))", *map(_element, hidden)]
    ways.append(_element("textarea", r"(?:\r?\n)?(.*?)"))
    ways.append(_element("title", ".*?()" if rendered else "(.*?)"))
    ways.append(rf"(/?[a-z][^{_WS}/>]*){_ATTRIBUTES}")
    ways.append(r"(?:[!?][^>]*(?:>|\z)|/(?:>|[^a-z>][^>]*(?:>|\z)))")
    return f"(?is)<(?:{'|'.join(ways)})"


def text_content_sql(html: str) -> str:
    text = f"regexp_replace({html}, {q(_markup(False))}, chr(1) || '\\1\\2', 'g')"
    return f"replace({decoded_sql(text)}, chr(1), '')"


def inner_text_sql(html: str) -> str:
    """For pages without ``pre`` and ``textarea``: marks of breaks, then their runs as lines."""
    marks = "chr(1) || '\\3' || chr(2) || '\\1\\2'"
    text = decoded_sql(f"regexp_replace({html}, {q(_markup(True))}, {marks}, 'g')")
    steps = [
        (r"(?i)\x01/t[dh]\x02[\t\n\f\r ]*\x01t[dh]\x02", "\x06"), (r"(?i)\x01/?p\x02", "\x03"), (r"(?i)\x01br\x02", "\x05"),
        (rf"(?i)\x01/?(?:{'|'.join(BLOCKS)})\x02", "\x04"), (r"\x01[^\x02]*\x02", ""), (r"[\t\n\f\r ]+", " "),
        (r"^(?: ?[\x03\x04])+|(?:[\x03\x04] ?)+$", ""), (r"^ | $", ""), (r" ?([\x05\x06]) ?", r"\1"),
        (r"(?: ?\x04)* ?\x03(?: ?[\x03\x04])* ?", "\n\n"), (r"(?: ?\x04)+ ?", "\n"),
    ]
    for pattern, mark in steps:
        text = f"regexp_replace({text}, {q(pattern)}, {q(mark)}, 'g')"
    return f"replace(replace({text}, chr(5), chr(10)), chr(6), chr(9))"


def decoded_sql(text: str) -> str:
    known = html5
    names = "[" + ", ".join(map(q, known)) + "]"
    chars = "[" + ", ".join(map(q, known.values())) + "]"
    bare = "|".join(sorted((n for n in known if n[-1] != ";"), key=len, reverse=True))
    closed = "regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')"
    opened = f"regexp_extract(p, '^(?:{bare})')"
    number = "regexp_extract(p, '^#([0-9]{1,8});?', 1)"

    def named(name: str) -> str:
        return f"{chars}[list_position({names}, {name})] || substring(p, length({name}) + 1)"

    return f"""array_to_string(list_transform(string_split({text}, '&'), lambda p, i:
  CASE WHEN i = 1 THEN p
    WHEN regexp_matches(p, '^#[0-9]{{1,8}}') THEN chr(CAST({number} AS INTEGER)) || regexp_replace(p, '^#[0-9]+;?', '')
    WHEN NOT regexp_matches(p, '^[A-Za-z]') THEN '&' || p
    ELSE coalesce({named(closed)}, {named(opened)}, '&' || p) END), '')"""


def escape_sql(text: str) -> str:
    for raw, safe in (("'&'", "&amp;"), ("chr(160)", "&nbsp;"), ("'<'", "&lt;"), ("'>'", "&gt;")):
        text = f"replace({text}, {raw}, '{safe}')"
    return text


def origin_sql(url: str, group: int) -> str:
    pattern = r"^([A-Za-z][A-Za-z0-9+.-]*)://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?(?:[/?#]|$)"
    return f"lower(regexp_extract({url}, '{pattern}', {group}))"


SETTINGS = """SELECT CAST(n_nationkey AS VARCHAR) AS scope,
  CASE n_nationkey % 3 WHEN 1 THEN FALSE WHEN 2 THEN TRUE END AS enabled,
  CASE n_nationkey % 4 WHEN 1 THEN 'hybrid' WHEN 2 THEN '' END AS "maskingMode",
  CASE WHEN n_nationkey % 5 = 1 THEN FALSE END AS "useML" FROM nation WHERE n_nationkey < 20"""

# --- entities ------------------------------------------------------------------------

CHUNKS = """chunk AS (SELECT id, CAST(i AS INTEGER) AS chunk_no, CAST(i * 135 AS INTEGER) AS "offset",
  substring(text, i * 135 + 1, 150) AS chunk FROM (SELECT id, text, unnest(
    CASE WHEN length(text) <= 150 THEN [0] ELSE range(0, CAST(ceil(length(text) / 135.0) AS BIGINT)) END) AS i FROM src))"""

_TAG = "CASE n % 5 " + " ".join(f"WHEN {i} THEN {q(t)}" for i, t in enumerate(TAGS)) + " END"

TOKENS = f"""cword AS (SELECT id, chunk_no, "offset", chunk, i, string_split(parts[i], {CLOSE})[1] AS w, {offset_of('parts', 'i')} AS pos0
  FROM (SELECT *, unnest(range(2, len(parts) + 1)) AS i FROM (SELECT *,
    string_split(regexp_replace(chunk, '[A-Z][a-z]+', {MARK}, 'g'), {OPEN}) AS parts FROM chunk))),
piece2 AS (SELECT *, length(w) AS n, CASE WHEN length(w) % 7 = 0 THEN lower(w) ELSE w END AS shown,
  unnest(CASE WHEN length(w) > {PIECE} THEN [0, 1] ELSE [0] END) AS piece FROM cword),
token AS (SELECT id, chunk_no, "offset", chunk,
  CAST(row_number() OVER (PARTITION BY id ORDER BY chunk_no, i, piece) - 1 AS INTEGER) AS token_no,
  CASE piece WHEN 0 THEN substring(shown, 1, {PIECE}) ELSE '##' || substring(shown, {PIECE + 1}) END AS word,
  {_TAG} AS entity, CAST(50 + n * 7 % 50 AS DOUBLE) / 100 AS score,
  CASE WHEN n % 3 = 0 THEN CAST(pos0 + piece * {PIECE} AS INTEGER) END AS tstart,
  CASE WHEN n % 3 = 0 THEN CAST(CASE piece WHEN 0 THEN pos0 + least(n, {PIECE}) ELSE pos0 + n END AS INTEGER) END AS tend
  FROM piece2)"""

LOCATED = """clean AS (SELECT *, regexp_replace(word, '^##', '') AS bare FROM token),
located AS (SELECT id, token_no, word, entity, score,
  CAST(CASE WHEN tstart IS NOT NULL THEN tstart + "offset" WHEN strpos(chunk, bare) > 0 THEN strpos(chunk, bare) - 1 + "offset" END AS INTEGER) AS tstart,
  CAST(CASE WHEN tend IS NOT NULL THEN tend + "offset" WHEN strpos(chunk, bare) > 0 THEN strpos(chunk, bare) - 1 + length(bare) + "offset" END AS INTEGER) AS tend
  FROM clean)"""

WORDS = """grouped AS (SELECT *, sum(CASE WHEN starts_with(word, '##') THEN 0 ELSE 1 END)
  OVER (PARTITION BY id ORDER BY token_no) AS wn FROM located),
word AS (SELECT id, wn, arg_min(word, token_no) AS piece,
  string_agg(CASE WHEN starts_with(word, '##') THEN substring(word, 3) ELSE word END, '' ORDER BY token_no) AS word,
  arg_min(entity, token_no) AS entity, max(score) AS score,
  max(tstart) FILTER (NOT starts_with(word, '##')) AS wstart, max(tend) FILTER (NOT starts_with(word, '##')) AS wend,
  arg_max(tend, token_no) FILTER (starts_with(word, '##') AND tend IS NOT NULL) AS sub_end
  FROM grouped WHERE wn > 0 GROUP BY id, wn)"""

FILL = """fill AS (SELECT id, CAST(0 AS HUGEINT) AS wn, 0 AS last, CAST(NULL AS INTEGER) AS wstart, CAST(NULL AS INTEGER) AS wend FROM src
  UNION ALL SELECT id, wn, coalesce(fend, last), fstart, fend FROM (
    SELECT id, wn, last, CAST(coalesce(wstart, found) AS INTEGER) AS fstart,
      CAST(coalesce(sub_end, CASE WHEN wstart IS NULL THEN found + length(piece) ELSE wend END) AS INTEGER) AS fend FROM (
      SELECT w.*, f.last, CASE WHEN w.wstart IS NULL AND strpos(substring(s.text, f.last + 1), w.piece) > 0
        THEN strpos(substring(s.text, f.last + 1), w.piece) - 1 + f.last END AS found
      FROM fill f JOIN word w ON w.id = f.id AND w.wn = f.wn + 1 JOIN src s ON s.id = w.id))),
placed AS (SELECT w.id, w.wn, w.word, w.entity, w.score, f.wstart, f.wend FROM word w JOIN fill f ON f.id = w.id AND f.wn = w.wn)"""

_TYPE = (
    "CASE entity "
    + " ".join(f"WHEN {q(tag)} THEN {q(kind)}" for tag, kind in ENTITY_TYPES.items())
    + " ELSE lower(regexp_replace(entity, '^[BI]-', '')) END"
)

MERGE = f"""typed AS (SELECT *, {_TYPE} AS type FROM placed),
island AS (SELECT id, CAST(0 AS HUGEINT) AS wn, 0 AS grp, CAST(NULL AS VARCHAR) AS ctype, CAST(NULL AS INTEGER) AS cstart, CAST(NULL AS INTEGER) AS cend FROM src
  UNION ALL SELECT id, wn, CASE WHEN near THEN grp ELSE grp + 1 END, type, CASE WHEN near THEN cstart ELSE wstart END, wend FROM (
    SELECT t.id, t.wn, t.type, t.wstart, t.wend, i.grp, i.cstart,
      coalesce(t.type = i.ctype AND i.cstart IS NOT NULL AND t.wstart - i.cend BETWEEN 0 AND 2
        AND regexp_matches(substring(s.text, least(i.cstart, t.wend) + 1, abs(t.wend - i.cstart)), {BLANK}), FALSE) AS near
    FROM island i JOIN typed t ON t.id = i.id AND t.wn = i.wn + 1 JOIN src s ON s.id = t.id)),
entity0 AS (SELECT t.id, i.grp, arg_min(t.entity, t.wn) AS entity, any_value(t.type) AS type, count(*) AS words,
  arg_min(t.word, t.wn) AS word, min(t.score) AS score, min(i.cstart) AS estart, arg_max(t.wend, t.wn) AS eend
  FROM typed t JOIN island i ON i.id = t.id AND i.wn = t.wn WHERE i.cstart IS NOT NULL GROUP BY t.id, i.grp),
entity AS (SELECT e.id, e.grp, e.entity, e.type, CASE WHEN words > 1
  THEN substring(s.text, least(estart, eend) + 1, abs(eend - estart)) ELSE word END AS word, score, estart, eend
  FROM entity0 e JOIN src s ON s.id = e.id)"""


def plain(kind: str) -> str:
    return f"regexp_replace(lower({kind}), '^[bi]-', '')"


def threshold(kind: str, gate: int) -> str:
    cases = " ".join(f"WHEN {q(t)} THEN CAST({v[gate]} AS DOUBLE)" for t, v in CONFIDENCE.items())
    return f"CASE {plain(kind)} {cases} ELSE CAST({DEFAULT_CONFIDENCE[gate]} AS DOUBLE) END"


_DIGITS = "length(regexp_replace(word, '[^0-9]', '', 'g'))"
VALID = {
    "valid_length": "length(word) >= 2",
    "valid_charmix": "NOT (regexp_matches(word, '[a-zA-Z]') AND regexp_matches(word, '[0-9]') AND NOT contains(word, '@') "
    "AND NOT contains(word, '.')) OR kind IN ('username', 'pass', 'driverlicense')",
    "valid_ip": r"kind <> 'ip' OR regexp_matches(word, '^[0-9]+\.[0-9]+')",
    "valid_email": "kind <> 'email' OR contains(word, '@') OR contains(word, '.')",
    "valid_phone": f"kind <> 'tel' OR ({_DIGITS} BETWEEN 7 AND 15 AND NOT starts_with(word, '-') AND NOT ends_with(word, '-'))",
    "valid_date": f"kind NOT IN ('bod', 'date') OR ({_DIGITS} >= 4 AND NOT ends_with(word, '-') AND NOT ends_with(word, '/') "
    f"AND (contains(word, '/') OR contains(word, '-') OR {_DIGITS} >= 6))",
    "valid_address": "kind NOT IN ('street', 'building', 'secaddress') OR (length(word) >= 3 AND NOT "
    "(regexp_full_match(word, '[0-9]+') AND length(word) < 5))",
    "valid_ssn": "kind <> 'socialnumber' OR length(word) >= 9",
}
ALL_VALID = " AND ".join(f"({rule})" for rule in VALID.values())


def trimmed(text: str) -> str:
    return f"regexp_replace({text}, {q(f'^[{RE2_SPACE}]+|[{RE2_SPACE}]+$')}, '', 'g')"


FOUND = f"""ml AS (SELECT e.id, e.grp, e.type, e.word AS value, e.score, e.estart, e.eend FROM entity e
  JOIN (SELECT id, grp, {trimmed('lower(word)')} AS word, {plain('type')} AS kind FROM entity) v ON v.id = e.id AND v.grp = e.grp
  WHERE e.score > {threshold('e.type', 0)} AND {ALL_VALID.replace('word', 'v.word').replace('kind', 'v.kind')})"""

HYBRID = f"""free AS (SELECT m.*, row_number() OVER (PARTITION BY m.id ORDER BY m.grp) AS cn FROM ml m
  WHERE m.score >= {threshold('m.type', 1)} AND NOT EXISTS (SELECT 1 FROM det d WHERE d.id = m.id
    AND d."index" < m.eend AND d."index" + length(d.value) > m.estart)),
chosen AS (SELECT id, CAST(0 AS BIGINT) AS cn, CAST([] AS STRUCT(s INTEGER, e INTEGER)[]) AS taken, FALSE AS keep FROM src
  UNION ALL SELECT id, cn, CASE WHEN clear THEN list_append(taken, {{'s': estart, 'e': CAST(estart + length(value) AS INTEGER)}}) ELSE taken END, clear FROM (
    SELECT f.*, c.taken, len(list_filter(c.taken, lambda t: t.s < f.eend AND f.estart < t.e)) = 0 AS clear
    FROM chosen c JOIN free f ON f.id = c.id AND f.cn = c.cn + 1)),
regex_det AS (SELECT * FROM det),
combined AS (SELECT id, type, value, "index", source, confidence, 0 AS part, ordinal AS no FROM regex_det
  UNION ALL SELECT f.id, f.type, f.value, f.estart, 'ml', f.score, 1, CAST(f.cn AS INTEGER) FROM free f
  JOIN chosen c ON c.id = f.id AND c.cn = f.cn WHERE c.keep),
det2 AS (SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY part, no) - 1 AS INTEGER) AS ordinal,
  type, value, "index", source, confidence FROM combined)"""


# Words that stand where they are said to, and entities as gaps and islands of them.
ISLANDS = f"""there AS (SELECT p.*, {_TYPE} AS type FROM placed p JOIN src s ON s.id = p.id
  WHERE wstart < wend AND lower(substring(s.text, wstart + 1, wend - wstart)) = lower(p.word)),
opened AS (SELECT *, CASE WHEN type = lag(type) OVER w AND wstart - lag(wend) OVER w BETWEEN 0 AND 2 THEN 0 ELSE 1 END AS o
  FROM there WINDOW w AS (PARTITION BY id ORDER BY wn)),
island AS (SELECT *, sum(o) OVER (PARTITION BY id ORDER BY wn) AS grp FROM opened),
entity AS (SELECT i.id, grp, arg_min(entity, wn) AS entity, any_value(type) AS type, min(score) AS score, min(wstart) AS estart,
  max(wend) AS eend, CASE WHEN count(*) = 1 THEN any_value(word) ELSE substring(any_value(s.text), min(wstart) + 1, max(wend) - min(wstart)) END AS word
  FROM island i JOIN src s ON s.id = i.id GROUP BY i.id, grp)"""
_ROW_ENTITY = (
    "SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY grp) - 1 AS INTEGER) AS "
    'entity_no, entity, type, word, score, estart AS "start", eend AS "end" FROM entity'
)


def entity_sql(upto: tuple[str, ...], select: str) -> str:
    body = SOURCES["documents"][1]
    return f"WITH RECURSIVE src AS ({body}), {', '.join(upto)} {select}"


TO_WORDS = (CHUNKS, TOKENS, LOCATED, WORDS)
TO_ENTITIES = (*TO_WORDS, FILL, MERGE)
_ENTITY = (
    "SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY grp) - 1 AS INTEGER) AS "
    'entity_no, entity, type, word, score, estart AS "start", eend AS "end" FROM entity'
)
_ML = (
    "CAST(row_number() OVER (PARTITION BY id ORDER BY grp) - 1 AS INTEGER) AS {no}, type, {word} AS value, "
    'score, estart AS "start", eend AS "end", \'ml\' AS source, score AS confidence'
)


def hybrid_sql(source: str, select: str, mask: bool) -> str:
    body = SOURCES[source][1]
    steps = [hits(body), *TO_ENTITIES, FOUND, HYBRID]
    if mask:
        steps += [RESOLVE.replace("FROM det)", "FROM det2)"), MASK]
    return f"WITH RECURSIVE {', '.join(steps)} {select}"


# --- mappings ------------------------------------------------------------------------


def cascade_mapping_sql() -> str:
    """Each pattern's matches in the text the former patterns left."""
    _, body = SOURCES["messages"]
    steps, current = [f"src AS ({body})"], "text"
    for n, name in enumerate(PATTERN_NAMES):
        steps.append(
            f"m{n} AS (SELECT scope, id, {n} AS pat, unnest(regexp_extract_all({current}, {q(re2_pattern(name))})) "
            f"AS value, {label(q(name))} AS mask, generate_subscripts(regexp_extract_all({current}, {q(re2_pattern(name))}), 1) AS i FROM src)"
        )
        mask = MASK_LABELS.get(name, "REDACTED_" + name.upper())
        current = f"regexp_replace({current}, {q(re2_pattern(name))}, '[{mask}]', 'g')"
    union = " UNION ALL ".join(f"SELECT * FROM m{n}" for n in range(len(PATTERN_NAMES)))
    return (
        f"WITH {', '.join(steps)} SELECT scope, mask, arg_max(value, row(id, pat, i)) AS value "
        f"FROM ({union}) GROUP BY scope, mask"
    )


SPAN_MAPPINGS = masked_sql(
    "messages",
    f"SELECT scope, mask, arg_max(value, row(id, -rn)) AS value FROM (SELECT s.scope, {label('k.type')} AS mask, "
    "k.value, k.id, k.rn FROM kept k JOIN src s ON s.id = k.id) GROUP BY scope, mask",
)


# The settings of a message's half: of odd keys, even nations have been changed.
_HALVES = (
    "SELECT s.*, s.id % 2 + 1 AS half, CASE WHEN s.id % 2 = 1 AND CAST(s.scope AS INTEGER) % 2 = 0 "
    "THEN CAST(s.scope AS INTEGER) % 4 = 0 ELSE coalesce(c.enabled, TRUE) END AS enabled "
    f"FROM src s LEFT JOIN ({SETTINGS}) c ON c.scope = s.scope"
)


def settled_sql() -> dict[str, str]:
    return {
        "mask_settled_messages": masked_sql(
            "messages",
            "SELECT h.id AS k, h.half AS settings_version, h.enabled, CASE WHEN h.enabled THEN m.masked ELSE h.text END AS masked "
            f"FROM ({_HALVES}) h JOIN masked m ON m.id = h.id",
        ),
        "alert_settled_messages": f"WITH src AS ({SOURCES['messages'][1]}) SELECT id AS k, half AS settings_version "
        f"FROM ({_HALVES}) WHERE enabled AND {any_match('text')}",
        "flush_settled_messages": masked_sql(
            "messages",
            f"SELECT scope, mask, arg_max(value, row(half, id, -rn)) AS value FROM (SELECT h.scope, {label('k.type')} AS mask, "
            f"k.value, h.half, k.id, k.rn FROM kept k JOIN ({_HALVES}) h ON h.id = k.id WHERE h.enabled) GROUP BY scope, mask",
        ),
    }


SENT = preview_sql(
    SOURCES["messages"][1],
    "SELECT id AS k, choice, CASE WHEN choice = 'protected' THEN masked ELSE text END AS sent FROM "
    "(SELECT *, CASE id % 4 WHEN 0 THEN 'protected' WHEN 1 THEN 'original' END AS choice FROM preview) WHERE choice IS NOT NULL",
)


def settings_log_sql() -> str:
    """Versions 1 and 3 as they were, and changes 2 and 4 with the mode before them."""
    log = f"""SELECT scope, enabled, "maskingMode", "useML", 1 AS version FROM ({SETTINGS})
  UNION ALL SELECT scope, enabled, 'mode' || scope, "useML", 3 FROM ({SETTINGS})"""
    change = """SELECT CAST(n_nationkey AS VARCHAR) AS scope, n_nationkey % 4 = 0 AS enabled, v AS version
  FROM nation, (VALUES (2), (4)) t(v) WHERE n_nationkey % 2 = 0"""
    return f"""WITH log AS ({log}), change AS ({change}) SELECT * FROM log UNION ALL
SELECT c.scope, c.enabled, (SELECT arg_max(row(l."maskingMode"), l.version)[1] FROM log l
  WHERE l.scope = c.scope AND l.version <= c.version), TRUE, c.version FROM change c"""


def mask_settings_sql() -> str:
    """Nothing masked, patterns only or patterns and entities, as each letter's scope has it."""
    both = hybrid_sql("letters", "SELECT id AS k, masked FROM masked", mask=True)
    patterns = masked_sql("letters", "SELECT id AS k, masked FROM masked")
    return f"""SELECT l.id AS k, coalesce(c.enabled, TRUE) AS enabled, coalesce(c."useML", TRUE) AS "useML",
  CAST(0 AS INTEGER) AS ml_errors,
  CASE WHEN NOT coalesce(c.enabled, TRUE) THEN l.text WHEN coalesce(c."useML", TRUE) THEN b.masked ELSE p.masked END AS masked
  FROM ({SOURCES['letters'][1]}) l JOIN customer u ON u.c_custkey = l.id
  JOIN ({both}) b ON b.k = l.id JOIN ({patterns}) p ON p.k = l.id
  LEFT JOIN ({SETTINGS}) c ON c.scope = CAST(u.c_nationkey AS VARCHAR)"""


def tag_errors_sql() -> str:
    """Masked documents where the chunks with a q have no tokens, and how many those are."""
    tokens = TOKENS.replace("FROM chunk)))", "FROM chunk WHERE NOT contains(chunk, 'q'))))", 1)
    steps = [hits(SOURCES["documents"][1]), CHUNKS, tokens, *TO_ENTITIES[2:], FOUND, HYBRID]
    steps += [RESOLVE.replace("FROM det)", "FROM det2)"), MASK]
    failed = "SELECT id, count(*) AS n FROM chunk WHERE contains(chunk, 'q') GROUP BY id"
    return (
        f"WITH RECURSIVE {', '.join(steps)} SELECT m.id AS doc_id, CAST(coalesce(f.n, 0) AS INTEGER) AS ml_errors, "
        f"m.masked FROM masked m LEFT JOIN ({failed}) f ON f.id = m.id"
    )


def tag_metrics_sql() -> str:
    tokens = TOKENS.replace("FROM chunk)))", "FROM chunk WHERE NOT contains(chunk, 'q'))))", 1)
    failed = "(SELECT count(*) FROM chunk WHERE contains(chunk, 'q'))"
    return (
        f"WITH RECURSIVE src AS ({SOURCES['documents'][1]}), {CHUNKS}, {tokens} SELECT (SELECT count(*) FROM src) AS texts, "
        f"(SELECT count(*) FROM chunk) AS chunks, (SELECT count(*) FROM token) AS tokens, {failed} AS failed, "
        f'{failed} AS "failed_ValueError", CAST(0 AS BIGINT) AS "failed_TypeError", CAST(0 AS BIGINT) AS failed_other'
    )


def utf16_sql() -> str:
    """Spans over the messages with fillers behind characters of two units."""
    smile, script, filler = "chr(128512)", "chr(119987)", "chr(65535)"
    around = f"repeat({smile} || {filler}, CAST(id % 4 AS INTEGER)) || {script} || {filler} || ' ' || text || ' ' || {smile} || {filler}"
    body = f"SELECT id, {around} AS text FROM ({SOURCES['messages'][1]})"
    return (
        f"WITH RECURSIVE {hits(body)}, {RESOLVE}, {MASK} SELECT m.id AS k, replace(m.masked, {filler}, '') AS masked, "
        "coalesce(p.places, '') AS places FROM masked m LEFT JOIN (SELECT id, string_agg(CAST(\"index\" AS VARCHAR), ',' "
        "ORDER BY ordinal) AS places FROM det GROUP BY id) p ON p.id = m.id"
    )


def oracle() -> dict[str, str]:
    documents, pages = SOURCES["documents"][1], SOURCES["pages"][1]
    text_pages = f"SELECT page_id AS id, {text_content_sql('html')} AS text FROM pages"
    mask_documents = masked_sql("documents", "SELECT id AS doc_id, masked FROM masked")
    sites = ", ".join(f"({q(scheme)}, {q(host)})" for scheme, host in PAGE_SITES)
    previews = 'text, masked, n_detected, has_pii, title, subtitle FROM preview'
    kinds = "[" + ", ".join(q(kind) for kind in KINDS) + "]"
    found = {
        f"detect_{name}_messages": detection_sql("messages", (name,)) for name in PATTERN_NAMES
    }
    found |= {
        "detect_regex_messages": detection_sql("messages"),
        "detect_regex_documents": detection_sql("documents"),
        "detect_regex_pages": detection_sql("pages"),
        "detect_regex_page_text": f"WITH {hits(text_pages)} SELECT id AS page_id, ordinal, type, value, "
        '"index", source, confidence FROM det',
        "flag_pii_documents": f"SELECT doc_id, {first_type('text')} AS first_type, {any_match('text')} AS has_pii FROM documents",
        "flag_pii_messages": f"SELECT id AS k, {first_type('text')} AS first_type, {any_match('text')} AS has_pii "
        f"FROM ({SOURCES['messages'][1]})",
        "only_pii_documents": f"SELECT doc_id, text FROM documents WHERE {any_match('text')}",
        "count_pii_documents": f"WITH {hits(documents)} SELECT type, count(*) AS hits FROM det GROUP BY type",
        "count_pii_messages": f"WITH {hits(SOURCES['messages'][1])} SELECT type, count(*) AS hits FROM det GROUP BY type",
        "count_detections_documents": f"WITH {hits(documents)} SELECT s.id AS doc_id, CAST(count(d.id) AS INTEGER) AS n_detected "
        "FROM src s LEFT JOIN det d ON d.id = s.id GROUP BY s.id",
        "resolve_overlaps_messages": resolved_sql("messages"),
        "resolve_overlaps_documents": resolved_sql("documents"),
        "mask_spans_messages": masked_sql("messages", "SELECT id AS k, masked FROM masked"),
        "mask_spans_documents": mask_documents,
        "mask_cascade_messages": f"SELECT id AS k, {cascade('text')} AS text FROM ({SOURCES['messages'][1]})",
        "mask_cascade_documents": f"SELECT doc_id, {cascade('text')} AS text FROM documents",
        "mask_columns_pages": f"SELECT page_id, {cascade('url')} AS url, {cascade('html')} AS html FROM pages",
        "mask_changed_documents": f"SELECT doc_id, masked FROM (SELECT doc_id, text, {cascade('text')} AS masked FROM documents) "
        "WHERE masked <> text",
        "mask_label_messages": f"WITH {hits(SOURCES['messages'][1])} SELECT type, {label('type')} AS mask, count(*) AS hits "
        "FROM det GROUP BY type",
        "inner_text_pages": f"SELECT page_id, {inner_text_sql('html')} AS text FROM pages",
        "text_content_pages": f"SELECT page_id, {text_content_sql('html')} AS text FROM pages",
        "escape_html_pages": f"SELECT page_id, {escape_sql('html')} AS safe FROM pages",
        "field_text_customer": "SELECT c_custkey AS k, coalesce(nullif(CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN c_name END, ''), "
        "nullif(CASE WHEN c_custkey % 2 = 0 THEN '' ELSE c_mktsegment END, ''), 'inner') AS text FROM customer",
        "nonblank_document_lines": "SELECT doc_id, count(*) AS lines, CAST(sum(length("
        + trimmed("line")
        + f")) AS BIGINT) AS chars FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) "
        f"WHERE regexp_matches(line, {BLANK}) GROUP BY doc_id",
        "preview_messages": preview_sql(SOURCES["messages"][1], f"SELECT id AS k, {previews}"),
        "preview_documents": preview_sql(documents, f"SELECT id AS doc_id, {previews}"),
        "preview_conversations": preview_sql(
            "SELECT row(conv_id, turn, role) AS id, text FROM conversations",
            f"SELECT id[1] AS conv_id, id[2] AS turn, id[3] AS role, {previews}",
        ),
        "preview_html_messages": preview_sql(
            SOURCES["messages"][1],
            f"SELECT id AS k, {escape_sql('text')} AS original_html, "
            f"CASE WHEN has_pii THEN {escape_sql('masked')} END AS masked_html FROM preview",
        ),
        "resolve_decisions_messages": SENT,
        "send_decided_messages": SENT,
        "site_filter_pages": f"SELECT page_id, url FROM pages WHERE ({origin_sql('url', 1)}, {origin_sql('url', 2)}) IN ({sites})",
        "site_table_pages": f"SELECT page_id, url FROM pages WHERE {origin_sql('url', 1)} = 'https' AND {origin_sql('url', 2)} IN "
        f"(SELECT {origin_sql('url', 2)} FROM pages WHERE contains(url, '?page='))",
        "apply_settings_messages": masked_sql(
            "messages",
            "SELECT m.id AS k, s.scope, coalesce(c.enabled, TRUE) AS enabled, coalesce(nullif(c.\"maskingMode\", ''), 'regex') "
            'AS "maskingMode", coalesce(c."useML", TRUE) AS "useML", CASE WHEN coalesce(c.enabled, TRUE) THEN m.masked '
            f"ELSE m.text END AS masked FROM masked m JOIN src s ON s.id = m.id LEFT JOIN ({SETTINGS}) c ON c.scope = s.scope",
        ),
        "update_settings_nation": f"SELECT coalesce(a.scope, b.scope) AS scope, CASE WHEN b.scope IS NULL THEN a.enabled ELSE b.enabled END AS enabled, "
        f'a."maskingMode", CASE WHEN b.scope IS NULL THEN a."useML" ELSE TRUE END AS "useML" FROM ({SETTINGS}) a FULL JOIN '
        "(SELECT CAST(n_nationkey AS VARCHAR) AS scope, n_nationkey % 4 = 0 AS enabled FROM nation WHERE n_nationkey % 2 = 0) b ON a.scope = b.scope",
        "settings_log_nation": settings_log_sql(),
        "mask_settings_letters": mask_settings_sql(),
        "tag_errors_documents": tag_errors_sql(),
        "chunk_text_documents": entity_sql((CHUNKS,), 'SELECT id AS doc_id, chunk_no, "offset", chunk AS text FROM chunk'),
        "tag_tokens_documents": entity_sql(
            (CHUNKS, TOKENS),
            'SELECT id AS doc_id, token_no, word, entity, score, tstart AS "start", tend AS "end" FROM token',
        ),
        "locate_tokens_documents": entity_sql(
            (CHUNKS, TOKENS, LOCATED),
            'SELECT id AS doc_id, token_no, word, entity, score, tstart AS "start", tend AS "end" FROM located',
        ),
        "join_subwords_documents": entity_sql(
            TO_WORDS,
            'SELECT id AS doc_id, CAST(wn - 1 AS INTEGER) AS word_no, word, entity, score, wstart AS "start", wend AS "end", sub_end FROM word',
        ),
        "fill_positions_documents": entity_sql(
            (*TO_WORDS, FILL),
            'SELECT id AS doc_id, CAST(wn - 1 AS INTEGER) AS word_no, word, wstart AS "start", wend AS "end" FROM placed',
        ),
        "map_entity_documents": entity_sql(
            (CHUNKS, TOKENS), f"SELECT entity, {_TYPE} AS type, count(*) AS tokens FROM token GROUP BY entity"
        ),
        "merge_entities_documents": entity_sql(TO_ENTITIES, _ENTITY),
        "filter_confidence_documents": entity_sql(TO_ENTITIES, f"{_ENTITY} WHERE score > {threshold('type', 0)}"),
        "filter_confidence_hybrid_documents": entity_sql(
            TO_ENTITIES,
            f"SELECT id AS doc_id, {_ML.format(no='entity_no', word='word')} FROM (SELECT * REPLACE (score / 2 AS score) FROM entity) "
            f"WHERE score >= {threshold('type', 1)}",
        ),
        "filter_valid_documents": entity_sql(
            (
                *TO_ENTITIES,
                f"retyped AS (SELECT * REPLACE ({kinds}[length(word) % {len(KINDS)} + 1] AS type) FROM entity)",
                f"shaped AS (SELECT e.*, {trimmed('lower(e.word)')} AS lw, {plain('e.type')} AS kind FROM retyped e)",
            ),
            f"{_ENTITY.replace('FROM entity', 'FROM shaped')} WHERE {ALL_VALID.replace('word', 'lw')}",
        ),
        "validity_rules_messages": f"WITH {hits(SOURCES['messages'][1])}, words AS (SELECT id AS k, lower(string_split(text, ' ')[-1]) AS word FROM src "
        f"UNION ALL SELECT id, lower(value) FROM det), kinded AS (SELECT k, word, {kinds}[k % {len(KINDS)} + 1] AS kind FROM words) "
        "SELECT k, word, kind, " + ", ".join(f"({rule}) AS {name}" for name, rule in VALID.items()) + f", ({ALL_VALID}) AS valid FROM kinded",
        "detect_ml_documents": entity_sql((*TO_ENTITIES, FOUND), f"SELECT id AS doc_id, {_ML.format(no='no', word='value')} FROM ml"),
        "without_overlaps_letters": f"WITH RECURSIVE {', '.join([hits(SOURCES['letters'][1]), *TO_ENTITIES, FOUND])}, numbered AS "
        f"(SELECT id AS k, {_ML.format(no='no', word='value')} FROM ml) SELECT * FROM numbered n WHERE NOT EXISTS "
        '(SELECT 1 FROM det d WHERE d.id = n.k AND d."index" < n."end" AND n."start" < d."index" + length(d.value))',
        **{
            f"detect_hybrid_{source}": hybrid_sql(
                source,
                f'SELECT id AS {SOURCES[source][0]}, ordinal, type, value, "index", source, confidence FROM det2',
                mask=False,
            )
            for source in ("documents", "letters")
        },
        **{
            f"mask_hybrid_{source}": hybrid_sql(
                source, f"SELECT id AS {SOURCES[source][0]}, masked FROM masked", mask=True
            )
            for source in ("documents", "letters")
        },
        "latest_mappings_cascade_messages": cascade_mapping_sql(),
        "latest_mappings_spans_messages": SPAN_MAPPINGS,
        "mapping_store_messages": SPAN_MAPPINGS,
        "mapping_log_messages": SPAN_MAPPINGS,
        "write_masked_documents": masked_sql("documents", "SELECT id AS doc_id, masked AS text FROM masked"),
        "mask_stream_documents": mask_documents,
        "alert_stream_documents": f"SELECT doc_id FROM documents WHERE {any_match('text')}",
        "flush_mappings_messages": SPAN_MAPPINGS,
        "flush_forgetting_messages": SPAN_MAPPINGS,
        **settled_sql(),
        "mask_utf16_messages": utf16_sql(),
        "tag_metrics_documents": tag_metrics_sql(),
    }
    # the same over rows
    found["token_rows_documents"] = found["locate_tokens_documents"]
    found["join_subword_rows_documents"] = found["join_subwords_documents"]
    found["merge_entity_rows_documents"] = entity_sql((*TO_WORDS, FILL, ISLANDS), _ROW_ENTITY)
    found["mask_by_chunk_documents"] = found["tag_errors_documents"]
    return found
