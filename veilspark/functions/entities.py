"""The entity pipeline, from chunks of text to detections.

Tokens, words and entities of a text live in arrays beside it, so the pipeline needs no
shuffle and no join on a document key: repeated or skewed keys cost nothing.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schema import CHUNK, DETECTION, ENTITY, ML_DETECTION, TOKEN, WORD
from .arrays import cut, empty, fold_emit, let, outcome, text_blocks
from .labels import map_entity, min_confidence
from .resolve import overlaps, span_end
from .text import is_blank, trim_word
from .validity import is_valid

CHUNK_SIZE = 150
CHUNK_OVERLAP = 15


def chunk_text(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Overlapping chunks: one if the text fits, else one every ``size - overlap`` characters."""
    step = size - overlap
    if step <= 0 or overlap < 0:
        raise ValueError("overlap must be at least 0 and smaller than size")
    # each match moves on by one step, while the group in the look-ahead takes a whole chunk
    pieces = F.regexp_extract_all(
        text, F.lit("(?s)(?=(.{1,%d})).{1,%d}" % (size, step)), F.lit(1)
    )
    chunks = F.transform(
        F.when(F.length(text) <= size, F.array(text)).otherwise(pieces),
        lambda piece, i: F.struct(
            i.alias("chunk_no"), (i * step).alias("offset"), piece.alias("text")
        ),
    )
    return F.coalesce(chunks, empty(CHUNK))


def locate_token(token: Column, chunk: Column) -> Column:
    """Token with offsets in the text: its own, or its first occurrence in the chunk, or none."""
    known = token["start"].isNotNull() & token["end"].isNotNull()
    bare = token["word"]
    for mark in ("##", "▁", "▁##"):
        rest = F.substring(token["word"], len(mark) + 1, 1 << 30)
        bare = F.when(token["word"].startswith(mark), rest).otherwise(bare)

    def placed(start: Column, end: Column) -> Column:
        return F.struct(
            token["word"].alias("word"),
            token["entity"].alias("entity"),
            token["score"].alias("score"),
            (start + chunk["offset"]).alias("start"),
            (end + chunk["offset"]).alias("end"),
        )

    def search(word: Column) -> Column:
        # sought once: every use of an expression evaluates it anew
        at = F.when(F.length(word) > 0, F.position(word, chunk["text"]) - 1)

        def build(found: Column) -> Column:
            return placed(F.when(found >= 0, found), F.when(found >= 0, found + F.length(word)))

        return let(at, build)

    return F.when(known, placed(token["start"], token["end"])).otherwise(let(trim_word(bare), search))


def locate_tokens(chunks: Column, tagged: Column) -> Column:
    """All tokens of a text, in order, located.  ``tagged`` holds the tokens of each chunk."""
    return F.flatten(
        F.zip_with(
            chunks,
            tagged,
            lambda c, t: F.coalesce(
                F.transform(t["tokens"], lambda token: locate_token(token, c)), empty(TOKEN)
            ),
        )
    )


def join_subwords(tokens: Column) -> Column:
    """Words: a token and the ``##`` pieces behind it; pieces before the first word are dropped."""

    def single(parts: Column) -> Column:
        token = parts[0]
        return F.struct(
            token["word"].alias("piece"),
            F.coalesce(token["word"], F.lit("")).alias("word"),
            token["entity"].alias("entity"),
            token["score"].alias("score"),
            token["start"].alias("start"),
            token["end"].alias("end"),
            F.lit(None).cast("int").alias("sub_end"),
        )

    def several(parts: Column) -> Column:
        head = parts[0]
        pieces = F.transform(
            parts, lambda p, i: F.when(i == 0, p["word"]).otherwise(F.substring(p["word"], 3, 1 << 30))
        )
        ends = F.filter(
            F.transform(F.slice(parts, 2, F.size(parts)), lambda p: p["end"]),
            lambda e: e.isNotNull(),
        )
        return F.struct(
            head["word"].alias("piece"),
            F.array_join(pieces, "").alias("word"),
            head["entity"].alias("entity"),
            F.array_max(F.transform(parts, lambda p: p["score"])).alias("score"),
            head["start"].alias("start"),
            head["end"].alias("end"),
            F.try_element_at(ends, F.lit(-1)).alias("sub_end"),
        )

    def word(parts: Column) -> Column:
        return F.when(F.size(parts) == 1, single(parts)).otherwise(several(parts))

    def build(toks: Column) -> Column:
        heads = F.filter(
            F.transform(
                toks, lambda t, i: F.when(~t["word"].startswith("##"), i + 1)
            ),
            lambda i: i.isNotNull(),
        )
        return let(
            heads,
            lambda at: F.transform(
                at,
                lambda first, k: let(
                    F.slice(
                        toks,
                        first,
                        F.coalesce(F.try_element_at(at, k + 2), F.size(toks) + 1) - first,
                    ),
                    word,
                ),
            ),
        )

    return let(tokens, build)


def fill_positions(words: Column, text: Column) -> Column:
    """Search words without a start in the text, each behind the word before it."""

    def placed(word: Column, found: Column) -> Column:
        return F.struct(
            word["piece"].alias("piece"),
            word["word"].alias("word"),
            word["entity"].alias("entity"),
            word["score"].alias("score"),
            F.coalesce(word["start"], found).alias("start"),
            F.coalesce(word["sub_end"], found + F.length(word["piece"]), word["end"]).alias("end"),
            word["sub_end"].alias("sub_end"),
        )

    def search(t: Column, bound: Column) -> Column:
        """Per word where it is found, null if it has a start; the words themselves stay aside."""

        def step(last: Column, word: Column) -> Column:
            piece = word["piece"]
            # contains rules a word out much faster than position, which most often finds none
            at = (
                F.when(piece == "", F.least(last, F.length(t)) + 1)
                .when(t.contains(piece), F.position(piece, t, last + 1))
                .otherwise(F.lit(0))
            )

            def place(found: Column) -> Column:
                end = F.coalesce(word["sub_end"], found + F.length(piece), word["end"])
                return outcome(F.coalesce(end, last), F.array(found))

            found = F.when(word["start"].isNull(), let(at, lambda a: F.when(a > 0, a - 1)))
            return let(found, place)

        return fold_emit(bound, F.lit(0), step, T.IntegerType())

    def build(bound: Column) -> Column:
        missing = F.exists(bound, lambda w: w["start"].isNull())
        as_is = F.transform(bound, lambda w: placed(w, F.lit(None).cast("int")))
        searched = F.zip_with(bound, let(text, lambda t: search(t, bound)), placed)
        return F.when(missing, searched).otherwise(as_is)

    return let(words, build)


def _nothing(schema: T.StructType) -> Column:
    return F.struct(*[F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


# An entity as ``merge_entities`` finds it: its first word, how many, and their place.
_MERGED = T.StructType([
    T.StructField("first", T.IntegerType()),
    T.StructField("n", T.IntegerType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()),
])


def merge_entities(words: Column, text: Column) -> Column:
    """Merge neighbouring words of one type, at most two characters apart, into entities.

    The text of a merged entity is cut from the source and its score is the lowest one.
    """

    def build(bound: Column, blocks: Column) -> Column:
        def source(start: Column, end: Column) -> Column:
            low = F.least(start, end)
            return cut(blocks, low, F.greatest(start, end) - low)

        def shown(found: Column) -> Column:
            """The text of an entity, which is only cut when the entity is complete."""
            single = F.when(found["n"] == 1, bound[found["first"]]["word"])
            return F.coalesce(single, source(found["start"], found["end"]))

        # the fold carries numbers and the type: state and output are copied at every step
        def opened(at: Column, word: Column) -> Column:
            return F.struct(
                (at + 1).alias("at"),
                at.alias("first"),
                F.lit(1).alias("n"),
                map_entity(word["entity"]).alias("type"),
                word["score"].alias("score"),
                word["start"].alias("start"),
                word["end"].alias("end"),
            )

        def step(current: Column, word: Column) -> Column:
            at = current["at"]
            gap = word["start"] - current["end"]
            # what the word adds is nearly always visible; only if not, look at the whole
            grows = (word["end"] > current["end"]) & (current["end"] >= current["start"])
            added = F.when(grows, source(current["end"], word["end"]))
            visible = F.when(~is_blank(added), F.lit(True)).otherwise(
                ~is_blank(source(current["start"], word["end"]))
            )

            near = gap.between(0, 2) & current["start"].isNotNull()
            near = near & (map_entity(word["entity"]) == current["type"])

            def decide(fits: Column) -> Column:
                joined = F.struct(
                    (at + 1).alias("at"),
                    current["first"].alias("first"),
                    (current["n"] + 1).alias("n"),
                    current["type"].alias("type"),
                    F.least(current["score"], word["score"]).alias("score"),
                    current["start"].alias("start"),
                    word["end"].alias("end"),
                )
                # only the entity closed by the end of the text must have a visible word
                last = at == F.size(bound)
                kept = F.array(F.struct(*[current[f.name].alias(f.name) for f in _MERGED]))
                out = F.when(
                    ~fits & current["start"].isNotNull(),
                    F.when(last & is_blank(shown(current)), empty(_MERGED)).otherwise(kept),
                ).otherwise(empty(_MERGED))
                return outcome(F.when(fits, joined).otherwise(opened(at, word)), out)

            return let(F.when(near, visible).otherwise(F.lit(False)), decide)

        def entity(found: Column) -> Column:
            tag = bound[found["first"]]["entity"]
            return F.struct(
                tag.alias("entity"),
                map_entity(tag).alias("type"),
                shown(found).alias("word"),
                found["score"].alias("score"),
                found["start"].alias("start"),
                found["end"].alias("end"),
            )

        # a last, empty item closes the entity that is still open
        items = F.concat(bound, F.array(_nothing(WORD)))
        found = fold_emit(items, opened(F.lit(-1), _nothing(WORD)), step, _MERGED)
        return F.transform(found, entity)

    return let(words, lambda w: let(text_blocks(text), lambda b: build(w, b)))


def filter_confidence(entities: Column) -> Column:
    """First gate: the score must exceed the threshold of the type."""
    return F.filter(entities, lambda e: e["score"] > min_confidence(e["type"], 0))


def filter_located(entities: Column) -> Column:
    return F.filter(entities, lambda e: e["start"].isNotNull())


def filter_valid(entities: Column) -> Column:
    return F.filter(entities, lambda e: is_valid(e["word"], e["type"]))


def to_detections(entities: Column) -> Column:
    return F.transform(
        entities,
        lambda e: F.struct(
            e["type"].alias("type"),
            e["word"].alias("value"),
            e["score"].alias("score"),
            e["start"].alias("start"),
            e["end"].alias("end"),
            F.lit("ml").alias("source"),
            e["score"].alias("confidence"),
        ),
    )


def detect_ml(text: Column, chunks: Column, tagged: Column) -> Column:
    """Entities of a text from the tokens of its chunks, after all first-stage filters."""
    words = fill_positions(join_subwords(locate_tokens(chunks, tagged)), text)
    entities = merge_entities(words, text)
    kept = filter_valid(filter_located(filter_confidence(entities)))
    return F.coalesce(to_detections(kept), empty(ML_DETECTION))


def filter_confidence_hybrid(found: Column) -> Column:
    """Second gate: the score must reach the threshold of the type."""
    return F.filter(found, lambda m: m["score"] >= min_confidence(m["type"], 1))


# What acceptance compares of a candidate: numbers only, as items are copied at every step.
_ITEM = T.StructType([
    T.StructField(name, T.IntegerType())
    for name in ("lo", "no", "hi", "start", "end", "index", "stop")
])


def _item(no: Column, index: Column, stop: Column, start: Column, end: Column) -> Column:
    """``start`` to ``end`` is what a candidate claims, ``index`` to ``stop`` what it takes."""
    return F.struct(
        F.least(start, end).alias("lo"),
        no.cast("int").alias("no"),
        F.greatest(start, end, stop).alias("hi"),
        start.alias("start"),
        end.alias("end"),
        index.alias("index"),
        stop.alias("stop"),
    )


def _clusters(ordered: Column) -> Column:
    """Groups of sorted items with nothing of one reaching into another, by a sweep over the text."""

    def step(state: Column, item: Column) -> Column:
        apart = item["lo"].isNull() | (item["lo"] >= state["reach"])
        reach = F.when(apart, item["hi"]).otherwise(F.greatest(state["reach"], item["hi"]))
        now = F.struct((state["at"] + 1).alias("at"), reach.alias("reach"))
        first = apart | (state["at"] == 1)
        return outcome(now, F.when(first, F.array(state["at"])).otherwise(empty(T.IntegerType())))

    start = F.struct(F.lit(1).alias("at"), F.lit(0).alias("reach"))
    return let(
        fold_emit(ordered, start, step, T.IntegerType()),
        lambda firsts: F.transform(
            firsts,
            lambda first, k: F.slice(
                ordered,
                first,
                F.coalesce(F.get(firsts, k + 1), F.size(ordered) + 1) - first,
            ),
        ),
    )


def _apart(ordered: Column) -> Column:
    """Whether no item reaches into the next one, so that each is a group of its own."""
    apart = F.forall(
        F.sequence(F.lit(1), F.size(ordered) - 1),
        lambda i: ordered[i - 1]["hi"] <= ordered[i]["lo"],
    )
    return F.when(F.size(ordered) > 1, apart).otherwise(F.lit(True))


def detect_hybrid(spans: Column, found: Column) -> Column:
    """Pattern hits, then the entities that overlap nothing accepted before them.

    Whether an entity is accepted depends only on what lies around it, so the text is first
    swept into groups that do not touch; the order of arrival is then followed inside each.
    """

    def by_arrival(items: Column) -> Column:
        return F.sort_array(
            F.transform(items, lambda x: F.struct(x["no"].alias("no"), x.alias("x")))
        )

    def accept(taken: Column, entry: Column) -> Column:
        x = entry["x"]
        blocked = (x["no"] >= 0) & F.exists(
            taken, lambda a: overlaps(a["index"], a["stop"], x["start"], x["end"])
        )
        return F.when(blocked, taken).otherwise(F.array_append(taken, x))

    def choose(group: Column) -> Column:
        """The numbers of the entities of a group that are accepted."""
        taken = F.when(F.size(group) == 1, group).otherwise(
            F.aggregate(by_arrival(group), empty(_ITEM), accept)
        )
        return F.filter(F.transform(taken, lambda x: x["no"]), lambda no: no >= 0)

    def detection(m: Column) -> Column:
        return F.struct(
            m["type"].alias("type"),
            m["value"].alias("value"),
            m["start"].alias("index"),
            F.lit("ml").alias("source"),
            m["score"].alias("confidence"),
        )

    def build(bound: Column, entities: Column) -> Column:
        hits = F.transform(
            bound,
            lambda s: let(span_end(s), lambda e: _item(F.lit(-1), s["index"], e, s["index"], e)),
        )
        candidates = F.transform(
            entities,
            lambda m, i: _item(
                i, m["start"], m["start"] + F.length(m["value"]), m["start"], m["end"]
            ),
        )

        def accepted(ordered: Column) -> Column:
            # nearly always all are apart, and no sweep is needed to see that all are accepted
            chosen = F.flatten(F.transform(_clusters(ordered), choose))
            some = F.transform(F.sort_array(chosen), lambda no: detection(entities[no]))
            return F.when(_apart(ordered), F.transform(entities, detection)).otherwise(some)

        return F.concat(bound, let(F.sort_array(F.concat(hits, candidates)), accepted))

    kept = filter_confidence_hybrid(found)
    return let(
        spans,
        lambda s: let(kept, lambda k: F.when(F.size(k) > 0, build(s, k)).otherwise(s)),
    )
