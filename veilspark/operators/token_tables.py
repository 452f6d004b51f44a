"""The entity pipeline over rows: chunks, tokens, words and entities as tables.

The array form keeps what belongs to a text beside it, in one row and one task.  Here a text of
any length is dealt over tasks by its chunks, and what the tagger answers stays a table that can
be stored and read again.  Words and entities are gaps and islands: a running number of what
starts one, then an aggregation by that number.

A running number over a text never needs the whole text in one place: rows are numbered inside
blocks of a text, and the blocks' totals, one row each, are summed up before.  Of entities, only the
first and the last of a block meet those of the next.

``keys`` tell texts apart; keys may be null, and rows with equal keys are one text.  Tables that
are read twice (tokens, words) should be stored, or the tagger behind them runs twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import empty, let
from ..functions.entities import CHUNK_OVERLAP, CHUNK_SIZE, chunk_text, detect_ml, locate_token
from ..functions.labels import map_entity, min_confidence
from ..functions.validity import is_valid
from ..schema import CHUNK, TAGGED_CHUNK
from .tagging import Tagger, token_tagger

CHUNKS_A_BLOCK = 256
WORDS_A_BLOCK = 8192
TILES_A_RUN = 64


def _beside(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``left`` with the columns of ``right``; null keys are equal to each other."""
    named = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(named, same, how).drop(*[f"_r_{k}" for k in keys])


def chunk_rows(
    df: DataFrame, *keys: str, text: str = "text", size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP
) -> DataFrame:
    """One row per chunk: keys, ``chunk_no``, ``offset``, ``text``; none for a null text."""
    chunks = chunk_text(F.col(text), size, overlap)
    return df.select(*keys, F.explode(let(chunks, lambda c: c)).alias("c")).select(*keys, "c.*")


def tag_chunk_rows(
    chunks: DataFrame,
    *keys: str,
    load: Callable[[], Tagger],
    parts: int | None = None,
    batch_size: int = 64,
) -> DataFrame:
    """The chunks with the tagger's ``answer``, dealt over tasks one by one.

    So many tasks work on one long text, and a key with a third of all chunks is no heavier
    than another.  ``parts`` is the number of tasks, else that of a shuffle.
    """
    by = [F.col(k) for k in (*keys, "chunk_no")]
    dealt = chunks.repartition(*by) if parts is None else chunks.repartition(parts, *by)
    tag = token_tagger(load, batch_size)
    return dealt.withColumn("answer", F.get(tag(F.array("text")), F.lit(0)))


def regroup_chunks(tagged: DataFrame, *keys: str) -> DataFrame:
    """Per text its ``chunks`` and, in the same order, ``tagged``: the form of arrays."""
    rows = tagged.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("chunk_no", "offset", "text", "answer"))).alias("c")
    )
    chunk = F.transform(
        "c", lambda c: F.struct(c["chunk_no"].alias("chunk_no"), c["offset"].alias("offset"), c["text"].alias("text"))
    )
    return rows.select(
        *keys, chunk.cast(f"array<{CHUNK.simpleString()}>").alias("chunks"),
        F.transform("c", lambda c: c["answer"]).alias("tagged"),
    )


def with_entities_by_chunk(
    df: DataFrame,
    *keys: str,
    load: Callable[[], Tagger],
    text: str = "text",
    out: str = "entities",
    errors: str = "ml_errors",
    parts: int | None = None,
) -> DataFrame:
    """As ``with_entities``, the chunks tagged as rows; ``keys`` must tell the rows apart.

    Chunks are grouped and joined by the keys as one struct, in which nulls are equal: so the join
    finds the groups where the aggregation leaves them, and they are not shuffled once more.
    """
    key = F.struct(*keys)
    tagged = tag_chunk_rows(chunk_rows(df, *keys, text=text), *keys, load=load, parts=parts)
    grouped = regroup_chunks(tagged.withColumn("_r_key", key), "_r_key").withColumnsRenamed(
        {"chunks": "_chunks", "tagged": "_tagged"}
    )
    joined = df.withColumn("_key", key).join(grouped, F.col("_key") == F.col("_r_key"), "left")
    whole = joined.drop("_key", "_r_key").withColumns({
        "_chunks": F.coalesce("_chunks", empty(CHUNK)),
        "_tagged": F.coalesce("_tagged", empty(TAGGED_CHUNK)),
    })
    found = detect_ml(F.col(text), F.col("_chunks"), F.col("_tagged"))
    failed = F.size(F.filter("_tagged", lambda a: a["error"].isNotNull()))
    return whole.withColumns({out: found, errors: failed}).drop("_chunks", "_tagged")


def token_rows(tagged: DataFrame, *keys: str) -> DataFrame:
    """One row per token, located in its text: keys, ``chunk_no``, ``token_no`` in the chunk."""
    chunk = F.struct("chunk_no", "offset", "text")
    located = F.transform("answer.tokens", lambda t: locate_token(t, chunk))
    rows = tagged.select(*keys, "chunk_no", F.posexplode(located).alias("token_no", "t"))
    return rows.select(*keys, "chunk_no", "token_no", "t.*")


def _numbered(rows: DataFrame, keys: list[str], block: Column, order: list[str], flag: Column, out: str) -> DataFrame:
    """Add the running number of rows with ``flag`` up to and with each row of a text."""
    rows = rows.withColumn("_block", block)
    one = F.when(flag, 1).otherwise(0)
    inside = Window.partitionBy(*keys, "_block").orderBy(*order)
    earlier = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, "_block").agg(F.sum(one).alias("_total"))
    before = totals.select(*keys, "_block", F.sum("_total").over(earlier).alias("_before"))
    counted = rows.withColumn("_inside", F.sum(one).over(inside))
    whole = _beside(counted, before, [*keys, "_block"])
    return whole.withColumn(out, F.col("_inside") + F.coalesce("_before", F.lit(0))).drop(
        "_inside", "_before", "_block"
    )


def join_subword_rows(tokens: DataFrame, *keys: str) -> DataFrame:
    """Words of a table of tokens: keys, ``word_no`` from 0 and the fields of a word.

    A token opens a word unless it begins with ``##``; pieces before the first word are dropped.
    """
    block = F.floor(F.col("chunk_no") / CHUNKS_A_BLOCK)
    head = ~F.col("word").startswith("##")
    numbered = _numbered(tokens, list(keys), block, ["chunk_no", "token_no"], head, "_no").where("_no > 0")
    at = F.struct("chunk_no", "token_no")
    piece = F.when(head, F.col("word")).otherwise(F.substring("word", 3, 1 << 30))
    parts = F.sort_array(F.collect_list(F.struct(at.alias("at"), piece.alias("piece"))))
    known = F.when(~head & F.col("end").isNotNull(), at)
    words = numbered.groupBy(*keys, (F.col("_no") - 1).alias("word_no")).agg(
        F.min_by("word", at).alias("piece"),
        F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias("word"),
        F.min_by("entity", at).alias("entity"),
        F.max("score").alias("score"),
        F.min_by("start", at).alias("start"),
        F.min_by("end", at).alias("end"),
        F.max_by("end", known).alias("sub_end"),
    )
    return words


def _place(keys: Sequence[str], tile: Column) -> Column:
    return F.struct(*keys, F.floor(tile / TILES_A_RUN).alias("_run")).alias("_place")


def tile_rows(chunks: DataFrame, *keys: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Texts as tiles that do not overlap, made of their chunks: keys, ``tile``, ``text``.

    ``_place`` is the keys and the number of a run of tiles as one struct, in which nulls are equal: by
    it the tiles are dealt over tasks, and ``merge_entity_rows`` finds them where they are, with no
    second shuffle.  The tiles of a run lie together on the way, which packs better.
    """
    step = size - overlap
    # only a text of one chunk may end in a chunk longer than a step; else the next one has the rest
    count = F.when(F.col("chunk_no") == 0, F.ceil(F.length("text") / step)).otherwise(F.lit(1)).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
        lambda n: F.struct(
            (F.col("chunk_no") + n - 1).alias("tile"), F.substring("text", (n - 1) * step + 1, step).alias("text")
        ),
    )
    rows = chunks.select(*keys, F.explode(tiles).alias("t")).where("t.text <> ''")
    placed = rows.select(_place(keys, F.col("t.tile")), "t.tile", "t.text").repartition("_place")
    whole = placed.groupBy("_place", "tile").agg(F.max("text").alias("text"))
    return whole.select(*[f"_place.{k}" for k in keys], "tile", "text", "_place")


def _islands(rows: DataFrame, by: list[str]) -> DataFrame:
    """Join neighbours among the rows of words or of islands that share ``by``.

    ``_no`` numbers the islands; only a row whose own is 1 may belong to the one before it.
    """
    inside = Window.partitionBy(*by).orderBy("first_word")
    before = F.lag(F.struct("type", "start", "end")).over(inside)
    near = (
        (F.col("_no") == 1)
        & (F.col("type") == F.col("_before.type"))
        & F.col("_before.start").isNotNull()
        & (F.col("start") - F.col("_before.end")).between(0, 2)
        & F.col("end").isNotNull()  # there would be no text to show
    )
    opens = F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1)
    opened = rows.withColumn("_before", before).withColumn("_opens", opens).drop("_before")
    return opened.withColumn("_no", F.sum("_opens").over(inside)).groupBy(*by, "_no").agg(
        F.sum("n_words").alias("n_words"),
        F.min_by("entity", "first_word").alias("entity"),
        F.min_by("type", "first_word").alias("type"),
        F.min("score").alias("score"),
        F.min_by("start", "first_word").alias("start"),
        F.max_by("end", "first_word").alias("end"),
        F.min_by("word", "first_word").alias("word"),
        F.min("first_word").alias("first_word"),
    )


def merge_entity_rows(
    words: DataFrame,
    *keys: str,
    tiles: DataFrame | None = None,
    size: int = CHUNK_SIZE,
    overlap: int = CHUNK_OVERLAP,
    blocks: bool = True,
) -> DataFrame:
    """Entities of a table of words: neighbours of one type, at most two characters apart.

    Returns keys, ``first_word``, ``n_words``, ``entity``, ``type``, ``score``, ``start``,
    ``end`` and, of the single words or with ``tiles`` of all, ``word``.  As the array form, but
    for words whose end lies before their start, and for merged entities of white space only.

    Words are shuffled once, by blocks of a text.  What a block's neighbours or the tiles may still
    change are its first and its last island and those of several words: they alone go further.
    Without ``blocks`` a text's words are sorted in one task, and its entities stay in it: one who goes
    on by text, and so has them in one task anyway, spares their shuffle.
    """
    keys = list(keys)
    names = [*keys, "first_word", "n_words", "entity", "type", "score", "start", "end", "word"]
    block = [F.floor(F.col("word_no") / WORDS_A_BLOCK).alias("_at")] if blocks else []
    by = [*keys, "_at"] if blocks else keys
    dealt = words.select(
        *keys, *block, F.col("word_no").alias("first_word"), "entity", "score", "start", "end", "word"
    ).repartition(*by)
    typed = dealt.withColumns({"type": map_entity(F.col("entity")), "n_words": F.lit(1), "_no": F.lit(1)})
    local, goes_on = _islands(typed, by), F.col("n_words") > 1
    if blocks:
        following = F.lead("_no").over(Window.partitionBy(*by).orderBy("_no"))
        local = local.withColumn("_following", following)
        goes_on = goes_on | (F.col("_no") == 1) | F.col("_following").isNull()
    local = local.withColumn("_goes_on", goes_on)
    done = local.where("NOT _goes_on AND start IS NOT NULL").select(*names)
    rest = local.where("_goes_on")
    joined = (_islands(rest, keys) if blocks else rest).where("start IS NOT NULL").select(*names)
    single = F.when(F.col("n_words") == 1, F.col("word"))
    if tiles is None:
        return done.unionByName(joined.withColumn("word", single))
    step = size - overlap
    low, high = F.least("start", "end"), F.greatest("start", "end")
    first = F.floor(low / step).cast("int")
    last = F.floor(F.greatest(high - 1, low) / step).cast("int")
    runs = F.sequence(F.floor(first / TILES_A_RUN), F.floor(last / TILES_A_RUN))
    needed = F.when(F.col("n_words") > 1, runs).otherwise(F.array(F.lit(None).cast("long")))
    if "_place" not in tiles.columns:
        tiles = tiles.withColumn("_place", _place(keys, F.col("tile")))
    there = tiles.select(F.col("_place").alias("_r_place"), "tile", "text")
    ends = joined.withColumns({"_first": first, "_last": last, "_run": F.explode(needed)})
    met = ends.withColumn("_place", F.struct(*keys, "_run")).join(
        there, (F.col("_place") == F.col("_r_place")) & F.col("tile").between(F.col("_first"), F.col("_last")), "left"
    )
    part = F.when(F.col("text").isNotNull(), F.struct("tile", "text"))
    whole = (met if blocks else met.repartition(*keys)).groupBy(*keys, "first_word").agg(
        F.first(F.struct(*names[len(keys) + 1:])).alias("_own"), F.sort_array(F.collect_list(part)).alias("_parts")
    ).select(*keys, "first_word", "_own.*", "_parts")
    text = F.array_join(F.transform("_parts", lambda t: t["text"]), "")
    cut = F.when(F.size("_parts") > 0, F.substring(text, low - first * step + 1, high - low))
    return done.unionByName(whole.withColumn("word", F.coalesce(single, cut)).drop("_parts"))


def keep_entity_rows(entities: DataFrame) -> DataFrame:
    """Entities above the threshold of their type and of a valid shape; needs ``word``."""
    sure = F.col("score") > min_confidence(F.col("type"), 0)
    return entities.where(sure & is_valid(F.col("word"), F.col("type")))
