"""Running a caller's token classifier over the chunks of each text."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.entities import chunk_text, detect_ml
from ..schema import TAGGED_CHUNK

# Ship this module's functions inside the task: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_ARROW_ANSWER = to_arrow_type(TAGGED_CHUNK)
_ARROW_TOKEN = _ARROW_ANSWER[0].type.value_type
CHUNKS_AT_ONCE = 4096

Token = dict
Tagger = Callable[[Sequence[str]], Sequence[Sequence[Token]]]


def _clean(token: Token) -> tuple:
    start, end = token.get("start"), token.get("end")
    return (
        token.get("word") or "",
        token.get("entity") or "",
        float(token["score"]),
        None if start is None else int(start),
        None if end is None else int(end),
    )


def _run(tagger: Tagger, chunks: Sequence[str]) -> list[tuple[list[tuple], str | None]]:
    """Tag one batch; if it fails, tag its chunks one by one and skip those that fail."""
    try:
        answers = [([_clean(t) for t in tokens], None) for tokens in tagger(chunks)]
        if len(answers) != len(chunks):
            raise ValueError(f"{len(answers)} answers for {len(chunks)} chunks")
        return answers
    except Exception as error:
        if len(chunks) > 1:
            return [_run(tagger, [chunk])[0] for chunk in chunks]
        return [([], f"{type(error).__name__}: {error}")]


def _arrow(answers: Sequence[tuple[list[tuple], str | None]]) -> pa.Array:
    """Answers as Arrow columns."""
    tokens = [token for found, _ in answers for token in found]
    columns = zip(*tokens) if tokens else [()] * len(_ARROW_TOKEN)
    fields = [pa.array(values, field.type) for values, field in zip(columns, _ARROW_TOKEN)]
    items = pa.StructArray.from_arrays(fields, fields=list(_ARROW_TOKEN))
    ends = np.cumsum([0, *(len(found) for found, _ in answers)])
    errors = pa.array([error for _, error in answers], pa.string())
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items, type=_ARROW_ANSWER[0].type)
    return pa.StructArray.from_arrays([lists, errors], fields=list(_ARROW_ANSWER))


def _parts(batch: pa.Array) -> Iterator[pa.Array]:
    """A batch in runs of rows of about ``CHUNKS_AT_ONCE`` chunks; a row is never cut."""
    before = np.cumsum(np.concatenate([[0], batch.value_lengths().fill_null(0).to_numpy()]))
    cuts = np.flatnonzero(np.diff(before[:-1] // CHUNKS_AT_ONCE)) + 1
    for first, last in zip([0, *cuts], [*cuts, len(batch)]):
        yield batch.slice(first, last - first)


def token_tagger(load: Callable[[], Tagger], batch_size: int = 64) -> Callable[[Column], Column]:
    """A function from an array of chunk texts to an array of ``TAGGED_CHUNK``.

    ``load`` is called once per Python worker task and returns the tagger: a function from
    a list of strings to one list of tokens per string.  A token has ``word``, ``entity``
    and ``score``, and may have ``start`` and ``end``.  If loading fails, every chunk
    carries the error and no token, so detection goes on with patterns only.
    """

    def answers(tagger: Tagger, part: pa.Array) -> pa.Array:
        chunks = part.flatten()
        done = [_arrow([])]
        for i in range(0, len(chunks), batch_size):
            done.append(_arrow(_run(tagger, chunks.slice(i, batch_size).to_pylist())))
        ends = np.cumsum(np.concatenate([[0], part.value_lengths().fill_null(0).to_numpy()]))
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.concat_arrays(done))

    @F.arrow_udf(T.ArrayType(TAGGED_CHUNK))
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        try:
            tagger = load()
        except Exception as error:
            failure = error

            def tagger(chunks):
                raise failure

        # a batch holds as many rows as the session has it: only so many chunks of it at a time
        # become Python objects, and their answers go back before the next ones are tagged
        for batch in batches:
            parts = _parts(batch)
            del batch  # gone before the next one is read
            for part in parts:
                yield answers(tagger, part)
                del part
                # workers live on from task to task, and Arrow keeps what it once had
                pa.default_memory_pool().release_unused()

    return tag


def tag_tokens(
    df: DataFrame,
    text: str,
    load: Callable[[], Tagger],
    chunks: str = "chunks",
    tagged: str = "tagged",
    batch_size: int = 64,
) -> DataFrame:
    """Add the chunks of ``text`` and the tagger's answer for each of them.

    Only the chunk texts travel to Python; the other columns stay in the JVM.
    """
    tag = token_tagger(load, batch_size)
    return df.withColumn(chunks, chunk_text(F.col(text))).withColumn(
        tagged, tag(F.transform(F.col(chunks), lambda c: c["text"]))
    )


def observe_tagging(
    tagged_df: DataFrame, metrics: Observation, kinds: Sequence[str] = (), tagged: str = "tagged"
) -> DataFrame:
    """The same rows; figures of the tagger's answers gather in ``metrics`` as they pass by.

    ``texts``, ``chunks``, ``tokens`` and ``failed`` chunks, ``failed_KIND`` for each kind of
    error named, ``failed_other``.  They are there once an action on the rows has ended, with no
    second run of the tagger; a task that is run again counts once.
    """

    def total(value: Callable[[Column], Column]) -> Column:
        zero = F.lit(0).cast("long")
        return F.coalesce(F.sum(F.aggregate(tagged, zero, lambda acc, a: acc + value(a))), zero)

    def failed(condition: Callable[[Column], Column]) -> Column:
        return total(lambda a: F.when(a["error"].isNotNull() & condition(a["error"]), 1).otherwise(0))

    def kind(error: Column) -> Column:
        return F.substring_index(error, ":", 1)

    return tagged_df.observe(
        metrics,
        F.count(F.lit(1)).alias("texts"),
        total(lambda a: F.lit(1)).alias("chunks"),
        total(lambda a: F.coalesce(F.size(a["tokens"]), F.lit(0))).alias("tokens"),
        failed(lambda e: F.lit(True)).alias("failed"),
        *[failed(lambda e, k=k: kind(e) == k).alias(f"failed_{k}") for k in kinds],
        failed(lambda e: ~kind(e).isin(list(kinds)) if kinds else F.lit(True)).alias("failed_other"),
    )


def with_entities(
    df: DataFrame,
    text: str,
    load: Callable[[], Tagger],
    out: str = "entities",
    errors: str = "ml_errors",
    metrics: Observation | None = None,
    kinds: Sequence[str] = (),
) -> DataFrame:
    """Add the entities found in ``text`` (``array<ML_DETECTION>``) by the tagger.

    ``errors`` is the number of chunks of the text on which the tagger failed.  ``metrics``
    gathers what ``observe_tagging`` does.
    """
    tagged = tag_tokens(df, text, load, "_chunks", "_tagged")
    if metrics is not None:
        tagged = observe_tagging(tagged, metrics, kinds, "_tagged")
    found = detect_ml(F.col(text), F.col("_chunks"), F.col("_tagged"))
    failed = F.size(F.filter("_tagged", lambda answer: answer["error"].isNotNull()))
    return tagged.withColumns({out: found, errors: F.greatest(failed, F.lit(0))}).drop(
        "_chunks", "_tagged"
    )


def tag_errors(tagged_df: DataFrame, *keys: str, tagged: str = "tagged") -> DataFrame:
    """One row per chunk the tagger failed on.

    The generator takes an expression, not the bare column: for a bare column the optimizer
    infers a filter, pushes it below the tagger and so runs the tagger twice.
    """
    numbered = F.transform(
        F.col(tagged),
        lambda answer, i: F.struct(i.alias("chunk_no"), answer["error"].alias("error")),
    )
    failed = F.filter(numbered, lambda n: n["error"].isNotNull())
    return tagged_df.select(*keys, F.explode(failed).alias("n")).select(*keys, "n.*")
