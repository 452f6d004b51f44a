"""The registered queries: each operator over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import cut, let, text_blocks
from ..functions.entities import (
    chunk_text,
    detect_ml,
    fill_positions,
    filter_confidence,
    filter_confidence_hybrid,
    filter_located,
    filter_valid,
    join_subwords,
    locate_tokens,
    merge_entities,
    to_detections,
)
from ..functions.labels import map_entity, mask_label
from ..functions.patterns import PATTERN_NAMES
from ..functions.resolve import mask_spans, resolve_overlaps
from ..functions.spans import detect_regex
from ..functions.text import escape_html, field_text, inner_text, is_blank, js_trim, text_content
from ..functions.validity import RULES, is_valid
from ..operators.detect import (
    count_pii,
    detect_pii,
    detection_rows,
    detections,
    flag_pii,
    only_pii,
)
from ..operators.joins import without_overlaps
from ..operators.lexical import load_failing, load_lexical
from ..operators.mappings import cascade_mapping_rows, latest_mappings, span_mapping_rows
from ..operators.mask import mask_changed, mask_columns, mask_messages
from ..operators.preview import preview, preview_html, resolve_decisions, send_decided
from ..operators.settings import apply_settings, latest_settings, update_settings
from ..operators.sites import site_filter
from ..operators.tagging import observe_tagging, tag_tokens
from ..operators.token_tables import (
    chunk_rows,
    join_subword_rows,
    merge_entity_rows,
    tag_chunk_rows,
    tile_rows,
    token_rows,
    with_entities_by_chunk,
)
from ..operators.utf16 import mask_messages_utf16
from ..session import checkpoint_root
from ..sources.mapping_log import compact_logged, load_logged, log_batch
from ..sources.mapping_store import load_mappings, save_mappings
from ..sources.messages import read_message_stream, write_masked
from ..streaming.settled import (
    alert_settled,
    flush_settled,
    mask_settled,
    settings_log,
    write_settled,
)
from ..streaming.streams import alert_stream, flush_mappings, mask_stream, write_stream
from . import tables

Query = Callable[[SparkSession, str], DataFrame]

# Kinds of entities the validity rules treat specially, and one they do not.
KINDS = (
    "ip", "email", "tel", "bod", "date", "street", "building", "secaddress",
    "socialnumber", "username", "pass", "driverlicense", "city",
)
# Hosts that occur in the pages table.
PAGE_SITES = (
    ("https", "blog.tionsh.example.com"),
    ("https", "blog.tionsh.example.net"),
    ("http", "blog.tionsh.example.net"),
    ("https", "m.tionsh.example.net"),
)


def _rows(df: DataFrame, key: str, array, number: str) -> DataFrame:
    """The elements of an array expression as rows numbered from 0."""
    # bound, so that the generator never takes a bare column (see tag_errors)
    return df.select(key, F.posexplode(let(array, lambda a: a)).alias(number, "x")).select(
        key, number, "x.*"
    )


# --- detection -----------------------------------------------------------------------


def _detector(name: str) -> Query:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return detection_rows(tables.messages(spark, root), "k", name=name)

    return run


def detect_regex_messages(spark, root):
    return detection_rows(tables.messages(spark, root), "k")


def detect_regex_documents(spark, root):
    return detection_rows(tables.documents(spark, root), "doc_id")


def detect_regex_pages(spark, root):
    return detection_rows(tables.pages(spark, root), "page_id", text="html")


def detect_regex_page_text(spark, root):
    pages = tables.pages(spark, root).withColumn("text", text_content(F.col("html")))
    return detection_rows(pages, "page_id")


def flag_pii_documents(spark, root):
    return flag_pii(tables.documents(spark, root)).drop("text")


def flag_pii_messages(spark, root):
    return flag_pii(tables.messages(spark, root)).drop("text", "scope")


def only_pii_documents(spark, root):
    return only_pii(tables.documents(spark, root))


def count_pii_documents(spark, root):
    return count_pii(tables.documents(spark, root))


def count_pii_messages(spark, root):
    return count_pii(tables.messages(spark, root))


def count_detections_documents(spark, root):
    found = F.size(detect_regex(F.col("text"))).alias("n_detected")
    return tables.documents(spark, root).select("doc_id", found)


# --- resolution and masking ----------------------------------------------------------


def resolve_overlaps_messages(spark, root):
    return _rows(
        tables.messages(spark, root), "k", resolve_overlaps(detect_regex(F.col("text"))), "no"
    )


def resolve_overlaps_documents(spark, root):
    return _rows(
        tables.documents(spark, root),
        "doc_id",
        resolve_overlaps(detect_regex(F.col("text"))),
        "no",
    )


def mask_spans_messages(spark, root):
    return mask_messages(tables.messages(spark, root)).select("k", "masked")


def mask_spans_documents(spark, root):
    return mask_messages(tables.documents(spark, root)).select("doc_id", "masked")


def _astral(spark, root):
    """The messages with characters of two UTF-16 units around them."""
    smile, script = F.lit("\U0001F600"), F.lit("\U0001D4B3")
    around = F.concat(F.repeat(smile, (F.col("k") % 4).cast("int")), script, F.lit(" "), "text", F.lit(" "), smile)
    return tables.messages(spark, root).select("k", around.alias("text"))


def mask_utf16_messages(spark, root):
    masked = mask_messages_utf16(_astral(spark, root))
    return masked.select("k", "masked", F.transform("detections", lambda d: d["index"]).alias("p")).select(
        "k", "masked", F.array_join("p", ",").alias("places")
    )


def mask_cascade_messages(spark, root):
    return mask_columns(tables.messages(spark, root), ["text"]).select("k", "text")


def mask_cascade_documents(spark, root):
    return mask_columns(tables.documents(spark, root), ["text"])


def mask_columns_pages(spark, root):
    return mask_columns(tables.pages(spark, root), ["url", "html"])


def mask_changed_documents(spark, root):
    return mask_changed(tables.documents(spark, root)).select("doc_id", "masked")


def mask_label_messages(spark, root):
    hits = detection_rows(tables.messages(spark, root), "k")
    masks = mask_label(F.col("type")).alias("mask")
    return hits.select("type", masks).groupBy("type", "mask").agg(F.count(F.lit(1)).alias("hits"))


# --- text, previews, decisions -------------------------------------------------------


def inner_text_pages(spark, root):
    pages = tables.pages(spark, root)
    return pages.select("page_id", inner_text(F.col("html")).alias("text"))


def text_content_pages(spark, root):
    pages = tables.pages(spark, root)
    return pages.select("page_id", text_content(F.col("html")).alias("text"))


def escape_html_pages(spark, root):
    pages = tables.pages(spark, root)
    return pages.select("page_id", escape_html(F.col("html")).alias("safe"))


def field_text_customer(spark, root):
    k = F.col("c_custkey")
    value = F.when(k % 3 == 0, F.lit("")).when(k % 3 == 1, F.col("c_name"))
    content = F.when(k % 2 == 0, F.lit("")).otherwise(F.col("c_mktsegment"))
    customers = spark.read.parquet(f"{root}/customer.parquet")
    return customers.select(
        k.alias("k"), field_text(value, content, F.lit("inner")).alias("text")
    )


def nonblank_document_lines(spark, root):
    """Lines with visible text and their characters, for documents that have such lines."""

    def count(lines):
        chars = F.aggregate(
            lines, F.lit(0).cast("long"), lambda total, line: total + F.length(js_trim(line))
        )
        found = F.struct(F.size(lines).cast("long").alias("lines"), chars.alias("chars"))
        return F.when(F.size(lines) > 0, F.array(found))

    visible = F.filter(F.split("text", "\n"), lambda line: ~is_blank(line))
    return tables.documents(spark, root).select("doc_id", F.inline(let(visible, count)))


def preview_messages(spark, root):
    return preview(tables.messages(spark, root)).drop("scope")


def preview_documents(spark, root):
    return preview(tables.documents(spark, root))


def preview_conversations(spark, root):
    return preview(tables.conversations(spark, root))


def preview_html_messages(spark, root):
    shown = preview_html(preview(tables.messages(spark, root)))
    return shown.select("k", "original_html", "masked_html")


def resolve_decisions_messages(spark, root):
    previews = preview(tables.messages(spark, root))
    decided = resolve_decisions(previews, tables.decisions(spark, root), ["k"])
    return decided.select("k", "choice", "sent")


def send_decided_messages(spark, root):
    sent = send_decided(tables.messages(spark, root), tables.decisions(spark, root), ["k"])
    return sent.select("k", "choice", "sent")


def site_filter_pages(spark, root):
    return site_filter(tables.pages(spark, root), "url", PAGE_SITES).select("page_id", "url")


def site_table_pages(spark, root):
    """The same with the sites in a table: every https host seen with a search query."""
    urls = spark.read.parquet(f"{root}/pages.parquet").where(F.col("url").contains("?page="))
    sites = urls.select(
        F.lit("https").alias("scheme"),
        F.regexp_extract("url", "^https?://([^/?#:]+)", 1).alias("host"),
    )
    return site_filter(tables.pages(spark, root), "url", sites).select("page_id", "url")


def apply_settings_messages(spark, root):
    joined = apply_settings(tables.messages(spark, root), tables.settings(spark, root))
    return mask_messages(joined, enabled="enabled").select(
        "k", "scope", "enabled", "maskingMode", "useML", "masked"
    )


def update_settings_nation(spark, root):
    log = tables.settings(spark, root).withColumn("version", F.lit(1))
    nation = spark.read.parquet(f"{root}/nation.parquet").where("n_nationkey % 2 = 0")
    changes = nation.select(
        F.col("n_nationkey").cast("string").alias("scope"),
        (F.col("n_nationkey") % 4 == 0).alias("enabled"),
        F.lit(2).alias("version"),
    )
    return latest_settings(update_settings(log, changes))


def settings_log_nation(spark, root):
    """A log of two versions per scope with changes between and after them."""
    settings = tables.settings(spark, root)
    later = settings.withColumn("maskingMode", F.concat(F.lit("mode"), "scope"))
    log = settings.withColumn("version", F.lit(1)).unionByName(later.withColumn("version", F.lit(3)))
    nation = spark.read.parquet(f"{root}/nation.parquet").where("n_nationkey % 2 = 0")
    changes = nation.select(
        F.col("n_nationkey").cast("string").alias("scope"),
        (F.col("n_nationkey") % 4 == 0).alias("enabled"),
        F.explode(F.array(F.lit(2), F.lit(4))).alias("version"),
    )
    return update_settings(log, changes)


def mask_settings_letters(spark, root):
    """Letters masked as their scope has it: not at all, by patterns only, or with the tagger."""
    texts = tables.letters(spark, root, "scope")
    joined = apply_settings(texts, tables.settings(spark, root))
    masked = mask_messages(joined, "text", load_lexical, enabled="enabled", use_ml="useML")
    return masked.select("k", "enabled", "useML", "ml_errors", "masked")


# --- entities ------------------------------------------------------------------------


def _tagged(spark, root):
    return tag_tokens(tables.documents(spark, root), "text", load_lexical)


def _words():
    return join_subwords(locate_tokens(F.col("chunks"), F.col("tagged")))


def _entities():
    return merge_entities(fill_positions(_words(), F.col("text")), F.col("text"))


def chunk_text_documents(spark, root):
    return tables.documents(spark, root).select(
        "doc_id", F.explode(chunk_text(F.col("text"))).alias("c")
    ).select("doc_id", "c.*")


def tag_tokens_documents(spark, root):
    tokens = F.transform(F.col("tagged"), lambda t: t["tokens"])
    return _rows(_tagged(spark, root), "doc_id", F.flatten(tokens), "token_no")


def locate_tokens_documents(spark, root):
    located = locate_tokens(F.col("chunks"), F.col("tagged"))
    return _rows(_tagged(spark, root), "doc_id", located, "token_no")


def join_subwords_documents(spark, root):
    return _rows(_tagged(spark, root), "doc_id", _words(), "word_no").drop("piece")


def fill_positions_documents(spark, root):
    placed = fill_positions(_words(), F.col("text"))
    return _rows(_tagged(spark, root), "doc_id", placed, "word_no").select(
        "doc_id", "word_no", "word", "start", "end"
    )


def map_entity_documents(spark, root):
    tags = F.transform(
        F.flatten(F.transform(F.col("tagged"), lambda t: t["tokens"])), lambda t: t["entity"]
    )
    rows = _tagged(spark, root).select(F.explode(let(tags, lambda a: a)).alias("entity"))
    typed = rows.withColumn("type", map_entity(F.col("entity")))
    return typed.groupBy("entity", "type").agg(F.count(F.lit(1)).alias("tokens"))


def merge_entities_documents(spark, root):
    return _rows(_tagged(spark, root), "doc_id", _entities(), "entity_no")


def _stored_chunks(spark, root):
    """The documents' chunks with the tagger's answers, as rows that are written and read back."""
    chunks = chunk_rows(tables.documents(spark, root), "doc_id")
    path = _scratch(spark, "tagged-chunks")
    tag_chunk_rows(chunks, "doc_id", load=load_lexical).write.parquet(path)
    return spark.read.parquet(path)


def _number(rows, order, name):
    """Consecutive numbers within a document."""
    by = Window.partitionBy("doc_id").orderBy(*order)
    return rows.withColumn(name, F.row_number().over(by) - 1).drop(*order)


def token_rows_documents(spark, root):
    rows = token_rows(_stored_chunks(spark, root), "doc_id").withColumnRenamed("token_no", "in_chunk")
    return _number(rows, ["chunk_no", "in_chunk"], "token_no")


def join_subword_rows_documents(spark, root):
    tokens = token_rows(_stored_chunks(spark, root), "doc_id")
    return join_subword_rows(tokens, "doc_id").drop("piece").withColumn("word_no", F.col("word_no").cast("int"))


def merge_entity_rows_documents(spark, root):
    """Words that stand where they are said to, as rows; entities by gaps and islands."""

    def placed(blocks):
        return F.filter(
            fill_positions(_words(), F.col("text")),
            lambda w: (w["start"] < w["end"])
            & (F.lower(cut(blocks, w["start"], w["end"] - w["start"])) == F.lower(w["word"])),
        )

    path = _scratch(spark, "word-rows")
    words = let(text_blocks(F.col("text")), placed)
    _rows(_tagged(spark, root), "doc_id", words, "word_no").write.parquet(path)
    tiles = tile_rows(chunk_rows(tables.documents(spark, root), "doc_id"), "doc_id")
    # numbered by document below, so that a document's entities meet in one task anyway
    merged = merge_entity_rows(spark.read.parquet(path), "doc_id", tiles=tiles, blocks=False).drop("n_words")
    return _number(merged, ["first_word"], "entity_no")


def mask_by_chunk_documents(spark, root):
    """Hybrid masking, the texts' chunks tagged as rows that are dealt over tasks."""
    texts = tables.documents(spark, root)
    tagged = with_entities_by_chunk(texts, "doc_id", load=load_failing)
    found = detections(F.col("text"), F.col("entities"))
    return tagged.select("doc_id", "ml_errors", mask_spans(F.col("text"), found).alias("masked"))


def filter_confidence_documents(spark, root):
    kept = filter_located(filter_confidence(_entities()))
    return _rows(_tagged(spark, root), "doc_id", kept, "entity_no")


def _with_field(items, name: str, value):
    """An array of structs with one field replaced by ``value(item)``."""
    return F.transform(items, lambda e: e.withField(name, value(e)))


def _kind(number):
    return F.element_at(F.array(*[F.lit(kind) for kind in KINDS]), (number % len(KINDS) + 1).cast("int"))


def filter_confidence_hybrid_documents(spark, root):
    """The second gate on halved scores, some of which it then drops."""
    weak = _with_field(to_detections(_entities()), "score", lambda e: e["score"] / 2)
    kept = filter_confidence_hybrid(_with_field(weak, "confidence", lambda e: e["score"]))
    return _rows(_tagged(spark, root), "doc_id", kept, "entity_no")


def filter_valid_documents(spark, root):
    """The shape rules on entities given, by their length, the types that have rules."""
    typed = _with_field(_entities(), "type", lambda e: _kind(F.length(e["word"])))
    return _rows(_tagged(spark, root), "doc_id", filter_valid(typed), "entity_no")


def validity_rules_messages(spark, root):
    """Each shape rule on the values found in the messages and on the messages' last words."""
    texts = tables.messages(spark, root)
    last = texts.select("k", F.lower(F.substring_index("text", " ", -1)).alias("word"))
    hits = detection_rows(texts, "k").select("k", F.lower("value").alias("word"))
    words = last.unionByName(hits).withColumn("kind", _kind(F.col("k")))
    checks = {name: rule(F.col("word"), F.col("kind")) for name, rule in RULES.items()}
    return words.withColumns({**checks, "valid": is_valid(F.col("word"), F.col("kind"))})


def detect_ml_documents(spark, root):
    found = detect_ml(F.col("text"), F.col("chunks"), F.col("tagged"))
    return _rows(_tagged(spark, root), "doc_id", found, "no")


def without_overlaps_letters(spark, root):
    """Entities and pattern hits as two tables, joined on the text they come from."""
    tagged = tag_tokens(tables.letters(spark, root), "text", load_lexical)
    found = detect_ml(F.col("text"), F.col("chunks"), F.col("tagged"))
    entities = _rows(tagged, "k", found, "no")
    return without_overlaps(entities, detection_rows(tables.letters(spark, root), "k"), ["k"], "no")


def detect_hybrid_documents(spark, root):
    found = detect_pii(tables.documents(spark, root), "text", load_lexical)
    return _rows(found, "doc_id", F.col("detections"), "ordinal")


def mask_hybrid_documents(spark, root):
    return mask_messages(tables.documents(spark, root), "text", load_lexical).select(
        "doc_id", "masked"
    )


def tag_errors_documents(spark, root):
    """A tagger that fails on some chunks: the others are masked, the errors counted."""
    masked = mask_messages(tables.documents(spark, root), "text", load_failing)
    return masked.select("doc_id", "ml_errors", "masked")


def tag_metrics_documents(spark, root):
    """Figures of the tagging of all documents, gathered while their masked texts are written."""
    metrics = Observation(f"tagging-{uuid.uuid4().hex}")
    tagged = tag_tokens(tables.documents(spark, root), "text", load_failing)
    seen = observe_tagging(tagged, metrics, ("ValueError", "TypeError"))
    seen.select("doc_id", F.size("tagged")).write.parquet(_scratch(spark, "tag-metrics"))
    found = metrics.get
    return spark.createDataFrame([tuple(found.values())], ", ".join(f"{name} long" for name in found))


def detect_hybrid_letters(spark, root):
    found = detect_pii(tables.letters(spark, root), "text", load_lexical)
    return _rows(found, "k", F.col("detections"), "ordinal")


def mask_hybrid_letters(spark, root):
    return mask_messages(tables.letters(spark, root), "text", load_lexical).select("k", "masked")


# --- mappings and sinks --------------------------------------------------------------


def latest_mappings_cascade_messages(spark, root):
    texts = tables.messages(spark, root)
    return latest_mappings(cascade_mapping_rows(texts, "scope", F.col("k")))


def latest_mappings_spans_messages(spark, root):
    found = detect_pii(tables.messages(spark, root))
    return latest_mappings(span_mapping_rows(found, "scope", F.col("k")))


def _scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_root(spark)}/queries/{name}-{uuid.uuid4().hex}"


def mapping_store_messages(spark, root):
    path = _scratch(spark, "mappings")
    save_mappings(latest_mappings_spans_messages(spark, root), path)
    return load_mappings(spark, path)


def mapping_log_messages(spark, root):
    """The messages' mappings in four commits, the second written twice, with a rewrite between."""
    path = _scratch(spark, "mapping-log")
    found = detect_pii(tables.messages(spark, root))
    rows = span_mapping_rows(found, "scope", F.col("k"))
    end = (tables.messages(spark, root).agg(F.max("k")).first()[0] or 0) + 1
    for batch in range(4):
        low, high = end * batch // 4, end * (batch + 1) // 4
        part = latest_mappings(rows.where(F.col("written._message").between(low, high - 1)))
        log_batch(part, path, batch)
        if batch == 1:
            log_batch(part, path, batch)
        if batch == 2:
            compact_logged(spark, path)
    return load_logged(spark, path)


def write_masked_documents(spark, root):
    path = _scratch(spark, "masked")
    write_masked(mask_messages(tables.documents(spark, root)), path)
    return spark.read.parquet(path)


# --- streams -------------------------------------------------------------------------


def _document_stream(spark, root):
    return tables.stream(spark, root, "documents", "doc_id long, text string")


def mask_stream_documents(spark, root):
    path = _scratch(spark, "mask-stream")
    masked = mask_stream(_document_stream(spark, root)).select("doc_id", "masked")
    name = f"mask-{uuid.uuid4().hex}"
    write_stream(masked, path, name, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(masked.schema).parquet(path)


def alert_stream_documents(spark, root):
    path = _scratch(spark, "alert-stream")
    alerts = alert_stream(_document_stream(spark, root)).select("doc_id")
    name = f"alert-{uuid.uuid4().hex}"
    write_stream(alerts, path, name, f"{path}-checkpoint").awaitTermination()
    return spark.read.schema(alerts.schema).parquet(path)


def _settled(spark, root, write):
    """Two triggers over the messages, the settings of even nations changed in between."""
    path = _scratch(spark, "settled")
    nation = spark.read.parquet(f"{root}/nation.parquet").where("n_nationkey % 2 = 0")
    changes = nation.select(
        F.col("n_nationkey").cast("string").alias("scope"),
        (F.col("n_nationkey") % 4 == 0).alias("enabled"),
        F.lit(None).cast("string").alias("maskingMode"),
        F.lit(True).alias("useML"),
    )
    texts = tables.messages(spark, root)
    for half, log in enumerate((tables.settings(spark, root), changes)):
        log.withColumn("version", F.lit(half + 1).cast("long")).write.mode("append").parquet(f"{path}/log")
        texts.where(F.col("k") % 2 == half).write.mode("append").parquet(f"{path}/in")
        stream = read_message_stream(spark, f"{path}/in", texts.schema)
        write(stream, settings_log(spark, f"{path}/log"), f"{path}/out", f"{path}/place").awaitTermination()
    return f"{path}/out"


def mask_settled_messages(spark, root):
    name = f"settled-{uuid.uuid4().hex}"
    out = _settled(
        spark, root, lambda s, log, to, at: write_settled(s, log, mask_settled, to, name, checkpoint=at)
    )
    return spark.read.parquet(out).select("k", "settings_version", "enabled", "masked")


def alert_settled_messages(spark, root):
    name = f"alerts-{uuid.uuid4().hex}"
    out = _settled(
        spark, root, lambda s, log, to, at: write_settled(s, log, alert_settled, to, name, checkpoint=at)
    )
    return spark.read.parquet(out).select("k", "settings_version")


def flush_settled_messages(spark, root):
    name = f"flushes-{uuid.uuid4().hex}"
    out = _settled(
        spark, root, lambda s, log, to, at: flush_settled(s, log, to, F.col("k"), name, checkpoint=at)
    )
    return load_mappings(spark, out)


def _flushed(spark, root, **options):
    path = _scratch(spark, "flush")
    customers = tables.stream(spark, root, "customer", "c_custkey long, c_nationkey int")
    texts = customers.select(
        F.col("c_custkey").alias("k"),
        F.col("c_nationkey").cast("string").alias("scope"),
        tables.message_text(F.col("c_custkey")).alias("text"),
    )
    flush_mappings(
        texts,
        path,
        "scope",
        F.col("k"),
        f"flush-{uuid.uuid4().hex}",
        checkpoint=f"{path}-checkpoint",
        interval=None,
        **options,
    ).awaitTermination()
    return load_mappings(spark, path)


def flush_mappings_messages(spark, root):
    return _flushed(spark, root)


def flush_forgetting_messages(spark, root):
    return _flushed(spark, root, forget_after=3600)


_QUERIES = (
    detect_regex_messages,
    detect_regex_documents,
    detect_regex_pages,
    detect_regex_page_text,
    flag_pii_documents,
    flag_pii_messages,
    only_pii_documents,
    count_pii_documents,
    count_pii_messages,
    count_detections_documents,
    resolve_overlaps_messages,
    resolve_overlaps_documents,
    mask_spans_messages,
    mask_spans_documents,
    mask_utf16_messages,
    mask_cascade_messages,
    mask_cascade_documents,
    mask_columns_pages,
    mask_changed_documents,
    mask_label_messages,
    inner_text_pages,
    text_content_pages,
    escape_html_pages,
    field_text_customer,
    nonblank_document_lines,
    preview_messages,
    preview_documents,
    preview_conversations,
    preview_html_messages,
    resolve_decisions_messages,
    send_decided_messages,
    site_filter_pages,
    site_table_pages,
    apply_settings_messages,
    update_settings_nation,
    settings_log_nation,
    mask_settings_letters,
    tag_errors_documents,
    tag_metrics_documents,
    chunk_text_documents,
    tag_tokens_documents,
    locate_tokens_documents,
    join_subwords_documents,
    fill_positions_documents,
    map_entity_documents,
    merge_entities_documents,
    token_rows_documents,
    join_subword_rows_documents,
    merge_entity_rows_documents,
    mask_by_chunk_documents,
    filter_confidence_documents,
    filter_confidence_hybrid_documents,
    filter_valid_documents,
    validity_rules_messages,
    detect_ml_documents,
    without_overlaps_letters,
    detect_hybrid_documents,
    mask_hybrid_documents,
    detect_hybrid_letters,
    mask_hybrid_letters,
    latest_mappings_cascade_messages,
    latest_mappings_spans_messages,
    mapping_store_messages,
    mapping_log_messages,
    write_masked_documents,
    mask_stream_documents,
    alert_stream_documents,
    mask_settled_messages,
    alert_settled_messages,
    flush_settled_messages,
    flush_forgetting_messages,
    flush_mappings_messages,
)


def registry() -> dict[str, Query]:
    detectors = {f"detect_{name}_messages": _detector(name) for name in PATTERN_NAMES}
    return {**detectors, **{query.__name__: query for query in _QUERIES}}
