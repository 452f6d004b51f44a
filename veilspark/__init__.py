"""Find and mask personal data in tables and streams of text, on Spark."""

from .functions.text import inner_text, text_content
from .operators.detect import (
    count_pii,
    detect_pii,
    detection_rows,
    detections,
    flag_pii,
    nonblank,
    only_pii,
)
from .operators.joins import join_lookup, without_overlaps
from .operators.mappings import cascade_mapping_rows, latest_mappings, span_mapping_rows
from .operators.mask import mask_changed, mask_columns, mask_messages
from .operators.preview import preview, preview_html, resolve_decisions, send_decided
from .operators.settings import apply_settings, latest_settings, update_settings
from .operators.sites import SITES, site_filter
from .operators.tagging import observe_tagging, tag_errors, tag_tokens, token_tagger, with_entities
from .operators.token_tables import (
    chunk_rows,
    join_subword_rows,
    keep_entity_rows,
    merge_entity_rows,
    regroup_chunks,
    tag_chunk_rows,
    tile_rows,
    token_rows,
    with_entities_by_chunk,
)
from .operators.utf16 import mask_messages_utf16
from .session import build_session, checkpoint_root
from .sources.mapping_log import compact_logged, load_logged, log_batch, log_whole, vacuum_logged
from .sources.mapping_store import compact_mappings, load_mappings, save_mappings
from .sources.messages import read_message_stream, read_messages, write_masked
from .streaming.forgetting import forgetting_mappings
from .streaming.settled import (
    alert_settled,
    flush_settled,
    mask_settled,
    settings_as_of,
    settings_log,
    write_settled,
)
from .streaming.streams import alert_stream, flush_mappings, mask_stream, write_stream

__all__ = [name for name in dir() if not name.startswith("_")]
