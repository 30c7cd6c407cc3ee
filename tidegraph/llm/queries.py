"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import chat, media, mixing, parsing, pieces, quality, secrets, simhash, warc, wrappers

QUERIES = {
    "op1_simhash": simhash.op1_simhash,
    "op2_chat_format": chat.op2_chat_format,
    "op3_phrase_fingerprint": parsing.op3_phrase_fingerprint,
    "op4_warc_archive": warc.op4_warc_archive,
    "op5_source_mix": mixing.op5_source_mix,
    "op6_html_wrappers": wrappers.op6_html_wrappers,
    "op7_media_columns": media.op7_media_columns,
    "op8_secret_scan": secrets.op8_secret_scan,
    "op9_quality_gam": quality.op9_quality_gam,
    "op10_sentencepiece": pieces.op10_sentencepiece,
}

ORACLE_SQL = {
    "op2_chat_format": chat.OP2_SQL,
    "op4_warc_archive": warc.OP4_SQL,
    "op5_source_mix": mixing.OP5_SQL,
}
