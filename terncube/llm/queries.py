"""Registered queries of the subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from terncube.llm.jaccard import op2_jaccard
from terncube.llm.langid import op10_language
from terncube.llm.lines import op8_line_dedup
from terncube.llm.media import op9_media
from terncube.llm.mixing import OP6_SQL, op6_mix
from terncube.llm.neighbours import op4_neighbours
from terncube.llm.packing import op5_pack
from terncube.llm.secrets import OP3_SQL, op3_secrets
from terncube.llm.urls import OP1_SQL, op1_url_filter
from terncube.llm.warc import op7_warc

QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op6_mix": op6_mix,
    "op7_warc": op7_warc,
    "op9_media": op9_media,
    "op10_language": op10_language,
    "op5_pack": op5_pack,
    "op4_neighbours": op4_neighbours,
    "op3_secrets": op3_secrets,
    "op2_jaccard": op2_jaccard,
    "op8_line_dedup": op8_line_dedup,
}
SQL = {"op1_url_filter": OP1_SQL, "op6_mix": OP6_SQL, "op3_secrets": OP3_SQL}
