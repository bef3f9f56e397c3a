"""Schemas of the tables that operators exchange. Offsets are code points; ordinals start at 0."""

from __future__ import annotations

STYLE = "struct<bold:boolean,italic:boolean,underline:boolean,color:string,font_family:string,font_size:string>"
RUN = f"struct<is_break:boolean,text:string,style:{STYLE}>"
RUNS = f"array<{RUN}>"

PARAGRAPHS = "doc_id string, para_idx int, text string, style string, num_id int, list_level int, table_no int, part string"
TEXT_NODES = "doc_id string, node_idx int, para_idx int, text string"
SNIPPETS = "name string, body string, updated_at bigint"
FIELD_VALUES = "record_id string, name string, value string"
EDITS = "doc_id string, seq int, op string, params map<string,string>, items array<struct<index:int,text:string>>, ts timestamp"
HIT = "struct<start:int,end:int,before:string,after:string>"
