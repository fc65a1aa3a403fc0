"""Pieces of SQL that the checks of several queries share."""

from __future__ import annotations

BASES = "ATGC"


def pack(payload: str) -> str:
    """Four bases for each byte of a blob expression."""
    out = f"lower(hex({payload}))"
    for n in range(16):
        out = f"replace({out}, '{n:x}', '{BASES[n >> 2] + BASES[n & 3]}')"
    return out


def gc(seq: str) -> str:
    return f"(length(replace(replace({seq}, 'A', ''), 'T', '')) * 1.0 / length({seq}))"


def max_run(seq: str) -> str:
    return f"list_max(list_transform(regexp_extract_all({seq}, 'A+|C+|G+|T+'), lambda r: length(r)))"


def revcomp(seq: str) -> str:
    return f"reverse(translate({seq}, 'ATGC', 'TACG'))"


def byte_list(payload: str) -> str:
    return f"list_transform(range(0, octet_length({payload})), lambda i: CAST('0x' || substr(hex({payload}), 2 * i + 1, 2) AS BIGINT))"


PART_SEQ = f"SELECT p_partkey, p_name, {pack('encode(p_name)')} AS seq FROM part"
DOCUMENT_FILES = """SELECT doc_id AS file_id, coalesce(source, '') || '/' || doc_id || '.' || coalesce(lang, '') AS filename,
  coalesce(text, '') AS text, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, source FROM documents"""
