"""The queries of this subpackage."""

from __future__ import annotations

from auditloom.registry import Registry

REGISTRY = Registry()

from auditloom.llm import (  # noqa: E402
    queries_align,
    queries_chat,
    queries_fingerprints,
    queries_jaccard,
    queries_markup,
    queries_media,
    queries_mix,
    queries_phrases,
    queries_pieces,
    queries_pivots,
    queries_spans,
    queries_suffixes,
    queries_toxicity,
)

for module in (queries_align, queries_chat, queries_fingerprints, queries_jaccard, queries_markup, queries_media, queries_mix, queries_phrases, queries_pieces, queries_pivots, queries_spans, queries_suffixes, queries_toxicity):
    module.register(REGISTRY)
