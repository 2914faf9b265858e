"""Constants, the edge-kind registry and the mode switch."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Edge kinds, in the order in which derived kinds claim a pair.
EVIDENCE_KINDS = ("ref", "imports", "contains", "hub")
DERIVED_KINDS = (
    "duplicate_of", "coupled_with", "co_cited_with", "mentions_symbol", "similar_to", "sibling_of", "supersedes",
    "shares_heading", "shares_term", "shares_entity", "semantic_similar",
)
ALWAYS_ON = ("duplicate_of", "coupled_with", "co_cited_with")
MODEL_KINDS = ("shares_entity", "semantic_similar")
KEYLESS_KINDS = tuple(k for k in DERIVED_KINDS if k not in MODEL_KINDS)
STRUCTURAL_KINDS = ("ref", "imports")
OFF_MODES = ("off", "none", "evidence", "0", "false")

# Words that the index leaves out.
STOP = (
    "a", "an", "and", "are", "as", "at", "be", "been", "but", "by", "can", "could", "did", "does", "for", "from",
    "had", "has", "have", "how", "i", "if", "in", "is", "it", "its", "no", "not", "of", "on", "or", "our", "so",
    "that", "the", "their", "them", "then", "there", "these", "they", "this", "to", "was", "we", "were", "when",
    "which", "will", "with", "you", "your", "use", "used", "using", "via", "etc", "also", "may", "must", "shall",
)

# Identifiers too common to point at a file.
SYMBOL_STOP = (
    "self", "this", "main", "init", "name", "args", "kwargs", "value", "values", "item", "items", "data", "result",
    "results", "text", "path", "type", "types", "ret", "true", "false", "none", "null", "error", "errors", "test",
    "tests", "config", "default", "return", "class", "def", "func", "function", "import", "from", "elif", "else",
    "then", "print", "format", "index", "count", "size", "length", "list", "dict", "tuple", "json", "args_",
    "kwargs_", "setup", "build", "make", "create", "update", "delete", "write", "read", "open",
)


@dataclass(frozen=True)
class Config:
    """Limits of the passes; defaults are fixed values of the data model."""

    posting_cap: int = 40
    df_ratio: float = 0.35
    index_chars: int = 2600
    digest_chars: int = 150
    similar_chars: int = 4000
    damping: float = 0.85
    iterations: int = 20
    min_prose: int = 220
    min_prose_entities: int = 400
    signature_terms: int = 15
    df_min: int = 2
    similar_postings: int = 64
    similar_from: float = 0.20
    similar_cap: int = 5
    sibling_min: int = 1
    sibling_max: int = 12
    symbol_cap: int = 5
    symbol_min_len: int = 4
    symbol_title_bonus: int = 2
    heading_min: int = 3
    heading_overlap: float = 0.35
    heading_cap: int = 5
    heading_df_floor: int = 8
    heading_postings: int = 64
    term_min: int = 2
    term_signature: int = 10
    term_cap: int = 5
    term_postings: int = 40
    term_weight: float = 1.0
    hub_out_max: int = 24
    group_max: int = 40
    couple_cap: int = 5
    couple_from: float = 0.25
    entity_cap: int = 5
    embed_cap: int = 5
    embed_from: float = 0.70
    symbol_chars: int = 300
    heavy_docs: int | None = None  # a budget on documents for similar_to and mentions_symbol; none is needed here
    hub_members: int = 200
    package_targets: int = 20

    def but(self, **changes) -> Config:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"no such option: {', '.join(sorted(unknown))}")
        return replace(self, **changes)


DEFAULT = Config()


def resolve_mode(mode: str | None) -> tuple[str, ...]:
    """Derived kinds that a mode enables: off words, ``all``, ``llm`` (with model kinds), ``auto``, or a comma list."""
    m = (mode or "auto").strip().lower()
    if m in OFF_MODES:
        return ()
    if m in ("all", "llm"):
        return DERIVED_KINDS
    if m == "auto":
        return KEYLESS_KINDS
    named = {x.strip() for x in m.split(",")}
    return tuple(k for k in DERIVED_KINDS if k in named)
