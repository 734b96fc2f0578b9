"""Column-level functions: numbers, clocks, symbols, text and keys."""

from .clock import (
    instant_at,
    parse_stamp,
    period_end,
    period_start,
    shanghai_date,
    shanghai_minute,
    shanghai_text,
    strict_date,
)
from .numbers import age_seconds, finite, strict_number
from .symbols import (
    dataset_symbol,
    excluded_name,
    is_screen_mainboard,
    lot_factor,
    normalize_symbol,
    supported_symbol,
    ticker_parts,
)
from .text import (
    canonical_json,
    composite_key,
    decode_entities,
    nfkc,
    normalized_name,
    search_text_ok,
    sha256_hex,
    st_name,
)

__all__ = [name for name in dir() if not name.startswith("_")]
