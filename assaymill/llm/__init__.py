"""Operators for preparing training corpora: deduplication, mixing, packing,
sharding, extraction, classification and chat formatting.

Nothing outside this subpackage imports it.  Each module holds one operator
with a general interface; ``queries`` holds the thin contract queries."""
