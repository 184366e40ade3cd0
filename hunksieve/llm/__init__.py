"""Training-data operators: sharding, packing, deduplication, scoring and scanning of text tables.

Nothing outside this folder imports it; `queries.py` holds the thin queries over the `documents` table.
"""
