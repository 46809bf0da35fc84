"""Queries of the library by name, and their SQL."""

from lobspark.plans import books, integrity, market, tokens

FLAGSHIP = "y07_acf_returns"
QUERIES: dict = {}
SQL: dict[str, str] = {}
for part in (market, books, tokens, integrity):
    QUERIES |= part.QUERIES
    SQL |= part.SQL
