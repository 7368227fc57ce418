"""All queries of the package and the SQL that checks them."""

from claritable.llm import (  # noqa: F401
    centroids,
    exact_dedup,
    language,
    line_dedup,
    mixing,
    packing,
    pii,
    prefix_trie,
    quality,
    secrets,
    simhash,
    token_counts,
    token_files,
)
from claritable.llm.common import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
