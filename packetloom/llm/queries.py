"""The operators over the given tables, with the columns their contracts name."""

from __future__ import annotations

from packetloom.llm import (
    align_queries,  # noqa: F401
    benchmark_queries,  # noqa: F401
    language_queries,  # noqa: F401
    model_queries,  # noqa: F401
    quality_queries,  # noqa: F401
    search_queries,  # noqa: F401
    secret_queries,  # noqa: F401
    simhash_queries,  # noqa: F401
    token_queries,  # noqa: F401
    url_queries,  # noqa: F401
    vector_queries,  # noqa: F401
)
