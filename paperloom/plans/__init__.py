"""The flows, and the named queries."""

from . import catalog, studies  # noqa: F401  each registers its queries
