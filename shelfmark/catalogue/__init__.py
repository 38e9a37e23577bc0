"""The registered queries. Importing this package fills the registry."""

from shelfmark.catalogue import (q_discovery, q_logs, q_products, q_store,  # noqa: F401
                                 q_streams, q_urls)
from shelfmark.catalogue.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
