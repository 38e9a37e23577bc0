"""shelfmark: product-page analytics on Spark.

Landed web pages, URL lists and crawl logs come in as DataFrames; clean URL
tables, typed product records and log analytics come out as DataFrames.
"""

__version__ = "0.1.0"
