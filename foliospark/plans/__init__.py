"""Named queries over the driver's tables and the same queries in SQL.

The driver's tables hold no scanned documents, so each operator runs on a table of the same
shape: a page's text is a document's text, zones are line items, pixels are vector components.
"""

from foliospark.plans import codecs, layout, raster, structure, text

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (text, layout, structure, raster, codecs):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
