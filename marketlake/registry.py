"""All registered queries of the library and the SQL that checks them, gathered from the query modules."""

from __future__ import annotations

from marketlake.queries import checks, keyed, lifecycle, market, more, portfolio, stores, text
from marketlake.queries.base import Query

QUERIES: dict[str, Query] = market.QUERIES | portfolio.QUERIES | stores.QUERIES | text.QUERIES | more.QUERIES | lifecycle.QUERIES | keyed.QUERIES
ORACLE: dict[str, str] = market.ORACLE | portfolio.ORACLE | stores.ORACLE | text.ORACLE | more.ORACLE | checks.ORACLE | lifecycle.ORACLE | keyed.ORACLE
