"""stockspark: stock, sales, staff and budget analytics as Spark DataFrame operators."""

from . import schemas
from .operators import changes, listings, quality, reports

__all__ = ["changes", "listings", "quality", "reports", "schemas"]
