"""hearthline: decision analytics on time-versioned evidence, as Spark DataFrame operators."""

from hearthline.session import configure

__all__ = ["configure"]
