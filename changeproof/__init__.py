"""changeproof: prove what a data change did, over many windows in one Spark job."""

from changeproof.schema import WINDOW

__all__ = ["WINDOW"]
