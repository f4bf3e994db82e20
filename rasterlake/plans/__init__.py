"""Registered queries: importing the modules fills the registry."""

from rasterlake.plans import cases, drawings, figures, labels, layers, loops, sequences, shapes, streams, tables, texts
from rasterlake.plans.common import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "cases", "drawings", "figures", "labels", "layers", "loops", "sequences", "shapes", "streams", "tables", "texts"]
