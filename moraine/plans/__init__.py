"""Queries over the driver's tables, one or more for each operator; importing this registers them all."""

from moraine.plans import events, judge, knowledge, layout, pages, retrieval, tables, texts, vectors

__all__ = ["events", "judge", "knowledge", "layout", "pages", "retrieval", "tables", "texts", "vectors"]
