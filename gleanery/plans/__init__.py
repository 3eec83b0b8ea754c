"""Queries over the provided tables, each with its SQL twin."""

from . import catalogue, depth, governance, retrieval, scalars, serving, shapes, snapshots  # noqa: F401
from .registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
