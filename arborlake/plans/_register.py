"""A decorator that puts a query and its SQL into a module's table."""

from __future__ import annotations


def registrar(table: dict):
    def query(sql: str | None = None):
        def add(f):
            table[f.__name__] = (f, sql)
            return f

        return add

    return query
