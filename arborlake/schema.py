"""Table schemas. Snapshots may carry further ``sum_<column>_<value>`` columns and ``mtime_mean``."""

from __future__ import annotations

from pyspark.sql import types as T

from .sources.listings import LAYER1

_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "date": T.DateType(), "ints": T.ArrayType(T.IntegerType())}


def _table(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (c.split() for c in text.split(","))])



#: One row per object.
LISTING = LAYER1
#: One row per file or directory, directories with sums over all that is below them.
SNAPSHOT = _table("path string, size long, mtime long, n_desc long, n_files long, n_children long, kind string, parent string, uri string, depth int")
#: One row per snapshot taken.
REGISTRY = _table("id long, path string, time timestamp, blob string, error_count int, error_paths string, size long, n_children long, n_desc long, mtime long")
#: One row per request.
ACCESS = _table("ts timestamp, store string, bucket string, path string, op string, op_raw string, status int, bytes_out long, bytes_in long, requester string, user_agent string, request_id string")
#: One row per path, day and verb.
ACCESS_TREE = _table("bucket string, path string, parent string, depth int, kind string, day date, op string, n_ops long, bytes_out long, bytes_in long, n_requesters long, last_ts timestamp")
#: One row per name of a snapshot.
VOCABULARY = _table("name string, n_dirs long, n_files long, row_groups ints")
