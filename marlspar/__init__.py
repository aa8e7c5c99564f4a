"""A query engine for Parquet tables on Spark: Mongo-style filters, row ranges, ordered slices and footer introspection."""

from importlib import import_module

#: Public name -> module; loaded on first use, so that Python workers that need one module load no more.
_WHERE = {
    name: module
    for module, names in {
        "errors": "ColumnNotFound FormatError QueryError",
        "functions.values": "equals flatten snappy_uncompress to_json",
        "operators.filters": "compile_filter filter_columns filter_paths",
        "operators.query": "cached count_rows query read read_column read_objects read_rows",
        "plans.rowgroups": "plan_groups",
        "plans.schema": "physical_columns schema_path schema_tree",
        "sources.footer": "bloom_might_contain footer_frame page_index read_footer",
        "sources.ranges": "CachedSource FileSource MemorySource UrlSource url_size",
        "sources.table": "ParquetTable",
        "streaming.chunks": "for_chunks iter_chunks iter_leaves stream",
    }.items()
    for name in names.split()
}

__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name not in _WHERE:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(f".{_WHERE[name]}", __name__), name)
