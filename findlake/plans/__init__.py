"""All registered queries; importing a module registers its plans."""

from importlib import import_module

from findlake.plans.registry import QUERIES, SQL

MODULES = ("text_queries", "ledger_queries", "graph_queries", "module_queries", "report_queries", "fact_queries", "stream_queries", "pipeline_queries", "import_queries", "detail_queries")


def _load() -> None:
    for module in MODULES:
        import_module(f"findlake.plans.{module}")


def all_queries():
    _load()
    return dict(QUERIES)


def all_sql():
    _load()
    return dict(SQL)
