"""DuckDB SQL for the queries that SQL can express."""

from voxweave.llm import licenses

SQL: dict[str, str] = {"op9_license_scan": licenses.oracle()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
