"""The data model: a property graph in two DataFrames, and its fixed vocabularies."""

from __future__ import annotations

NODES = (
    "id string, kind string, name string, path string, lang string, signature string, start_line int, end_line int, "
    "metadata map<string,string>, tags array<string>, updated_at timestamp"
)
EDGES = (
    "id string, type string, src string, dst string, evidence array<struct<file:string,line:int,snippet:string>>, "
    "sources array<string>, confidence double, conflict boolean, metadata map<string,string>, updated_at timestamp"
)
# Edge types and node kinds by role.
STRUCTURAL = ("CALLS", "IMPORTS", "DEPENDS_ON", "CONSUMES", "EXPOSES")
RELATIONAL = ("CALLS", "IMPORTS", "EXPOSES", "CONSUMES", "READS", "WRITES", "PUBLISHES", "SUBSCRIBES", "TESTS", "DEPENDS_ON", "IMPLEMENTS", "DOCUMENTS", "USES_CONFIG")
UNSCORED = ("File", "Repo", "Doc", "External", "Interface", "Column", "ConfigKey")
SYMBOLS = ("Function", "Method", "Class", "Module")
TERMINALS = ("External", "Table", "Test")
FLOW_PRIORITY = ("EXPOSES", "CONSUMES", "CALLS", "WRITES", "PUBLISHES", "CONTAINS", "DEPENDS_ON", "DOCUMENTS", "TESTS")
AFFECTED_ORDER = ("Function", "Method", "Class", "Interface", "API", "Table", "Service", "Event", "External", "Test", "File", "Module", "Package")
VIEWS = {
    "height": (
        ("Function", "Method", "Class", "Interface", "Module", "Package", "API", "Route", "Table", "External", "Service", "Repo", "Event", "Job", "Contract", "Test", "Infra", "Doc"),
        ("DEPENDS_ON", "EXPOSES", "CONSUMES", "READS", "WRITES", "PUBLISHES", "SUBSCRIBES", "CONTAINS"),
    ),
    "call": (("Function", "Method", "Class"), ("CALLS", "IMPLEMENTS")),
    "api": (("API", "Route", "Service", "External", "Contract"), ("EXPOSES", "CONSUMES", "DEPENDS_ON")),
    "db": (("Table", "Column", "Function", "Method", "Job"), ("READS", "WRITES", "CONTAINS")),
    "depth": (("Service", "Package", "Class", "Interface", "Function", "Method", "API", "Table", "Test", "Event"), None),
}
