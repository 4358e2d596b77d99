from .tables import TABLES, read_table, shipments, supplier_chain_edges
from .sinks import write_table, write_report

__all__ = ["TABLES", "read_table", "shipments", "supplier_chain_edges",
           "write_table", "write_report"]
