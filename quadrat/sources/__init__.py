"""Table schemas, readers and writers, and survey roles over the driver tables."""

from .catalog import find_table, read_csv, read_table, write_table
from .roles import DriverRoles
from .schemas import SCHEMAS

__all__ = ["find_table", "read_csv", "read_table", "write_table", "DriverRoles", "SCHEMAS"]
