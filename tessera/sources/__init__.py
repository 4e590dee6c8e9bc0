from tessera.sources.catalog import Catalog, TableInfo
from tessera.sources.index import KeyIndex

__all__ = ["Catalog", "KeyIndex", "TableInfo"]
