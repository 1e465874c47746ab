from touchline.sources.catalog import Catalog

__all__ = ["Catalog"]
