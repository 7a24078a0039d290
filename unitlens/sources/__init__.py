from unitlens.sources.marts import forget_versions, publish, read_mart
from unitlens.sources.readers import normalise_ads, read_ads, read_orders, read_product_events
from unitlens.sources.schemas import MARKETING_ADS_RAW, ORDERS, PRODUCT_EVENTS
from unitlens.sources.sinks import write_mart
from unitlens.sources.tables import Tables
from unitlens.sources.workspace import work_folder

__all__ = [
    "MARKETING_ADS_RAW",
    "ORDERS",
    "PRODUCT_EVENTS",
    "Tables",
    "forget_versions",
    "normalise_ads",
    "publish",
    "read_ads",
    "read_mart",
    "read_orders",
    "read_product_events",
    "work_folder",
    "write_mart",
]
