import datetime as dt
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from ordersight.session import local_session  # noqa: E402
from ordersight.sources.orders import RAW_SCHEMA  # noqa: E402

BASE = {
    "orderDate": dt.date(2020, 3, 2), "productId": 1, "sellerId": 7, "productTitle": "lamp",
    "productGroup": "Lighting", "quantityOrdered": 1.0, "totalPrice": 10.0, "fulfilmentType": "FBB",
    "countryCode": "NL", "countryOriginSeller": "DE", "transporterCode": "TNT",
    "registrationDateSeller": dt.date(2019, 1, 1), "promisedDeliveryDate": dt.date(2020, 12, 31),
    "shipmentDate": dt.date(2020, 12, 31), "onTimeDelivery": True, "noCancellation": True, "noReturn": True,
    "noCase": True, "hasOneCase": False, "hasMoreCases": False, "calculationDefinitive": True,
    "generalMatchClassification": "KNOWN HAPPY", "detailedMatchClassification": "KNOWN HAPPY",
}


@pytest.fixture(scope="session")
def spark():
    session = local_session("4", "tests", "8g")
    session.conf.set("spark.sql.shuffle.partitions", "4")
    yield session
    session.stop()


@pytest.fixture
def raw(spark):
    """Raw order lines from dicts that differ from a harmless line."""
    def build(*lines):
        rows = []
        for i, line in enumerate(lines):
            full = {"orderLineId": f"o{i:04d}", **BASE, **line}
            rows.append(tuple(full.get(f.name) for f in RAW_SCHEMA))
        return spark.createDataFrame(rows, RAW_SCHEMA)
    return build
